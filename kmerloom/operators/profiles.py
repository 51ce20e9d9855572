"""Mismatch profiles: N_m(i, j), the pairs of words of i and j that differ in m letters.

Three exact plans, all equi-joins:

* neighbourhood: one side's words are spread to all words within d (xor with
  the patterns of at most d nonzero letters), summed per word, and joined by
  word. Best for short words or small d.
* gapped: both sides are spread to the words with g open places, g = 0..d.
  A pair at distance m agrees in C(L-m, L-g) of them, so the profile follows
  from the sums by substitution, in whole numbers. Best for long words.
* the same for a sequence with itself needs no join: squares of gapped counts.
"""

from __future__ import annotations

import math
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.functions import sequences as S


def _mask(L: int, open_places: tuple[int, ...]) -> int:
    m = (1 << (2 * L)) - 1
    for i in open_places:
        m &= ~(3 << (2 * (L - 1 - i)))
    return m


def patterns(L: int, d: int, b: int = 4) -> list[tuple[int, int]]:
    """(distance, xor pattern) of all words within d of any word. With 3 letters a pattern may lead to a fourth; neighbourhood() drops those."""
    step = (1,) if b == 2 else (1, 2, 3)
    return [(m, sum(v << (2 * (L - 1 - i)) for i, v in zip(places, values, strict=True))) for m in range(d + 1) for places in combinations(range(L), m) for values in product(step, repeat=m)]


def neighbourhood_size(L: int, d: int, b: int = 4) -> int:
    return sum(math.comb(L, m) * (b - 1) ** m for m in range(d + 1))


def gapped_size(L: int, d: int) -> int:
    return sum(math.comb(L, g) for g in range(d + 1))


def neighbourhood(bags: DataFrame, L: int, d: int, key: list[str], value: str = "n", b: int = 4) -> DataFrame:
    """key, u, m, value: sums over the words at distance m of u."""
    near = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(x).cast("bigint").alias("x")) for m, x in patterns(L, d, b)))
    spread = bags.select(*key, "u", value, F.explode(near).alias("e")).select(*key, F.col("u").bitwiseXOR(F.col("e.x")).alias("u"), F.col("e.m").alias("m"), value)
    if b == 3:  # no letter has both bits
        spread = spread.where(F.col("u").bitwiseAND(F.shiftright("u", 1)).bitwiseAND(F.lit(S.PAIR_MASK)) == 0)
    return spread.groupBy(*key, "u", "m").agg(F.sum(value).alias(value))


def _open_words(bags: DataFrame, L: int, d: int, key: str, out: str) -> DataFrame:
    ms = [(k, g, _mask(L, places)) for k, (g, places) in enumerate((g, p) for g in range(d + 1) for p in combinations(range(L), g))]
    each = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(g).alias("g"), F.lit(m).cast("bigint").alias("mask")) for k, g, m in ms))
    s = bags.select(key, "u", "n", F.explode(each).alias("e"))
    s = s.select(F.col(key).alias(out), F.col("e.k").alias("k"), F.col("e.g").alias("g"), F.col("u").bitwiseAND(F.col("e.mask")).alias("f"), "n")
    return s.groupBy(out, "k", "g", "f").agg(F.sum("n").alias("n"))


def _solve(sums: DataFrame, keys: list[str], L: int, d: int) -> DataFrame:
    """From G_g = sum over m <= g of C(L-m, L-g) N_m to rows (keys, m, cnt) with cnt > 0."""
    wide = sums.groupBy(*keys).agg(*(F.coalesce(F.sum(F.when(F.col("g") == g, F.col("s"))), F.lit(0)).alias(f"g{g}") for g in range(d + 1)))
    for g in range(d + 1):
        known = F.col(f"g{g}")
        for m in range(g):
            known = known - math.comb(L - m, L - g) * F.col(f"n{m}")
        wide = wide.withColumn(f"n{g}", known)
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.col(f"n{m}").cast("bigint").alias("cnt")) for m in range(d + 1))))
    return wide.select(*keys, rows.alias("x")).select(*keys, "x.m", "x.cnt").where("cnt > 0")


def profile(bags: DataFrame, L: int, d: int, key: str = "seq_id", other: DataFrame | None = None, plan: str = "auto", b: int = 4) -> DataFrame:
    """i, j, m, cnt for pairs with a word pair within d. Without `other`: pairs i >= j of the bags, itself included."""
    if plan == "auto":
        plan = "neighbourhood" if neighbourhood_size(L, d, b) <= 2 * gapped_size(L, d) ** 1.5 else "gapped"
    second = bags if other is None else other
    if plan == "neighbourhood":
        right = neighbourhood(second.withColumnRenamed(key, "j"), L, d, ["j"], b=b)
        left = bags.select(F.col(key).alias("i"), "u", F.col("n").alias("n_i"))
        j = left.join(right, "u")
        j = j if other is not None else j.where("i >= j")
        return j.groupBy("i", "j", "m").agg(F.sum(F.col("n") * F.col("n_i")).cast("bigint").alias("cnt"))
    one, two = _open_words(bags, L, d, key, "i"), _open_words(second, L, d, key, "j").withColumnRenamed("n", "n_j").drop("g")
    j = one.join(two, ["k", "f"])
    j = j if other is not None else j.where("i >= j")
    return _solve(j.groupBy("i", "j", "g").agg(F.sum(F.col("n") * F.col("n_j")).alias("s")), ["i", "j"], L, d)


def self_profile(bags: DataFrame, L: int, d: int, key: str = "seq_id") -> DataFrame:
    """key, m, cnt of each sequence with itself, linear in the words: no join."""
    squares = _open_words(bags, L, d, key, key).groupBy(key, "g").agg(F.sum(F.col("n") * F.col("n")).alias("s"))
    return _solve(squares, [key], L, d)


def word_profile(bags: DataFrame, word: Column, L: int, d: int | None = None, key: str = "seq_id") -> DataFrame:
    """key, m, cnt: one packed word against every bag, at all distances or up to d."""
    m = S.hamming(F.col("u"), word).cast("int")
    near = bags.select(key, m.alias("m"), "n").where(F.col("m") <= (L if d is None else d))
    return near.groupBy(key, "m").agg(F.sum("n").alias("cnt"))


def direct_profile(bags: DataFrame, L: int, d: int, key: str = "seq_id") -> DataFrame:
    """The definition: all word pairs of two sequences. Quadratic; for checks and tiny inputs."""
    a = bags.select(F.col(key).alias("i"), F.col("u").alias("u_i"), F.col("n").alias("n_i"))
    b = bags.select(F.col(key).alias("j"), F.col("u").alias("u_j"), F.col("n").alias("n_j"))
    j = a.join(b, F.col("i") >= F.col("j")).withColumn("m", S.hamming(F.col("u_i"), F.col("u_j"))).where(F.col("m") <= d)
    return j.groupBy("i", "j", "m").agg(F.sum(F.col("n_i") * F.col("n_j")).cast("bigint").alias("cnt"))
