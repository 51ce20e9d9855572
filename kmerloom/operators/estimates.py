"""Estimates of word frequencies from gapped counts, and log ratios of them."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.functions import sequences as S
from kmerloom.functions.weights import choose, ml_weights

from . import words


def mismatch_counts(wanted: DataFrame, counts: DataFrame, L: int, K: int) -> DataFrame:
    """u, m, total: for a word, the counts of gapped words (f, n) by letters that differ at the fixed places, over all masks.

    Distinct gapped words of the wanted side, at most 4^K a mask, are spread to
    all of their mask by distance and meet the counts in an equi-join on (mask,
    letters); the sums go back to the words. Letters are packed numbers.
    """
    open_places = F.translate("f", "ACGT", "xxxx")
    packed = S.pack(F.translate("f", ".", "A"))
    c = counts.select(open_places.alias("mask"), packed.alias("f"), "n")
    w = words.gapped_words(wanted.select("u").distinct(), L, K).select("u", open_places.alias("mask"), packed.alias("g"))
    near = F.create_map(*(x for places in words.masks(L, K) for x in (F.lit("".join("x" if i in places else "." for i in range(L))), _patterns(places, L))))
    spread = w.select("mask", "g").distinct().select("mask", "g", F.explode(F.element_at(near, F.col("mask"))).alias("e"))
    spread = spread.select("mask", "g", F.col("e.m").alias("m"), F.col("g").bitwiseXOR(F.col("e.x")).alias("f"))
    sums = spread.join(c, ["mask", "f"]).groupBy("mask", "g", "m").agg(F.sum("n").alias("total"))
    return w.join(sums, ["mask", "g"]).groupBy("u", "m").agg(F.sum("total").alias("total"))


def _patterns(places: tuple[int, ...], L: int) -> Column:
    """(distance, xor pattern) of all letters at the fixed places."""
    out = [(0, 0)]
    for i in places:
        out = [(m + (v > 0), x | v << (2 * (L - 1 - i))) for m, x in out for v in range(4)]
    return F.array(*(F.struct(F.lit(m).alias("m"), F.lit(x).cast("bigint").alias("x")) for m, x in out))


def ml_estimate(wanted: DataFrame, counts: DataFrame, L: int, K: int, b: int = 4) -> DataFrame:
    """u, estimate: the minimum-norm estimate of the word's count, from the gapped counts by distance."""
    wm = ml_weights(L, K, b)
    per = F.array(*(F.coalesce(F.sum(F.when(F.col("m") == m, F.col("total"))), F.lit(0)) for m in range(K + 1)))
    value = F.lit(0.0)
    for m, w in enumerate(wm):
        value = value + F.col("c")[m] * F.lit(w)
    return mismatch_counts(wanted, counts, L, K).groupBy("u").agg(per.alias("c")).select("u", value.alias("estimate"))


def log_counts(counts: DataFrame, L: int, K: int, b: int = 4) -> DataFrame:
    """f, n: log(1+n) less its mean over all C(L,K) b^K cells, absent ones too."""
    cells = choose(L, K) * float(b) ** K
    mean = counts.agg(F.sum(F.log1p("n")) / cells).first()[0] or 0.0
    return counts.select("f", (F.log1p("n") - F.lit(mean)).alias("n"))


def log_estimate(wanted: DataFrame, counts: DataFrame, L: int, K: int, b: int = 4) -> DataFrame:
    """u, estimate: the minimum-norm estimate on the centred log counts."""
    return ml_estimate(wanted, log_counts(counts, L, K, b), L, K, b)


def table_moments(counts: DataFrame, L: int, K: int, b: int = 4) -> DataFrame:
    """mean, variance of the counts over all cells, absent ones counting 0."""
    cells = F.lit(choose(L, K) * float(b) ** K)
    return counts.agg((F.sum("n") / cells).alias("mean"), (F.sum(F.col("n") * F.col("n")) / cells - F.pow(F.sum("n") / cells, 2)).alias("variance"))


#: Weights no larger than this don't count; n0 is this share of the smallest that does, or of 1.
LEAST_WEIGHT, SHARE = 1e-90, 0.5


def log10_ratio(u: Column, v: Column, weights: list[float]) -> Column:
    """log10 of (u + n0) / (v + n0), negative counts as 0; n0 is half the smallest weight that counts (at most 1/2)."""
    n0 = SHARE * min([1.0, *(abs(w) for w in weights if abs(w) > LEAST_WEIGHT)])
    kept = lambda c: F.greatest(c, F.lit(0.0)) + n0
    return F.log10(kept(u) / kept(v))


def map_log_ratio(u: Column, v: Column, s2n: float, s2r: float, mean: float = 0.0, points: int = 5000) -> Column:
    """The likeliest r = log(u / v) of the values from -4 in steps of 8 / points, given counts with noise.

    r has a normal prior (mean, s2r); u - e^r v is normal with variance
    s2n (1 + e^2r). The least negative log posterior wins, the first on ties.
    """

    def posterior(i: Column) -> Column:
        r = -4 + i * (8 / points)
        spread = 1 + F.exp(2 * r)
        misfit = u - F.exp(r) * v
        return F.struct(((r - mean) * (r - mean) / s2r + misfit * misfit / (s2n * spread) + F.log(spread)).alias("loss"), r.alias("r"))

    return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), posterior))["r"]


def basis_counts(bags: DataFrame, L: int, K: int) -> DataFrame:
    """p, v, n: coefficients of the word counts on the orthogonal basis of functions of at most K places.

    Words are digits 0..3. At each place of a set of at most K places the
    basis has three functions j = 1..3: 1 on letters below j, -j on letter j,
    0 above. p lists the places, v the functions; n sums the products.
    """
    rows = bags.select("n", F.explode(_terms(L, K)).alias("t")).where("t.x <> 0")
    return rows.groupBy("t.p", "t.v").agg(F.sum(F.col("n") * F.col("t.x")).alias("n"))


def _terms(L: int, K: int) -> Column:
    """The values of all basis functions at the word u."""

    def at_place(terms: Column, i: int) -> Column:
        d = F.translate(F.substring("u", i + 1, 1), "ACGT", "0123").cast("int")
        step = {j: F.when(d < j, 1).when(d == j, -j).otherwise(0) for j in (1, 2, 3)}
        return F.flatten(F.transform(terms, lambda t: F.array(*(F.struct(t["p"].alias("p"), F.concat(t["v"], F.lit(str(j))).alias("v"), (t["x"] * step[j]).alias("x")) for j in (1, 2, 3)))))

    out = []
    for size in range(K + 1):
        for places in combinations(range(L), size):
            terms = F.array(F.struct(F.lit(",".join(map(str, places))).alias("p"), F.lit("").alias("v"), F.lit(1).alias("x")))
            for i in places:
                terms = at_place(terms, i)
            out.append(terms)
    return F.concat(*out)


def normalised_basis(coefficients: DataFrame, L: int) -> DataFrame:
    """p, v, n divided by the squared norm of the basis function over words of L places."""
    own = F.aggregate(F.split("v", ""), F.lit(1.0), lambda s, j: s * F.when(j == "", 1.0).otherwise(j.cast("double") * (j.cast("double") + 1)))
    return coefficients.withColumn("n", F.col("n") / (own * F.pow(F.lit(4.0), L - F.length("v"))))


def basis_estimate(wanted: DataFrame, coefficients: DataFrame, L: int, K: int) -> DataFrame:
    """u, estimate: a word's count as the basis functions of at most K places give it (exact for K = L)."""
    each = wanted.select("u").distinct().select("u", F.lit(1).alias("n"))
    terms = each.select("u", F.explode(_terms(L, K)).alias("t")).where("t.x <> 0").select("u", "t.p", "t.v", "t.x")
    j = terms.join(normalised_basis(coefficients, L), ["p", "v"])
    return j.groupBy("u").agg(F.sum(F.col("x") * F.col("n")).alias("estimate"))


def basis_norm(p: str, v: str, K: int) -> float:
    """The squared norm of a basis function over words of K places (4 per open place)."""
    out = 4.0 ** (K - len(v))
    for j in map(int, v):
        out *= j * (j + 1)
    return out
