"""Normalised pairwise kernels from mismatch profiles."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.functions.weights import Filter, Params
from kmerloom.plans.lineage import saved

from . import profiles, words

#: A side of the square of blocks that all pairs of a pseudo-count kernel are dealt to.
PAIR_BLOCKS = 32


def weight_of(m: Column, weights: list[float]) -> Column:
    return F.element_at(F.array(*map(F.lit, weights)), m.cast("int") + 1)


def weighted(counts: Column, weights: list[float]) -> Column:
    """The weighted sum of an array of whole counts by distance; weights last and in order: the same double whatever the partitioning."""
    value = F.lit(0.0)
    for m, w in enumerate(weights):
        value = value + counts[m] * F.lit(w)
    return value


def by_distance(d: int, count: str = "cnt") -> Column:
    """Aggregate: the counts of a profile as an array over 0..d."""
    return F.array(*(F.coalesce(F.sum(F.when(F.col("m") == m, F.col(count))), F.lit(0)) for m in range(d + 1)))


def inner_products(profile: DataFrame, params: Params, totals: DataFrame | None = None, d: int | None = None) -> DataFrame:
    """i, j, product: the weighted sum over distances, plus the pseudo-count terms where asked for (totals: seq_id, n_total)."""
    d = params.max_distance if d is None else d
    sums = profile.groupBy("i", "j").agg(by_distance(d).alias("c"))
    value = weighted(F.col("c"), params.weights()[: d + 1])
    if not params.pseudo_count:
        return sums.select("i", "j", value.alias("product"))
    factor, constant = params.pseudo_terms()
    # a pair without common words still has the pseudo-counts, so every pair is a result; pairs are dealt by blocks of ids
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(PAIR_BLOCKS)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(PAIR_BLOCKS - 1)))
    ti = totals.select(F.col("seq_id").alias("i"), F.col("n_total").alias("ti"), block("seq_id").alias("bi"), other.alias("bj"))
    tj = totals.select(F.col("seq_id").alias("j"), F.col("n_total").alias("tj"), block("seq_id").alias("bj"), other.alias("bi"))
    every = ti.join(tj, ["bi", "bj"]).where("i >= j")
    both = every.join(sums.select("i", "j", value.alias("v")), ["i", "j"], "left")
    return both.select("i", "j", (F.coalesce("v", F.lit(0.0)) + (F.col("ti") + F.col("tj")) * factor + constant).alias("product"))


def normalise(products: DataFrame) -> DataFrame:
    """i, j, k with k = product / sqrt(product_ii product_jj); 0 below 1e-50, 1 on the diagonal."""
    own = products.where("i = j")
    ni = own.select("i", F.sqrt("product").alias("norm_i"))
    nj = own.select("j", F.sqrt("product").alias("norm_j"))
    k = F.when(F.col("i") == F.col("j"), 1.0).when(F.col("product") < 1e-50, 0.0).otherwise(F.col("product") / (F.col("norm_i") * F.col("norm_j")))
    return products.join(ni, "i").join(nj, "j").select("i", "j", k.alias("k"))


def kernel(seqs: DataFrame, params: Params, plan: str = "auto", checked: bool = True, all_distances: bool = False) -> DataFrame:
    """seqs(seq_id, seq) -> i, j, k for j <= i. Pairs without a word pair within the distance are absent (0).

    Every sequence has its diagonal 1, a sequence shorter than L too. An id that
    occurs twice is an error, unless checked is off: then its sequences merge.
    all_distances ignores the maximal distance and the pseudo-count: every
    distance with a weight counts, as in the pairwise form of the published kernel.
    """
    if checked:
        words.assert_unique_ids(seqs)
    clean = words.clean_sequences(seqs, alphabet=params.alphabet)
    bags = words.packed_bag(clean, params.L, both_strands=params.both_strands, alphabet=params.alphabet)
    if all_distances:
        params = replace(params, pseudo_count=False, d=params.reach)
    totals = words.word_totals(bags) if params.pseudo_count else None
    if params.custom is None and params.filter == Filter.GAPPED and params.max_distance >= params.L - params.K and not params.pseudo_count:
        products = gapped_products(bags, params)
    else:
        d = min(params.max_distance, params.reach)
        products = inner_products(profiles.profile(bags, params.L, d, plan=plan, b=params.b), params, totals, d)
    # read for the rows, both norms and the sequences without words: computed once
    k = normalise(saved(products))
    ids = clean.select("seq_id").distinct()
    short = ids.join(k.where("i = j").select(F.col("i").alias("seq_id")), "seq_id", "left_anti")
    return k.unionByName(short.select(F.col("seq_id").alias("i"), F.col("seq_id").alias("j"), F.lit(1.0).alias("k")))


def gapped_products(bags: DataFrame, params: Params) -> DataFrame:
    """i, j, product as the dot product of gapped word counts: what the distance weights C(L-m, K) come to."""
    from itertools import combinations

    ms = [profiles._mask(params.L, p) for p in combinations(range(params.L), params.L - params.K)]
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(m).cast("bigint").alias("mask")) for k, m in enumerate(ms))))
    f = bags.select("seq_id", "u", "n", each.alias("e")).groupBy("seq_id", F.col("e.k").alias("k"), F.col("u").bitwiseAND(F.col("e.mask")).alias("f")).agg(F.sum("n").alias("n"))
    a = f.select(F.col("seq_id").alias("i"), "k", "f", F.col("n").alias("n_i"))
    b = f.select(F.col("seq_id").alias("j"), "k", "f", F.col("n").alias("n_j"))
    return a.join(b, ["k", "f"]).where("i >= j").groupBy("i", "j").agg(F.sum(F.col("n_i") * F.col("n_j")).cast("double").alias("product"))


def full_matrix(k: DataFrame) -> DataFrame:
    """Both triangles."""
    return k.unionByName(k.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "k"))
