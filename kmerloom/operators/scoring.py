"""Scoring sequences with a kernel model: alphas on support sequences.

The model is folded into one weight per word; the weights are spread to the
words around (a table bounded by the model), and a sequence's score is one
equi-join of its words. Nothing is compared pairwise with the support sequences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.functions import sequences as S
from kmerloom.functions.weights import Params

from . import kernels, profiles, words


def norms(bags: DataFrame, params: Params, key: str = "seq_id", all_distances: bool = True) -> DataFrame:
    """key, norm: the root of the weighted self profile over all distances (or up to the maximum).

    Distances beyond the last weight other than 0 add nothing, so no word is
    spread to their masks.
    """
    d = params.reach if all_distances else min(params.max_distance, params.reach)
    p = profiles.self_profile(bags, params.L, d, key)
    value = kernels.weighted(F.col("c"), params.weights()[: d + 1])
    return p.groupBy(key).agg(kernels.by_distance(d).alias("c")).select(key, F.sqrt(value).alias("norm"))


def _bags(seqs: DataFrame, params: Params) -> DataFrame:
    clean = words.clean_sequences(seqs, alphabet=params.alphabet)
    return words.packed_bag(clean, params.L, both_strands=params.both_strands, alphabet=params.alphabet)


def support(alphas: DataFrame, seqs: DataFrame) -> DataFrame:
    """Sequences with their weights, matched by id; an id may have several weights."""
    return seqs.join(alphas.select("seq_id", "alpha"), "seq_id")


def fold_model(alphas: DataFrame, seqs: DataFrame, params: Params, consistent_norm: bool = False) -> DataFrame:
    """u, w: the sum over support sequences of alpha / norm times the word's count."""
    bags = _bags(seqs, params)
    weight = support(alphas, seqs.select("seq_id").distinct()).groupBy("seq_id").agg(F.sum("alpha").alias("alpha"))
    n = norms(bags, params, all_distances=params.b == 4 and not consistent_norm)
    return bags.join(weight, "seq_id").join(n, "seq_id").groupBy("u").agg(F.sum(F.col("n") * F.col("alpha") / F.col("norm")).alias("w"))


def word_scores(model: DataFrame, params: Params) -> DataFrame:
    """u, score: what one occurrence of a word adds to the unnormalised score, for all words near the model."""
    near = profiles.neighbourhood(model, params.L, min(params.max_distance, params.reach), [], "w", params.b)
    return near.groupBy("u").agg(F.sum(F.col("w") * kernels.weight_of(F.col("m"), params.weights())).alias("score"))


def classify(seqs: DataFrame, model: DataFrame, params: Params, consistent_norm: bool = False) -> DataFrame:
    """seq_id, score without bias; null for a sequence without a word. Rows of one id merge.

    The denominator's norm runs over all distances while the numerator stops at
    the maximum, as in the published scores; consistent_norm stops both.
    """
    return classify_with(seqs, word_scores(model, params), params, consistent_norm)


def classify_with(seqs: DataFrame, table: DataFrame, params: Params, consistent_norm: bool = False) -> DataFrame:
    """As classify, with the model's word scores (u, score) at hand."""
    bags = _bags(seqs, params)
    raw = bags.join(table, "u").groupBy("seq_id").agg(F.sum(F.col("n") * F.col("score")).alias("raw"))
    n = norms(bags, params, all_distances=params.b == 4 and not consistent_norm)
    ids = seqs.select("seq_id").distinct()
    out = ids.join(n, "seq_id", "left").join(raw, "seq_id", "left")
    return out.select("seq_id", F.when(F.col("norm") > 0, F.coalesce("raw", F.lit(0.0)) / F.col("norm")).alias("score"))


def delta(ref: DataFrame, alt: DataFrame, model: DataFrame, params: Params, on: str = "seq_id") -> DataFrame:
    """on, ref_score, alt_score, delta = alt - ref; pairs meet by an id or an ordinal, not by row order."""
    a = classify(ref.withColumn("seq_id", F.col(on)), model, params).select(F.col("seq_id").alias(on), F.col("score").alias("ref_score"))
    b = classify(alt.withColumn("seq_id", F.col(on)), model, params).select(F.col("seq_id").alias(on), F.col("score").alias("alt_score"))
    return a.join(b, on).withColumn("delta", F.col("alt_score") - F.col("ref_score"))


def score_all_words(model: DataFrame, params: Params) -> DataFrame:
    """Every one of the b^L words (packed) with its score, 0 where the model is far."""
    every = model.sparkSession.range(params.b**params.L).select(S.nth_word(F.col("id"), params.b).alias("u"))
    return every.join(word_scores(model, params), "u", "left").fillna(0.0, ["score"])


def score_word(bags: DataFrame, word: Column, params: Params, d: int | None = None) -> DataFrame:
    """seq_id, score: the weighted matches of one packed word with each bag, at all distances or up to d."""
    p = profiles.word_profile(bags, word, params.L, d)
    return p.groupBy("seq_id").agg(kernels.by_distance(params.L).alias("c")).select("seq_id", kernels.weighted(F.col("c"), params.weights()).alias("score"))


def kernel_scores(cross_kernel: DataFrame, alphas: DataFrame) -> DataFrame:
    """From kernel rows (i test, j support, k): i, score = sum alpha_j k_ij."""
    return cross_kernel.join(alphas.select(F.col("seq_id").alias("j"), "alpha"), "j").groupBy("i").agg(F.sum(F.col("alpha") * F.col("k")).alias("score"))
