"""The entry points of a sequence-classification run, over DataFrames.

Positive and negative sequences are DataFrames (seq_id, seq); ids are unique
over both.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.functions.weights import Params
from kmerloom.operators import background, intervals, kernels, metrics, scoring, svm, words
from kmerloom.plans.lineage import saved
from kmerloom.sources import fasta, tables


def labelled(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """seq_id, seq, label 1 or 0; an id that occurs twice, in one class or in both, is an error."""
    words.assert_unique_ids(positives, negatives)
    one = positives.select("seq_id", "seq", F.lit(1).alias("label"))
    return one.unionByName(negatives.select("seq_id", "seq", F.lit(0).alias("label")))


def kernel(positives: DataFrame, negatives: DataFrame, params: Params = Params(), plan: str = "auto", alg: int = 0) -> DataFrame:
    """i, j, k: the lower triangle of the normalised kernel of both classes.

    alg 1 counts all distances (and no pseudo-count), where the alphabet has 4
    letters; 0 and 2 stop at the maximal distance.
    """
    if alg not in (0, 1, 2):
        raise ValueError("alg is 0, 1 or 2")
    both = labelled(positives, negatives).select("seq_id", "seq")
    return kernels.kernel(both, params, plan, checked=False, all_distances=alg == 1 and params.b == 4)


def train(kernel_rows: DataFrame, labels: DataFrame, c: float = 1.0) -> DataFrame:
    """seq_id, alpha: the signed weights of the support sequences."""
    return svm.train(kernel_rows, labels, c)


def classify(seqs: DataFrame, alphas: DataFrame, support_seqs: DataFrame, params: Params = Params()) -> DataFrame:
    """seq_id, score."""
    return scoring.classify(seqs, scoring.fold_model(alphas, support_seqs, params), params)


def delta(ref: DataFrame, alt: DataFrame, alphas: DataFrame, support_seqs: DataFrame, params: Params = Params(), on: str = "seq_id") -> DataFrame:
    """on, ref_score, alt_score, delta."""
    return scoring.delta(ref, alt, scoring.fold_model(alphas, support_seqs, params), params, on)


@dataclass(frozen=True)
class CrossValidation:
    """What a cross-validation gives: all predictions, the table of settings, the best setting, its means per sequence, its ROC and PR points, and a model of all sequences at it."""

    predictions: DataFrame
    settings: DataFrame
    c: float
    means: DataFrame
    curves: DataFrame
    model: DataFrame

    def write(self, predictions: str | None = None, settings: str | None = None, alphas: str | None = None) -> None:
        """The text files asked for: per-sequence predictions, the settings, the model's weights."""
        if predictions:
            tables.write_cv_predictions(self.means, predictions)
        if settings:
            tables.write_auc_table(self.settings, settings)
        if alphas:
            tables.write_alphas(self.model, alphas)


def train_cv(kernel_rows: DataFrame, labels: DataFrame, settings: list[float], n_folds: int = 5, repeats: int = 1, folds: DataFrame | None = None) -> CrossValidation:
    """Cross-validation over the settings, and the final fit at the best of them."""
    kernel_rows = saved(kernel_rows)
    predictions, table, means = svm.cross_validate(kernel_rows, labels, settings, n_folds, repeats, folds)
    table = saved(table)
    c, model = svm.refit(kernel_rows, labels, table)
    best = predictions.where(F.col("c") == c)
    curves = metrics.curve(best.withColumn("fold", F.concat_ws(":", "r", "fold")))
    top = best.select("idx").distinct().limit(1)
    return CrossValidation(predictions, table, c, means.join(top, "idx", "left_semi"), curves, model)


def write_model(alphas: DataFrame, seqs: DataFrame, alpha_path: str, seq_path: str) -> None:
    """A model as two files: the weights of the support sequences, and the sequences."""
    tables.write_alphas(alphas, alpha_path)
    fasta.write_fasta(seqs.join(alphas.select("seq_id").distinct(), "seq_id", "left_semi").select("seq_id", "seq"), seq_path)


def read_model(spark: SparkSession, alpha_path: str, seq_path: str) -> tuple[DataFrame, DataFrame]:
    """alphas (seq_id, alpha) and sequences (seq_id, seq) of write_model."""
    return tables.read_alphas(spark, alpha_path), fasta.read_fasta(spark, seq_path).select("seq_id", "seq")


def null_sequences(positives: DataFrame, genome: DataFrame, masks: DataFrame, bed: str | None = None, negatives: str | None = None, matched: str | None = None, **options) -> DataFrame:
    """A matched random interval for each positive one.

    genome: (chrom, seq), or tiles (chrom, tile, seq). Writes, where paths are
    given, the intervals as BED, their sequences as FASTA named
    chrom_start_end_neg_n, and those of the positive intervals that have a match
    as chrom_start_end_pos_n.
    """
    found = saved(background.null_sequences(positives, genome, masks, **options))
    if bed:
        tables.write_bed(found, bed)
    if negatives:
        fasta.write_fasta(fasta.interval_names(found, "neg"), negatives)
    if matched:
        own = positives.join(found.select(F.col("target_id").alias("id")).distinct(), "id", "left_semi")
        fasta.write_fasta(fasta.interval_names(intervals.fetch(own, genome), "pos"), matched)
    return found
