"""Text formats of sequences, models, kernels, scores and intervals, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tab(spark: SparkSession, path: str) -> DataFrame:
    """name, label, seq."""
    return spark.read.csv(path, sep="\t", schema="seq_id string, label string, seq string", quote="")


def write_tab(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws("\t", F.col("seq_id").cast("string"), F.col("label").cast("string"), "seq").alias("value")).write.text(path)


def literal(spark: SparkSession, **seqs: str) -> DataFrame:
    return spark.createDataFrame(list(seqs.items()), "seq_id string, seq string")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The first word of each line that has one."""
    return spark.read.text(path).select(F.regexp_extract("value", "^\\s*(\\S+)", 1).alias("seq_id")).where("seq_id <> ''")


def read_alphas(spark: SparkSession, path: str) -> DataFrame:
    """seq_id TAB weight."""
    return spark.read.csv(path, sep="\t", schema="seq_id string, alpha double", quote="")


def write_alphas(df: DataFrame, path: str) -> None:
    df.select(F.format_string("%s\t%11.6e", F.col("seq_id").cast("string"), F.col("alpha")).alias("value")).write.text(path)


def read_alphabet(spark: SparkSession, path: str, most: int = 4) -> str:
    """One letter a line; more than `most` letters are an error."""
    letters = [r[0].strip()[:1].upper() for r in spark.read.text(path).limit(most + 64).collect() if r[0].strip()]
    if len(letters) > most:
        raise ValueError(f"an alphabet has at most {most} letters")
    return "".join(letters)


def write_kernel_text(kernel: DataFrame, path: str) -> None:
    """Row i of the lower triangle: i+1 tab-ended numbers, the diagonal 1.0; absent pairs are 0. i, j are ordinals from 0."""
    e = F.when(F.col("i") == F.col("j"), "1.0").otherwise(F.format_string("%e", F.col("k")))
    cells = kernel.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct(F.col("j").cast("bigint"), e))).alias("m"))
    zero = F.format_string("%e", F.lit(0.0))
    line = F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("i").cast("bigint")), lambda j: F.coalesce(F.element_at("m", j), zero)), "\t")
    cells.select("i", F.concat(line, F.lit("\t")).alias("value")).repartitionByRange("i").sortWithinPartitions("i").select("value").write.text(path)


def read_kernel_text(spark: SparkSession, path: str) -> DataFrame:
    """Both triangles of a lower-triangular text kernel: row i is the line with i+1 numbers."""
    cells = F.filter(F.split("value", "\\s+"), lambda x: x != "")
    rows = spark.read.text(path).select(cells.alias("c")).where(F.size("c") > 0)
    k = rows.select((F.size("c") - 1).cast("bigint").alias("i"), F.posexplode("c").alias("j", "k")).select("i", F.col("j").cast("bigint").alias("j"), F.col("k").cast("double").alias("k"))
    return k.unionByName(k.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "k"))


def write_scores(df: DataFrame, path: str) -> None:
    df.select(F.format_string("%s\t%f", F.col("seq_id").cast("string"), F.col("score")).alias("value")).write.text(path)


def write_delta(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws(" ", F.col("seq_id").cast("string"), F.col("delta").cast("string")).alias("value")).write.text(path)


def write_cv_predictions(df: DataFrame, path: str) -> None:
    """id, mean with 5 decimals, label -1 or 1, fold from 0."""
    df.select(F.concat_ws("\t", F.col("seq_id").cast("string"), F.format_string("%.5f", F.col("cvpred_mean")), F.when(F.col("label") > 0, "1").otherwise("-1"), (F.col("cv_set") - 1).cast("string")).alias("value")).write.text(path)


def write_auc_table(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in ("idx", "c", "auroc", "auprc"))).alias("value")).write.text(path)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start (1-based), end, strand ('*' where absent)."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where("value <> '' and not value rlike '^(#|track|browser)'")
    return rows.select(f[0].alias("chrom"), (f[1].cast("bigint") + 1).alias("start"), f[2].cast("bigint").alias("end"), F.coalesce(F.get(f, F.lit(5)), F.lit("*")).alias("strand"))


def write_bed(df: DataFrame, path: str, zero_based: bool = True) -> None:
    """chrom, start, end; zero_based off leaves the 1-based start as it is."""
    start = F.col("start") - (1 if zero_based else 0)
    df.select(F.concat_ws("\t", "chrom", start.cast("string"), F.col("end").cast("string")).alias("value")).write.text(path)
