"""FASTA, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kmerloom.plans.ranks import by_quantile, running_sums


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """seq_id (first word of the header), header, seq. Lines from ';' are comments; CRLF and a last line without end are read; an empty header is "NA".

    Records are split by the reader at the header mark, so a large file is read
    by many tasks.
    """
    body = F.regexp_replace(F.col("value"), "\r", "")
    lines = F.split(body, "\n")
    # only the first record of a file still has its mark
    d = spark.read.option("lineSep", "\n>").text(path).select(lines.alias("lines"))
    marked = F.element_at("lines", 1).startswith(">")
    d = d.select(F.when(marked, F.substring(F.element_at("lines", 1), 2, 1 << 30)).otherwise(F.element_at("lines", 1)).alias("header"), "lines")
    kept = F.filter(F.slice("lines", 2, 1 << 30), lambda x: ~x.startswith(";"))
    seq = F.regexp_replace(F.array_join(kept, ""), "\\s", "")
    d = d.select("header", seq.alias("seq"))
    word = F.regexp_extract("header", "^\\s*(\\S+)", 1)
    return d.where(F.length(F.trim(F.col("header"))) + F.length("seq") > 0).select(F.when(word == "", "NA").otherwise(word).alias("seq_id"), "header", "seq")


def write_fasta(df: DataFrame, path: str, width: int = 60) -> None:
    """Records of >seq_id TAB length (TAB label, where there is one) and lines of `width` letters."""
    label = F.concat(F.lit("\t"), F.col("label").cast("string")) if "label" in df.columns else F.lit("")
    wrapped = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    df.select(F.concat(F.lit(">"), F.col("seq_id").cast("string"), F.lit("\t"), F.length("seq").cast("string"), F.coalesce(label, F.lit("")), F.lit("\n"), wrapped).alias("value")).write.text(path)


def interval_names(df: DataFrame, suffix: str) -> DataFrame:
    """seq_id as chrom_start_end_suffix_n, n from 1 by the order of chrom, start and end."""
    chroms = by_quantile(df.withColumn("_all", F.lit(0)), "start", "_all")
    one = chroms.withColumn("_one", F.lit(1))
    # running numbers within a chromosome, and those of the chromosomes before it
    inner = running_sums(one, "_slot", [F.col("start"), F.col("end")], {"_n": "_one"}, ["chrom"])
    sizes = df.groupBy("chrom").count()
    before = F.coalesce(F.sum("count").over(W.orderBy("chrom").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("chrom").alias("_chrom"), before.alias("_before"))
    d = inner.join(sizes, F.col("chrom") == F.col("_chrom"))
    n = F.col("_n") + F.col("_before") + 1
    name = F.concat_ws("_", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), F.lit(suffix), n.cast("bigint").cast("string"))
    return d.withColumn("seq_id", name).select(*(c for c in df.columns if c != "seq_id"), "seq_id")
