"""Mixing sources to target weights by capped water-filling (DataFrame operations only).

Every source gets weight-proportional words until it would pass its cap (a
number of epochs of its own words); what is over goes to the others by weight,
until none is above its cap. Of a source that should give r times its words,
each document is taken floor(r) times, and a seeded fraction once more: the
documents in the order of md5(seed, id) until the remaining words are reached,
the document across the border when its middle lies before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, running_sum, saved

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = "mix-1:"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def water_levels(sources: DataFrame, epochs: int, share: float) -> DataFrame:
    """sources(source, weight, source_size) -> with target.

    Each round asks for three sums over the small table of sources and clamps
    those that the common level puts above their caps; a round that clamps none
    ends it. The clamped stay clamped, as the level only rises.
    """
    cap = F.col("source_size") * epochs
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    want = total * share if share != 1 else total
    level = 0.0
    while True:
        above = F.col("weight") * F.lit(level) >= cap
        row = sources.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0)).alias("full"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("free"),
        ).first()
        if not row["free"] or (new := (want - row["full"]) / row["free"]) <= level:
            break
        level = new
    return sources.withColumn("target", F.least((F.col("weight") * F.lit(float(level))), cap.cast("double")))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, share: float = 1.0, seed: str = SEED, carry: str | None = None) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, source, size, source_size, target, copies, taken.

    Sources in code point order, null last, weigh `weights`, repeating. A null
    text has size 0; a document of size 0 takes 0 words and, as all others of
    its source, `copies` copies. Repeated rows count and are taken one by one;
    rows equal in id, source and size are interchangeable. No rows: no rows.
    Extra columns are left out, but for `carry`, which comes along as _carry.
    The table of sources has one row per distinct source and is joined, not
    collected; only three sums of it reach the driver.
    """
    more = [] if carry is None else [docs[carry].alias("_carry")]
    sized = saved(docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["source"].cast("string").alias("source"), word_count(docs["text"]).alias("size"), *more))
    # sources are ranked within ranges of them, whose sizes give the ranks before
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = saved(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_range", F.spark_partition_id()).withColumn("_one", F.lit(1)))
    sources = running_sum(sources.withColumn("_all", F.lit(0)), ["_all"], ["source"], "_one", "_rank", F.col("_range"), 0, nulls_last=True)
    rank = F.col("_rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    sources = saved(sources.select("source", "source_size", weight.cast("bigint").alias("weight")))
    plan = water_levels(sources, epochs, share)
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("whole", F.floor(times)).withColumn("part_words", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = plan.select(F.col("source").alias("_source"), "source_size", "target", "whole", "part_words")
    order = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    # two hex digits more for every 256 times a million rows: a salt of one source holds some thousands of rows
    digits = 2 if sized.count() < 1 << 24 else 4
    salt = F.conv(F.substring("_order", 1, digits), 16, 10).cast("int")
    d = running_sum(sized.withColumn("_order", order), ["source"], ["_order", "size"], "size", "_before", salt, 16**digits)
    d = d.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    once_more = F.col("_before") + F.col("size") / 2 < F.col("part_words")
    copies = (F.col("whole") + F.when(once_more & (F.col("whole") < epochs), 1).otherwise(0)).cast("bigint")
    return d.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["_carry"] if carry else []))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: each row as often as mix_sources takes it, with the columns of docs, whatever their names.

    Where ids repeat, rows get numbers of their own first, so that each of them
    is taken as planned. Null texts, ids and sources take part; an empty table
    stays empty.
    """
    times = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        chosen = mix_sources(docs, **options).where("copies > 0").select(F.col("doc_id").alias("_d"), F.col("copies").alias("_copies"))
        d = docs.select(docs["doc_id"].cast("bigint").alias("_key"), F.struct(*(docs[c] for c in docs.columns)).alias("_row"))
        taken = d.join(chosen, F.col("_key").eqNullSafe(F.col("_d")))
    else:
        d = saved(docs.select(F.monotonically_increasing_id().alias("_key"), F.struct(*(docs[c] for c in docs.columns)).alias("_row")))
        chosen = mix_sources(d.select("_key", "_row.doc_id", "_row.text", "_row.source"), carry="_key", **options).where("copies > 0")
        taken = d.join(chosen.select(F.col("_carry").alias("_key"), F.col("copies").alias("_copies")), "_key")
    return taken.select("_row", times).select("_row.*")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    r = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return r.select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s AS (SELECT source, source_size, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS BIGINT) AS weight FROM s0),
step(n, level, done) AS (
  SELECT 0, CAST(0 AS DOUBLE), false
  UNION ALL
  SELECT n + 1, greatest(new, level), new <= level FROM (
    SELECT st.n, st.level,
      (SELECT CAST(sum(source_size) AS DOUBLE) - coalesce(sum(source_size * 3) FILTER (weight * st.level >= source_size * 3), 0) FROM s)
      / nullif((SELECT coalesce(sum(weight) FILTER (weight * st.level < source_size * 3), 0) FROM s), 0) AS new
    FROM step st WHERE NOT st.done) WHERE new IS NOT NULL),
lv AS (SELECT max(level) AS level FROM step),
t AS (SELECT source, source_size, least(CAST(weight AS DOUBLE) * level, CAST(source_size * 3 AS DOUBLE)) AS target FROM s, lv),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
c AS (SELECT d.*, p.source_size, p.target, p.whole, target - whole * source_size AS part_words,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN CAST(before AS DOUBLE) + size / 2.0 < part_words AND whole < 3 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
