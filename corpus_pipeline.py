"""From raw documents to packed training sequences, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is
written as Parquet and read again as the docs of the next. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kmerloom.llm import common, mixing, near_dups, packing, substrings, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled ones, scores below 0.5.

    Null and empty texts stay, repeated rows fare alike, an empty table stays
    empty, and extra columns may have any names.
    """
    return toxicity.without_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, by the smallest id; ties and repeated ids as without_near_duplicates says.

    Rows with a null id or without words stay, an empty table stays empty, and
    extra columns may have any names.
    """
    return near_dups.without_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 13 words or more that a document with a smaller id also has.

    Null texts stay null, a null id is larger than any other, repeated rows fare
    alike, an empty table stays empty, and extra columns may have any names.
    """
    return substrings.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them.

    Null texts have no words, null sources are one that sorts last, repeated
    rows are taken one by one, an empty table stays empty, and extra columns may
    have any names.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents of the mix, in sequences of at most 1024 tokens.

    A null text is the end id alone, repeated rows are packed one by one, an
    empty table has no pieces, and extra columns are left out.
    """
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("substring_dedup", cut_repeats), ("mixing", mix), ("packing", pack)]

#: The learned toxicity model and the tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.saved(docs)
    return docs
