"""Words of sequences: sliding windows, bags, indexes and gapped features."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.functions import sequences as S


def clean_sequences(df: DataFrame, seq: str = "seq", alphabet: str = S.DNA) -> DataFrame:
    """Sequences in the alphabet; those left empty are dropped."""
    return df.withColumn(seq, S.clean(F.col(seq), alphabet)).where(F.length(seq) > 0)


def windows(seq: Column, L: int) -> Column:
    """Every word of L letters, in order; none for a shorter sequence. One pass: substring() would walk from the start for each."""
    return F.regexp_extract_all(seq, F.lit(f"(?=(.{{{L}}}))"), F.lit(1))


def words(df: DataFrame, L: int, both_strands: bool = True, alphabet: str = S.DNA, seq: str = "seq") -> DataFrame:
    """A row per word (column u) of each sequence, and of its reverse complement. Alphabets of other than 4 letters have one strand."""
    text = F.col(seq)
    all_words = windows(text, L)
    if both_strands and len(alphabet) == 4:
        all_words = F.concat(all_words, windows(S.reverse_complement(text, alphabet), L))
    return df.withColumn("u", F.explode(all_words)).drop(seq)


def bag(df: DataFrame, L: int, key: str = "seq_id", both_strands: bool = True, alphabet: str = S.DNA, seq: str = "seq") -> DataFrame:
    """key, u, n: how often each word occurs. Sequences of one key are merged.

    The sequences are dealt by key before they are cut into words, so the words
    themselves, and whatever is grouped by the key and more, need no shuffle. A
    given number of partitions: adaptive execution would size them by the
    sequences, a hundredth of what they become.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return words(df.select(key, seq).repartition(n, key), L, both_strands, alphabet, seq).groupBy(key, "u").agg(F.count("*").alias("n"))


def packed_bag(df: DataFrame, L: int, key: str = "seq_id", both_strands: bool = True, alphabet: str = S.DNA, seq: str = "seq") -> DataFrame:
    """As bag, with words as numbers."""
    return bag(df, L, key, both_strands, alphabet, seq).withColumn("u", S.pack(F.col("u"), alphabet))


def word_totals(bags: DataFrame, key: str = "seq_id") -> DataFrame:
    """Distinct and all words of each sequence."""
    return bags.groupBy(key).agg(F.count("*").alias("n_distinct"), F.sum("n").alias("n_total"))


def prefix_counts(bags: DataFrame, L: int) -> DataFrame:
    """Distinct prefixes of the corpus' words at each depth 1..L."""
    distinct = bags.select("u").distinct()
    by = distinct.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(L)), lambda k: F.struct(k.alias("depth"), F.substring("u", F.lit(1), k).alias("p")))).alias("x"))
    return by.select("x.depth", "x.p").distinct().groupBy("depth").agg(F.count("*").alias("n_prefixes"))


def postings(bags: DataFrame, key: str = "seq_id") -> DataFrame:
    """u and the sequences that hold it, as rows (not one list: a frequent word has one entry per sequence)."""
    return bags.select("u", key, "n").repartition("u").sortWithinPartitions("u", key)


def document_frequency(bags: DataFrame) -> DataFrame:
    return bags.groupBy("u").agg(F.count("*").alias("n_seqs"), F.sum("n").alias("n_total"))


def lookup(bags: DataFrame, wanted: DataFrame, key: str = "seq_id") -> DataFrame:
    """Counts of the wanted words (column u) per sequence."""
    return bags.join(wanted.select("u").distinct(), "u").select(key, "u", "n")


def duplicate_ids(*frames: DataFrame, key: str = "seq_id") -> DataFrame:
    """Ids that occur more than once in the frames together, and how often."""
    ids = frames[0].select(key)
    for f in frames[1:]:
        ids = ids.unionByName(f.select(key))
    return ids.groupBy(key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def assert_unique_ids(*frames: DataFrame, key: str = "seq_id") -> None:
    found = duplicate_ids(*frames, key=key).limit(5).collect()
    if found:
        raise ValueError(f"ids that occur more than once: {[r[0] for r in found]}")


def partition_filter(df: DataFrame, k: int, chosen: int, ordinal: str = "ordinal") -> DataFrame:
    """Rows whose 1-based ordinal is `chosen` modulo k."""
    return df.where(F.pmod(F.col(ordinal), F.lit(k)) == chosen)


# --- gapped features -------------------------------------------------------------


def masks(L: int, K: int, first_fixed: bool = False) -> list[tuple[int, ...]]:
    """Which K of L places are fixed, in lexicographic order."""
    return [c for c in combinations(range(L), K) if not first_fixed or 0 in c]


def _gapped(u: Column, fixed: tuple[int, ...], L: int) -> Column:
    return F.concat(*(F.substring(u, i + 1, 1) if i in fixed else F.lit(".") for i in range(L)))


def gapped_words(df: DataFrame, L: int, K: int, u: str = "u", first_fixed: bool = False) -> DataFrame:
    """A row per word and mask: f, the word with '.' at the open places."""
    return df.withColumn("f", F.explode(F.array(*(_gapped(F.col(u), m, L) for m in masks(L, K, first_fixed)))))


def gapped_counts(bags: DataFrame, L: int, K: int, key: list[str] | None = None, first_fixed: bool = False, half: bool = False) -> DataFrame:
    """How often each gapped word occurs (by key).

    first_fixed keeps the masks whose first place is fixed; half, with it, the
    gapped words that begin with the first half of the alphabet: on both strands
    the others are their reverse complements.
    """
    g = gapped_words(bags, L, K, first_fixed=first_fixed or half)
    return (first_letters(g, "f") if half else g).groupBy(*(key or []), "f").agg(F.sum("n").alias("n"))


def first_letters(df: DataFrame, word: str = "u", letters: str = S.DNA[:2]) -> DataFrame:
    """Rows whose word begins with one of the letters."""
    return df.where(F.substring(word, 1, 1).isin(*letters))


def class_ratio(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """f, n_pos, n_neg and 1e6 (p-n)/(p+n) cut towards zero; both are tables (f, n)."""
    p = positive.select("f", F.col("n").alias("n_pos"))
    n = negative.select("f", F.col("n").alias("n_neg"))
    j = p.join(n, "f", "full").fillna(0, ["n_pos", "n_neg"])
    total = F.col("n_pos") + F.col("n_neg")
    ratio = F.when(total == 0, 0).otherwise((1e6 * (F.col("n_pos") - F.col("n_neg")) / total).cast("int"))
    return j.withColumn("ratio", ratio)
