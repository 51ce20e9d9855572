"""Quality rules: text statistics and a learned decision list.

Sequential covering grows conjunctions of thresholds that describe the rejected
class (FOIL gain on two thirds of the labelled rows), prunes them on the last
third, and stops when a pruned rule is no longer precise. The ordered list is
emitted as one Spark conditional expression over the statistics.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, U64, Words, arrow_map, only, saved, slices, sums_by, to_batch

#: Labelled rows that the list is learned from, at most (about): a hash of the id picks them.
TRAIN_ROWS = 20_000
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in "!?;:"]] = True
_UPPER, _DIGITS, _WORD_CHARS = np.zeros(256, bool), np.zeros(256, bool), ~SPACE
_UPPER[65:91] = _DIGITS[48:58] = True
_WORD_CHARS[0x80:0xC0] = False  # bytes that go on with a character
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_digits", "n_adjacent", "n_distinct", "n_lines")
_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in STATS)


def _distinct_keys(w: Words, h: np.ndarray, docs: np.ndarray) -> np.ndarray:
    bits = max(1, int(len(w.count)).bit_length())
    if len(w.count) == 1:
        return h
    return (docs.astype(U64) << U64(64 - bits)) | (h >> U64(bits))


def _statistics(b: pa.RecordBatch) -> pa.RecordBatch:
    col = b.column("text")
    w = Words(col)
    n = len(w.count)
    docs = w.doc()
    keys = np.sort(_distinct_keys(w, w.hash, docs))
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    bits = max(1, n.bit_length())
    owner = (keys >> U64(64 - bits)).astype(np.int64) if n > 1 else np.zeros(len(keys), np.int64)
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (docs[1:] == docs[:-1])
    repeat = np.zeros(len(w.hash), bool)
    g = w.grams(8)
    if len(g):
        at = np.flatnonzero(w.left()[: len(g)] >= 8)
        k = _distinct_keys(w, g[at], docs[at])
        s = np.sort(k)
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        if len(twice):
            hit = at[twice[np.minimum(np.searchsorted(twice, k), len(twice) - 1)] == k]
            edge = np.zeros(len(repeat) + 1, np.int64)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + 8, -1)
            repeat = np.cumsum(edge[:-1]) > 0
    off = w.off.tolist()
    dup, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n):
        full = [x for x in w.data[off[i] : off[i + 1]].tobytes().split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
        lines[i] = len(full)
        dup[i] = len(full) - len(set(full))
    return to_batch(
        _SCHEMA, doc_id=b.column("doc_id"), n_words=w.count, word_chars=w.sums(_WORD_CHARS), n_symbols=w.sums(_SYMBOLS), n_dup_lines=dup,
        n_repeat_words=sums_by(repeat, w.at), n_upper=w.sums(_UPPER), n_marks=w.sums(_MARKS), n_digits=w.sums(_DIGITS),
        n_adjacent=sums_by(same, w.at), n_distinct=np.bincount(owner[fresh], minlength=n)[:n], n_lines=lines,
    )


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        yield _statistics(b)


def text_statistics(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id and the counts STATS, all long; a null text counts as empty."""
    return arrow_map(only(docs, doc_id="bigint", text="string"), _run, _SCHEMA)


#: What the rules may test: ratios of the counts.
RATIOS = {
    "words": ("n_words", None), "chars_per_word": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"),
    "repeat_words": ("n_repeat_words", "n_words"), "upper_per_char": ("n_upper", "word_chars"), "marks_per_word": ("n_marks", "n_words"),
    "digits_per_char": ("n_digits", "word_chars"), "adjacent": ("n_adjacent", "n_words"), "distinct": ("n_distinct", "n_words"), "words_per_line": ("n_words", "n_lines"),
}


def ratio(name: str) -> Column:
    a, b = RATIOS[name]
    return F.col(a).cast("double") if b is None else F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    bound: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.bound if self.above else x[self.feature] <= self.bound

    def column(self) -> Column:
        c = ratio(self.feature)
        return c > F.lit(self.bound) if self.above else c <= F.lit(self.bound)


def _all(rule: list[Test], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    m = np.ones(n, bool)
    for t in rule:
        m &= t.holds(x)
    return m


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> list[Test]:
    rule: list[Test] = []
    live = np.ones(len(bad), bool)
    while len(rule) < most and live.any() and not bad[live].all():
        p0, n0 = bad[live].sum(), (~bad[live]).sum()
        if not p0:
            break
        best, gain = None, 1e-9
        for f, v in x.items():
            v = v[live]
            for bound in np.unique(np.quantile(v, np.linspace(0.005, 0.995, 100))):
                hit = v > bound
                p, n = int((hit & bad[live]).sum()), int((hit & ~bad[live]).sum())
                for above, p1, n1 in ((True, p, n), (False, p0 - p, n0 - n)):
                    if p1 and (g := p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0)))) > gain:
                        best, gain = Test(f, above, float(bound)), g
        if best is None:
            break
        rule.append(best)
        live &= best.holds(x)
    return rule


def learn_list(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, most_rules: int = 12, most_tests: int = 4) -> list[list[Test]]:
    """Ordered rules for the rejected class; a rule stays if it holds `precision` on rows that didn't grow it."""
    fold = np.arange(len(bad)) % 3
    left = np.ones(len(bad), bool)
    rules: list[list[Test]] = []
    while len(rules) < most_rules and (left & bad).sum() >= 5:
        g, p = left & (fold != 2), left & (fold == 2)
        sub = lambda m: {f: v[m] for f, v in x.items()}
        rule = _grow(sub(g), bad[g], most_tests)
        xp, bp = sub(p), bad[p]

        def worth(r: list[Test], xp=xp, bp=bp) -> float:
            hit = _all(r, xp, len(bp))
            return (2 * bp[hit].mean() - 1) if hit.any() else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = _all(rule, xp, len(bp))
        if not rule or hit.sum() < 2 or bp[hit].mean() < precision:
            break
        rules.append(rule)
        left &= ~_all(rule, x, len(bad))
    return rules


def verdict(rules: list[list[Test]]) -> Column:
    """The list as an ordered conditional expression: false where a rule rejects, else true."""
    out = None
    for rule in rules:
        cond = rule[0].column()
        for t in rule[1:]:
            cond = cond & t.column()
        out = F.when(cond, False) if out is None else out.when(cond, False)
    return F.lit(True) if out is None else out.otherwise(True)


def apply_rules(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[DataFrame, list[list[Test]]]:
    """Statistics of docs with base_failed and kept, and the list learned from labels(doc_id, quality).

    Rows with a null label or id don't teach; an id labelled more than once
    counts with its lowest label; without labels the list is empty and keeps
    all. A repeated document is judged row by row. Empty texts fail the base
    rule on the number of words. No rows, no rows; extra columns are left out,
    whatever their names.
    """
    stats = saved(text_statistics(docs))
    known = only(labels, doc_id="bigint", quality="int").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = known.count()
    part = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, train_rows / max(n, 1))))
    # an id that documents share teaches once, by its least statistics
    rows = stats.join(part, "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(*(ratio(f).alias(f) for f in RATIOS))).alias("x"))
    rows = rows.select("doc_id", "quality", "x.*").orderBy(F.xxhash64("doc_id", F.lit(7))).toPandas()
    bad = (rows["quality"] == 0).to_numpy()
    rules = learn_list({f: rows[f].to_numpy() for f in RATIOS}, bad)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules)), rules


def op2_quality(spark, sf_dir: str) -> DataFrame:
    out, _ = apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_base(spark, sf_dir: str) -> DataFrame:
    """The counts and the base rule of op2_quality, which SQL can express."""
    return op2_quality(spark, sf_dir).drop("kept")


QUALITY_BASE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS s FROM d, LATERAL (SELECT unnest(range(1, len(w) - 6)) AS i) WHERE len(w) >= 8),
m AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM m WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
c AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c
"""
