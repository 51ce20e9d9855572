"""Language identification by mixture inference.

A document is a mixture of languages; its words are drawn from them. The
likelihood of a word under a language is the product of its byte trigrams'
probabilities there. Expectation-maximisation estimates the proportions of all
learned languages; then the least of them go, step by step, with new estimates
for the rest. Of the sets on the way, from all languages to one, that with the
highest penalised likelihood (BIC) is kept, and its likeliest language is the
answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, arrow_map, crc_mod, only, slices, text_bytes, to_batch

BITS = 15
#: Documents of a language that teach, at most (about): a hash of the id picks them.
TRAIN_ROWS = 4_000
#: Estimates stop when no proportion of a text moves further than this.
MOVE = 1e-3
#: Learned languages at most: a table of them is sent to every task.
MOST_LANGS = 1_000
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True
_COUNTS = "lang string, counts binary"
_PRED = "doc_id long, held_out boolean, lang_pred string, score double, n_langs int, langs string"


def trigrams(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bin of the trigram around every byte (1 << BITS outside words), where words begin, the words of each text (at), and offsets.

    Bytes other than letters and those of multi-byte characters are gaps; a
    text's ends act as gaps too, so a text's trigrams depend on it alone.
    """
    raw, off = text_bytes(col)
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64), off
    x = LOWER[raw]
    inside = _LETTER[x]
    x = np.where(inside, x, np.uint8(32)).astype(np.uint32)
    before, after = np.empty_like(x), np.empty_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    full = np.flatnonzero(np.diff(off))
    before[off[:-1][full]] = 32
    after[off[1:][full] - 1] = 32
    code = (before * np.uint32(0x9E3779B1) ^ x * np.uint32(0x85EBCA6B)) + after * np.uint32(0xC2B2AE35)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    bins = (code >> np.uint32(32 - BITS)).astype(np.int32)
    bins[~inside] = 1 << BITS
    first = inside & (before == 32)
    starts = np.flatnonzero(first)
    return bins, starts, np.searchsorted(starts, off), off


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for b in slices(batches):
        bins, _, _, off = trigrams(b.column("text"))
        for i, lang in enumerate(b.column("lang").to_pylist()):
            c = np.bincount(bins[off[i] : off[i + 1]], minlength=(1 << BITS) + 1)
            total[lang] = total.get(lang, 0) + c
    for lang, c in total.items():
        yield to_batch(_COUNTS, lang=[lang], counts=[c.astype(np.int64).tobytes()])


def _add(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in t.column("counts").to_pylist())
    return pa.table({"lang": t.column("lang").combine_chunks()[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities of the bins under each (one more bin for gaps, at 0)."""
    d = only(docs, doc_id="bigint", text="string", lang="string").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (crc_mod("doc_id", 5) > 0))
    known = d.groupBy("lang").agg(F.count("*").alias("n"))
    if known.count() > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    share = F.least(F.lit(1.0), F.lit(float(train_rows)) / F.col("n")) * (1 << 30)
    sizes = sorted((r["lang"], r["n"]) for r in known.collect())
    if not sizes:
        return [], np.zeros(((1 << BITS) + 1, 0), np.float32)
    part = d.join(F.broadcast(known), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)
    counts = {lang: np.zeros((1 << BITS) + 1) for lang, _ in sizes}
    for r in arrow_map(part.select("text", "lang").repartition(8), _count, _COUNTS).groupBy("lang").applyInArrow(_add, _COUNTS).toLocalIterator():
        counts[r["lang"]] += np.frombuffer(r["counts"], np.int64)
    langs = [lang for lang, _ in sizes]
    c = np.stack([counts[x] for x in langs], 1)
    c[-1] = 0
    table = np.log(c + 0.2) - np.log(c.sum(0) + 0.2 * (1 << BITS))
    table[-1] = 0
    return langs, table.astype(np.float32)


def _likelihoods(table: np.ndarray, bins: np.ndarray, starts: np.ndarray, words: int = 1 << 16) -> np.ndarray:
    """Log likelihoods (word, language), some words at a time."""
    out = [np.add.reduceat(table[bins[a : z]], starts[lo : lo + words] - a, axis=0) for lo in range(0, len(starts), words) for a, z in [(starts[lo], starts[lo + words] if lo + words < len(starts) else len(bins))]]
    return np.concatenate(out)


def _seg(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the rows at[i]..at[i+1], none of them empty."""
    return np.add.reduceat(x, at[:-1], axis=0)


def _estimate(a: np.ndarray, n: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """Expectation-maximisation from proportions pi until none of a text moves by more than MOVE; texts that stand still drop out."""
    pi, on = pi.copy(), np.arange(len(n))
    at = np.concatenate([[0], np.cumsum(n)])
    while len(on):
        r = a * np.repeat(pi[on], n, 0)
        r /= np.maximum(r.sum(1), 1e-30)[:, None]
        new = _seg(r, at) / n[:, None]
        moves = np.abs(new - pi[on]).max(1) > MOVE
        pi[on] = new
        if not moves.all():
            a, on, n = a[np.repeat(moves, n)], on[moves], n[moves]
            at = np.concatenate([[0], np.cumsum(n)])
    return pi


def mixtures(words: np.ndarray, at: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words: log likelihoods (word, language) of texts with words at[i]..at[i+1] -> proportions of all languages, those of the chosen set (0 elsewhere), and its size.

    Ties in proportions keep the earlier language.
    """
    n_docs, langs = len(at) - 1, words.shape[1]
    n = np.diff(at)
    top = words.max(1)
    a = np.exp(words - top[:, None])
    mask = np.ones((n_docs, langs), bool)
    pi = every = _estimate(a, n, np.full((n_docs, langs), 1.0 / langs, a.dtype))
    best, best_fit, size = pi, np.full(n_docs, -np.inf), np.full(n_docs, langs)
    live = np.arange(n_docs)
    while len(live):
        on = np.isin(np.arange(n_docs), live)
        held = np.repeat(on, n)
        p, k, m = pi[live], mask[live].sum(1), n[live]
        cut = np.concatenate([[0], np.cumsum(m)])
        fit = _seg(np.log(np.maximum((a[held] * np.repeat(p, m, 0)).sum(1), 1e-30)), cut) - penalty * 0.5 * (2 * k - 1) * np.log(np.maximum(m, 2))
        better = live[fit >= best_fit[live]]
        best = best.copy()
        best[better], size[better] = pi[better], mask[better].sum(1)
        best_fit[live] = np.maximum(fit, best_fit[live])
        live = live[k > 1]
        if not len(live):
            break
        # the least language goes, and with it all that have less than half a word
        p = np.where(mask[live], pi[live], np.inf)
        least = (langs - 1) - p[:, ::-1].argmin(1)
        gone = mask[live] & (pi[live] * n[live][:, None] < 0.5)
        gone[np.arange(len(live)), least] = True
        gone[np.arange(len(live)), np.where(mask[live], pi[live], -1.0).argmax(1)] = False
        mask[live] &= ~gone
        start = pi[live] * mask[live] + 1e-6 * mask[live]
        start /= start.sum(1)[:, None]
        pi = pi.copy()
        pi[live] = _estimate(a[np.repeat(np.isin(np.arange(n_docs), live), n)], n[live], start.astype(a.dtype))
    return every, best, size


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """docs(doc_id, text) -> a row each: lang_pred, its proportion among all learned languages as score, and the chosen languages.

    `und` with score 0 where the text is null or has no letter, or nothing was
    learned. A null id counts as held out. Texts are taken whole. Ties go to the
    language that sorts first. Repeated rows are judged one by one, alike. No
    rows, no rows; extra columns are left out, whatever their names.
    """
    langs, table = model
    held = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = held.value
        for b in slices(batches):
            col = b.column("text")
            bins, starts, at, off = trigrams(col)
            n = np.diff(at)
            raw, _ = text_bytes(col)
            x = LOWER[raw]
            plain = np.zeros(len(x) + 1, np.int64)
            np.cumsum((x >= 97) & (x <= 122), out=plain[1:])
            letters = plain[off[1:]] > plain[off[:-1]]
            for i in np.flatnonzero(~letters & (n > 0)):
                letters[i] = any(ch.isalpha() for ch in raw[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"))
            use = np.flatnonzero(letters & (n > 0)) if langs else np.zeros(0, np.int64)
            pred, score = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            size, named = np.zeros(b.num_rows, np.int32), np.full(b.num_rows, "", object)
            if len(use):
                words = _likelihoods(t, bins, starts)
                keep = np.repeat(np.isin(np.arange(b.num_rows), use), n)
                every, pi, k = mixtures(words[keep], np.concatenate([[0], np.cumsum(n[use])]))
                top = pi.argmax(1)
                pred[use] = np.array(langs, object)[top]
                score[use] = np.minimum(every[np.arange(len(use)), top], 1.0)
                size[use] = k
                named[use] = [",".join(langs[j] for j in np.flatnonzero(row > 0)) for row in pi]
            yield to_batch(_PRED, doc_id=b.column("doc_id"), held_out=b.column("held_out"), lang_pred=pred.tolist(), score=score, n_langs=size, langs=named.tolist())

    d = only(docs, doc_id="bigint", text="string").withColumn("held_out", crc_mod("doc_id", 5) <= 0)
    return arrow_map(d, run, _PRED)


def op5_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs))
