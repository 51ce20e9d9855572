"""Toxicity by multiple-instance learning.

A sentence has the probability sigma(b + sum of the weights of its words and of
their first 5, 6 and 7 bytes); a document is toxic when a sentence is: P = 1 - prod(1 - p) (noisy-or). The
weights are trained from document labels alone, by the gradient of the
document's log loss, and then locate the offending sentences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, arrow_map, crc_mod, mix, only, ship, slices, sums_by, text_size, to_batch

#: Labelled rows that teach, at most (about): toxic ones first, up to TOXIC_ROWS, then clean ones; a hash of the id picks them.
TRAIN_ROWS = 12_000
TOXIC_ROWS = 4_000
#: Bytes of text that teach, at most (about): beyond, a hash of the id picks fewer rows.
TRAIN_BYTES = 256 << 20
BITS = 18
#: Bytes of the prefixes that count beside the whole word; a shorter word has none (bin 1 << BITS, without weight).
PREFIXES = (5, 6, 7)
PER_WORD = 1 + len(PREFIXES)
EPOCHS = 10
#: Sentences that are judged at a time.
SENTENCES = 1 << 15
#: Share of the words that a training batch sees.
KEEP = 0.6
_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True
_BAGS = "toxic int, bins binary, breaks binary"
_SCORES = "doc_id long, held_out boolean, score double, n_sentences long, n_toxic long, worst_start long, worst_end long, worst_score double"


def sentences(col: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of lower-cased texts, their bins (PER_WORD each), and the words that open a sentence (a stop or a line end lies before them, or their text begins)."""
    w = Words(col, lower=True, gap=_GAP, prefixes=PREFIXES)
    stops = np.flatnonzero(_STOP[w.data])
    before = np.searchsorted(stops, w.start)
    opens = np.zeros(len(w.start), bool)
    if len(opens):
        opens[1:] = before[1:] > before[:-1]
        opens[w.at[:-1][w.count > 0]] = True
    bins = np.full((len(w.start), PER_WORD), 1 << BITS, np.uint32)
    bins[:, 0] = w.hash >> U64(64 - BITS)
    for j, h in enumerate(w.prefix, 1):
        long = h != 0
        bins[long, j] = (h[long] >> U64(64 - BITS))
    return w, bins.ravel(), np.flatnonzero(opens)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        w, bins, opens = sentences(b.column("text"))
        at = np.searchsorted(opens, w.at)
        yield to_batch(_BAGS, toxic=b.column("toxic"), bins=[bins[PER_WORD * w.at[i] : PER_WORD * w.at[i + 1]].tobytes() for i in range(b.num_rows)], breaks=[(PER_WORD * (opens[at[i] : at[i + 1]] - w.at[i])).astype(np.uint32).tobytes() for i in range(b.num_rows)])


def noisy_or(p: np.ndarray, at: np.ndarray) -> np.ndarray:
    """1 - prod(1 - p) over p[at[i]:at[i+1]]; 0 for none."""
    logs = np.zeros(len(p) + 1)
    np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-9)), out=logs[1:])
    return -np.expm1(np.minimum(logs[at[1:]] - logs[at[:-1]], 0))


def telling(df: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """df: documents of class 0 and 1 that hold each bin, of n[0] and n[1] -> the bins that are more frequent
    in class 1 beyond what chance makes of so many bins (G test), and their log ratios."""
    rate = (df + 0.5) / (n + 1)[:, None]
    tested = max(int((df.sum(0) > 1).sum()), 2)

    def part(k: np.ndarray, m: np.ndarray, p: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(k / (m * p)), 0) + np.where(m > k, (m - k) * np.log((m - k) / (m * (1 - p))), 0)

    pool = np.clip(df.sum(0) / n.sum(), 1e-12, 1 - 1e-12)
    g = 2 * (part(df[0], n[0], pool) + part(df[1], n[1], pool))
    ratio = np.log(rate[1] / rate[0])
    return (ratio > 0) & (g > 2 * np.log(tested)), ratio


def train(bags: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.5, l1: float = 2e-5, weigh: tuple[float, float] = (1.0, 1.0)) -> tuple[np.ndarray, float]:
    """Weights per bin and the offset, from (label, bins, sentence starts) of documents; `weigh` is what a document of each class counts in the loss."""
    size = (1 << BITS) + 1
    bags = [b for b in bags if len(b[1])]
    w, bias = np.zeros(size), -6.0
    if not any(b[0] for b in bags) or all(b[0] for b in bags):
        return w.astype(np.float32), bias
    df, n = np.zeros((2, size)), np.zeros(2)
    # a text most of whose sentences its class had before is a near copy: only its new sentences are evidence
    keys = [np.add.reduceat(mix(bins.astype(U64) + U64(1)), opens) for _, bins, opens in bags]
    fresh = np.zeros(sum(map(len, keys)), bool)
    home = np.repeat([b[0] for b in bags], [len(k) for k in keys])
    for y in (0, 1):
        own = np.flatnonzero(home == y)
        fresh[own[np.unique(np.concatenate(keys)[own], return_index=True)[1]]] = True
    at = 0
    for y, bins, opens in bags:
        new = fresh[at : at + len(opens)]
        at += len(opens)
        df[y, np.unique(bins if 2 * new.sum() >= len(new) else bins[np.repeat(new, np.diff(np.append(opens, len(bins))))])] += 1
        n[y] += new.any()
    n = np.maximum(n, 1)
    usable, ratio = telling(df, n)
    usable[-1] = False
    w = np.where(usable, ratio, 0.0)
    grown, grown_b = np.full(size, 1e-6), 1e-6
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), 128):
            part = [bags[i] for i in order[lo : lo + 128]]
            y = np.array([b[0] for b in part])
            bins = np.concatenate([b[1] for b in part])
            n_words = np.array([len(b[1]) for b in part])
            begin = np.concatenate([[0], np.cumsum(n_words)])
            opens = np.concatenate([b[2].astype(np.int64) + s for b, s in zip(part, begin, strict=False)])
            at = np.concatenate([[0], np.cumsum([len(b[2]) for b in part])])
            seen = rng.random(size) < KEEP  # of the bins, anew for each batch, so that no word hides behind its companions
            z = np.add.reduceat((w * seen)[bins], opens) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            doc = noisy_or(p, at)
            # d loss / d z: p for a clean document, -p (1-P)/P for a toxic one
            g = p * np.repeat(np.where(y == 1, -weigh[1] * (1 - doc) / np.maximum(doc, 1e-9), weigh[0]), np.diff(at))
            per_word = np.repeat(g, np.diff(np.append(opens, len(bins))))
            gw = np.bincount(bins, per_word, minlength=size) * (usable & seen) / len(part) ** 0.5
            touched = np.flatnonzero(gw)
            grown[touched] += gw[touched] ** 2
            step = rate / np.sqrt(grown[touched])
            new = w[touched] - step * gw[touched]
            w[touched] = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
            gb = g.sum() / len(part) ** 0.5
            grown_b += gb * gb
            bias -= 0.1 * gb / grown_b**0.5
    return w.astype(np.float32), float(bias)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, toxic_rows: int = TOXIC_ROWS) -> tuple[np.ndarray, float]:
    """The model, from labelled rows whose crc32(doc_id as text) mod 5 isn't 0. Classes weigh in the loss what they have of all those rows."""
    known = only(labels, doc_id="bigint", toxic="int").dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(crc_mod("doc_id", 5) > 0)
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    toxic = min(sizes.get(1, 0), toxic_rows)
    share = [min(1.0, k / max(sizes.get(y, 0), 1)) for y, k in enumerate((train_rows - toxic, toxic))]
    limit = F.when(F.col("toxic") == 1, int((1 << 30) * share[1])).otherwise(int((1 << 30) * share[0]))
    part = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < limit)
    # part has about train_rows ids at most, whatever the input: it may be broadcast
    # an id that documents share teaches one text, the first in order
    rows = only(docs, doc_id="bigint", text="string").where("text is not null").join(F.broadcast(part), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    size = text_size(rows)
    if size > TRAIN_BYTES:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < int((1 << 30) * TRAIN_BYTES / size))
    rows = rows.select("toxic", "text")
    # a part at a time, so that the JVM of the driver never holds them all
    rows = arrow_map(rows, _bags, _BAGS).repartition(16).toLocalIterator()
    found = sorted((int(r["toxic"]), bytes(r["bins"]), bytes(r["breaks"])) for r in rows)
    taught, whole = [sizes.get(y, 0) * share[y] for y in (0, 1)], max(sum(sizes.values()), 1)
    weigh = tuple(sizes.get(y, 0) / whole * sum(taught) / max(taught[y], 1e-9) for y in (0, 1))
    return train([(y, np.frombuffer(b, np.uint32), np.frombuffer(s, np.uint32)) for y, b, s in found], weigh=weigh)


def _judge(col: pa.Array, model: tuple[np.ndarray, float]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, where sentences open, the sentences of each text (at), and the probability of each sentence."""
    weights, bias = model
    w, bins, opens = sentences(col)
    p = np.zeros(len(opens))
    for lo in range(0, len(opens), SENTENCES):
        on = opens[lo : lo + SENTENCES]
        end = opens[lo + SENTENCES] if lo + SENTENCES < len(opens) else len(w.start)
        z = np.add.reduceat(weights[bins[PER_WORD * on[0] : PER_WORD * end]].astype(np.float64), PER_WORD * (on - on[0])) + bias
        p[lo : lo + SENTENCES] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return w, opens, np.searchsorted(opens, w.at), p


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """docs(doc_id, text) -> a row each with its score and its worst sentence (byte range in the text).

    A null or empty text has no sentence: score 0. A null id counts as held out.
    Of equally bad sentences the first is the worst. Repeated rows are scored one
    by one, alike. No rows, no rows; extra columns are left out, whatever their
    names.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w, opens, at, p = _judge(b.column("text"), held.value)
            n = np.diff(at)
            worst = np.zeros(b.num_rows, np.int64)
            for i in np.flatnonzero(n):
                worst[i] = at[i] + p[at[i] : at[i + 1]].argmax()
            none = n == 0
            last = np.append(opens[1:], len(w.start)) - 1
            pick = lambda v: pa.array(v[worst] if len(v) else np.zeros(b.num_rows, v.dtype), mask=none)  # noqa: B023, E731
            home = np.repeat(w.off[:-1], n)
            yield to_batch(
                _SCORES, doc_id=b.column("doc_id"), held_out=b.column("held_out"), score=noisy_or(p, at), n_sentences=n, n_toxic=sums_by(p >= 0.5, at),
                worst_start=pick(w.start[opens] - home), worst_end=pick(w.end[last] - home if len(opens) else home), worst_score=pick(p),
            )

    d = only(docs, doc_id="bigint", text="string").withColumn("held_out", crc_mod("doc_id", 5) <= 0)
    return arrow_map(d, run, _SCORES)


def without_toxic(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """The rows of docs, all columns, whatever their names, whose score is below 0.5.

    Null and empty texts score 0 and stay; repeated rows fare alike; an empty
    table stays empty. Without a model that learned from both classes all stay.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            _, _, at, p = _judge(b.column("text"), held.value)
            yield b.filter(pa.array(noisy_or(p, at) < 0.5))

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    s = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return s.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
