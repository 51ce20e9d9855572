"""Asking the whole corpus about hashes, without a row per word.

Texts are dealt to chunks by a hash (one shuffle, reused by every pass). A chunk
sends its distinct hashes, sorted and packed, one blob per bucket of the hash
range; a bucket merges them and answers each chunk. Memory is bounded by the
chunk or the bucket: none depends on how often a word or a passage occurs,
since a chunk sends a hash once.

Chunks and buckets both grow with the input. While blobs are large, chunks send
to buckets directly. From 2^DIRECT buckets on, where blobs would fall to a few
hashes, they go by relays: a group of chunks sends to its relays by the first
half of the bucket's bits, and a relay, which merges what the group has, sends
to buckets by the second half; answers return the same way. So a blob keeps
hundreds of hashes, and their number grows with the input to the power 1.5
instead of 2.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, only, ship, text_size

#: Bytes of text of a partition, chunks a partition, and bytes of text whose hashes a bucket holds.
PART_BYTES = 8 << 20
CHUNKS = 2
BUCKET_BYTES = 16 << 20
LEAST_BITS = 4
#: Tasks of a stage at most: beyond, a task works at more chunks or buckets, one after another.
MOST_TASKS = 20_000
#: Bits of the bucket number up to which chunks send to buckets directly.
DIRECT = 10
SENT = "bucket long, chunk long, n int, hashes binary, load binary"
ANSWER = "bucket long, chunk long, n int, answer binary"
_SENT = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("n", pa.int32()), ("hashes", pa.binary()), ("load", pa.binary())])
_ANSWER = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("n", pa.int32()), ("answer", pa.binary())])


def dealt(docs: DataFrame, **cols: str) -> tuple[DataFrame, int, int]:
    """docs by chunk (with the columns asked for): the frame, its partitions, and the bits of the bucket number.

    Rows equal in id and text share a chunk; null ids and copies of a text spread.
    """
    d = only(docs, **cols)
    size = text_size(d)
    parts = max(4, math.ceil(size / PART_BYTES))
    ship(docs.sparkSession)
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts * CHUNKS)).cast("long")
    parts = min(parts, MOST_TASKS)
    bits = max(LEAST_BITS, math.ceil(math.log2(max(size, 1) / BUCKET_BYTES)))
    if bits > 32:
        raise ValueError("more than 2^32 buckets")
    return d.withColumn("chunk", chunk).repartition(parts, "chunk"), parts, bits


# --- packing -------------------------------------------------------------------


def planes(x: np.ndarray) -> bytes:
    """Ascending numbers as differences, byte plane by byte plane, so that the shuffle's compression finds the zeros."""
    if not len(x):
        return b""
    d = np.diff(x, prepend=x.dtype.type(0))
    return d.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()


def unplanes(raw: bytes, kind: type = np.uint64) -> np.ndarray:
    if not raw:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    d = np.frombuffer(raw, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()
    return np.cumsum(d, dtype=kind)


def plain(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane."""
    return np.ascontiguousarray(x, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()


def unplain(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel()


def bits_of(*arrays: np.ndarray) -> bytes:
    return b"".join(np.packbits(x).tobytes() for x in arrays)


def unbits(raw: bytes, n: int, arrays: int = 1) -> list[np.ndarray]:
    size = (n + 7) // 8
    return [np.unpackbits(np.frombuffer(raw[i * size : (i + 1) * size], np.uint8), count=n).astype(bool) for i in range(arrays)]


def member(sorted_set: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of x are in a sorted array."""
    if not len(sorted_set):
        return np.zeros(len(x), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, x), len(sorted_set) - 1)] == x


def runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


# --- the protocol ----------------------------------------------------------------


@dataclass(frozen=True)
class Question:
    """What is asked about hashes of `width` bits, the bucket number first.

    A load is an array of columns (kinds x hashes); merge joins the loads of
    equal hashes, given sorted with the starts of their runs; verdict is what
    the merged loads of all chunks say of each hash; reply is what a sender
    learns, from its own load, the merged one and the verdict, for each hash.
    """

    width: int
    pack: Callable[[np.ndarray], bytes]
    unpack: Callable[[bytes, int], np.ndarray]
    merge: Callable[[np.ndarray, np.ndarray], np.ndarray]
    verdict: Callable[[np.ndarray], np.ndarray]
    reply: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    write: Callable[[np.ndarray, np.ndarray], bytes]
    read: Callable[[bytes, np.ndarray], np.ndarray]
    #: A number about a bucket's merged loads, sent to chunk -1.
    summary: Callable[[np.ndarray], int] | None = None

    def sent(self, chunk: int, hashes: np.ndarray, load: np.ndarray, top: int) -> pa.Table:
        """Rows of a sender: one for each value of the top bits that its sorted hashes have."""
        bucket = (hashes >> U64(self.width - top)).astype(np.int64)
        first = runs(bucket)
        cut = np.append(first, len(hashes))
        each = [slice(a, b) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        return pa.table({
            "bucket": bucket[first], "chunk": np.full(len(first), chunk, np.int64), "n": np.diff(cut).astype(np.int32),
            "hashes": pa.array([planes(hashes[x]) for x in each], pa.binary()), "load": pa.array([self.pack(load[:, x]) for x in each], pa.binary()),
        }, schema=_SENT)

    def parts(self, t: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
        hashes = [unplanes(r) for r in t.column("hashes").to_pylist()]
        return hashes, [self.unpack(r, len(h)) for r, h in zip(t.column("load").to_pylist(), hashes, strict=True)]

    def merged(self, hashes: list[np.ndarray], loads: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        h, load = np.concatenate(hashes), np.concatenate(loads, 1)
        order = np.argsort(h, kind="stable")  # runs that are sorted already
        h, load = h[order], load[:, order]
        first = runs(h)
        return h[first], self.merge(load, first)

    def answers(self, t: pa.Table, hashes: list, loads: list, known: np.ndarray, load: np.ndarray, verdict: np.ndarray) -> pa.Table:
        """A row per sender, given the verdict on the merged hashes."""
        out = []
        for h, own in zip(hashes, loads, strict=True):
            at = np.searchsorted(known, h)
            out.append(self.write(h, self.reply(own, load[:, at], verdict[..., at])))
        return pa.table({"bucket": t.column("bucket"), "chunk": t.column("chunk"), "n": t.column("n"), "answer": pa.array(out, pa.binary())}, schema=_ANSWER)

    def learnt(self, t: pa.Table, hashes: np.ndarray) -> np.ndarray:
        """What a sender's answers say of its sorted hashes."""
        t = t.take(np.argsort(t.column("bucket").to_numpy()))
        out, at = [], 0
        for n, raw in zip(t.column("n").to_pylist(), t.column("answer").to_pylist(), strict=True):
            out.append(self.read(raw, hashes[at : at + n]))
            at += n
        return np.concatenate(out)


def ask(sent: DataFrame, q: Question, parts: int, bits: int, direct: int = DIRECT, keep: Callable[[DataFrame], DataFrame] = lambda x: x) -> tuple[DataFrame, DataFrame]:
    """Answers to what chunks sent by `sent_bits(bits, direct)` top bits: rows (bucket, chunk, n, answer) for the chunks; and those of the buckets, with the summaries of chunk -1.

    keep: what to do with the buckets' answers where both are used (save them).
    """

    def bucket(t: pa.Table) -> pa.Table:
        hashes, loads = q.parts(t)
        known, load = q.merged(hashes, loads)
        out = q.answers(t, hashes, loads, known, load, q.verdict(load))
        if q.summary is None:
            return out
        more = {"bucket": [t.column("bucket")[0].as_py()], "chunk": [-1], "n": [q.summary(load)], "answer": [None]}
        return pa.concat_tables([out, pa.table(more, schema=_ANSWER)])

    buckets = min(1 << bits, MOST_TASKS)
    if bits <= direct:
        found = keep(sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(bucket, ANSWER))
        return found.where("chunk >= 0"), found
    first = sent_bits(bits, direct)
    group = 1 << first

    def up(key: tuple, t: pa.Table) -> pa.Table:
        known, load = q.merged(*q.parts(t))
        return q.sent(key[0].as_py() * group + key[1].as_py(), known, load, bits)

    def down(key, t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _ANSWER.empty_table()
        t = t.select(_SENT.names)
        hashes, loads = q.parts(t)
        known, load = q.merged(hashes, loads)
        return q.answers(t, hashes, loads, known, load, q.learnt(answers, known))

    by = [F.floor(F.col("chunk") / group).alias("group"), F.col("bucket").alias("head")]
    own = sent.select(*by, *_SENT.names).repartition(max(parts, buckets), "group", "head")
    raised = own.groupBy("group", "head").applyInArrow(lambda key, t: up(key, t.select(_SENT.names)), SENT)
    found = keep(raised.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(bucket, ANSWER))
    back = found.where("chunk >= 0").select(F.floor(F.col("chunk") / group).alias("group"), F.pmod("chunk", F.lit(group)).alias("head"), *_ANSWER.names)
    back = back.repartition(max(parts, buckets), "group", "head")
    return own.groupBy("group", "head").cogroup(back.groupBy("group", "head")).applyInArrow(lambda key, t, a: down(key, t, a.select(_ANSWER.names)), ANSWER), found


def sent_bits(bits: int, direct: int = DIRECT) -> int:
    """Top bits by which a chunk cuts what it sends: the bucket's, or the first half of them where relays stand between."""
    return bits if bits <= direct else bits // 2
