"""Shared pieces: vectorised word hashing, Arrow maps, saved tables, salted prefix sums.

Words are found and hashed for a whole slice of texts with numpy: each byte adds
T[b] * B^i to a running sum modulo 2^64, so the hash of a word is a difference of
two sums times B^-start. Slices hold about SLICE bytes (a longer text is a slice
of its own) and are hashed in pieces of PIECE bytes, whatever text they cut: a
word across pieces is put together from its parts.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE = 1 << 19
#: Rows of ids up to which a table may be broadcast (some 16 MB); a larger one is shuffled.
BROADCAST_ROWS = 1_000_000
WORD = r"[^\x20\x09-\x0D]+"
#: Odd, so that it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
U64 = np.uint64

_cache: dict = {}
_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


# --- session -----------------------------------------------------------------


def ship(spark: SparkSession) -> None:
    """Give the executors this package, and Arrow batches of a bounded number of texts, unless the session has a number of its own."""
    if _RECORDS not in dict(spark.conf.getAll):
        spark.conf.set(_RECORDS, "1000")
    sc = spark.sparkContext
    if _cache.get("shipped") == sc.applicationId:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.join(tempfile.mkdtemp(), "kmerloom.zip")
    with zipfile.ZipFile(name, "w") as z:
        for d, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    p = os.path.join(d, f)
                    z.write(p, os.path.relpath(p, os.path.dirname(root)))
    sc.addPyFile(name)
    _cache["shipped"] = sc.applicationId


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where the setting is absent and Spark is local."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = _cache.setdefault("dir", tempfile.mkdtemp(prefix="kmerloom-"))
    return d


def saved(df: DataFrame, by: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts lineage, survives lost executors. `by`: a column whose values are read apart."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, a saved table of ids, marked for broadcast where a count shows that it has at most `rows` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def text_size(df: DataFrame) -> int:
    """Bytes of all texts of df and 64 a row, counted: compressed files would say too little."""
    row = df.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 64), F.lit(0))).first()
    return int(row[0])


def only(df: DataFrame, **cols: str) -> DataFrame:
    """The named columns alone, so that other columns of the input cannot clash."""
    return df.select(*(df[c].cast(t).alias(c) for c, t in cols.items()))


# --- Arrow maps --------------------------------------------------------------


def slices(batches: Iterable[pa.RecordBatch], col: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of each have about `limit` bytes."""
    for b in batches:
        if not b.num_rows:
            continue
        off = offsets(b.column(col))
        at = 0
        while at < b.num_rows:
            to = int(np.searchsorted(off, off[at] + limit, "right")) - 1
            to = min(max(to, at + 1), b.num_rows)
            yield b.slice(at, to - at)
            at = to


def offsets(a: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type) else np.int32
    return np.frombuffer(a.buffers()[1], kind)[a.offset : a.offset + len(a) + 1]


def text_bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each begins (one more for the end); null is empty."""
    if a.null_count:
        a = a.fill_null("")
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = offsets(a).astype(np.int64)
    buf = a.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def to_batch(schema: str, **cols) -> pa.RecordBatch:
    """A record batch with the columns that the Spark schema string names."""
    if schema not in _cache:
        kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
        kinds |= {f"array<{k}>": pa.list_(v) for k, v in kinds.items()}
        _cache[schema] = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))])
    s = _cache[schema]
    return pa.RecordBatch.from_arrays([v if isinstance(v := cols[f.name], pa.Array) and v.type == f.type else v.cast(f.type) if isinstance(v, pa.Array) else pa.array(v, f.type) for f in s], schema=s)


# --- words -------------------------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SAME = np.arange(256, dtype=np.uint8)
LOWER = _SAME.copy()
LOWER[65:91] += 32


#: Bytes that are hashed at a time.
PIECE = 1 << 18


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i, i up to PIECE."""
    if "pow" not in _cache:
        out = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(PIECE + 64, b, U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _cache["pow"] = tuple(out)
    return _cache["pow"]


def _values() -> np.ndarray:
    if "values" not in _cache:
        _cache["values"] = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
    return _cache["values"]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Words:
    """The words of a slice of texts: byte ranges, 64-bit hashes, and where each text's words begin.

    Bytes are hashed piece by piece, so beyond the texts only some 16 bytes a
    word are held, however long a text is. `prefixes`: lengths k for which
    prefix[j] has the hash of the first k bytes of each longer word (0 else).
    """

    def __init__(self, col: pa.Array, lower: bool = False, gap: np.ndarray = SPACE, prefixes: tuple[int, ...] = ()):
        raw, off = text_bytes(col)
        self.raw = raw
        self.data = LOWER[raw] if lower else raw
        self.off = off
        starts, ends, hashes, heads = [], [], [], [[] for _ in prefixes]
        opened = None  # of a word that goes on in the next piece: its hash so far and its bytes
        for at in range(0, len(raw), PIECE):
            opened = self._piece(at, gap, prefixes, opened, starts, ends, hashes, heads)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        kind = np.int32 if len(raw) < 1 << 31 else np.int64
        self.start, self.end, self.hash = join(starts, kind), join(ends, kind), join(hashes, U64)
        self.prefix = [join(h, U64) for h in heads]
        self.at = np.searchsorted(self.start, off)  # words of text d: at[d]..at[d+1]
        self.count = np.diff(self.at)

    def _piece(self, at: int, gap: np.ndarray, prefixes: tuple[int, ...], opened: tuple[int, int] | None, starts: list, ends: list, hashes: list, heads: list) -> tuple[int, int] | None:
        x = self.data[at : at + PIECE]
        n = len(x)
        inside = ~gap[x]
        before = np.empty(n + 1, bool)  # before[i]: a word comes from the byte before i to i
        before[0] = opened is not None
        before[1:n] = inside[:-1] & inside[1:]
        before[n] = inside[-1] and at + n < len(self.data) and not gap[self.data[at + n]]
        cut = self.off[np.searchsorted(self.off, at, "right") : np.searchsorted(self.off, at + n, "right")] - at
        before[cut] = False
        first, last = inside & ~before[:-1], inside & ~before[1:]
        up, down = _powers()
        total = np.zeros(n + 1, U64)
        np.cumsum(_values()[x] * up[:n], out=total[1:])
        kind = np.int32 if len(self.data) < 1 << 31 else np.int64
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        starts.append((s + at).astype(kind))
        ends.append((e + at).astype(kind))
        if opened is not None:
            done = int(e[0]) if len(e) else n
            whole = (opened[0] + int(total[done]) * pow(BASE, opened[1], 1 << 64)) % (1 << 64)
            opened = whole, opened[1] + done
            if len(e):
                hashes.append(mix(np.array([whole], U64)))
                opened, e = None, e[1:]
        m = len(e)
        hashes.append(mix((total[e] - total[s[:m]]) * down[s[:m]]))
        for k, out in zip(prefixes, heads, strict=True):
            h = np.zeros(len(s), U64)
            long = e - s[:m] > k
            h[:m][long] = mix((total[s[:m][long] + k] - total[s[:m][long]]) * down[s[:m][long]] ^ U64(k))
            if len(s) > m:  # the word that goes on
                h[m] = self._head(at + int(s[m]), k, gap)
            out.append(h)
        if len(s) > m:
            return (int(total[n]) - int(total[s[m]])) * int(down[s[m]]) % (1 << 64), n - int(s[m])
        return opened

    def _head(self, start: int, k: int, gap: np.ndarray) -> np.uint64:
        end = int(self.off[np.searchsorted(self.off, start, "right")])
        x = self.data[start : min(start + k + 1, end)]
        if len(x) <= k or gap[x].any():
            return U64(0)
        return mix((_values()[x[:k]] * _powers()[0][:k]).sum(dtype=U64, keepdims=True) ^ U64(k))[0]

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def left(self) -> np.ndarray:
        """For each word, the words from it to the end of its text."""
        return np.repeat(self.at[1:], self.count) - np.arange(len(self.start))

    def grams(self, k: int, salt: int = 0) -> np.ndarray:
        """Hash of the k words from each word on (of the first len-k+1 words of the slice; those that cross a text's end mean nothing)."""
        h = self.hash
        if len(h) < k:
            return np.zeros(0, U64)
        g = h[: len(h) - k + 1] ^ U64(salt)
        m = U64(0xD6E8FEB86659FD93)
        for j in range(1, k):
            g = g * m + h[j : len(h) - k + 1 + j]
        return mix(g)

    def sums(self, marked: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked in a table of 256."""
        out = np.zeros(len(self.off) - 1, np.int64)
        for at in range(0, len(self.data), PIECE):
            total = np.zeros(min(PIECE, len(self.data) - at) + 1, np.int64)
            np.cumsum(marked[self.data[at : at + PIECE]], out=total[1:])
            lo, hi = np.searchsorted(self.off, at, "right") - 1, np.searchsorted(self.off, at + len(total) - 1, "left")
            edge = np.clip(self.off[lo : hi + 1] - at, 0, len(total) - 1)
            out[lo:hi] += total[edge[1:]] - total[edge[:-1]]
        return out


def sums_by(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Of n positions, those within k of a start on its right."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + k, n), -1)
    return np.cumsum(d[:n]) > 0


# --- folds and salted prefix sums ---------------------------------------------


def crc_mod(col: str, k: int) -> Column:
    """crc32(the id as text) mod k; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(k)), F.lit(-1)).cast("int")


def running_sum(df: DataFrame, key: list[str], order: list[str], value: str, out: str, salt: Column, salts: int, nulls_last: bool = False) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same key before this one.

    Order: the salt (0..salts-1), then `order`. No task gets a whole key: rows
    are summed within (key, salt), and the offsets of the salts come from a
    table of one row per (key, salt).
    """
    from pyspark.sql import Window as W

    d = df.withColumn("_salt", salt)
    w = W.partitionBy(*key, "_salt").orderBy(*(F.col(c).asc_nulls_last() if nulls_last else F.col(c) for c in order)).rowsBetween(W.unboundedPreceding, -1)
    part = d.groupBy(*key, "_salt").agg(F.sum(value).alias("_part"))
    before = part.withColumn("_offset", F.coalesce(F.sum("_part").over(W.partitionBy(*key).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    before = before.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), F.col("_salt").alias("_s"), "_offset")
    inner = d.withColumn("_own", F.coalesce(F.sum(value).over(w), F.lit(0)))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)] + [F.col("_salt") == F.col("_s")]
    joined = inner.join(before, on, "inner")
    return joined.withColumn(out, F.col("_own") + F.col("_offset")).drop("_own", "_offset", "_salt", "_s", *(f"_k{i}" for i in range(len(key))))
