"""Packing by cutting-stock column generation.

A document longer than a sequence gives full pieces, which fill sequences of
their own, and a rest. The rests' lengths, rounded up to units, are the items
of a cutting-stock problem over the length histogram: a linear program whose
columns are patterns (how many items of each length share a sequence), priced
by a knapsack dynamic program. Whole multiples of the patterns are kept; the
few items that rounding leaves are placed by best fit, longest first. The n-th
item of a length takes the n-th slot of that length in the patterns.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import arrow_map, only, running_sum, saved, slices, to_batch
from .subwords import PART, TOKENIZER, shared_encoder

LENGTH = 1024
UNIT = 4
END = 0
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, cls int"
_PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long"


def _cut(size: int, unit: int, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared_encoder(path)
        for b in slices(batches, limit=PART):
            ids, lengths = enc.arrays(b.column("text"))
            raw = np.insert(ids, np.cumsum(lengths), END).tobytes()
            rows: list[tuple] = []
            begin = 0
            for doc, n in zip(b.column("doc_id").to_pylist(), (lengths + 1).tolist(), strict=True):
                for at in range(0, n, size):
                    m = min(size, n - at)
                    rows.append((doc, at, m, zlib.crc32(raw[begin + 4 * at : begin + 4 * (at + m)]), n, -(-m // unit)))
                begin += 4 * n
            d, s, m, c, n, k = zip(*rows, strict=True)
            yield to_batch(_PIECES, doc_id=list(d), start=list(s), length=list(m), ids_crc32=list(c), doc_tokens=list(n), cls=list(k))

    return run


def _knapsack(value: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items that fits: value, and how many of each (unbounded knapsack)."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        n = int(np.searchsorted(sizes, c, "right"))  # sizes ascend
        best[c], pick[c] = best[c - 1], -1
        if n:
            v = value[:n] + best[c - sizes[:n]]
            j = int(v.argmax())
            if v[j] > best[c] + 1e-12:
                best[c], pick[c] = v[j], j
    count, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            count[pick[c]] += 1
            c -= sizes[pick[c]]
    return float(best[room]), count


def first_basis(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """A feasible basis: patterns of the longest item left and the fullest company for it, each used until a size is spent.

    The t-th pattern spends a size that no later one holds, so the patterns in
    order make a triangular matrix. Returns them, their amounts and their inverse.
    """
    left, live = demand.astype(float).copy(), np.ones(len(sizes), bool)
    patterns, amounts, order = [], [], []
    while live.any():
        on = np.flatnonzero(live)
        big = on[-1]
        pattern = np.zeros(len(sizes), np.int64)
        pattern[big] = 1
        if room - sizes[big] >= sizes[on[0]]:
            # a little more than its size for each unit, so that long items are used first
            _, more = _knapsack(sizes[on] * (1 + 1e-3 * sizes[on] / room), sizes[on], int(room - sizes[big]))
            pattern[on] += more
        held = np.flatnonzero(pattern)
        ratio = left[held] / pattern[held]
        spent = held[ratio.argmin()]
        amount = max(ratio.min(), 0.0)
        left -= pattern * amount
        left[spent] = 0.0
        live[spent] = False
        patterns.append(pattern)
        amounts.append(amount)
        order.append(spent)
    m = len(sizes)
    lower = np.stack(patterns, 1).astype(float)[order]
    solved = np.zeros((m, m))
    for i in range(m):
        on = np.flatnonzero(lower[i, :i])
        row = -(lower[i, on][:, None] * solved[on]).sum(0)
        row[i] += 1.0
        solved[i] = row / lower[i, i]
    inverse = np.zeros((m, m))
    inverse[:, order] = solved
    return patterns, np.array(amounts), inverse


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = 5e-4, most: int = 500) -> list[tuple[np.ndarray, float]]:
    """The linear relaxation: patterns and how often each is used.

    Revised simplex with an explicit basis inverse; each column is the knapsack
    optimum for the current duals. Stops when no column prices in, when the
    bound z / (best price), or the total size, is within `gap` of z (or half a
    sequence), or after `most` columns.
    """
    basis, x, inverse = first_basis(sizes, demand, room)
    least = float(demand @ sizes) / room
    for _ in range(most):
        z = x.sum()
        if z - least <= max(0.5, gap * z):
            break
        price, column = _knapsack(inverse.sum(0), sizes, room)
        if price <= 1 + 1e-9 or z - z / price <= max(0.5, gap * z):
            break
        d = inverse @ column
        up = np.flatnonzero(d > 1e-9)
        if not len(up):
            break
        r = up[(x[up] / d[up]).argmin()]
        step = x[r] / d[r]
        x -= step * d
        x[r] = step
        np.maximum(x, 0, out=x)
        row = inverse[r] / d[r]
        inverse -= np.outer(d, row)
        inverse[r] = row
        basis[r] = column
    return [(p, v) for p, v in zip(basis, x.tolist(), strict=True) if v > 1e-9]


def least_sequences(histogram: dict[int, int], room: int) -> int:
    """Sequences that no plan can do without: the total size, and a sequence for each item of more than half."""
    return max(-(-sum(s * n for s, n in histogram.items()) // room), sum(n for s, n in histogram.items() if 2 * s > room))


def plan_sequences(histogram: dict[int, int], room: int) -> tuple[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
    """histogram: items by size in units -> per size (first slot, sequences' base, slots per sequence) of its runs of slots, and the number of sequences."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = dict.fromkeys(histogram, 0)
    total = 0

    def take(size: int, per: int, times: int) -> None:
        runs.setdefault(size, []).append((used[size], total, per))
        used[size] += per * times

    small = {s: n for s, n in sorted(histogram.items()) if s < room and n}
    if histogram.get(room):
        take(room, 1, histogram[room])
        total += histogram[room]
    if small:
        sizes, left = np.array(list(small)), np.array(list(small.values()), np.int64)
        for pattern, amount in column_generation(sizes, left.astype(float), room):
            on = np.flatnonzero(pattern)
            times = min(int(amount + 1e-6), int((left[on] // pattern[on]).min()))
            if times:
                for i in on:
                    take(int(sizes[i]), int(pattern[i]), times)
                left -= pattern * times
                total += times
        open_at: list[list[dict[int, int]]] = [[] for _ in range(room + 1)]  # by free room: what each open sequence holds
        done: list[dict[int, int]] = []
        for i in range(len(sizes) - 1, -1, -1):
            s = int(sizes[i])
            for _ in range(int(left[i])):
                free = next((f for f in range(s, room + 1) if open_at[f]), None)
                seq = open_at[free].pop() if free is not None else {}
                seq[s] = seq.get(s, 0) + 1
                rest = (room if free is None else free) - s
                (open_at[rest] if rest >= sizes[0] else done).append(seq)
        for seq in [*done, *(q for held in open_at for q in held)]:
            for s, k in seq.items():
                take(s, k, 1)
            total += 1
    return {s: tuple(np.array(c) for c in zip(*r, strict=True)) for s, r in runs.items()}, total


def _place(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = plan.value
        for b in batches:
            cls, rank = b.column("cls").to_numpy(), b.column("rank").to_numpy()
            seq = np.zeros(len(cls), np.int64)
            for c in np.unique(cls):
                first, base, per = slots[int(c)]
                m = cls == c
                j = np.searchsorted(first, rank[m], "right") - 1
                seq[m] = base[j] + (rank[m] - first[j]) // per[j]
            yield to_batch(_PLACED, sequence_id=seq, **{k: b.column(k) for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")})

    return run


def pack(docs: DataFrame, length: int = LENGTH, unit: int = UNIT, tokenizer: str = TOKENIZER) -> DataFrame:
    """docs(doc_id, text) -> a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is empty: its one piece is the end id. Repeated rows are packed
    one by one; a null id is an id like others. Items of one size are
    interchangeable: ties go by id, start and checksum. No rows, no rows; extra
    columns are left out, whatever their names. The histogram (length / unit numbers) is all that reaches the
    driver; the plan sent back has a few runs per size. Ranks within a size are
    prefix sums over salts, so a size that a third of all pieces share is no
    single task's work.
    """
    if length % unit:
        raise ValueError("length must be a multiple of unit")
    pieces = saved(arrow_map(only(docs, doc_id="bigint", text="string"), _cut(length, unit, tokenizer), _PIECES))
    histogram = {r["cls"]: r["count"] for r in pieces.groupBy("cls").count().collect()}
    plan, _ = plan_sequences(histogram, length // unit)
    n = sum(histogram.values())
    salts = max(16, min(1 << 14, n >> 14))
    salt = F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int")
    ranked = running_sum(pieces.withColumn("_one", F.lit(1)), ["cls"], ["doc_id", "start", "ids_crc32"], "_one", "rank", salt, salts)
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "cls", F.col("rank").cast("bigint").alias("rank"))
    placed = arrow_map(ranked, _place(docs.sparkSession.sparkContext.broadcast(plan)), _PLACED)
    w = W.partitionBy("sequence_id").orderBy(F.col("length").desc(), "doc_id", "start", "ids_crc32").rowsBetween(W.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)))


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
