"""Substring dedup by fixed-block anchors.

Reference blocks are the non-overlapping blocks of 7 words of every text; every
rolling window of 7 words probes them. A repeat of 13 words or more contains a
whole block of either text, so a pair of texts that share one always meets.
Hits are extended to the repeats around them (the windows of 13 words that
hold a hit), whose 64-bit hashes are compared over the whole corpus: a window
that also starts in a document with a smaller id is removed, and neighbouring
windows unite to the maximal repeat.

Three passes over the chunks of exchange.py: (1) blocks and probes, with the
bits that a bucket answers; (2) the windows around hits, with the smallest id;
(3) removal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, U64, Words, mix, text_bytes
from .exchange import DIRECT, SENT, Question, ask, bits_of, dealt, member, planes, runs, sent_bits, unbits, unplanes

WINDOW, BLOCK = 13, 7
#: Bits of a probe's hash beyond the bucket number.
PROBE_BITS = 32
_OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_LAST = (1 << 63) - 1
_WHITE = [bytes([c]) for c in (0x20, *range(0x09, 0x0E))]


def _probes(bits: int) -> Question:
    """Is a hash a block of one text and a window of another? Load: in several texts, a block of one."""

    def merge(load: np.ndarray, first: np.ndarray) -> np.ndarray:
        several = np.diff(np.append(first, load.shape[1])) > 1
        either = np.logical_or.reduceat(load, first, axis=1) if len(first) else load
        either[0] |= several
        return either

    return Question(
        width=bits + PROBE_BITS,
        pack=lambda load: bits_of(*load), unpack=lambda raw, n: np.stack(unbits(raw, n, 2)),
        merge=merge, verdict=lambda load: load[0] & load[1], reply=lambda own, load, verdict: verdict,
        write=lambda h, reply: bits_of(reply), read=lambda raw, h: unbits(raw, len(h))[0],
    )


def _starts() -> Question:
    """Does a window start in a document with a smaller id? Load: the smallest id, of the chunk or of the group of chunks. The answer lists the hashes for which it does."""
    return Question(
        width=64,
        pack=lambda load: load[0].astype(np.int64).tobytes(), unpack=lambda raw, n: np.frombuffer(raw, np.int64)[None],
        merge=lambda load, first: np.minimum.reduceat(load, first, axis=1) if len(first) else load,
        verdict=lambda load: np.zeros(load.shape[1], bool), reply=lambda own, load, verdict: verdict | (load[0] < own[0]),
        write=lambda h, reply: planes(h[reply]), read=lambda raw, h: member(unplanes(raw), h),
    )


def _texts(t: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """Texts in the order of their ids (null last) and the ids (null: the largest long)."""
    t = t.combine_chunks()
    t = t.take(pa.compute.sort_indices(t, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))
    col = t.column("text").combine_chunks() if isinstance(t.column("text"), pa.ChunkedArray) else t.column("text")
    return col, pa.compute.fill_null(t.column("doc_id"), _LAST).to_numpy()


class _Chunk:
    """Word hashes of a chunk's texts, computed in slices; grams never cross texts."""

    def __init__(self, t: pa.Table):
        self.col, self.ids = _texts(t)
        hashes, counts = [], []
        _, off = text_bytes(self.col) if len(self.col) else (None, np.zeros(1, np.int64))
        at = 0
        while at < len(self.col):
            to = min(max(int(np.searchsorted(off, off[at] + SLICE, "right")) - 1, at + 1), len(self.col))
            w = Words(self.col.slice(at, to - at))
            hashes.append(w.hash)
            counts.append(w.count)
            at = to
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        self.count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.count)])

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, text and start of every window of k words."""
        h = self.hash
        if len(h) < k:
            return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        g = h[: len(h) - k + 1].copy()
        for j in range(1, k):
            g *= U64(0xD6E8FEB86659FD93)
            g += h[j : len(h) - k + 1 + j]
        left = np.repeat(self.at[1:], self.count) - np.arange(len(h))
        start = np.flatnonzero(left >= k)
        return mix(g[start]), np.repeat(np.arange(len(self.count)), self.count)[start], start


def _probe_keys(c: _Chunk, bits: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct short hashes of the windows; two rows: in several texts of the chunk, a block of one; and short hash and start of every window."""
    g, doc, start = c.grams(block)
    s = g >> U64(64 - PROBE_BITS - bits)
    order = np.argsort(s)
    first = runs(s[order])
    if not len(first):
        return s, np.zeros((2, 0), bool), s, start
    doc, at_block = doc[order], ((start - c.at[doc]) % block == 0)[order]
    several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
    return s[order[first]], np.stack([several, np.logical_or.reduceat(at_block, first)]), s, start


def _send(bits: int, block: int, direct: int):
    def run(t: pa.Table) -> pa.Table:
        distinct, load, _, _ = _probe_keys(_Chunk(t), bits, block)
        return _probes(bits).sent(t.column("chunk")[0].as_py(), distinct, load, sent_bits(bits, direct))

    return run


def _around_hits(c: _Chunk, start: np.ndarray, hit: np.ndarray, window: int, block: int) -> np.ndarray:
    """Starts of the windows of `window` words that hold a hit block window."""
    left = np.repeat(c.at[1:], c.count) - np.arange(len(c.hash))
    edge = np.zeros(len(c.hash) + 1, np.int64)
    p = start[hit]
    begin = np.repeat(c.at[:-1], c.count)
    np.add.at(edge, np.maximum(p - (window - block), begin[p]) if len(p) else p, 1)
    np.add.at(edge, p + 1, -1)
    return np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (left >= window))


def _ask(bits: int, window: int, block: int, direct: int):
    def run(key, texts: pa.Table, answers: pa.Table) -> pa.Table:
        q = _starts()
        if not texts.num_rows or not answers.num_rows:
            return q.sent(0, np.zeros(0, U64), np.zeros((1, 0), np.int64), sent_bits(bits, direct))
        c = _Chunk(texts)
        distinct, _, s, start = _probe_keys(c, bits, block)
        p = _around_hits(c, start, member(distinct[_probes(bits).learnt(answers, distinct)], s), window, block)
        g, doc, at = c.grams(window)
        k = np.searchsorted(at, p)
        g, doc = g[k], doc[k]
        order = np.lexsort((doc, g))  # texts are in the order of their ids
        first = runs(g[order])
        on = order[first]
        return q.sent(key[0].as_py(), g[on], c.ids[doc[on]][None], sent_bits(bits, direct))

    return run


def _removed(c: _Chunk, earlier: np.ndarray, window: int) -> np.ndarray:
    """Which words of the chunk go: those of windows that start in an earlier document, in the chunk or out of it."""
    g, doc, start = c.grams(window)
    gone = member(earlier, g)
    s = np.sort(g)
    twice = s[1:][s[1:] == s[:-1]]
    k = np.flatnonzero(member(twice, g))
    if len(k):
        order = np.lexsort((doc[k], g[k]))
        k = k[order]
        first = runs(g[k])
        least = np.repeat(c.ids[doc[k[first]]], np.diff(np.append(first, len(k))))
        gone[k] |= least < c.ids[doc[k]]
    edge = np.zeros(len(c.hash) + 1, np.int64)
    np.add.at(edge, start[gone], 1)
    np.add.at(edge, start[gone] + window, -1)
    return np.cumsum(edge[:-1]) > 0


def cut_out(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the words `gone`, each with the white space after it."""
    w = Words(pa.array([text], pa.binary()))
    nxt = np.append(w.start[1:], len(text))
    drop = np.flatnonzero(gone)
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, w.start[drop], 1)
    np.add.at(edge, nxt[drop], -1)
    return np.frombuffer(text, np.uint8)[np.cumsum(edge[:-1]) == 0].tobytes()


def _sha256(text: bytes, keep: np.ndarray, size: int = 1 << 20) -> str:
    """Of the words to keep, joined by a space, worked at `size` bytes at a time."""
    sha, at, first, gap = hashlib.sha256(), 0, 0, b""
    while at < len(text):
        to = at + size
        if to < len(text):  # not inside a word
            to = max(text.rfind(s, at, to) for s in _WHITE)
            if to < 0:
                to = min((x for s in _WHITE if (x := text.find(s, at + size)) >= 0), default=len(text))
            to += 1
        words = text[at:to].split()
        part = keep[first : first + len(words)]
        if not part.all():
            words = [words[j] for j in np.flatnonzero(part).tolist()]
        if words:
            sha.update(gap + b" ".join(words))
            gap = b" "
        at, first = to, first + len(part)
    return sha.hexdigest()


def _finish(window: int, with_text: bool, schema: pa.Schema):
    def run(key, texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return schema.empty_table()
        texts = texts.combine_chunks()
        texts = texts.take(pa.compute.sort_indices(texts, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))
        c = _Chunk(texts)
        earlier = [unplanes(r) for r in answers.column("answer").to_pylist()] if answers.num_rows else []
        gone = _removed(c, np.sort(np.concatenate(earlier)) if earlier else np.zeros(0, U64), window)
        data, off = text_bytes(c.col)
        n = len(c.count)
        removed = np.zeros(n, np.int64)
        shas, kept = [], []
        for i in range(n):
            text = data[off[i] : off[i + 1]].tobytes()
            g = gone[c.at[i] : c.at[i + 1]]
            removed[i] = g.sum()
            if with_text:
                kept.append(cut_out(text, g) if removed[i] else text)
            else:
                shas.append(_sha256(text, ~g))
        out = {"doc_id": texts.column("doc_id"), "n_words": pa.array(c.count, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
        if with_text:
            null = texts.column("text").is_null().to_pylist()
            out["kept_text"] = pa.array([None if z else k.decode("utf-8", "replace") for z, k in zip(null, kept, strict=True)], pa.string())
        else:
            out["kept_sha256"] = pa.array(shas, pa.string())
        return pa.table({f.name: out[f.name] if f.name in out else texts.column(f.name) for f in schema}).cast(schema)

    return run


def remove_repeats(docs: DataFrame, with_text: bool = False, window: int = WINDOW, block: int = BLOCK, direct: int = DIRECT) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_removed and kept_sha256, or with with_text kept_text (the text without the removed words).

    Null texts have no words (kept_text stays null); a null id is larger than
    any other; rows that share an id never remove from each other, so repeated
    rows fare alike. No rows, no rows. With with_text the extra columns of docs
    come along in a struct column `rest`, whatever their names.

    Windows are compared by 64-bit hashes: among n distinct repeated windows a
    false match has odds of about n^2 / 2^65. Probes use 32 bits beyond the
    bucket number; a false hit there only costs a comparison.
    """
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block wherever it starts")
    extra = [c for c in docs.columns if c not in ("doc_id", "text")] if with_text else []
    cols = {"doc_id": "bigint", "text": "string"}
    if extra:
        docs = docs.select("doc_id", "text", F.struct(*(docs[c] for c in extra)).alias("rest"))
        cols["rest"] = docs.schema["rest"].dataType.simpleString()
    d, parts, bits = dealt(docs, **cols)
    q = [_probes(bits), _starts()]
    sent = d.groupBy("chunk").applyInArrow(_send(bits, block, direct), SENT)
    answers, _ = ask(sent, q[0], parts, bits, direct)
    asked = d.groupBy("chunk").cogroup(answers.repartition(parts, "chunk").groupBy("chunk")).applyInArrow(_ask(bits, window, block, direct), SENT)
    earlier, _ = ask(asked, q[1], parts, bits, direct)
    if with_text:
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import LongType, StringType, StructField, StructType

        out = StructType([StructField("doc_id", LongType()), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType()), *(d.schema[c] for c in cols if c == "rest")])
        arrow = to_arrow_schema(out)
    else:
        out = _OUT
        arrow = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
    return d.groupBy("chunk").cogroup(earlier.repartition(parts, "chunk").groupBy("chunk")).applyInArrow(_finish(window, with_text, arrow), out)


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs, all rows and columns, with the repeated passages cut out of text; n_chars, where there is one, follows a text that was cut.

    As remove_repeats: null texts and ids, repeated rows and empty tables; other columns stay as they are, whatever their names.
    """
    cut = remove_repeats(docs, with_text=True, **options)
    changed = F.col("n_removed") > 0
    cols = []
    for c in docs.columns:
        if c == "doc_id":
            cols.append(F.col("doc_id").cast(docs.schema[c].dataType).alias(c))
        elif c == "text":
            cols.append(F.col("kept_text").alias(c))
        elif c == "n_chars":
            cols.append(F.when(changed, F.length("kept_text")).otherwise(F.col("rest").getField(c)).cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col("rest").getField(c).alias(c))
    return cut.select(*cols)


def op6_substrings(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS s FROM d, LATERAL (SELECT unnest(range(1, len(w) - 11)) AS i) WHERE len(w) >= 13),
m AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s HAVING min(doc_id) <> max(doc_id)),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN m USING (s) WHERE m.first < g.doc_id),
a AS (SELECT doc_id, list(p) AS gone FROM r GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n, coalesce(len(gone), 0) AS x,
        CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(gone, p)), lambda p: w[p]) END AS keep
      FROM d LEFT JOIN a ON d.doc_id = a.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(x AS BIGINT) AS n_removed, sha256(array_to_string(keep, ' ')) AS kept_sha256 FROM k
"""
