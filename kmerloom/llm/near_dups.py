"""Near-duplicates by DartMinHash signatures, banded joining and exact checks.

Darts are a random point set over (element, weight height, rank), the same for
every document; each dart also has a coordinate of the signature. A document
sees the darts inside its elements' weight regions up to a rank that leaves
some k log k + 2k of them, and keeps the earliest of each coordinate, so its
cost follows the darts, not elements times k. Two documents share a coordinate
with the probability of their weighted Jaccard similarity.

Documents with the same words are one text. Texts that share a band are
candidates, and every pair of candidates is either compared exactly or known to
be in one class already. First each band's texts are compared with one of them,
the one with most company (the original, where copies have one), which costs as
many comparisons as there are texts. Bands whose other texts are then still of
different classes go on, with another pivot, and at last what is left of a band
is compared in blocks of bounded size: all pairs, but for those within the
band's largest class. Bands with the same texts are one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, arrow_map, if_small, mix, only, saved, slices, to_batch
from .components import HEAVY, components, heavy_keys, split_join

SHINGLE = 5
#: At similarity 0.8 a pair shares no band with probability (1 - 0.8^5)^27 = 2e-5.
BANDS, ROWS = 27, 5
#: Similarity 4/5 or more.
NUM, DEN = 4, 5
#: Texts of a block: of those that one is compared with, and on a side of all pairs.
STAR, BLOCK = 64, 256
#: Pivots of a band before all pairs of its texts are compared.
PIVOTS = 2
#: Elements whose darts are thrown at a time.
ELEMENTS = 1 << 18
_STEP = U64(0x9E3779B97F4A7C15)
#: Rank cells: short ones first, for documents of many elements, which need only the lowest ranks.
_EDGES = np.concatenate([[0.0, 0.03125, 0.0625, 0.125, 0.25, 0.5], np.arange(1.0, 1 << 14)])
_SKETCH = "doc_id long, h1 long, h2 long, n_words long, bands array<long>"
_SETS = "h1 long, h2 long, shingles binary"
_EDGE = "a long, b long"


def _poisson(u: np.ndarray, area: np.ndarray) -> np.ndarray:
    """The Poisson count of that mean at each uniform."""
    p = np.exp(-area)
    total = p.copy()
    n = np.zeros(len(u), np.int64)
    more = np.flatnonzero(u > total)
    k = 0
    while len(more) and k < 40:
        k += 1
        n[more] = k
        p[more] *= area[more] / k
        total[more] += p[more]
        more = more[u[more] > total[more]]
    return n


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> U64(11)).astype(np.float64) * 2.0**-53


def _throw(elements: np.ndarray, top: np.ndarray | None, owner: np.ndarray, limit: np.ndarray, on: np.ndarray, cells: np.ndarray, k: int, out: np.ndarray) -> None:
    """The darts of some elements, each in its first cells, kept where they are the earliest of their set and coordinate."""
    e = np.repeat(on, cells)
    c = np.arange(len(e)) - np.repeat(np.cumsum(cells) - cells, cells)
    lo, length = _EDGES[c], _EDGES[c + 1] - _EDGES[c]
    seed = mix(elements[e] ^ ((c + 1).astype(U64) * _STEP))
    n = _poisson(_uniform(seed), length)
    d = np.repeat(np.arange(len(e)), n)
    j = np.arange(len(d)) - np.repeat(np.cumsum(n) - n, n)
    h = mix(seed[d] + (j + 1).astype(U64) * _STEP)
    rank = lo[d] + length[d] * _uniform(h)
    who = owner[e[d]]
    ok = rank < limit[who]
    if top is not None:
        ok &= _uniform(mix(h ^ U64(0x5851F42D4C957F2D))) < top[e[d]]
    h, rank, who = h[ok], rank[ok], who[ok]
    coordinate = (mix(h + _STEP) % U64(k)).astype(np.int64)
    # rank first, then the dart's own bits
    value = ((rank * 2.0**18).astype(U64) << U64(32)) | (mix(h ^ _STEP) >> U64(32))
    np.minimum.at(out, who * k + coordinate, value)


def signatures(elements: np.ndarray, weights: np.ndarray | None, at: np.ndarray, k: int) -> np.ndarray:
    """DartMinHash of the weighted sets elements[at[i]:at[i+1]] -> (sets, k) values; a set without elements gets zeros.

    weights: None for 1 each. Heights are cells of length 1, the last cut at
    the weight.
    """
    n_sets = len(at) - 1
    owner = np.repeat(np.arange(n_sets), np.diff(at))
    top = None
    if weights is not None:
        whole = np.ceil(weights).astype(np.int64)
        base = np.repeat(np.arange(len(elements)), whole)
        height = np.arange(len(base)) - np.repeat(np.cumsum(whole) - whole, whole)
        top = np.minimum(weights[base] - height, 1.0)
        elements, owner = mix(elements[base] + height.astype(U64) * _STEP), owner[base]
        size = np.bincount(owner, top, minlength=n_sets)
    else:
        size = np.diff(at).astype(float)
    darts = k * math.log(k) + 2 * k
    out = np.full(n_sets * k, np.iinfo(np.uint64).max, U64)
    limit = np.where(size > 0, darts / np.maximum(size, 1e-9), 0.0)
    todo = size > 0
    while todo.any():
        on = np.flatnonzero(todo[owner])
        cells = np.searchsorted(_EDGES, limit[owner[on]], "left")
        cut = np.append(np.arange(0, len(on), ELEMENTS), len(on))
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            _throw(elements, top, owner, limit, on[lo:hi], cells[lo:hi], k, out)
        empty = (out.reshape(n_sets, k) == np.iinfo(np.uint64).max).any(1)
        todo &= empty & (limit < _EDGES[-2])
        limit = np.where(todo, np.minimum(limit * 2, _EDGES[-2]), limit)
    return out.reshape(n_sets, k)


def shingle_sets(w: Words, counts: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text (sorted), their weights (counts, or None), where each text's begin, and a 128-bit fingerprint of its words.

    A text of 1 to 4 words has one shingle, all of it; a text without words none.
    """
    n = len(w.count)
    first = np.zeros(len(w.hash), bool)
    first[w.at[:-1][w.count > 0]] = True
    place = np.arange(len(w.hash)) - np.repeat(w.at[:-1], w.count)
    prints = [sums_hash(mix(w.hash + (place + 1).astype(U64) * U64(s)), w.at) for s in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
    g = w.grams(SHINGLE)
    ok = np.flatnonzero(w.left()[: len(g)] >= SHINGLE)
    short = np.flatnonzero((w.count > 0) & (w.count < SHINGLE))
    h = np.concatenate([g[ok], mix(prints[0][short])])
    d = np.concatenate([w.doc()[ok], short])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.searchsorted(d[new], np.arange(n + 1))
    weight = np.diff(np.append(np.flatnonzero(new), len(h))).astype(float) if counts else None
    return h[new], weight, at, prints[0], prints[1]


def sums_hash(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1, U64)
    np.cumsum(x, out=total[1:])
    return mix(total[at[1:]] - total[at[:-1]])


def _sketch(counts: bool, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = Words(b.column("text"))
            x, weight, at, h1, h2 = shingle_sets(w, counts)
            sig = signatures(x, weight, at, bands * rows).reshape(-1, bands, rows)
            key = np.zeros(sig.shape[:2], U64) + np.arange(1, bands + 1, dtype=np.uint64) * _STEP
            for r in range(rows):
                key = mix(key ^ sig[:, :, r]) + U64(r)
            has = w.count > 0
            keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32)), pa.array(key[has].ravel().view(np.int64)))
            yield to_batch(_SKETCH, doc_id=b.column("doc_id"), h1=h1.view(np.int64), h2=h2.view(np.int64), n_words=w.count, bands=keys)

    return run


def _sets(counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x, weight, at, h1, h2 = shingle_sets(Words(b.column("text")), counts)
            if weight is not None:  # the j-th occurrence is an element of its own: sizes and overlaps become weighted
                k = weight.astype(np.int64)
                base = np.repeat(np.arange(len(x)), k)
                x = mix(x[base] + (np.arange(len(base)) - np.repeat(np.cumsum(k) - k, k)).astype(U64) * _STEP)
                at = np.concatenate([[0], np.cumsum(k)])[at]
                for i in range(b.num_rows):
                    x[at[i] : at[i + 1]].sort()
            yield to_batch(_SETS, h1=h1.view(np.int64), h2=h2.view(np.int64), shingles=[x[at[i] : at[i + 1]].tobytes() for i in range(b.num_rows)])

    return run


def linked(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """For each set the first set of its component under |a & b| / |a | b| >= num / den, exactly."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    everything = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(everything, kind="stable")
    everything, owner = everything[order], owner[order]
    group = np.cumsum(np.append(False, everything[1:] != everything[:-1]))
    shared = np.bincount(group)[group] > 1
    group, owner = group[shared], owner[shared]
    both = np.zeros((n, n))
    if len(group):
        group = np.cumsum(np.append(False, group[1:] != group[:-1]))
        for lo in range(0, int(group[-1]) + 1, 4096):
            m = (group >= lo) & (group < lo + 4096)
            part = np.zeros((n, 4096), np.float32)
            part[owner[m], group[m] - lo] = 1
            both += part @ part.T
    near = both * (num + den) >= num * (size[:, None] + size[None, :]) - 1e-6
    np.fill_diagonal(near, True)
    label = np.arange(n)
    while True:
        new = np.where(near, label[None, :], n).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _unpacked(t: pa.Table) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Nodes (each once, ascending), their sets, and the row of each."""
    node, row = np.unique(t.column("node").to_numpy(), return_index=True)
    raw = t.column("shingles").to_pylist()
    return node, [np.frombuffer(raw[i], np.uint64) for i in row], row


def _star(num: int, den: int):
    """Links of a block's texts to the one they are compared with."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        node, sets, _ = _unpacked(t)
        pivot = key[0].as_py()
        centre = sets[int(np.searchsorted(node, pivot))]
        size = np.array([len(x) for x in sets])
        at = np.searchsorted(centre, np.concatenate(sets))
        both = np.add.reduceat(centre[np.minimum(at, len(centre) - 1)] == np.concatenate(sets), np.cumsum(size) - size)
        near = both * (num + den) >= num * (size + len(centre))
        b = node[near & (node != pivot)]
        return pa.table({"a": pa.array(np.full(len(b), pivot), pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _compare(num: int, den: int):
    """Links between texts of two blocks that aren't of one class yet."""

    def run(t: pa.Table) -> pa.Table:
        node, sets, row = _unpacked(t)
        label = t.column("label").to_numpy()[row]
        if (label == label[0]).all():
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        top = linked(sets, num, den)
        on = np.flatnonzero((node[top] != node) & (label[top] != label))
        return pa.table({"a": pa.array(node[top[on]], pa.int64()), "b": pa.array(node[on], pa.int64())})

    return run


def _bands_once(live: DataFrame) -> DataFrame:
    """live(node, key) without the bands of one text, and one of those with the same texts."""
    bands = live.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("s"), F.min("node").alias("least")).where("n > 1")
    return bands.groupBy("n", "s", "least").agg(F.min("key").alias("key")).select("key", "n")


def _blocks(live: DataFrame, labels: DataFrame | None, total: int, block: int = BLOCK, heavy: int = HEAVY) -> DataFrame:
    """live(node, key, n) -> node, key, label, i, j: a row for each pair of blocks (i, j) of its band that a text is in.

    Any two texts of a band and of different classes meet in a pair of blocks.
    The texts of the band's largest class meet those of the others alone, so a
    class costs as many rows as it has texts for each block of others.
    """
    d = live.select("node", "key", "n")
    d = d.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")) if labels is not None else d.withColumn("label", F.col("node"))
    d = saved(d)
    of_class = d.groupBy("key", "n", "label").agg(F.count("*").alias("c"))
    bands = of_class.groupBy("key", "n").agg(F.max(F.struct("c", "label")).alias("m")).select("key", "n", F.col("m.c").alias("c"), F.col("m.label").alias("largest")).where("c < n")
    bands = saved(bands)
    d = split_join(d.drop("n"), bands, "key", "node", heavy_keys(bands.select("key", "n"), "key", total, heavy))
    mine, theirs = (F.ceil(x / block).cast("int") for x in (F.col("c"), F.col("n") - F.col("c")))
    d = d.select("node", "key", "label", (F.col("label") == F.col("largest")).alias("inner"), mine.alias("mine"), theirs.alias("theirs"))
    h = F.xxhash64("node", "key")
    d = d.withColumn("block", F.when(F.col("inner"), F.pmod(h, F.col("mine"))).otherwise(F.col("mine") + F.pmod(h, F.col("theirs"))).cast("int"))
    other = F.explode(F.sequence(F.when(F.col("inner"), F.col("mine")).otherwise(F.lit(0)), F.col("mine") + F.col("theirs") - 1))
    return d.select("node", "key", "label", "block", other.alias("other")).select("node", "key", "label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def near_duplicates(docs: DataFrame, weights: str = "unit", bands: int = BANDS, rows: int = ROWS, num: int = NUM, den: int = DEN, pivots: int = PIVOTS, block: int = BLOCK, heavy: int = HEAVY) -> DataFrame:
    """docs(doc_id, text) -> doc_id, class_id (the smallest id of its class), one row per input row.

    Two texts are linked when the Jaccard similarity of their 5-word shingles
    (sets; with weights="count" multisets, whose signatures are weighted) is
    num/den or more, or when their words are equal; classes are the components.
    Texts without words (null, empty) are alone, as are rows with a null id
    (class null). A row has the class of its text, so repeated rows share one,
    and rows that share an id but no text may not. No rows, no rows; extra
    columns are left out, whatever their names.

    Cost: linear, but for bands whose texts are alike without being near any of
    the `pivots` texts of the band that all others are compared with: their
    pairs are compared block by block (`block` texts a side), those within the
    largest class left out. A task holds two
    blocks and emits at most one link per text.
    """
    counts = weights == "count"
    d = only(docs, doc_id="bigint", text="string")
    sketch = saved(arrow_map(d, _sketch(counts, bands, rows), _SKETCH))
    named = sketch.where("doc_id is not null and n_words > 0")
    texts = named.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands"))
    texts = saved(texts.withColumn("node", F.monotonically_increasing_id()))
    keys = saved(texts.select("node", F.explode("bands").alias("key")).distinct())
    total = keys.count()

    def of(live: DataFrame, wanted: DataFrame) -> DataFrame:
        """The rows of live of the wanted bands (key, n)."""
        wanted = saved(wanted)
        return saved(split_join(live, wanted, "key", "node", heavy_keys(wanted, "key", total, heavy)))

    live = of(keys, _bands_once(keys))
    ids = saved(texts.join(live.select("node").distinct(), "node").select("node", "rep", "h1", "h2"))
    some = d.join(if_small(ids.select(F.col("rep").alias("doc_id")).distinct()), "doc_id")
    sets = saved(arrow_map(some, _sets(counts), _SETS).join(ids.select("node", "h1", "h2"), ["h1", "h2"]).select("node", "shingles"))
    links, labels = None, None
    for _ in range(pivots):
        if live.isEmpty():
            break
        # of a band's texts the one with most company; the smallest node on ties
        own = live.groupBy("node").agg(F.sum("n").alias("company"), F.collect_list(F.struct("key", "n")).alias("own")).select("node", "company", F.explode("own").alias("band"))
        most = saved(own.groupBy("band.key", "band.n").agg(F.min(F.struct((-F.col("company")).alias("c"), "node")).alias("m")).select("key", "n", F.col("m.node").alias("pivot")))
        hot = heavy_keys(most.select("key", "n"), "key", total, heavy)
        each = saved(split_join(live.select("key", "node"), most, "key", "node", hot))
        pairs = saved(each.where("pivot <> node").select("pivot", "node").distinct())
        blocks = saved(pairs.groupBy("pivot").agg(F.count("*").alias("n")))
        of_pivot = blocks.select("pivot", F.ceil(F.col("n") / STAR).cast("int").alias("blocks"))
        dealt = split_join(pairs, of_pivot, "pivot", "node", heavy_keys(blocks, "pivot", total, heavy)).select("pivot", "node", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
        centres = of_pivot.select("pivot", F.col("pivot").alias("node"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        found = dealt.unionByName(centres).join(sets, "node").groupBy("pivot", "block").applyInArrow(_star(num, den), _EDGE)
        links = saved(found if links is None else found.unionByName(links))
        labels = components(links, heavy=heavy)
        live = each.where("pivot <> node").select("node", "key").join(labels, "node", "left").select("node", "key", F.coalesce("label", "node").alias("label"))
        live = saved(live)
        split = live.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
        left = live.join(split, "key", "left_semi")
        live = of(left.select("node", "key"), _bands_once(left.select("node", "key")))
    if not live.isEmpty():
        spot = _blocks(live, labels, total, block, heavy)
        found = spot.join(sets, "node").groupBy("key", "i", "j").applyInArrow(_compare(num, den), _EDGE)
        links = saved(found if links is None else found.unionByName(links))
        labels = components(links, heavy=heavy)
    same = texts.select("h1", "h2", "rep", "node")
    if labels is not None:
        least = texts.join(labels, "node").groupBy("label").agg(F.min("rep").alias("class"))
        of_node = labels.join(least, "label").select("node", "class")
        same = same.join(of_node, "node", "left").select("h1", "h2", F.coalesce("class", "rep").alias("class"))
    else:
        same = same.select("h1", "h2", F.col("rep").alias("class"))
    same = saved(same)
    out = sketch.select("doc_id", "h1", "h2").join(same, ["h1", "h2"], "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id")).alias("class_id"))


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, that stand for their class: one row of each class (the smallest id), and those with a null id.

    Where ids repeat, classes are of rows: of rows with equal words one stays,
    by the smallest id and then by a hash of its columns; rows of one id and
    different classes all stay. Rows without words (null, empty) are alone and
    stay. An empty table stays empty; extra columns may have any names.
    """
    known = docs.where(docs["doc_id"].isNotNull())
    if known.groupBy("doc_id").count().where("count > 1").isEmpty():
        classes = near_duplicates(docs, **options)
        gone = saved(classes.where("class_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct())
        return docs.join(if_small(gone), docs["doc_id"] == F.col("_gone"), "left_anti")
    rows = saved(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.monotonically_increasing_id().alias("rid")))
    own = rows.where("row.doc_id is not null")
    classes = near_duplicates(own.select(F.col("rid").alias("doc_id"), F.col("row.text").alias("text")), **options)
    first = own.select("rid", F.struct("row.doc_id", F.md5(F.to_json("row").cast("binary")).alias("h"), "rid").alias("by")).join(classes, F.col("rid") == F.col("doc_id"))
    stays = saved(first.groupBy("class_id").agg(F.min("by").alias("by")).select(F.col("by.rid").alias("rid")))
    return rows.join(stays, "rid", "left_semi").select("row.*").unionByName(rows.where("row.doc_id is null").select("row.*"))


def op9_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All pairs of texts that share a shingle, by the definition; classes by the smallest id that reaches a document.
OP9_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END AS s FROM d),
s AS (SELECT DISTINCT doc_id, x FROM (SELECT doc_id, unnest(s) AS x FROM g)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 9 * c >= 4 * (a.n + b.n)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, least) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.least FROM r JOIN l ON l.x = r.doc_id WHERE r.least < l.y)
SELECT doc_id, min(least) AS class_id FROM r GROUP BY doc_id
"""
