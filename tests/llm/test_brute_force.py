"""The registered queries against plain Python at the smallest scale factor."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from kmerloom.llm import common, exchange, langid, licences, lm, mixing, near_dups, packing, quality, queries, search, subwords, substrings, toxicity


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def split(text):
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = c.sql(queries.ORACLES[name])
    at = [want.columns.index(x) for x in df.columns]
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, (tuple(r[i] for i in at) for r in want.fetchall())))


def test_search_prunes_without_loss(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=24).round(2).tolist()) for i in range(300)]
    v = search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in search.top_k(v.where("vec_id % 50 = 0"), v, levels=(2, 6, 12)).collect()}
    x = np.array([[math.floor(256 * c) for c in e] for _, e in rows])
    for q in range(0, 300, 50):
        s = x @ x[q]
        best = sorted((-int(s[i]), i) for i in range(300) if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]


def test_search_in_groups(spark):
    rng = np.random.default_rng(12)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(200)] + [(i, rng.normal(size=5).tolist()) for i in range(200, 260)] + [(7, [1.0] * 8)] * 30
    v = search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    q = v.where("vec_id % 10 = 0")
    want = sorted(map(tuple, search.top_k(q, v).collect()))
    assert sorted(map(tuple, search.top_k(q, v, query_bytes=500).collect())) == want
    plan = search.top_k(q, v, query_bytes=500)._jdf.queryExecution().toString()
    assert "hashpartitioning(dim" not in plan


def test_quality(spark, sf, docs):
    for r in queries.QUERIES["op2_quality"](spark, sf).collect():
        text = docs[r.doc_id].text
        words = split(text)
        lines = [x for x in text.split("\n") if split(x)]
        grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        hit = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        want = (len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 20 or 100 * len(hit) > 30 * len(words))
        assert not (r.base_failed and r.kept)


def test_decision_list():
    rng = np.random.default_rng(1)
    x = {"a": rng.random(900), "b": rng.random(900)}
    bad = (x["a"] > 0.7) & (x["b"] <= 0.4) | (x["b"] > 0.9)
    rules = quality.learn_list(x, bad)
    hit = np.zeros(900, bool)
    for r in rules:
        hit |= quality._all(r, x, 900)
    assert (hit == bad).mean() > 0.95
    assert quality.learn_list(x, rng.random(900) < 0.3) == [] or len(quality.learn_list(x, rng.random(900) < 0.3)) < 3


def test_packing_round_trip(spark, sf, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(subwords.tokenizer_path())
    found = queries.QUERIES["op4_packing"](spark, sf).collect()
    by_doc, by_seq = {}, {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == docs.keys()
    for i, d in docs.items():
        ids = [*tok.encode(d.text, add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert sum(r.length for r in found) > 0.97 * 1024 * len(by_seq)
    sizes = Counter(-(-r.length // packing.UNIT) for r in found)
    assert len(by_seq) <= 1.005 * packing.least_sequences(sizes, 1024 // packing.UNIT) + 1


def test_column_generation_reaches_the_bound():
    sizes, demand = np.array([3, 5, 7]), np.array([40.0, 30.0, 20.0])
    used = packing.column_generation(sizes, demand, 10, gap=0, most=100)
    assert sum(p * v for p, v in used) == pytest.approx(demand)
    assert all(p @ sizes <= 10 for p, _ in used)
    # 7+3, 5+5, 3+3+3: 20 + 15 + 20/3
    assert sum(v for _, v in used) == pytest.approx(20 + 15 + 20 / 3, abs=0.5)
    runs, total = packing.plan_sequences({3: 40, 5: 30, 7: 20, 10: 4}, 10)
    assert total <= 4 + 43


def test_pieces_give_the_tokenizer_s_ids():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(subwords.tokenizer_path()), subwords.Encoder()
    assert enc.merge is not None
    text = st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "it's", "'ll", "Zü", "12", "…", "?!", " ", "　", "\x1c", "<|endoftext|>", "漢"]), max_size=12).map("".join)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(text, min_size=1, max_size=4))
    def same(ts):
        for t, ids in zip(ts, enc.ids(ts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids

    same()


def test_long_texts_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    words = ["a", "it's", "Zü", "12", "…", "漢字", "longerword", "\n", "  "]
    text = " ".join(words[i] for i in rng.integers(0, len(words), 3_000))
    enc = subwords.shared_encoder()
    want = enc.ids([text, "", "short"])
    assert want == [enc.ids([t])[0] for t in (text, "", "short")]
    monkeypatch.setattr(subwords, "PART", 50)
    assert enc.ids([text, "", "short"]) == want
    raw = text.encode() + b"x" * 300 + b"\t\x0b end "
    found = raw.split()
    for keep in (np.ones(len(found), bool), np.zeros(len(found), bool), rng.random(len(found)) < 0.5):
        kept = b" ".join(w for w, k in zip(found, keep, strict=True) if k)
        for size in (1, 7, 64, 1 << 20):
            assert substrings._sha256(raw, keep, size) == hashlib.sha256(kept).hexdigest()


def test_language_on_held_out(spark, sf, docs):
    rows = [r for r in queries.QUERIES["op5_language"](spark, sf).collect() if r.held_out]
    assert {r.doc_id for r in rows} == {i for i in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in rows]) >= 0.9


def test_language_mixture():
    rng = np.random.default_rng(0)
    words = np.where(rng.random((400, 1)) < 0.7, [[-2.0, -9.0, -9.0]], [[-9.0, -2.0, -9.0]])
    every, pi, size = langid.mixtures(words.astype(np.float32), np.array([0, 400]))
    assert size[0] == 2 and pi[0, 0] == pytest.approx(0.7, abs=0.06) and pi[0, 2] == 0 and every[0, 0] == pytest.approx(0.7, abs=0.06)
    # five languages in equal parts: the set may hold them all
    five = np.full((500, 6), -12.0)
    five[np.arange(500), np.arange(500) % 5] = -2
    assert langid.mixtures(five, np.array([0, 500]))[2][0] == 5
    pure = np.tile(np.float32([[-2.0, -9.0, -9.0]]), (50, 1))
    assert langid.mixtures(pure, np.array([0, 50]))[2][0] == 1


def test_toxicity_locates_sentences(spark):
    rng = np.random.default_rng(4)
    plain = [f"word{i}" for i in range(40)]
    rows, labels = [], []
    for i in range(400):
        body = [" ".join(rng.choice(plain, 6)) for _ in range(5)]
        bad = i % 4 == 0
        if bad:
            body[2] = f"you {rng.choice(['vilething', 'meanthing'])} word1"
        rows.append((i, ". ".join(body)))
        labels.append((i, int(bad)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.score(d, toxicity.fit(d, lab)).collect()
    for r in out:
        assert (r.score >= 0.5) == (r.doc_id % 4 == 0)
        if r.score >= 0.5:
            assert "thing" in rows[r.doc_id][1][r.worst_start : r.worst_end] and r.n_toxic == 1


def test_licences(spark, sf, docs):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in queries.QUERIES["op8_licences"](spark, sf).collect():
        words = word.findall((docs[r.doc_id].text or "").translate(low))
        places, labels = [], set()
        for phrase, label in licences.PHRASES.items():
            p = phrase.split()
            at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(",")) | (set() if labels else labels)


def test_automaton_statistics():
    rng = np.random.default_rng(5)
    seqs = [rng.integers(0, 4, n).tolist() for n in (30, 12, 25)]
    text = rng.integers(0, 5, 300).tolist()
    grams = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    auto = licences.Automaton(seqs)
    for i, (v, n) in enumerate(auto.stream(text)):
        assert n == max((k for k in range(1, i + 2) if tuple(text[i + 1 - k : i + 1]) in grams), default=0)
        for t, end in auto.ends[v] if n else []:
            assert seqs[t][end - n + 1 : end + 1] == text[i + 1 - n : i + 1]


def test_long_template_with_a_gap():
    t = licences.TEMPLATES["mit"][1].split()
    s = licences.Scanner()
    text = "intro " + " ".join(t[:30]) + " inserted words here " + " ".join(t[30:]) + " outro"
    r = s.scan(pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})).to_pylist()[0]
    assert r["labels"] == "mit" and 0.9 < r["score"] <= 1


def classes(texts, counts=False):
    sets = {i: Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter() for i, w in texts.items()}
    if not counts:
        sets = {i: Counter(dict.fromkeys(c, 1)) for i, c in sets.items()}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if min(len(x), len(y)) * 5 >= max(len(x), len(y)) and x and (both := sum((x & y).values())) and 9 * both >= 4 * (sum(x.values()) + sum(y.values())):
                p, q = find(ids[a]), find(ids[b])
                top[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


def test_near_duplicates(spark, sf, docs):
    got = {r.doc_id: r.class_id for r in queries.QUERIES["op9_near_duplicates"](spark, sf).collect()}
    assert got == classes({i: split(d.text) for i, d in docs.items()})


def test_near_duplicates_around_a_hidden_centre(spark):
    """Copies that are like their original but not like each other."""
    rng = np.random.default_rng(6)
    base = [f"b{i}" for i in range(120)]
    texts = {0: " ".join(f"x{i}" for i in range(60))}
    for i in range(1, 60):
        w = list(base)
        for j in rng.choice(120, int(rng.integers(1, 4)), replace=False):
            w[j] = f"n{i}_{j}"
        texts[i] = " ".join(w if i != 30 else base)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for weights in ("unit", "count"):
        got = {r.doc_id: r.class_id for r in near_dups.near_duplicates(d, weights=weights).collect()}
        assert got == classes({i: split(t) for i, t in texts.items()}, weights == "count")


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(7)
    x = rng.integers(1, 1 << 62, 300, dtype=np.uint64)
    w1, w2 = rng.random(300) * 3, rng.random(300) * 3
    both = near_dups.signatures(np.concatenate([x, x]), np.concatenate([w1, w2]), np.array([0, 300, 600]), 1024)
    assert (both[0] == both[1]).mean() == pytest.approx(np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum(), abs=0.06)
    one = near_dups.signatures(x, None, np.array([0, 300, 300]), 64)
    assert (one[0] != np.iinfo(np.uint64).max).all()
    tiny = near_dups.signatures(x[:1], None, np.array([0, 1]), 135)
    assert (tiny != np.iinfo(np.uint64).max).all()


def test_groups_without_a_centre_and_hot_bands(spark):
    """A chain whose neighbours are alike, and a band that most texts share: no pivot is near them all."""
    words = [f"c{i}" for i in range(400)]
    texts = {i: " ".join(words[4 * i : 4 * i + 100]) for i in range(60)}
    texts |= {100 + i: " ".join([*(f"same{j}" for j in range(60)), *(f"own{i}_{j}" for j in range(40))]) for i in range(40)}
    texts |= {200 + i: texts[5] for i in range(30)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = classes({i: split(t) for i, t in texts.items()})
    for options in ({}, {"pivots": 0, "block": 7}, {"pivots": 1, "block": 5, "heavy": 3}, {"pivots": 3, "block": 2}):
        assert {r.doc_id: r.class_id for r in near_dups.near_duplicates(d, **options).collect()} == want


def test_blocks_of_a_large_class_grow_with_its_texts(spark):
    """A band with one large class and a few other texts: all pairs of different classes meet, in about a row a text and block of others."""
    for n in (60, 120):
        live = spark.range(n).selectExpr("id AS node", "7L AS key", f"{n}L AS n")
        labels = spark.range(n - 4).selectExpr("id AS node", "0L AS label")
        rows = near_dups._blocks(live, labels, n, block=6).collect()
        assert len(rows) == (n - 4) + 4 * (-(-(n - 4) // 6) + 1)
        groups = {}
        for r in rows:
            groups.setdefault((r.i, r.j), set()).add(r.node)
        met = {(a, b) for g in groups.values() for a in g for b in g if a < b}
        assert met >= {(a, b) for b in range(n - 4, n) for a in range(b)}


def test_rows_of_one_id_have_the_class_of_their_text(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    d = spark.createDataFrame([(1, a), (5, a), (5, b), (5, b), (7, None), (7, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id) for r in near_dups.near_duplicates(d).collect())
    assert got == [(1, 1), (5, 1), (5, 5), (5, 5), (7, 7), (7, 7)]
    kept = sorted((r.doc_id, r.text or "") for r in near_dups.without_near_duplicates(d).collect())
    assert kept == [(1, a), (5, b), (7, ""), (7, "")]


def test_multisets_are_compared_by_weight(spark, sf, docs):
    want = classes({i: split(d.text) for i, d in docs.items()}, counts=True)
    d = spark.read.parquet(f"{sf}/documents.parquet")
    for block in (256, 2):
        assert {r.doc_id: r.class_id for r in near_dups.near_duplicates(d, weights="count", block=block).collect()} == want


def test_linked_is_exact():
    sets = [np.arange(0, 9, dtype=np.uint64), np.arange(0, 10, dtype=np.uint64), np.arange(2, 10, dtype=np.uint64), np.arange(50, 60, dtype=np.uint64)]
    assert near_dups.linked(sets, 4, 5).tolist() == [0, 0, 0, 3]


def test_substring_texts(spark):
    a = " ".join(f"w{i}" for i in range(40))
    texts = [(1, a), (2, "start\n" + " ".join(f"w{i}" for i in range(10, 30)) + "\tend"), (3, " ".join(f"w{i}" for i in range(10, 22)))]
    out = {r.doc_id: r for r in substrings.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"), with_text=True).collect()}
    assert out[1].kept_text == a and out[2].kept_text == "start\nend" and out[3].n_removed == 0
    sha = {r.doc_id: r.kept_sha256 for r in substrings.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert sha[2] == hashlib.sha256(b"start end").hexdigest()


def test_packed_numbers():
    rng = np.random.default_rng(8)
    for kind in (np.uint32, np.uint64):
        x = np.sort(rng.integers(0, np.iinfo(kind).max, 1000, dtype=kind))
        assert (exchange.unplanes(exchange.planes(x), kind) == x).all()
    n = rng.integers(0, 1 << 40, 100)
    assert (exchange.unplain(exchange.plain(n)) == n).all()
    flags = rng.random((2, 37)) < 0.5
    assert (np.stack(exchange.unbits(exchange.bits_of(*flags), 37, 2)) == flags).all()


@pytest.mark.parametrize("bits", [5, 20, 24, 32])
def test_probe_keys_keep_every_bit(bits):
    """2,000 texts a chunk: whatever the bucket bits, the keys are the hashes' top bits, and no text number takes any of them."""
    rng = np.random.default_rng(bits)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 500, 20)) for _ in range(2_000)]
    texts[7] = texts[1_900]
    c = substrings._Chunk(pa.table({"doc_id": pa.array(range(2_000), pa.int64()), "text": texts}))
    distinct, load, s, start = substrings._probe_keys(c, bits, 7)
    g, doc, at = c.grams(7)
    short = [int(h) >> (32 - bits) for h in g]
    where = {}
    for h, d, p in zip(short, doc.tolist(), at.tolist(), strict=True):
        x = where.setdefault(h, [set(), False])
        x[0].add(d)
        x[1] |= (p - int(c.at[d])) % 7 == 0
    assert distinct.tolist() == sorted(where) and s.tolist() == short and (start == at).all()
    assert load[0].tolist() == [len(where[h][0]) > 1 for h in sorted(where)]
    assert load[1].tolist() == [where[h][1] for h in sorted(where)]


def test_relays_change_nothing(spark, sf, monkeypatch):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(map(tuple, substrings.remove_repeats(d).collect()))
    scores = sorted(map(tuple, lm.score_texts(d).collect()))
    monkeypatch.setattr(exchange, "LEAST_BITS", 6)
    assert sorted(map(tuple, substrings.remove_repeats(d, direct=2).collect())) == want
    assert [x[:6] for x in sorted(map(tuple, lm.score_texts(d, direct=3).collect()))] == [x[:6] for x in scores]


@pytest.mark.parametrize("direct", [10, 2])
def test_blobs_grow_no_faster_than_chunks_times_buckets(direct):
    """One chunk's rows: as many as the top bits it cuts by, however many buckets there are; hundreds of hashes in each where relays stand between."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 1 << 30, 500)) for _ in range(40)]
    t = pa.table({"doc_id": pa.array(range(40), pa.int64()), "text": texts, "chunk": pa.array([3] * 40, pa.int64())})
    for bits in (5, 8, 12, 20):
        sent = substrings._send(bits, 7, direct)(t)
        assert sent.num_rows <= 1 << exchange.sent_bits(bits, direct)
        assert sum(sent.column("n").to_pylist()) == 40 * 494
    few, many = (sum(1 << exchange.sent_bits(bits, 10) for _ in range(chunks)) for chunks, bits in ((1_000, 9), (5_000, 11)))
    assert many <= 5 * few  # five times the input beyond the direct range: no more than five times the rows


def test_language_model(spark, sf, docs):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    words = {i: [*(w.translate(low) for w in split(d.text)), None] for i, d in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for r in queries.QUERIES["op10_lm"](spark, sf).collect():
        ws = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert r.score < 0


def test_model_is_a_distribution_and_windows_cover_once():
    rng = np.random.default_rng(9)
    w, over = lm.WINDOW, lm.OVERLAP
    texts = [rng.integers(0, 18, n) for n in (0, 1, w - 1, w, w + 1, 2 * w + 16, 4 * w)] * 8
    s = lm.train(texts, 21, 20, steps=20)
    assert s.stats.unseen == 2  # ids 18 and 19
    ids = rng.integers(0, 21, (3, w))
    seen = s.stats.row[ids]
    seen[:, 0] = s.stats.opening
    p = sum(np.exp(s.log_probs(seen, np.full_like(seen, s.stats.row[t]))) for t in range(21))
    assert p == pytest.approx(np.ones((3, w)), abs=1e-3)
    lengths = np.array([len(t) + 1 for t in texts[:7]])
    text, first, scored = lm.windows(lengths)
    places = Counter((int(t), p) for t, f, k in zip(text, first, scored, strict=True) for p in range(k, min(f + w, lengths[t])))
    assert places == Counter({(t, p): 1 for t in range(7) for p in range(lengths[t])})
    # the definition, for each text: whole windows, of which the scored places count
    got = lm.score_ids(s, texts, 20) * math.log(10)
    for k in range(7):
        rows = s.stats.row[np.append(texts[k], 20).astype(np.int64)]
        before = np.append(s.stats.opening, rows[:-1])
        want = sum(s.log_probs(before[None, f : f + w], rows[None, f : f + w])[0, q - f :].sum() for t, f, q in zip(text, first, scored, strict=True) if t == k)
        assert got[k] == pytest.approx(want, rel=1e-4)
    # later ids never change the score of earlier places
    cut = np.where(np.arange(w) < 20, seen, 0)
    goal = s.stats.row[ids]
    assert s.log_probs(seen, goal)[:, :20] == pytest.approx(s.log_probs(cut, goal)[:, :20], abs=1e-4)
    assert over > 0


def test_training_lowers_the_loss():
    rng = np.random.default_rng(10)
    texts = [np.tile(rng.permutation(6), 30) for _ in range(40)]
    before, after = (lm.score_ids(lm.train(texts, 8, 7, steps=s), texts, 7).sum() for s in (0, 150))
    assert after > 0.7 * before


def test_large_scores_stay_finite():
    s = lm.train([np.arange(8)] * 30, 9, 8, steps=0)
    seen = np.tile(np.arange(8), (2, 8))
    want = s.log_probs(seen, seen)
    for shift in (500, -500):  # a constant for all choices changes nothing
        s.of_group = (s.of_group[0] + np.float32(shift), *s.of_group[1:])
        assert s.log_probs(seen, seen) == pytest.approx(want, abs=1e-3)
        s.of_group = (s.of_group[0] - np.float32(shift), *s.of_group[1:])
    s.qkv = s.qkv * 1e4
    assert np.isfinite(s.log_probs(seen, seen)).all()


def test_language_model_counts_all_training_ids(spark, sf, docs):
    enc = subwords.shared_encoder()
    n_ids, end = lm.id_range()
    d = spark.createDataFrame([(i, docs[i].text) for i in docs], "doc_id long, text string")
    texts = [x for i, x in docs.items() if zlib.crc32(str(i).encode()) % 7 != 2 and x.text is not None]
    flat = [np.append(np.frombuffer(x, "<u4"), end).astype(np.int64) for x in enc.ids([x.text for x in texts])]
    want = np.bincount(np.concatenate(flat), minlength=n_ids)
    part, _, bits = exchange.dealt(d.withColumn("held_out", common.crc_mod("doc_id", 7) == 2), doc_id="bigint", text="string", held_out="boolean")
    coded = common.saved(part.groupBy("chunk").applyInArrow(lm._send(bits, 10, n_ids, end, subwords.TOKENIZER), exchange.SENT)).where("bucket < 0")
    assert (lm.id_counts(coded, n_ids) == want).all()
    # neighbours, too: the corpus' counts are those of the same texts in one place
    row, cls = (np.arange(n_ids) % 50).astype(np.int32), np.arange(50) % 7
    out = np.zeros(51 * 7 + 8 * 50, np.int64)
    now = row[np.concatenate(flat)]
    lm.count_pairs(lm.neighbours(now, np.array([len(x) for x in flat]), 50), now, cls, 7, out)
    assert (lm.corpus_pairs(coded, n_ids)(row, cls, 7) == out).all()


def test_language_model_beats_the_bigram(spark):
    """Held-out texts at sf0.01: the network against an interpolated bigram (Witten-Bell) over the same subword ids."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in d.collect()}
    n_ids, end = lm.id_range()
    ids = dict(zip(texts, [np.append(np.frombuffer(x, "<u4"), end).astype(np.int64) for x in subwords.shared_encoder().ids(list(texts.values()))], strict=True))
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    pairs, before, alone, after = Counter(), Counter(), Counter(), {}
    for i in texts.keys() - held:
        p = [-1, *ids[i][:-1].tolist()]
        pairs.update(zip(p, ids[i].tolist(), strict=True))
        before.update(p)
        alone.update(ids[i].tolist())
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    n = sum(alone.values())
    bigram, places = 0.0, 0
    for i in held:
        for a, b in zip([-1, *ids[i][:-1].tolist()], ids[i].tolist(), strict=True):
            one = (alone[b] + 0.1) / (n + 0.1 * n_ids)
            lam = before[a] / (before[a] + len(after[a])) if before[a] else 0.0
            bigram += math.log10(lam * pairs[a, b] / max(before[a], 1) + (1 - lam) * one)
            places += 1
    score = sum(r.score for r in queries.QUERIES["op10_lm"](spark, "/root/testdata/sf0.01").collect() if r.doc_id in held)
    assert score / places > bigram / places + 0.05


def test_training_rows_grow_with_the_corpus(spark):
    n_ids, end = lm.id_range()
    stats = lm.train([np.arange(300)], n_ids, end, steps=0).stats
    shards = []
    for n in (1_000, 5_000):
        found = []
        old = lm.saved
        lm.saved = lambda df: found.append(old(df)) or found[-1]
        try:
            net = lm.fit(spark.range(n).selectExpr("id AS doc_id", "concat('text ', id) AS text"), stats, end, train_rows=50, share=0.1, steps=4, rounds=2)
        finally:
            lm.saved = old
        shards.append((found[0].count(), found[0].select("shard").distinct().count()))
        assert np.isfinite(net.flat()).all()
    assert 3 < shards[1][0] / shards[0][0] < 8 and shards[1][1] > shards[0][1]


def test_mixed_rows_of_repeated_ids(spark):
    rows = [(i % 90, "w " * (1 + i % 7), f"s{i % 3}", i) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    plan = mixing.mix_sources(d)
    taken = {r.source: r.n for r in plan.groupBy("source").agg({"taken": "sum"}).toDF("source", "n").collect()}
    mixed = mixing.mixed_documents(d)
    assert mixed.columns == d.columns
    got, times = Counter(), Counter()
    for r in mixed.collect():
        assert rows[r.copies] == tuple(r)
        got[r.source] += len(r.text.split())
        times[r.copies] += 1
    for s in taken:
        target = plan.where(f"source = '{s}'").first().target
        assert abs(got[s] - target) <= 7 and abs(taken[s] - target) <= 7
    assert max(times.values()) <= 3


def test_mixing_targets(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 3}" if i % 11 else None) for i in range(3000)] + [(9999, "w " * 50, "tiny")]
    r = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    found = r.groupBy("source", "source_size", "target").sum("taken").collect()
    total = sum(x.source_size for x in found)
    assert sum(x.target for x in found) == pytest.approx(total)
    for x in found:
        assert x.target <= 3 * x.source_size + 1e-6 and abs(x["sum(taken)"] - x.target) <= 50
    assert sorted(map(tuple, r.collect()), key=repr) == sorted(map(tuple, mixing.mix_sources(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string")).collect()), key=repr)


def test_network_learns_from_every_training_text(spark, monkeypatch):
    """Each round's shards hold all training texts, or, of many chunks, each one of them; none is left out."""
    n_ids, end = lm.id_range()
    texts = {i: " ".join(f"w{i}x{j}" for j in range(5)) for i in range(300)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    part, _, bits = exchange.dealt(d.withColumn("held_out", common.crc_mod("doc_id", 7) == 2), doc_id="bigint", text="string", held_out="boolean")
    coded = common.saved(part.groupBy("chunk").applyInArrow(lm._send(bits, 10, n_ids, end, subwords.TOKENIZER), exchange.SENT)).where("bucket < 0")
    stats = lm.train([np.arange(300)], n_ids, end, steps=0).stats
    found, work = [], lm._work_ids
    monkeypatch.setattr(lm, "_work_ids", lambda held, *a: found.append(b := work(held, *a)) or b)
    net = lm.fit_ids(coded, stats, n_ids, steps=2, rounds=2)
    assert np.isfinite(net.flat()).all() and len(found) == 2
    ids = subwords.shared_encoder().ids([texts[i] for i in texts if zlib.crc32(str(i).encode()) % 7 != 2])
    want = sum(len(x) // 4 + 1 for x in ids) + len(ids)  # ids, ends and openings
    for f in found:
        rows = [r for b in f(iter(coded.select("chunk", "hashes", "load").toArrow().to_batches())) for r in b.to_pylist() if r["part"] == -1]
        assert sum(np.frombuffer(r["x"], float)[0] for r in rows) == want
    # many chunks: each teaches in one of the rounds
    parts = [coded.where(f"pmod(xxhash64(chunk), 2) = {r}").select("chunk") for r in (0, 1)]
    assert sum(p.count() for p in parts) == coded.count()
