"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import pytest
from pyspark.sql import functions as F

from kmerloom.llm import langid, licences, lm, mixing, near_dups, packing, quality, search, substrings, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk int, n_words long, n_removed long, kept_text string, rest int, copies int, node long, size long, rank int, class_id long, cls string, start string, label string, key string, a int, score double"
PROSE = "the quick brown fox jumps over the lazy dog and runs through the old green forest near a small river today"


def rows():
    texts = [None, "", "  \n\t ", PROSE, PROSE, PROSE + " again", "a b", "x", "über straße naïve ☃ " * 20, "1234 5678", ("word%d " * 7 % tuple(range(7))) * 3000, " ".join(f"w{i}" for i in range(30_000)), "General Public License. All rights reserved cc by", "1 <|endoftext|> 2\n\n  end "]
    out = [(i, t, ["en", "de", None][i % 3], ["s1", None, "s2"][i % 3], len(t or "")) for i, t in enumerate(texts)]
    out += [out[3], (None, PROSE, "en", "s1", 3), (None, None, None, None, None)]
    return [(*r, 7, 7, 7, "kept", 7, 7, 7, 7, 7, 7, "c", "s", "l", "k", 1, 0.5) for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2, 1) for i in range(14)] + [(None, 1, 1, 1), (3, None, None, 1), (3, 1, 1, 1)], "doc_id long, quality int, toxic int, score int")


def run_all(docs, labels):
    yield "quality", quality.apply_rules(docs, labels)[0]
    yield "mixing", mixing.mix_sources(docs)
    yield "langid", langid.predict(docs, langid.fit(docs))
    yield "substrings", substrings.remove_repeats(docs)
    yield "substrings text", substrings.remove_repeats(docs, with_text=True)
    yield "toxicity", toxicity.score(docs, toxicity.fit(docs, labels))
    yield "licences", licences.scan_licences(docs)
    yield "near_dups", near_dups.near_duplicates(docs)
    yield "near_dups counts", near_dups.near_duplicates(docs, weights="count")
    yield "lm", lm.score_texts(docs)


def test_a_row_per_document(docs, labels):
    n = docs.count()
    for name, out in run_all(docs, labels):
        found = out.collect()
        assert len(found) == n, name
        assert sum(r["doc_id"] is None for r in found) == (2 if "source_size" not in out.columns else 2), name


def test_empty_tables(spark, docs, labels):
    none, unlabelled = docs.limit(0), labels.limit(0)
    for name, out in run_all(none, unlabelled):
        assert out.count() == 0, name
    assert packing.pack(none).count() == 0
    v = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert search.top_k(search.quantised(v), search.quantised(v)).count() == 0
    assert mixing.mixed_documents(none).count() == 0
    assert near_dups.without_near_duplicates(none).count() == 0


def test_packing(docs):
    found = packing.pack(docs).collect()
    assert {r["doc_id"] for r in found} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    null = [r for r in found if r["doc_id"] == 0]
    assert [(r["start"], r["length"], r["doc_tokens"]) for r in null] == [(0, 1, 1)]


def test_results(docs, labels):
    near = {(r["doc_id"], r["class_id"]) for r in near_dups.near_duplicates(docs).collect()}
    assert {(3, 3), (4, 3), (5, 3), (0, 0), (1, 1), (2, 2), (None, None)} <= near
    cut = {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(docs).collect()}
    assert cut[4] == 21 and cut[3] == 0 and cut[5] == 21 and cut[None] in (0, 21) and cut[10] == 0
    kept = near_dups.without_near_duplicates(docs).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [i for i in range(14) if i not in (4, 5)]
    assert kept[0].asDict().keys() == docs.first().asDict().keys()
    pred = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert [pred[i] for i in (0, 1, 2, 9)] == ["und"] * 4
    scan = {r["doc_id"]: r for r in licences.scan_licences(docs).collect()}
    assert scan[12]["base_labels"] == "cc-by,gpl,reserved" and (scan[12]["first_word"], scan[12]["last_word"]) == (0, 6)
    assert scan[0]["first_word"] is None and scan[0]["labels"] == ""
    assert toxicity.without_toxic(docs, toxicity.fit(docs, labels)).columns == docs.columns
    mix = mixing.mix_sources(docs)
    assert mix.where("taken > 3 * size").count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_pipeline_stages_on_edges(spark, docs, labels, tmp_path):
    """Nulls, ties, repeated rows and clashing names in each stage that returns documents; empty tables stay empty."""
    import corpus_pipeline

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    extra = [c for c in docs.columns if c not in ("text", "n_chars")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
        known = {tuple(r) for r in docs.select(*extra).collect()}
        rows = [tuple(r) for r in out.select(*extra).collect()]
        assert set(rows) <= known and rows, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    cut = corpus_pipeline.cut_repeats(spark, docs, str(tmp_path)).collect()
    assert len(cut) == docs.count() and all(r["chunk"] == 7 and r["n_words"] == 7 and r["n_removed"] == 7 and r["kept_text"] == "kept" for r in cut)
    whole = {r["doc_id"]: r for r in docs.collect()}
    assert all(r["n_chars"] == whole[r["doc_id"]]["n_chars"] for r in cut if r["text"] == whole[r["doc_id"]]["text"])
    assert corpus_pipeline.pack(spark, docs, str(tmp_path)).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_search_extra_columns(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0], 1, 2, "x") for i in range(60)], "vec_id long, embedding array<double>, rank int, qrow int, v string")
    q = search.quantised(v)
    assert search.top_k(q.where("vec_id % 50 = 0"), q).columns == ["query_id", "rank", "vec_id", "score"]
    assert search.top_k(q.where("vec_id % 50 = 0"), q).count() == 10


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    v = spark.createDataFrame([(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [0.25, nan]), (3, None), (4, [None, 1.0]), (5, [inf, 1.0]), (6, [0.0, 0.0]), (7, [1.0]), (8, []), (50, [-1.0, 2.0]), (50, [2.0, 2.0]), (None, [1.0, 1.0]), (100, []), (9, [3e30, 3e30])], "vec_id long, embedding array<double>")
    q = search.quantised(v)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in search.top_k(q.where("vec_id = 0"), q).collect()}
    assert got[(0, 2)] == (50, 256 * 512 + 128 * 512) and got[(0, 3)] == (1, 256 * 256 + 128 * 128)
    assert got[(0, 1)] == (9, (1 << 63) - 1)
    assert {r.vec_id for r in search.top_k(q.where("vec_id = 100"), q).collect()} == {8}
