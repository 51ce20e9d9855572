"""Each stage of the corpus pipeline against plain Python."""

from collections import Counter

import pytest

import corpus_pipeline
from kmerloom.llm import common, mixing, near_dups, toxicity


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        docs = common.saved(f(spark, docs, sf))
        out.append(docs)
    return out


def test_stages(spark, sf, stages):
    raw, clean, unique, cut, mixed, packed = stages
    columns = raw.columns
    assert all(s.columns == columns for s in stages[:5])
    scores = {r.doc_id: r.score for r in toxicity.score(raw, toxicity.fit(raw, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    rows = {r.doc_id: r for r in raw.collect()}
    assert {r.doc_id for r in clean.select("doc_id").collect()} == {i for i, s in scores.items() if s < 0.5}
    classes = {r.doc_id: r.class_id for r in near_dups.near_duplicates(clean).collect()}
    assert {r.doc_id for r in unique.select("doc_id").collect()} == set(classes.values())
    assert all(tuple(r) == tuple(rows[r.doc_id]) for r in unique.collect())
    seen, want = {}, {}
    texts = {r.doc_id: (r.text or "").encode() for r in unique.collect()}
    for i in sorted(texts):
        w = texts[i].split()
        gone = {j for p in range(len(w) - 12) if seen.get(tuple(w[p : p + 13]), i) < i for j in range(p, p + 13)}
        for p in range(len(w) - 12):
            seen.setdefault(tuple(w[p : p + 13]), i)
        want[i] = [x for j, x in enumerate(w) if j not in gone]
    got = {r.doc_id: r for r in cut.collect()}
    assert {i: (r.text or "").encode().split() for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values() if want[r.doc_id] != texts[r.doc_id].split())
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(cut).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: c for i, c in copies.items() if c})
    pieces = Counter()
    for r in packed.collect():
        pieces[r.doc_id] += r.length
    tokens = {r.doc_id: r.doc_tokens for r in packed.collect()}
    assert pieces == Counter({i: copies[i] * t for i, t in tokens.items()})


def test_run(spark, sf, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, stages[-1].collect()))
