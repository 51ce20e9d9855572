"""What teaches the toxicity model."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from kmerloom.llm import toxicity


def test_rare_toxic_rows_all_teach(spark, monkeypatch):
    taught = []
    monkeypatch.setattr(toxicity, "train", lambda bags, **kw: taught.append((bags, kw)))
    d = spark.range(2_000).selectExpr("id AS doc_id", "concat('words of ', id) AS text")
    labels = spark.range(2_000).selectExpr("id AS doc_id", "CAST(id % 100 = 1 AS INT) AS toxic")
    toxicity.fit(d, labels, train_rows=200, toxic_rows=100)
    bags, kw = taught[0]
    used = [i for i in range(2_000) if toxicity_fold(i) > 0]
    toxic = sum(i % 100 == 1 for i in used)
    assert sum(b[0] for b in bags) == toxic
    assert 130 < len(bags) < 270
    # the loss gives the classes their shares of all labelled rows
    w, n1 = kw["weigh"], toxic
    assert w[1] * n1 / (w[0] * (200 - toxic) + w[1] * n1) == pytest.approx(toxic / len(used), abs=1e-3)


def toxicity_fold(i):
    return zlib.crc32(str(i).encode()) % 5


def test_near_copies_are_evidence_once(monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "telling", lambda df, n: seen.append((df.copy(), n.copy())) or (np.zeros(df.shape[1], bool), np.zeros(df.shape[1])))
    s = [np.arange(4 * k, 4 * k + 4, dtype=np.uint32) for k in range(9)]
    bag = lambda y, *k: (y, np.concatenate([s[i] for i in k]), 4 * np.arange(len(k), dtype=np.uint32))
    # a text, its near copy, its copy, and another text that shares a sentence with it
    toxicity.train([bag(1, 0, 1, 2, 3), bag(1, 0, 1, 2, 4), bag(1, 0, 1, 2, 3), bag(1, 5, 6, 7, 0), bag(0, 8, 0)], epochs=0)
    df, n = seen[0]
    assert df[1, ::4][:9].tolist() == [2, 1, 1, 1, 1, 1, 1, 1, 0] and df[0, ::4][:9].tolist() == [1, 0, 0, 0, 0, 0, 0, 0, 1]
    assert n.tolist() == [1, 3]
