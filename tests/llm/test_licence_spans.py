"""Spans of notices that a file holds several times."""

from __future__ import annotations

import pyarrow as pa

from kmerloom.llm import licences


def scanned(text):
    s = licences.Scanner()
    return s.scan(pa.RecordBatch.from_pydict({"doc_id": pa.array([1], pa.int64()), "text": [text]})).to_pylist()[0]


def test_every_occurrence_has_its_span():
    bsd, n = licences.TEMPLATES["bsd"][0], len(licences.word_list(licences.TEMPLATES["bsd"][0]))
    one = scanned(bsd)
    assert one["spans"] == f"bsd:0-{n - 1}"
    for between in ("", " x" * 7, " x" * 300):
        step = n + len(between.split())
        r = scanned((bsd + between + " ") * 4)
        assert r["spans"] == ",".join(f"bsd:{k * step}-{k * step + n - 1}" for k in range(4))
        assert (r["labels"], r["score"]) == (one["labels"], one["score"])


def test_many_copies_of_a_short_notice():
    r = scanned("Released under the MIT License. " * 5_000)
    assert len(r["spans"].split(",")) == 5_000 and r["score"] == 1.0
