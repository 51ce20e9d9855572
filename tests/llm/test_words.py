"""Word hashes are those of the bytes, whatever the pieces that they are worked out in."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from kmerloom.llm import common


def by_hand(texts, lower, prefixes):
    out = []
    for t in texts:
        x = (common.LOWER if lower else np.arange(256, dtype=np.uint8))[np.frombuffer(t, np.uint8)]
        for m in re.finditer(rb"[^ \n]+", x.tobytes()):
            w = x[m.start() : m.end()]
            whole = lambda y, k: int(common.mix(np.array([sum(int(v) * pow(common.BASE, q, 1 << 64) for q, v in enumerate(common._values()[y])) % (1 << 64)], np.uint64) ^ np.uint64(k))[0])
            out.append((whole(w, 0), [whole(w[:k], k) if len(w) > k else 0 for k in prefixes]))
    return out


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1 << 18])
def test_pieces(piece, monkeypatch):
    monkeypatch.setattr(common, "PIECE", piece)
    common._cache.pop("pow", None)
    rng = random.Random(piece)
    marked = np.zeros(256, bool)
    marked[[97, 32]] = True
    try:
        for _ in range(40):
            texts = [bytes(rng.choice(b"ab \nCd\xc3") for _ in range(rng.randrange(30))) for _ in range(rng.randrange(6))]
            for lower in (False, True):
                w = common.Words(pa.array(texts, pa.binary()), lower=lower, prefixes=(2, 3))
                want = by_hand(texts, lower, (2, 3))
                assert w.hash.tolist() == [h for h, _ in want]
                assert [[int(p[i]) for p in w.prefix] for i in range(len(want))] == [p for _, p in want]
                assert w.count.tolist() == [len(re.findall(rb"[^ \n]+", t)) for t in texts]
                assert w.sums(marked).tolist() == [sum(marked[(common.LOWER if lower else np.arange(256))[c]] for c in t) for t in texts]
    finally:
        common._cache.pop("pow", None)
