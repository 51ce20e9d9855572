import random

import pytest

from kmerloom import engine
from kmerloom.functions.weights import Params


def test_a_run(spark):
    rng = random.Random(1)
    word = lambda n, letters="ACGT": "".join(rng.choice(letters) for _ in range(n))
    pos = spark.createDataFrame([(i, word(10) + "ACGTACGGT" + word(10)) for i in range(8)], "seq_id long, seq string")
    neg = spark.createDataFrame([(100 + i, word(29)) for i in range(8)], "seq_id long, seq string")
    p = Params(L=5, K=4, d=1)
    k = engine.kernel(pos, neg, p).persist()
    both = engine.labelled(pos, neg)
    alphas = engine.train(k, both, 1.0)
    scores = {r.seq_id: r.score for r in engine.classify(both, alphas, both, p).collect()}
    assert min(scores[i] for i in range(8)) > sum(scores[100 + i] for i in range(8)) / 8
    with pytest.raises(ValueError):
        engine.labelled(pos, pos)


def test_cross_validation_and_its_files(spark, tmp_path):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    pos = spark.createDataFrame([(i, word(8) + "ACGTACGGT" + word(8)) for i in range(10)], "seq_id long, seq string")
    neg = spark.createDataFrame([(100 + i, word(25)) for i in range(10)], "seq_id long, seq string")
    both = engine.labelled(pos, neg)
    cv = engine.train_cv(engine.kernel(pos, neg, Params(L=5, K=4, d=1)), both, [0.1, 1.0], n_folds=4, repeats=2)
    table = sorted(map(tuple, cv.settings.collect()))
    assert cv.c == max(table, key=lambda r: (r[2], -r[0]))[1] and len(table) == 2
    cv.write(str(tmp_path / "pred"), str(tmp_path / "auc"), str(tmp_path / "alpha"))
    lines = sorted(r[0].split("\t") for r in spark.read.text(str(tmp_path / "pred")).collect())
    assert len(lines) == 20 and {x[2] for x in lines} == {"1", "-1"} and {x[3] for x in lines} == {"0", "1", "2", "3"}
    engine.write_model(cv.model, both, str(tmp_path / "a"), str(tmp_path / "s"))
    alphas, seqs = engine.read_model(spark, str(tmp_path / "a"), str(tmp_path / "s"))
    p = Params(L=5, K=4, d=1)
    one = {r.seq_id: r.score for r in engine.classify(both, cv.model, both, p).collect()}
    two = {int(r.seq_id): r.score for r in engine.classify(both, alphas, seqs, p).collect()}
    assert two == pytest.approx(one, rel=1e-4)


def test_null_sequence_files(spark, tmp_path):
    rng = random.Random(4)
    genome = spark.createDataFrame([("c", "".join(rng.choice("ACGT") for _ in range(3_000)))], "chrom string, seq string")
    masks = spark.createDataFrame([("c", 1, 1)], "chrom string, start long, end long")
    pos = spark.createDataFrame([(i, "c", 100 * i + 1, 100 * i + 40, "+") for i in range(5)], "id long, chrom string, start long, end long, strand string")
    found = engine.null_sequences(pos, genome, masks, str(tmp_path / "bed"), str(tmp_path / "neg"), str(tmp_path / "pos")).collect()
    assert len(found) == 5
    bed = engine.tables.read_bed(spark, str(tmp_path / "bed")).collect()
    assert sorted((r.start, r.end) for r in bed) == sorted((r.start, r.end) for r in found)
    neg = {r.seq_id: r.seq for r in engine.fasta.read_fasta(spark, str(tmp_path / "neg")).collect()}
    want = sorted(found, key=lambda r: (r.start, r.end))
    assert neg == {f"c_{r.start}_{r.end}_neg_{n}": r.seq for n, r in enumerate(want, 1)}
    assert {r.seq_id for r in engine.fasta.read_fasta(spark, str(tmp_path / "pos")).collect()} == {f"c_{100 * i + 1}_{100 * i + 40}_pos_{i + 1}" for i in range(5)}


def test_all_distances(spark):
    pos = spark.createDataFrame([(1, "ACGTACGA"), (2, "ACGTTCGA")], "seq_id long, seq string")
    neg = spark.createDataFrame([(3, "GGGCCCTA"), (4, "TTTTTGCA")], "seq_id long, seq string")
    at = lambda **o: {(r.i, r.j): r.k for r in engine.kernel(pos, neg, Params(L=5, K=3, d=1), **o).collect()}
    assert at()[2, 1] == pytest.approx(3.841520e-01, rel=1e-6) and at(alg=1)[2, 1] == pytest.approx(4.053204e-01, rel=1e-6)


def test_two_letters(spark):
    seqs = spark.createDataFrame([(1, "ABBABA"), (2, "BBBAAB")], "seq_id long, seq string")
    from kmerloom.operators import kernels, scoring

    p = Params(L=3, K=2, d=1, alphabet="AB", custom=lambda m: [2.0, 1.0, 0.0, 0.0][m])
    words = lambda s: [s[i : i + 3] for i in range(len(s) - 2)]
    dot = lambda s, t: sum(p.custom(sum(a != b for a, b in zip(u, v, strict=True))) for u in words(s) for v in words(t))
    a, b = "ABBABA", "BBBAAB"
    for plan in ("neighbourhood", "gapped"):
        k = {(r.i, r.j): r.k for r in kernels.kernel(seqs, p, plan).collect()}
        assert k[2, 1] == pytest.approx(dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5)
    alphas = spark.createDataFrame([(1, 1.0)], "seq_id long, alpha double")
    every = scoring.score_all_words(scoring.fold_model(alphas, seqs, p), p).collect()
    assert len(every) == 8
    for n, r in enumerate(sorted(every, key=lambda r: r.u)):
        w = format(n, "03b").translate(str.maketrans("01", "AB"))
        assert r.score == pytest.approx(dot(w, a) / dot(a, a) ** 0.5)
