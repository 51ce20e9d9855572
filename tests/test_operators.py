import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerloom.functions import sequences as S
from kmerloom.operators import background, estimates, intervals, metrics, svm, words
from kmerloom.sources import fasta, tables


def test_sequence_functions(spark):
    d = spark.createDataFrame([("acgNNta",), ("",), (None,)], "s string").withColumn("c", S.clean(F.col("s")))
    assert [r.c for r in d.collect()] == ["ACGTA", "", None]
    one = lambda e: spark.range(1).select(e.alias("x")).first().x
    assert one(S.reverse_complement(F.lit("AACG"))) == "CGTT"
    assert one(S.pack(F.lit("ACGT"))) == 0b00011011 and one(S.unpack(F.lit(0b00011011), 4)) == "ACGT"
    assert one(S.reverse_complement_code(S.pack(F.lit("AACG")), 4)) == one(S.pack(F.lit("CGTT")))
    assert one(S.hamming(S.pack(F.lit("ACGTT")), S.pack(F.lit("ACCTA")))) == 2
    assert one(S.mutate(F.lit("ACGT"), F.lit(1), F.lit("T"))) == "ATGT" and one(S.mutate(F.lit("AC"), F.lit(5), F.lit("T"))) == "AC"
    assert one(S.dinucleotides(F.lit("ACG"))) == [4, 9] and one(S.dinucleotides(F.lit("A"))) == []
    assert one(S.gc_content(F.lit("GCNA"))) == 0.5 and one(S.gc_content(F.lit(""))) is None
    assert one(S.pattern_hits(F.lit("AAAA"), "A.A")) == 2
    assert one(S.common_words(F.lit("A..T"), F.lit("AC.."))) == 4 and one(S.common_words(F.lit("A"), F.lit("C"))) == 0
    assert one(S.background_log_odds(F.lit("AC.T"))) == pytest.approx(np.log(1.25))
    assert one(S.subsequence(F.lit("ACGT"), -1, 3)) == "AC" and one(S.subsequence(F.lit("ACGT"), 2, 9)) == "GT"


def test_words(spark):
    d = spark.createDataFrame([(1, "ACGT"), (2, "AC")], "seq_id long, seq string")
    bag = {(r.seq_id, r.u): r.n for r in words.bag(d, 4).collect()}
    assert bag == {(1, "ACGT"): 2}  # a palindrome counts on both strands
    assert words.bag(d, 2, both_strands=False).count() == 4
    assert len(words.masks(5, 3)) == 10 and len(words.masks(5, 3, True)) == 6
    g = {r.f: r.n for r in words.gapped_counts(words.bag(d, 4), 4, 3).collect()}
    assert g == {".CGT": 2, "A.GT": 2, "AC.T": 2, "ACG.": 2}
    p = {(r.depth): r.n_prefixes for r in words.prefix_counts(words.bag(d, 2, both_strands=False), 2).collect()}
    assert p == {1: 3, 2: 3}
    two = spark.createDataFrame([("x", 3), ("y", 1)], "f string, n long")
    r = {x.f: x.ratio for x in words.class_ratio(two, spark.createDataFrame([("x", 1), ("z", 2)], "f string, n long")).collect()}
    assert r == {"x": 500000, "y": 1000000, "z": -1000000}


def test_estimates(spark):
    d = spark.createDataFrame([(1, "ACGTACGGTTACGATTACAGGC")], "seq_id long, seq string")
    bag = words.bag(d, 3, both_strands=False)
    b = bag.groupBy("u").agg(F.sum("n").alias("n"))
    counts = words.gapped_counts(b, 3, 3)
    est = {r.u: r.estimate for r in estimates.ml_estimate(b, counts, 3, 3).collect()}
    assert est == pytest.approx({r.u: r.n for r in b.collect()})  # no gaps: the counts themselves
    m = estimates.table_moments(counts, 3, 3).first()
    n = [r.n for r in counts.collect()]
    assert m["mean"] == pytest.approx(sum(n) / 64) and m["variance"] == pytest.approx(sum(x * x for x in n) / 64 - (sum(n) / 64) ** 2)
    one = lambda e: spark.range(1).select(e.alias("x")).first().x
    assert one(estimates.log10_ratio(F.lit(1.5), F.lit(-3.0), [2.0, 0.5, 0.0])) == pytest.approx(np.log10(1.75 / 0.25))
    r = one(estimates.map_log_ratio(F.lit(20.0), F.lit(10.0), 1.0, 100.0, points=400))
    assert r == pytest.approx(np.log(2), abs=0.05)


def test_basis_is_complete(spark):
    """With K = L the basis gives every count back."""
    b = spark.createDataFrame([("AC", 3), ("GT", 5), ("TT", 1)], "u string, n long")
    coef = {(r.p, r.v): r.n for r in estimates.basis_counts(b, 2, 2).collect()}
    step = lambda d, j: 1 if d < j else -j if d == j else 0
    for u, n in (("AC", 3), ("GT", 5), ("TT", 1), ("AA", 0)):
        d = ["ACGT".index(c) for c in u]
        total = sum(c / estimates.basis_norm(p, v, 2) * np.prod([step(d[int(i)], int(j)) for i, j in zip([x for x in p.split(",") if x], v, strict=True)]) for (p, v), c in coef.items())
        assert total == pytest.approx(n)


def test_metrics(spark):
    rows = [("a", s, y) for s, y in [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.1, 1)]] + [("b", 1.0, 1)]
    d = spark.createDataFrame(rows, "fold string, score double, label int")
    auc = {r.fold: r.auroc for r in metrics.auroc(d).collect()}
    assert auc["a"] == pytest.approx((2 + 1.5 + 0) / 6) and auc["b"] is None
    prc = {r.fold: r.auprc for r in metrics.auprc(d).collect()}
    assert prc["a"] == pytest.approx(1 / 3 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 5)
    t = spark.createDataFrame([(0, 0.5), (1, 0.7), (2, 0.7)], "idx int, auroc double")
    assert metrics.best_setting(t).first().idx == 1


def test_svm(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(1, 0.5, (20, 2)), rng.normal(-1, 0.5, (20, 2))])
    y = np.repeat([1.0, -1.0], 20)
    k = x @ x.T
    a, b = svm.solve_svc(k, y, 1.0, tol=1e-6)
    f = k @ (a * y) - b
    assert abs(a @ y) < 1e-9 and (a >= -1e-12).all() and (a <= 1 + 1e-12).all()
    free = (a > 1e-6) & (a < 1 - 1e-6)
    assert (y * f)[free] == pytest.approx(1, abs=1e-4) and (y * f)[a < 1e-9].min() > 1 - 1e-4
    lam = svm.solve_ascent(k / np.sqrt(np.outer(np.diag(k), np.diag(k))), y)
    assert ((lam >= 0) & (lam <= 1)).all()
    kd = spark.createDataFrame([(i, j, float(k[i, j])) for i in range(40) for j in range(i + 1)], "i long, j long, k double")
    lab = spark.createDataFrame([(i, int(y[i] > 0)) for i in range(40)], "seq_id long, label int")
    got = {r.seq_id: r.alpha for r in svm.train(kd, lab).collect()}
    assert got == pytest.approx({i: v for i, v in enumerate(svm.solve_svc(k, y)[0] * y) if abs(v) > 1e-10})
    sizes = [r["count"] for r in svm.assign_folds(lab, 5).groupBy("cv_set").count().collect()]
    assert sizes == [8] * 5
    assert svm.rotated(np.array([1, 2, 3, 4, 5]), 1).tolist() == [2, 3, 4, 5, 1]
    f = svm.assign_folds(lab, 4)
    before = [r.cv_set for r in f.orderBy("seq_id").collect()]
    got = {}
    for r in svm.rotate_folds(f, 2).collect():
        got.setdefault(r.repeat, {})[r.seq_id] = r.cv_set
    assert all([got[r][i] for i in range(40)] == before[r:] + before[:r] for r in (1, 2))
    twice = lab.unionByName(lab.where("seq_id < 5").selectExpr("seq_id", "1 - label AS label"))
    assert {r.seq_id: r.label for r in svm.classes(twice).collect()} == {i: int(y[i] > 0 or i < 5) for i in range(40)}
    whole, _ = svm.solve_svc(k, y, 1.0, tol=1e-6)
    blocks, off = svm.solve_in_blocks(kd.unionByName(kd.where("i <> j").selectExpr("j AS i", "i AS j", "k")), np.arange(40), y, 1.0, tol=1e-6, working=8)
    assert k @ (blocks * y) - off == pytest.approx(k @ (whole * y) - b, abs=1e-3)
    with pytest.raises(ValueError):
        svm.solve_svc(np.full((2, 2), np.nan), np.array([1.0, -1.0]))
    pred, table, means = svm.cross_validate(kd, lab, [1.0], n_folds=4, repeats=2)
    assert {r.seq_id: r.cv_set for r in means.collect()} == dict(enumerate(before))
    assert pred.count() == 80 and means.count() == 40 and table.first().auroc > 0.9


def test_intervals(spark):
    a = spark.createDataFrame([("c", 1, 10, 1), ("c", 100, 400, 2), ("d", 5, 5, 3)], "chrom string, start long, end long, id long")
    m = spark.createDataFrame([("c", 10, 20), ("c", 90, 150), ("c", 140, 160), ("c", 300, 500), ("d", 6, 9)], "chrom string, start long, end long")
    got = {r.id: r.fraction for r in intervals.covered_fraction(a, m, 16).collect()}
    assert got == pytest.approx({1: 1 / 10, 2: (51 + 21 + 101) / 301, 3: 0})
    sizes = spark.createDataFrame([(0, "c", 300), (1, "d", 10)], "ord long, chrom string, length long")
    assert {r.id for r in intervals.bad_intervals(a, sizes).collect()} == {2}
    pos = spark.createDataFrame([(1,), (300,), (301,), (310,), (311,)], "pos long")
    assert {(r.pos, r.chrom, r.offset) for r in intervals.locate(pos, sizes).collect()} == {(1, "c", 1), (300, "c", 300), (301, "d", 1), (310, "d", 10)}
    g = spark.createDataFrame([("c", "aacgt")], "chrom string, seq string")
    iv = spark.createDataFrame([("c", 2, 4, "+"), ("c", 2, 4, "-")], "chrom string, start long, end long, strand string")
    for size in (1, 2, 3, 100):
        assert sorted(r.seq for r in intervals.fetch(iv.unionByName(iv), g, size).collect()) == ["ACG", "ACG", "CGT", "CGT"]
        odd = spark.createDataFrame([("c", -3, 2, "+"), ("c", 4, 90, "+"), ("c", 50, 60, "+"), ("x", 1, 2, "+")], iv.schema)
        assert sorted(r.seq for r in intervals.fetch(odd, intervals.tiles(g, size), size).collect()) == ["", "AA", "GT"]
    assert [(r.pos, r.chrom) for r in intervals.locate(pos, sizes, bin_size=7).orderBy("pos").collect()] == [(1, "c"), (300, "c"), (301, "d"), (310, "d")]


def test_greedy_match(spark):
    cols = "id long, gc double, len long, rep double"
    t = spark.createDataFrame([(1, 0.40, 100, 0.0), (2, 0.41, 100, 0.0), (3, 0.90, 100, 0.0)], cols)
    c = spark.createDataFrame([(10, 0.30, 100, 0.0), (11, 0.39, 100, 0.5), (12, 0.40, 101, 0.0), (13, 0.41, 100, 0.01), (14, 0.42, 150, 0.0)], cols)
    assert {(r.target_id, r.candidate_id) for r in background.greedy_match(t, c).collect()} == {(1, 12), (2, 13)}


def test_null_sequences(spark):
    rng = np.random.default_rng(3)
    g = spark.createDataFrame([(c, "".join(rng.choice(list("ACGT"), 400))) for c in ("x", "y")], "chrom string, seq string")
    p = spark.createDataFrame([(i, "x", 1 + 30 * i, 30 + 30 * i, "+") for i in range(3)], "id long, chrom string, start long, end long, strand string")
    m = spark.createDataFrame([("x", 1, 2)], "chrom string, start long, end long")
    rows = background.null_sequences(p, g, m, gc_tol=0.3, repeat_tol=1.0, max_trials=2).collect()
    assert rows and all(len(r.seq) == 30 and r.end - r.start == 29 for r in rows)
    assert len({r.target_id for r in rows}) == len(rows) <= 3


def test_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 first\r\nACG\r\n;note\r\nTT\r\n>s2\nGG\nCC\n>\nA")
    got = [(r.seq_id, r.seq) for r in fasta.read_fasta(spark, str(tmp_path / "a.fa")).collect()]
    assert got == [("s1", "ACGTT"), ("s2", "GGCC"), ("NA", "A")]
    d = spark.createDataFrame([("s1", "ACGT" * 20, "1")], "seq_id string, seq string, label string")
    fasta.write_fasta(d, str(tmp_path / "out"))
    back = fasta.read_fasta(spark, str(tmp_path / "out")).first()
    assert (back.seq_id, back.seq, back.header) == ("s1", "ACGT" * 20, "s1\t80\t1")
    tables.write_tab(d, str(tmp_path / "tab"))
    assert tables.read_tab(spark, str(tmp_path / "tab")).first().label == "1"
    k = spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0), (1, 0, 0.25), (2, 2, 1.0), (2, 1, 0.5)], "i long, j long, k double")
    tables.write_kernel_text(k, str(tmp_path / "k"))
    both = {(r.i, r.j): r.k for r in tables.read_kernel_text(spark, str(tmp_path / "k")).collect()}
    assert both == {(0, 0): 1, (1, 1): 1, (2, 2): 1, (1, 0): 0.25, (0, 1): 0.25, (2, 0): 0, (0, 2): 0, (2, 1): 0.5, (1, 2): 0.5}
    a = spark.createDataFrame([("s1", -0.5)], "seq_id string, alpha double")
    tables.write_alphas(a, str(tmp_path / "al"))
    assert tables.read_alphas(spark, str(tmp_path / "al")).first().alpha == -0.5
    (tmp_path / "x.bed").write_text("#c\nchr1\t0\t10\nchr2\t5\t9\tn\t0\t-\n")
    bed = tables.read_bed(spark, str(tmp_path / "x.bed"))
    assert [tuple(r) for r in bed.collect()] == [("chr1", 1, 10, "*"), ("chr2", 6, 9, "-")]
    tables.write_bed(bed, str(tmp_path / "bed"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "bed")).collect()] == ["chr1\t0\t10", "chr2\t5\t9"]
    (tmp_path / "al.txt").write_text("A\nc\n")
    assert tables.read_alphabet(spark, str(tmp_path / "al.txt")) == "AC"
    tables.write_scores(spark.createDataFrame([("s", 0.5)], "seq_id string, score double"), str(tmp_path / "sc"))
    assert spark.read.text(str(tmp_path / "sc")).first()[0] == "s\t0.500000"


def test_stream(spark, tmp_path):
    from kmerloom.functions.weights import Params
    from kmerloom.operators import scoring
    from kmerloom.streaming import scorer

    p = Params(L=3, K=2, d=1)
    seqs = spark.createDataFrame([(1, "ACGTAC"), (2, "GGGTTT"), (3, "A")], "seq_id long, seq string")
    seqs.write.parquet(str(tmp_path / "in"))
    model = scoring.fold_model(spark.createDataFrame([(1, 1.0)], "seq_id long, alpha double"), seqs.where("seq_id = 1"), p)
    arrivals = spark.readStream.schema(seqs.schema).parquet(str(tmp_path / "in"))
    q = scorer.score_stream(arrivals, model, p, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    rows = lambda df: sorted((r.seq_id, None if r.score is None else round(r.score, 9)) for r in df.collect())
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(scoring.classify(seqs, model, p))
