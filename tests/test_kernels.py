import itertools
import random

import pytest
from pyspark.sql import functions as F

from kmerloom.functions.weights import Filter, Params
from kmerloom.operators import kernels, profiles, scoring, words

TOY = {"p1": "ACGTACGA", "p2": "ACGTTCGA", "n1": "GGGCCCTA", "n2": "TTTTTGCA"}
IDS = {"p1": 1, "p2": 2, "n1": 3, "n2": 4}
PROFILE = {
    ("p1", "p1"): [12, 4, 0, 2, 4, 42], ("p2", "p1"): [0, 12, 4, 2, 16, 30], ("p2", "p2"): [8, 0, 4, 8, 12, 32], ("n1", "p1"): [0, 0, 4, 24, 20, 16],
    ("n1", "p2"): [0, 0, 0, 32, 16, 16], ("n1", "n1"): [12, 8, 8, 12, 8, 16], ("n2", "p1"): [0, 0, 2, 26, 30, 6], ("n2", "p2"): [0, 0, 8, 18, 20, 18],
    ("n2", "n1"): [0, 0, 0, 12, 26, 26], ("n2", "n2"): [8, 4, 8, 14, 12, 18],
}
KERNELS = [
    (dict(filter=Filter.TRUNCATED), [4.053204e-01, 2.070621e-02, 0, 1.283503e-02, 6.506284e-02, 0]),
    (dict(filter=Filter.GAPPED), [4.865128e-01, 2.711631e-02, 0, 1.681682e-02, 8.559210e-02, 0]),
    (dict(filter=Filter.WILDCARD, wildcard_lambda=0.8), [3.612877e-01, 1.607537e-02, 0, 9.967704e-03, 5.047067e-02, 0]),
    (dict(filter=Filter.MISMATCH, wildcard_m=1), [3.329560e-01, 3.580574e-02, 0, 2.192645e-02, 1.084652e-01, 0]),
    (dict(filter=Filter.FULL), [3.360678e-01, 0, 0, 0, 0, 0]),
    (dict(pseudo_count=True), [4.810625e-01, 1.178917e-01, 1.219369e-01, 1.313410e-01, 2.029466e-01, 1.130254e-01]),
]


@pytest.fixture(scope="module")
def toy(spark):
    return spark.createDataFrame([(IDS[k], v) for k, v in TOY.items()], "seq_id long, seq string")


@pytest.mark.parametrize("plan", ["neighbourhood", "gapped"])
def test_toy_profile(toy, plan):
    rows = profiles.profile(words.packed_bag(toy, 5), 5, 5, plan=plan).collect()
    got = {(r.i, r.j, r.m): r.cnt for r in rows}
    want = {(IDS[a], IDS[b], m): n for (a, b), ns in PROFILE.items() for m, n in enumerate(ns) if n}
    assert got == want


def test_self_profile(toy):
    got = {(r.seq_id, r.m): r.cnt for r in profiles.self_profile(words.packed_bag(toy, 5), 5, 5).collect()}
    assert got == {(IDS[a], m): n for (a, b), ns in PROFILE.items() if a == b for m, n in enumerate(ns) if n}


@pytest.mark.parametrize(("options", "want"), KERNELS)
def test_toy_kernels(toy, options, want):
    k = {(r.i, r.j): r.k for r in kernels.kernel(toy, Params(L=5, K=3, d=2, **options)).collect()}
    pairs = [("p2", "p1"), ("n1", "p1"), ("n1", "p2"), ("n2", "p1"), ("n2", "p2"), ("n2", "n1")]
    assert [k.get((IDS[a], IDS[b]), 0.0) for a, b in pairs] == pytest.approx(want, rel=1e-6, abs=1e-12)
    assert all(k[i, i] == 1.0 for i in IDS.values())


@pytest.mark.parametrize(("L", "d"), [(6, 2), (8, 3)])
def test_plans_agree_on_random_sequences(spark, L, d):
    rng = random.Random(L)
    seqs = spark.createDataFrame([(i, "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 40)))) for i in range(8)], "seq_id long, seq string")
    bags = words.packed_bag(words.clean_sequences(seqs), L).persist()
    rows = lambda df: sorted(map(tuple, df.select("i", "j", "m", "cnt").collect()))
    want = rows(profiles.direct_profile(bags, L, d))
    assert want == rows(profiles.profile(bags, L, d, plan="neighbourhood")) == rows(profiles.profile(bags, L, d, plan="gapped"))


def test_strand_invariance_and_duplicates(spark, toy):
    from kmerloom.functions.sequences import reverse_complement

    p = Params(L=5, K=3, d=2)
    flipped = toy.withColumn("seq", F.when(F.col("seq_id") == 1, reverse_complement(F.col("seq"))).otherwise(F.col("seq")))
    key = lambda df: {(r.i, r.j): round(r.k, 9) for r in df.collect()}
    assert key(kernels.kernel(toy, p)) == key(kernels.kernel(flipped, p))
    with pytest.raises(ValueError, match="more than once"):
        kernels.kernel(toy.unionByName(toy), p)


def test_short_and_empty_sequences(spark):
    s = spark.createDataFrame([(1, "ACGTACGT"), (2, "AC"), (3, "nnn"), (4, None)], "seq_id long, seq string")
    k = {(r.i, r.j): r.k for r in kernels.kernel(s, Params(L=5, K=3, d=2)).collect()}
    assert k == {(1, 1): 1.0, (2, 2): 1.0}


@pytest.mark.parametrize(("d", "want"), [(1, [0.601174, 0.300755]), (2, [0.581470, 0.300874])])
def test_toy_scores(spark, toy, d, want):
    p = Params(L=5, K=3, d=d)
    alphas = spark.createDataFrame([(1, 0.7), (2, 0.3), (3, -0.6), (4, -0.4)], "seq_id long, alpha double")
    model = scoring.fold_model(alphas, toy, p)
    test = spark.createDataFrame([(1, "ACGTACCA"), (2, "ACGTTCCA"), (3, "A")], "seq_id long, seq string")
    got = {r.seq_id: r.score for r in scoring.classify(test, model, p).collect()}
    assert [got[1], got[2]] == pytest.approx(want, abs=2e-6) and got[3] is None
    both = scoring.delta(test.where("seq_id = 1"), test.where("seq_id = 2").withColumn("seq_id", F.lit(1).cast("bigint")), model, p).first()
    assert both.delta == pytest.approx(want[1] - want[0], abs=3e-6)


def test_all_words_equal_word_scores(spark, toy):
    p = Params(L=3, K=2, d=1)
    alphas = spark.createDataFrame([(1, 1.0)], "seq_id long, alpha double")
    model = scoring.fold_model(alphas, toy.where("seq_id = 1"), p)
    rows = {r.u: r.w for r in model.collect()}
    got = {r.u: r.score for r in scoring.score_all_words(model, p).collect()}
    c = p.weights()
    for u in range(64):
        far = lambda a, b: sum((a >> 2 * i) & 3 != (b >> 2 * i) & 3 for i in range(3))
        assert got[u] == pytest.approx(sum(w * c[far(u, v)] for v, w in rows.items() if far(u, v) <= 1))
    assert len(list(itertools.islice(got, 100))) == 64
