"""Each trial of the matched background draws a batch."""

from __future__ import annotations

import random

from kmerloom.operators import background


def test_one_trial_matches_a_rare_composition(spark):
    rng = random.Random(3)
    seq = "".join(rng.choice("AT") for _ in range(1_000)) + "GC" * 10 + "".join(rng.choice("AT") for _ in range(1_000))
    genome = spark.createDataFrame([("c", seq)], "chrom string, seq string")
    masks = spark.createDataFrame([("c", 1, 1)], "chrom string, start long, end long")
    pos = spark.createDataFrame([(1, "c", 1001, 1020, "+")], "id long, chrom string, start long, end long, strand string")
    got = background.null_sequences(pos, genome, masks, max_trials=1).collect()
    assert [(r.target_id, r.start, r.gc) for r in got] == [(1, 1001, 1.0)]


def test_draws_go_on_until_an_interval_fits(spark):
    sizes = spark.createDataFrame([(k, f"c{k}", 30) for k in range(50)], "ord int, chrom string, length long")
    wanted = spark.range(200).selectExpr("id", "IF(id = 199, 31L, 30L) AS len")
    got = background.random_intervals(wanted, sizes, 1).collect()
    assert sorted(r.id for r in got) == list(range(199)) and {(r.start, r.end) for r in got} == {(1, 30)}


def test_most_draw_once(spark, monkeypatch):
    """Where nearly all places fit, places drawn are few more than intervals, however many a later round may draw."""
    drawn, old = [], background.I.locate
    monkeypatch.setattr(background.I, "locate", lambda d, sizes: drawn.append(d.count()) or old(d, sizes))
    sizes = spark.createDataFrame([(k, f"c{k}", 1_000) for k in range(20)], "ord int, chrom string, length long")
    wanted = spark.range(2_000).selectExpr("id", "20L AS len")
    got = background.random_intervals(wanted, sizes, 1, 40)
    assert sorted(r.id for r in got.collect()) == list(range(2_000)) and sum(drawn) < 4 * 2_000
