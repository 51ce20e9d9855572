"""Background sets: random intervals matched to given ones by composition, length and repeats."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.functions.sequences import gc_content
from kmerloom.plans.lineage import saved
from kmerloom.plans.ranks import hashed_order, running_sums

from . import intervals as I

_MATCH = "target_id long, candidate_id long"


def greedy_match(targets: DataFrame, candidates: DataFrame, gc_tol: float = 0.02, length_tol: float = 0.02, repeat_tol: float = 0.02, strata: list[str] | None = None) -> DataFrame:
    """(id, gc, len, rep) of both sides -> target_id, candidate_id, each candidate at most once.

    Targets by rising gc take the unused candidate of the lowest gc with |gc|,
    relative |len| and |rep| differences within the tolerances. The assignment
    is a sequential scan: one task, or one for each value of `strata` (columns
    of both sides) where the sets are large.
    """
    keys = strata or ["_all"]
    side = lambda df, t: df.withColumn("_all", F.lit(0)).select(*keys, F.col("id").cast("bigint").alias("id"), F.col("gc").cast("double").alias("gc"), F.col("len").cast("bigint").alias("len"), F.col("rep").cast("double").alias("rep"), F.lit(t).alias("_t"))

    def assign(df: pd.DataFrame) -> pd.DataFrame:
        t = df[df["_t"] == 1].sort_values(["gc", "id"])
        c = df[df["_t"] == 0].sort_values(["gc", "id"])
        cid, cgc, clen, crep = (c[x].to_numpy() for x in ("id", "gc", "len", "rep"))
        used = [False] * len(c)
        first, out = 0, []
        for tid, gc, ln, rep in t[["id", "gc", "len", "rep"]].itertuples(index=False):
            while first < len(c) and (used[first] or cgc[first] < gc - gc_tol):
                first += 1
            for k in range(first, len(c)):
                if cgc[k] > gc + gc_tol:
                    break
                if not used[k] and abs(clen[k] - ln) <= length_tol * ln and abs(crep[k] - rep) <= repeat_tol:
                    used[k] = True
                    out.append((tid, cid[k]))
                    break
        return pd.DataFrame(out, columns=["target_id", "candidate_id"])

    return side(targets, 1).unionByName(side(candidates, 0)).groupBy(*keys).applyInPandas(assign, _MATCH)


def _draw(seed: int, below: Column, *of: str) -> Column:
    """A number from 0 to below - 1 by the md5 of the seed and the columns, the same in any engine."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in of)).cast("binary"))
    return F.pmod(F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint"), below)


def random_intervals(wanted: DataFrame, chrom_sizes: DataFrame, seed: int, tries: int = 8) -> DataFrame:
    """wanted(id, len) -> id, chrom, start, end, strand at uniform places of the genome.

    Each id draws until its interval lies in one chromosome: one place, then,
    for the ids still without one, `tries` more, four times as many, and so on.
    Only ids longer than every chromosome are dropped.
    """
    sizes = chrom_sizes.select("chrom", F.col("length").alias("chrom_length"))
    whole = chrom_sizes.agg(F.sum("length"), F.max("length"), F.count("*")).first()
    if whole[2] <= I.FEW:
        sizes = F.broadcast(sizes)
    # a small file is one partition, whatever its rows cost
    left, found, first, times = saved(wanted.select("id", "len").where(F.col("len") <= (whole[1] or 0)).repartition("id")), None, 1, 1
    strand = F.when(_draw(seed, F.lit(2), "id") == 0, "+").otherwise("-")
    while True:
        draw = _draw(seed, F.lit(max(whole[0] or 0, 1)), "id", "try") + 1
        d = left.select("id", "len", F.explode(F.sequence(F.lit(first), F.lit(first + times - 1))).alias("try")).withColumn("pos", draw)
        at = I.locate(d, chrom_sizes).join(sizes, "chrom").where("offset + len - 1 <= chrom_length")
        one = at.groupBy("id").agg(F.min_by(F.struct("chrom", "offset", "len"), "try").alias("x"))
        part = saved(one.select("id", "x.chrom", F.col("x.offset").alias("start"), (F.col("x.offset") + F.col("x.len") - 1).alias("end"), strand.alias("strand")))
        found = part if found is None else found.unionByName(part)
        left = saved(left.join(part.select("id"), "id", "left_anti"))
        if left.isEmpty():
            return found
        first, times = first + times, tries if first == 1 else 4 * times


def features(intervals: DataFrame, genome: DataFrame, masks: DataFrame) -> DataFrame:
    """id, gc, len, rep, seq of intervals."""
    s = I.fetch(intervals, genome).select("id", "seq", gc_content(F.col("seq")).alias("gc"), (F.col("end") - F.col("start") + 1).alias("len"))
    return s.join(I.covered_fraction(intervals, masks).select("id", F.col("fraction").alias("rep")), "id")


def replicas(targets: DataFrame, xfold: float, seed: int = 1) -> DataFrame:
    """targets(id, ...) -> id of the copy, target, ...: round(n * xfold) rows (half-even), each target as often as any other, but for one."""
    n = targets.count()
    copies = round(n * xfold)
    times = -(-copies // max(n, 1))
    many = targets.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(max(times - 1, 0)))))
    many = many.withColumn("target", F.col("id")).withColumn("id", F.xxhash64("id", "c"))
    # whole rounds stay; of the last one the first by a seeded order
    rest = copies - n * (times - 1) if copies else 0
    if rest == n:
        return many.drop("c")
    slot, order = hashed_order("target", f"{seed}:")
    last = many.where(F.col("c") == times - 1).withColumn("_slot", slot).withColumn("_order", order).withColumn("_one", F.lit(1))
    last = running_sums(last, "_slot", [F.col("_order")], {"_place": "_one"}).where(F.col("_place") < rest)
    return many.where(F.col("c") < times - 1).unionByName(last.select(*many.columns)).drop("c")


def null_sequences(positives: DataFrame, genome: DataFrame, masks: DataFrame, xfold: float = 1.0, gc_tol: float = 0.02, length_tol: float = 0.02, repeat_tol: float = 0.02, max_trials: int = 20, seed: int = 1, batch: int = 5_000) -> DataFrame:
    """positives(id, chrom, start, end, strand) -> a matched random interval each, xfold times: target_id, chrom, start, end, strand, seq, gc, rep.

    Trials go on while targets lack a match, at most max_trials; those left are
    absent. Each trial draws `batch` intervals or more, of the lengths of the
    targets left in turn. Half-even rounding of n * xfold.
    """
    spark = positives.sparkSession
    genome = genome if "tile" in genome.columns else saved(I.tiles(genome))
    sizes = saved(I.sizes_of(genome).select(F.dense_rank().over(_by("chrom")).alias("ord"), "chrom", "length"))
    t = saved(features(positives, genome, masks).select("id", "gc", "len", "rep"))
    kept = saved(replicas(t, xfold, seed).select("id", "target", "gc", "len", "rep"))
    left, found = kept, None
    for trial in range(max_trials):
        each = -(-batch // max(left.count(), 1))
        wanted = left.select("id", "len", F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("c"))
        places = saved(random_intervals(wanted.select(F.xxhash64("id", "c").alias("id"), "len"), sizes, seed + 17 * trial))
        f = saved(features(places, genome, masks))
        m = greedy_match(left, f, gc_tol, length_tol, repeat_tol)
        drawn = places.select(F.col("id").alias("candidate_id"), "chrom", "start", "end", "strand")
        described = f.select(F.col("id").alias("candidate_id"), "seq", "gc", "rep")
        part = saved(m.join(drawn, "candidate_id").join(described, "candidate_id").drop("candidate_id"))
        found = part if found is None else found.unionByName(part)
        left = saved(left.join(part.select(F.col("target_id").alias("id")), "id", "left_anti"))
        if left.isEmpty():
            break
    if found is None:
        return spark.createDataFrame([], "target_id long, chrom string, start long, end long, strand string, seq string, gc double, rep double")
    names = kept.select(F.col("id").alias("target_id"), "target")
    return found.join(names, "target_id").drop("target_id").withColumnRenamed("target", "target_id").select("target_id", "chrom", "start", "end", "strand", "seq", "gc", "rep")


def _by(col: str):
    from pyspark.sql import Window as W

    return W.orderBy(col)
