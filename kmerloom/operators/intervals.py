"""Genomic intervals (1-based, closed): overlaps, positions, matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Chromosomes that are broadcast where there are no more; their rows are counted first.
FEW = 100_000


def overlaps(a: DataFrame, b: DataFrame, bin_size: int = 1024) -> DataFrame:
    """Pairs of intervals (chrom, start, end, id) that share a position: id_a, id_b, width of what they share.

    A range join as an equi-join on (chrom, bin): each interval goes to the bins
    it touches, and a pair counts in the bin where the later start lies.
    """

    def binned(df: DataFrame, side: str) -> DataFrame:
        bins = F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor(F.col("end") / bin_size)))
        return df.where("end >= start").select("chrom", F.col("start").alias(f"start_{side}"), F.col("end").alias(f"end_{side}"), F.col("id").alias(f"id_{side}"), bins.alias("bin"))

    j = binned(a, "a").join(binned(b, "b"), ["chrom", "bin"])
    lo, hi = F.greatest("start_a", "start_b"), F.least("end_a", "end_b")
    return j.where((lo <= hi) & (F.floor(lo / bin_size) == F.col("bin"))).select("id_a", "id_b", (hi - lo + 1).alias("width"))


def covered_fraction(a: DataFrame, masks: DataFrame, bin_size: int = 1024) -> DataFrame:
    """id, fraction: the summed widths of the mask intervals over each interval, by its width; 0 where none."""
    shared = overlaps(a, masks.withColumn("id", F.lit(0)), bin_size).groupBy("id_a").agg(F.sum("width").alias("shared"))
    return a.join(shared, F.col("id") == F.col("id_a"), "left").select("id", (F.coalesce("shared", F.lit(0)) / (F.col("end") - F.col("start") + 1)).alias("fraction"))


def bad_intervals(a: DataFrame, chrom_sizes: DataFrame) -> DataFrame:
    """Intervals on no known chromosome, or beyond its end."""
    known = a.join(chrom_sizes.select("chrom", F.col("length").alias("_length")), "chrom", "left")
    return known.where("_length is null or end > _length or start < 1").drop("_length")


def locate(positions: DataFrame, chrom_sizes: DataFrame, bin_size: int | None = None) -> DataFrame:
    """positions(pos: 1-based place in the concatenated genome) -> with chrom and offset (1-based); places beyond the end are dropped.

    chrom_sizes(ord, chrom, length). An equi-join on bins of the concatenated
    genome: a chromosome goes to the bins it touches. The bin is by default the
    mean length, which makes at most two rows a chromosome and bin; up to FEW
    chromosomes go to the positions.
    """
    from kmerloom.plans.ranks import by_quantile, running_sums

    whole = chrom_sizes.agg(F.sum("length"), F.count("*")).first()
    size = bin_size or max(1, -(-int(whole[0] or 0) // max(whole[1], 1)))
    c = by_quantile(chrom_sizes.select("ord", "chrom", "length").withColumn("_all", F.lit(0)), "ord", "_all", 64)
    c = running_sums(c, "_slot", [F.col("ord")], {"before": "length"}).where("length > 0")
    bins = F.explode(F.sequence(F.floor(F.col("before") / size), F.floor((F.col("before") + F.col("length") - 1) / size)))
    c = c.select("chrom", "length", "before", bins.alias("_bin"))
    if bin_size is None and whole[1] <= FEW:
        c = F.broadcast(c)
    p = positions.withColumn("_bin", F.floor((F.col("pos") - 1) / size))
    j = p.join(c, "_bin").where((F.col("pos") > F.col("before")) & (F.col("pos") <= F.col("before") + F.col("length")))
    return j.withColumn("offset", F.col("pos") - F.col("before")).drop("before", "length", "_bin")


TILE = 1 << 16


def tiles(genome: DataFrame, size: int = TILE) -> DataFrame:
    """genome(chrom, seq) -> chrom, tile, seq: the chromosomes in pieces of `size` letters, tile 0 first. One pass over each sequence."""
    cut = F.regexp_extract_all(F.col("seq"), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return genome.select("chrom", F.posexplode(cut).alias("tile", "seq"))


def sizes_of(tiled: DataFrame) -> DataFrame:
    """chrom, length of a tiled genome."""
    return tiled.groupBy("chrom").agg(F.sum(F.length("seq").cast("bigint")).alias("length"))


def fetch(intervals: DataFrame, genome: DataFrame, size: int = TILE) -> DataFrame:
    """intervals(chrom, start, end, strand) with seq from genome(chrom, seq), or from its tiles of `size` (chrom, tile, seq).

    The reverse complement on strand '-'. An interval meets the tiles it
    touches, by (chrom, tile), and its pieces are joined in order; no chromosome
    travels whole. What lies beyond a chromosome's end is left out; an interval
    on no chromosome is dropped, one without a letter has an empty seq.
    """
    from kmerloom.functions.sequences import reverse_complement

    tiled = genome if "tile" in genome.columns else tiles(genome, size)
    known = intervals.join(tiled.select("chrom").distinct(), "chrom", "left_semi")
    known = known.groupBy(F.struct(*intervals.columns).alias("_row")).agg(F.count("*").cast("int").alias("_n")).select("_row", "_n", "_row.*")
    first, last = F.floor((F.greatest(F.col("start"), F.lit(1)) - 1) / size), F.floor((F.col("end") - 1) / size)
    asked = known.select("_row", "_n", "chrom", F.greatest("start", F.lit(1)).alias("_from"), F.col("end").alias("_to"), F.explode(F.sequence(first, F.greatest(first, last))).alias("tile"))
    own = tiled.select("chrom", F.col("tile").cast("bigint").alias("tile"), F.upper("seq").alias("_seq"))
    j = asked.join(own, ["chrom", "tile"], "left")
    lo = F.greatest(F.col("_from") - F.col("tile") * size, F.lit(1)).cast("int")
    hi = F.least(F.col("_to") - F.col("tile") * size, F.lit(size)).cast("int")
    piece = F.coalesce(F.substring(F.col("_seq"), lo, F.greatest(hi - lo + 1, F.lit(0))), F.lit(""))
    found = j.groupBy("_row", "_n").agg(F.array_sort(F.collect_list(F.struct("tile", piece.alias("s")))).alias("_p"))
    s = F.array_join(F.transform("_p", lambda x: x["s"]), "")
    found = found.select("_row.*", s.alias("_s"), F.explode(F.sequence(F.lit(1), "_n"))).drop("col")
    return found.withColumn("seq", F.when(F.col("strand") == "-", reverse_complement(F.col("_s"))).otherwise(F.col("_s"))).drop("_s")
