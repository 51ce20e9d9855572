"""Running sums in a given order without a window over everything.

Rows are cut into slots whose order agrees with the order asked for. A window
sums within a slot; the sums before each slot come from a table of one row per
slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLOTS = 256


def running_sums(df: DataFrame, slot: str, order: list[Column], values: dict[str, str], group: list[str] | None = None) -> DataFrame:
    """df with, for each out: value, the sum of `value` over the rows of the group before this one, by (slot, order)."""
    keys = group or []
    inner = W.partitionBy(*keys, slot).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy(*keys).orderBy(slot).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0)
    part = df.groupBy(*keys, slot).agg(*(F.sum(v).alias(f"_s_{o}") for o, v in values.items()))
    # one row per slot (and group): the window holds SLOTS rows
    part = part.select(*(F.col(k).alias(f"_k_{k}") for k in [*keys, slot]), *(F.coalesce(F.sum(f"_s_{o}").over(before), zero).alias(f"_b_{o}") for o in values))
    own = df.select("*", *(F.coalesce(F.sum(v).over(inner), zero).alias(f"_o_{o}") for o, v in values.items()))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in [*keys, slot]]
    return own.join(part, on).select(*df.columns, *((F.col(f"_o_{o}") + F.col(f"_b_{o}")).alias(o) for o in values))


def by_quantile(df: DataFrame, score: str, group: str, slots: int = SLOTS) -> DataFrame:
    """df with _slot: how many of the group's approximate quantiles lie below the score."""
    at = [k / slots for k in range(1, slots)]
    cuts = df.groupBy(group).agg(F.percentile_approx(score, at, 1000).alias("_cuts")).withColumnRenamed(group, "_cut_group")
    j = df.join(cuts, F.col(group).eqNullSafe(F.col("_cut_group")))
    return j.withColumn("_slot", F.size(F.filter("_cuts", lambda c: c < F.col(score)))).drop("_cuts", "_cut_group")


def hashed_order(key: str, seed: str) -> tuple[Column, Column]:
    """A seeded order of a key: its slot and, within the slots, its md5."""
    h = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary"))
    return F.conv(F.substring(h, 1, 2), 16, 10).cast("int"), h
