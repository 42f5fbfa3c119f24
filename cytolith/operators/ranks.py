"""Running counts by value, within groups that may be large."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that the values of a group are cut into.
PARTS = 64


def below(rows: DataFrame, groups: list[str], value: str, counts: list[str], parts: int = PARTS) -> DataFrame:
    """rows with _below_X, for each X of counts: the sum of X over the group's rows with a smaller value.

    rows have one row for each group and value. The values of a group are cut at approximate quantiles; sums of the ranges
    below and of the smaller values of the same range are added up, so no task gets a whole group. Where the cuts lie
    changes nothing in the result.
    """
    shares = [k / parts for k in range(1, parts)]
    cuts = rows.groupBy(*groups).agg(F.percentile_approx(value, shares, 1000).alias("_cuts"))
    ranged = rows.join(cuts, groups).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    totals = ranged.groupBy(*groups, "_range").agg(*(F.sum(c).alias(c) for c in counts))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    bases = totals.select(*groups, "_range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_base_{c}") for c in counts))
    own = Window.partitionBy(*groups, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(bases, [*groups, "_range"])
    return placed.select(*rows.columns, *((F.col(f"_base_{c}") + F.coalesce(F.sum(c).over(own), F.lit(0))).alias(f"_below_{c}") for c in counts))
