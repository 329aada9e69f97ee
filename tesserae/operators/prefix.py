"""Running sums over any number of rows: range partitions, a total of each, and windows within them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.session import settled

PART = "part_"


def by_ranges(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``rows`` dealt to ranges of (by, order), which sampling makes about equal, with the range's number as ``part_``; computed once."""
    return settled(rows.repartitionByRange(*by, *order).withColumn(PART, F.spark_partition_id()))


def sums_before(ranged: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds to rows of ``by_ranges``, for each {name: value}, the sum over the rows before it in its group.

    No task holds a group: it holds a range, and the totals of ranges, a row for each group in each.
    """
    totals = ranged.groupBy(*by, PART).agg(*[F.sum(v).alias(f"{n}_total_") for n, v in sums.items()])
    earlier = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, PART, *[F.coalesce(F.sum(f"{n}_total_").over(earlier), F.lit(0)).alias(f"{n}_offset_") for n in sums])
    inside = Window.partitionBy(*by, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumns({n: F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in sums.items()}).join(offsets, [*by, PART])
    return rows.withColumns({n: F.col(n) + F.col(f"{n}_offset_") for n in sums}).drop(*[f"{n}_offset_" for n in sums])


def last_before(ranged: DataFrame, by: list[str], order: list[str], values: dict[str, Column], firsts: dict[str, Column] | None = None) -> DataFrame:
    """Adds to rows of ``by_ranges``, for each {name: value}, the last value that isn't null among the rows before it in its group;
    of ``firsts`` the first such value.

    As with ``sums_before`` no task holds a group; the group's columns hold no nulls. ``order`` is ascending.
    """
    firsts = firsts or {}
    both = {**values, **firsts}
    end = lambda n: F.min_by if n in firsts else F.max_by
    over = lambda n, c, w: (F.first if n in firsts else F.last)(c, ignorenulls=True).over(w)
    held = ranged.withColumns({f"{n}_own_": v for n, v in both.items()})
    ends = held.groupBy(*by, PART).agg(*[end(n)(f"{n}_own_", F.when(F.col(f"{n}_own_").isNotNull(), F.struct(*order))).alias(f"{n}_end_") for n in both])
    earlier = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*by, PART, *[over(n, f"{n}_end_", earlier).alias(f"{n}_carried_") for n in both])
    inside = Window.partitionBy(*by, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = held.withColumns({n: over(n, f"{n}_own_", inside) for n in both}).join(carried, [*by, PART])
    found = {n: F.coalesce(f"{n}_carried_", n) if n in firsts else F.coalesce(n, f"{n}_carried_") for n in both}
    return rows.withColumns(found).drop(*[f"{n}{tail}" for n in both for tail in ("_own_", "_carried_")])
