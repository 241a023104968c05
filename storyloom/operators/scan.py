"""Running values over groups of any size: rows are cut into ranges, ranges are scanned on their own, and only the ranges' totals are scanned over a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.sources.checkpoints import table


def cut_into_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """``df`` with ``_range``: rows are sorted into ranges by (keys, order) and written, so that the numbers stay as they are. Ranges hold about as many rows each,
    whatever the size of a group; their number is the session's number of shuffle partitions, if none is given."""
    by = [*keys, *order]
    dealt = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    return table(dealt.withColumn("_range", F.spark_partition_id()))


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """``df`` with the inclusive running sum of each of ``sums`` (name: number of a row, not null) in its group by ``order``.

    Rows of a group that are equal in ``order`` lie in the same range and stand there in any order, as in a window over rows. The sums before a range are those of
    the group's earlier ranges: one row for each range that holds the group. A null key is a group of its own.
    """
    rows = cut_into_ranges(df.select("*", *(c.alias(f"_add_{name}") for name, c in sums.items())), keys, order, ranges)
    within = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy(*keys, "_range").agg(*(F.sum(f"_add_{name}").alias(f"_all_{name}") for name in sums))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*(F.col(k).alias(f"_of_{k}") for k in keys), F.col("_range").alias("_of_range"), *(F.coalesce(F.sum(f"_all_{name}").over(earlier), F.lit(0)).alias(f"_before_{name}") for name in sums))
    scanned = rows.select("*", *(F.sum(f"_add_{name}").over(within).alias(f"_in_{name}") for name in sums))
    same = F.col("_range") == F.col("_of_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return scanned.join(before, same).select(*df.columns, *((F.col(f"_in_{name}") + F.col(f"_before_{name}")).alias(name) for name in sums))


def following(df: DataFrame, keys: Sequence[str], order: str, name: str, ranges: int | None = None) -> DataFrame:
    """``df`` with ``name``: the value of ``order`` in the next row of its group, null in the last. The next of a range's last row is the first of the group's next range."""
    rows = cut_into_ranges(df, keys, [order], ranges)
    within = Window.partitionBy(*keys, "_range").orderBy(order)
    firsts = rows.groupBy(*keys, "_range").agg(F.min(order).alias("_first"))
    later = firsts.select(*(F.col(k).alias(f"_of_{k}") for k in keys), F.col("_range").alias("_of_range"), F.lead("_first").over(Window.partitionBy(*keys).orderBy("_range")).alias("_later"))
    same = F.col("_range") == F.col("_of_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return rows.select("*", F.lead(order).over(within).alias("_next")).join(later, same).select(*df.columns, F.coalesce("_next", "_later").alias(name))
