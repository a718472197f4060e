"""Row numbers over a whole table without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, materialise, unused


def ranked(df: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """df with the column rank: 1, 2, 3 ... in the given order.

    Rows are range-partitioned and sorted, and written once with their place in their partition; a partition's rank begins after
    the rows of those before it. Only these sizes, one for each partition, are added up in one task. Rows that are equal under the order are told apart
    by their place, so one value that many rows have spreads over partitions. df must be read from files, or it is written first.
    """
    file, at, part, place, before = (unused(n, df) for n in ("row_file", "row_at", "rank_part", "rank_place", "rank_before"))
    keys = [*order, F.asc(file), F.asc(at)]
    sorted_rows = keyed(df, file, at).repartitionByRange(*keys).sortWithinPartitions(*keys)
    within = F.monotonically_increasing_id()
    placed = materialise(sorted_rows.select(*[F.col(f"`{c}`") for c in df.columns], F.shiftright(within, 33).alias(part), within.bitwiseAND((1 << 33) - 1).alias(place)), "ranked")
    sizes = placed.groupBy(part).count().withColumn(before, F.sum("count").over(Window.orderBy(part)) - F.col("count")).drop("count")
    return placed.join(F.broadcast(sizes), part).select(*[F.col(f"`{c}`") for c in df.columns], (F.col(before) + F.col(place) + 1).alias(rank))  # a row for each partition
