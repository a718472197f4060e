"""Places within groups, without a task that sees a whole group.

Percentiles: values of all measures are brought into long form and counted by distinct value, so many equal values are one row. A group's
values are cut into ranges at approximate quantiles; values are numbered within their range, and the rows of the higher ranges are
added. That is exact wherever the quantiles fall, and equal values share their mean place.

Ranks: rows are range-partitioned by group and order, written with their place in their partition, and the sizes of the partitions
before are added, less what stood before the group.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.sqlexpr import Percentile

from .tables import written

#: Ranges into which a group's values are cut; a value's range is looked for among every STEP-th edge first.
RANGES, STEP = 200, 14


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null groups meet; right's keys are left out."""
    named = right.withColumnsRenamed({k: f"other_{k}" for k in keys})
    return left.join(named, functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"other_{k}")) for k in keys]), how).drop(*[f"other_{k}" for k in keys])


def _measures(asked: dict[str, Percentile]) -> dict[tuple[str, str], int]:
    """Different measures among those asked for, with a number for each."""
    out: dict[tuple[str, str], int] = {}
    for p in asked.values():
        out.setdefault((p.x, p.better), len(out))
    return out


def _value(x: str, better: str) -> Column:
    """What is ordered from high to low: null where a value takes no part."""
    v = F.expr(f"cast({x} as double)")
    return -v if better == "low" else F.when(v > 0, v) if better == "positive" else v


def places(long: DataFrame, group: list[str]) -> DataFrame:
    """group, v, score for each different v of long (group, v): 1 for the highest of its group, 0 for the lowest, mean places for ties, 1 for one alone."""
    counts = long.groupBy(*group, "v").agg(F.count("*").alias("n"))
    cuts = counts.groupBy(*group).agg(F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)], 20 * RANGES).alias("cuts"))
    cuts = cuts.withColumn("tops", F.expr(f"filter(cuts, (c, i) -> (i + 1) % {STEP} = 0)"))
    found = _joined(counts, F.broadcast(cuts), group).withColumn("low", F.expr(f"{STEP} * size(filter(tops, c -> c <= v))"))  # a row for each group and measure
    ranged = found.select(*group, "v", "n", F.expr(f"size(cuts) - low - size(filter(slice(cuts, low + 1, {STEP}), c -> c <= v))").alias("range"))
    held = ranged.groupBy(*group, "range").agg(F.sum("n").alias("held"))
    whole = Window.partitionBy(*group)
    edges = held.select(*group, "range", (F.sum("held").over(whole.orderBy("range")) - F.col("held")).alias("before"), F.sum("held").over(whole).alias("total"))
    within = Window.partitionBy(*group, "range").orderBy(F.desc("v"))
    numbered = _joined(ranged.withColumn("higher", F.sum("n").over(within) - F.col("n")), F.broadcast(edges), [*group, "range"])  # RANGES rows for each group and measure
    place = F.col("before") + F.col("higher") + (F.col("n") - 1) / F.lit(2.0)
    return numbered.select(*group, "v", F.when(F.col("total") == 1, F.lit(1.0)).otherwise(F.lit(1.0) - place / F.expr("nullif(cast(total - 1 as double), cast(0 as double))")).alias("score"))


def percentiles(rows: DataFrame, group: list[str], key: str, asked: dict[str, Percentile]) -> DataFrame:
    """rows with a column for each percentile asked for. group and key together tell rows apart; rows is read several times, so it should be a written table."""
    measures = _measures(asked)
    values = F.posexplode(F.array(*[_value(*m) for m in measures])).alias("measure", "v")
    long = rows.select(*group, key, values).filter("v is not null")
    score = places(long.select(*group, "measure", "v"), [*group, "measure"])
    each = _joined(long, score, [*group, "measure", "v"])
    found = each.groupBy(*group, key).agg(*[F.max(F.when(F.col("measure") == i, F.col("score"))).alias(f"measure_{i}") for i in measures.values()])
    out = []
    for name, p in asked.items():
        c = F.col(f"measure_{measures[p.x, p.better]}")
        out.append((F.coalesce(c, F.lit(0.0)) if p.better == "positive" else c).alias(name))
    return _joined(rows, found, [*group, key], "left").select(*rows.columns, *out)


def ranked(rows: DataFrame, group: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """rows with their row number within their group. order must leave no ties between different rows."""
    spot = F.monotonically_increasing_id()
    ordered = rows.repartitionByRange(*[F.asc(g) for g in group], *order).sortWithinPartitions(*[F.asc(g) for g in group], *order)
    held = written(ordered.withColumn("part", F.shiftright(spot, 33)).withColumn("place", spot.bitwiseAND((1 << 33) - 1)), "ranked")
    sizes = held.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    numbered = held.join(F.broadcast(before), "part").withColumn("number", F.col("before") + F.col("place"))  # a row for each partition
    first = numbered.groupBy(*group).agg(F.min("number").alias("first"))
    return _joined(numbered, F.broadcast(first), group).select(*rows.columns, (F.col("number") - F.col("first") + 1).alias(rank))  # a row for each group
