"""Bars kept as a table that a profile reads in part: partitions by market and quarter, buckets by ticker.

A profile looks at each ticker's last bars, so a run needs the quarters that hold these and no others; the partition filter is part of the plan. Files are
bucketed by ticker, so windows and aggregates of tickers move no bar. How far back a market must be read is asked of its tickers' column alone: the quarter
in which every ticker that may pass has enough bars behind it. A ticker without a bar in the last two quarters can't have its last bar on the as-of date,
which all profiles ask for, so what was delisted long ago reaches back for nobody; one that is traded seldom does, and is never cut short.

Defined cases: a bar without market, ticker or date, one that repeats another's ticker and date, or one that is there already ends the job that appends
with DataError, and nothing is appended. A market without bars by the runs' dates is read as empty. Other columns than those of bars aren't kept.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.errors import Invalid
from marlstone.operators import checks
from marlstone.operators.tables import located

COLUMNS = {"market": "string", "ticker": "string", "bar_date": "date"} | dict.fromkeys(("open", "high", "low", "close", "adjusted_close", "volume"), "double")
#: Bars before the last `keep` that features of these look back to: the longest is a mean of 60 bars.
BACK = 60


def _quarter(day: date) -> date:
    return date(day.year, day.month - (day.month - 1) % 3, 1)


class BarTable:
    """The table `name` of the session's catalogue over the files in path. buckets: tasks that read a span, the same for the table's whole life."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int) -> None:
        if not re.fullmatch(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)?", name) or "'" in path or buckets < 1:
            raise Invalid(f"not a table's name, path and number of buckets: {name!r}, {path!r}, {buckets}")
        self.spark, self.name, self.buckets = spark, name, buckets
        columns = ", ".join(f"{c} {t}" for c, t in {**{c: t for c, t in COLUMNS.items() if c != "market"}, "market": "string", "quarter": "date"}.items())
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet OPTIONS (compression 'zstd') PARTITIONED BY (market, quarter) CLUSTERED BY (ticker) SORTED BY (ticker, bar_date) INTO {buckets} BUCKETS LOCATION '{path}'")
        at, system = located(spark, path)
        system.mkdirs(at)
        spark.sql(f"MSCK REPAIR TABLE {name}")  # partitions that other sessions have appended

    def quarters(self) -> dict[str, list[date]]:
        """The quarters of each market, in order: names of partitions, no data."""
        out: dict[str, list[date]] = {}
        for (spec,) in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect():
            market, quarter = (part.split("=", 1)[1] for part in spec.split("/"))
            out.setdefault(market, []).append(date.fromisoformat(quarter))
        return {m: sorted(q) for m, q in out.items()}

    def append(self, bars: DataFrame, dealt: bool = False) -> None:
        """Add bars; only quarters from the earliest new bar on are looked at for bars that are there already.

        dealt: bars come hashed by ticker into as many partitions as there are buckets, so they are not moved again.
        """
        keys = ["market", "ticker", "bar_date"]
        bar = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in keys])
        new = bars.select(*[F.col(c).cast(t) for c, t in COLUMNS.items()]).withColumn("quarter", F.trunc("bar_date", "quarter"))
        new = checks.must(new, F.col("market").isNotNull() & F.col("ticker").isNotNull() & F.col("bar_date").isNotNull(), F.concat(F.lit("a bar without market, ticker or date: "), bar))
        new = checks.unrepeated(new if dealt else new.repartition(self.buckets, "ticker"), ["market", "ticker"], "bar_date", F.concat(F.lit("repeated bar: "), bar))
        with checks.translated():
            if self.quarters():
                first = new.agg(F.min("quarter")).first()[0]
                held = self.spark.table(self.name).filter(F.col("quarter") >= F.lit(first)).groupBy("ticker").agg(F.collect_set(F.struct("market", "bar_date")).alias("there"))  # by ticker alone, as the buckets are
                is_there = F.expr("coalesce(array_contains(there, struct(market, bar_date)), false)")
                new = checks.must(new.join(held, "ticker", "left"), ~is_there, F.concat(F.lit("bar is there already: "), bar)).drop("there")
            ordered = new.select(*[c for c in COLUMNS if c != "market"], "market", "quarter")
            ordered.write.mode("append").format("parquet").partitionBy("market", "quarter").bucketBy(self.buckets, "ticker").sortBy("ticker", "bar_date").saveAsTable(self.name)

    def spans(self, keep: int, dates: dict[str, tuple[date, date]]) -> dict[str, tuple[date, date]]:
        """The first and last quarter that runs need, by market. dates: the first and the last date of each market's runs."""
        held = self.quarters()
        asked = []
        for market, (first, last) in dates.items():
            if upto := [q for q in held.get(market, []) if q <= _quarter(first)][-2:]:
                asked.append((market, upto[0], _quarter(last)))
        if not asked:
            return {}
        recent = F.broadcast(self.spark.createDataFrame(asked, "market string, recent date, last date"))  # a row a market
        n = self.spark.table(self.name).filter(F.col("market").isin([a[0] for a in asked])).groupBy("market", "ticker", "quarter").agg(F.count("*").alias("n"))
        n = n.join(recent, "market").filter("quarter <= last")
        so_far = F.sum(F.expr("CASE WHEN quarter < recent THEN n ELSE 0 END")).over(Window.partitionBy("market", "ticker").orderBy(F.desc("quarter")))
        each = n.withColumn("so_far", so_far).groupBy("market", "ticker").agg(
            F.max("quarter").alias("newest"), F.min("quarter").alias("oldest"), F.max(F.when(F.col("so_far") >= keep + BACK, F.col("quarter"))).alias("enough"),
            F.first("recent").alias("recent"), F.first("last").alias("last"),
        )
        live = each.filter("newest >= recent").groupBy("market").agg(F.min(F.expr("coalesce(enough, least(oldest, recent))")).alias("start"), F.max("last").alias("last"))
        return {r["market"]: (r["start"], r["last"]) for r in live.collect()}  # a row a market

    def bars(self, keep: int, runs: DataFrame) -> DataFrame:
        """The bars that a profile with `keep` bars needs for runs (market, run_date): those of the spans, by a filter of partitions."""
        dates = {r["market"]: (r["low"], r["high"]) for r in runs.groupBy("market").agg(F.min("run_date").alias("low"), F.max("run_date").alias("high")).collect()}
        wanted = F.lit(False)
        for market, (low, high) in sorted(self.spans(keep, dates).items()):
            wanted |= (F.col("market") == market) & F.col("quarter").between(F.lit(low), F.lit(high))
        return self.spark.table(self.name).filter(wanted).select(*COLUMNS)
