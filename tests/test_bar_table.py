"""Bars kept by market, quarter and ticker: what a profile reads of them, and that it ranks as if it had read all."""

import re
import uuid
from datetime import date

import pytest
from pyspark.sql import functions as F

from marlstone.errors import DataError, Invalid
from marlstone.plans import catalog, engine
from marlstone.sources import panel
from marlstone.sources.bar_table import COLUMNS, BarTable

SF = "/root/testdata/sf0.001"
LAST = date(2025, 10, 7)


@pytest.fixture(scope="module")
def history(spark, tmp_path_factory):
    """840 days of tickers that are traded daily, but for one traded every fifth day, and one of which nothing was heard since 2023."""
    one = panel.bars(spark, SF).filter("cast(substr(ticker, 2) as int) <= 60 AND cast(substr(ticker, 2) as int) % 14 <> 10")
    all_days = one
    for k in (1, 2):
        all_days = all_days.union(one.withColumn("bar_date", F.date_sub("bar_date", k * panel.DAYS)))
    all_days = all_days.filter("NOT (ticker = 'P1' AND datediff(bar_date, DATE '2025-10-07') % 5 <> 0) AND NOT (ticker = 'P2' AND bar_date > DATE '2023-12-31')")
    path = str(tmp_path_factory.mktemp("bars"))
    all_days.write.parquet(f"{path}/plain")
    return path, spark.read.parquet(f"{path}/plain")


@pytest.fixture(scope="module")
def held(spark, history):
    table = BarTable(spark, f"bars_{uuid.uuid4().hex[:8]}", f"{history[0]}/table", 4)
    table.append(history[1].filter("bar_date < DATE '2025-08-01'"))
    table.append(history[1].filter("bar_date >= DATE '2025-08-01'"))
    return table


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_a_profile_reads_its_quarters(spark, history, held):
    _, plain = history
    runs = spark.createDataFrame([("a", "US", LAST), ("b", "US", date(2025, 9, 30)), ("c", "TW", LAST), ("d", "TW", date(2026, 1, 1)), ("e", "XX", LAST)], "run_id string, market string, run_date date")
    for name in ("liquidity_quality_v1", "momentum_v1", "relative_strength_leader_v1"):
        p = catalog.PROFILES[name]
        bars = held.bars(p.keep, runs)
        assert bars.count() < plain.count() and rows(engine.snapshot(p, bars, runs=runs)) == rows(engine.snapshot(p, plain, runs=runs))
    p = catalog.PROFILES["liquidity_quality_v1"]
    bars = held.bars(p.keep, runs.filter("market = 'TW'"))
    assert engine.snapshot(p, bars, runs=runs).count() > 0
    # 63 bars and 60 before them: the second quarter of 2025 has 91 days, the first one the rest; runs are in the fourth
    assert {re.search("quarter=([0-9-]+)", f)[1] for f in bars.inputFiles()} == {"2025-01-01", "2025-04-01", "2025-07-01", "2025-10-01"}
    plan = engine.snapshot(p, bars, runs=runs)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*quarter", plan) and "Exchange hashpartitioning(market" not in plan and "Exchange hashpartitioning(ticker" not in plan


def test_a_seldom_traded_ticker_reaches_back(spark, history, held):
    """P1 has 18 bars a quarter, so its market is read as far back as it goes; P2, gone since 2023, alone would not do that."""
    spans = held.spans(63, {"US": (LAST, LAST), "TW": (LAST, LAST)})
    assert spans["TW"] == (date(2025, 1, 1), date(2025, 10, 1)) and spans["US"][0] < date(2024, 1, 1)
    seen = held.bars(63, spark.createDataFrame([("US", LAST)], "market string, run_date date")).filter("ticker = 'P1'")
    assert seen.filter("bar_date < DATE '2025-07-01'").count() >= 123
    assert held.spans(63, {"US": (date(2020, 1, 1), date(2020, 1, 1)), "none": (LAST, LAST)}) == {}
    assert held.bars(63, spark.createDataFrame([("US", date(2020, 1, 1))], "market string, run_date date")).count() == 0


def test_what_may_not_be_appended(spark, history, held):
    path, plain = history
    n = spark.table(held.name).count()
    assert n == plain.count()
    bar = plain.filter("ticker = 'P3'").limit(1)
    fresh = bar.withColumn("bar_date", F.lit(date(2026, 2, 2)))
    for bad, text in ((bar, "there already"), (fresh.union(fresh), "repeated bar"), (fresh.withColumn("ticker", F.lit(None).cast("string")), "without market"), (fresh.union(bar), "there already")):
        with pytest.raises(DataError, match=text):
            held.append(bad)
    assert spark.table(held.name).count() == n
    again = BarTable(spark, f"bars_{uuid.uuid4().hex[:8]}", f"{path}/table", 4)  # another session over the same files
    assert spark.table(again.name).count() == n and again.quarters() == held.quarters()
    empty = BarTable(spark, f"bars_{uuid.uuid4().hex[:8]}", f"{path}/other", 2)
    assert empty.bars(63, spark.createDataFrame([("US", LAST)], "market string, run_date date")).count() == 0
    empty.append(fresh.withColumn("more", F.lit(1)))
    assert rows(empty.bars(63, spark.createDataFrame([("US", LAST), ("TW", date(2026, 2, 3))], "market string, run_date date"))) == rows(fresh.select(*COLUMNS)) != []
    with pytest.raises(Invalid):
        BarTable(spark, "x; DROP TABLE y", path, 4)


def test_bars_dealt_by_ticker_are_not_moved(spark, tmp_path):
    """Bars that come laid out as the buckets are appended without a shuffle, and read back as they were."""
    bars = panel.bars(spark, SF, by=("ticker",)).filter("cast(substring(ticker, 2) as int) <= 30")
    table = BarTable(spark, f"bars_{uuid.uuid4().hex[:8]}", f"{tmp_path}/dealt", panel.tasks(spark, SF))
    tracker = spark.sparkContext._jsc.sc().statusStore()
    empty = spark.sparkContext._jvm.java.util.ArrayList
    moved = lambda: sum(s.shuffleWriteRecords() for s in (lambda x: [x.apply(i) for i in range(x.size())])(tracker.stageList(empty(), False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), empty())))
    before = moved()
    for part in ("bar_date < DATE '2025-08-15'", "bar_date >= DATE '2025-08-15'"):
        table.append(bars.filter(part), dealt=True)
    assert moved() - before < bars.count() / 2 and rows(spark.table(table.name).select(*COLUMNS)) == rows(bars)
    with pytest.raises(DataError, match="there already"):
        table.append(bars.filter("bar_date = DATE '2025-09-15'"), dealt=True)
