"""The screening engine against DuckDB, and its features and scores against plain Python."""

import math
import os
import re
import statistics
from datetime import date

import duckdb
import pytest
from pyspark.sql import functions as F

from marlstone.functions import sqlexpr
from marlstone.operators import features
from marlstone.plans import catalog, engine, relational, valuation
from marlstone.sources import panel

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def same(spark, con, name):
    got = catalog.queries()[name](spark, SF)
    want = con.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    a = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    at = {c: i for i, c in enumerate(want.columns)}
    b = sorted((tuple(r[at[c]] for c in columns) for r in want.fetchall()), key=repr)
    assert a == b
    return a


@pytest.mark.parametrize("name", ["rank_sample_price_trend_v1", "rank_trend_quality_v1", "rank_base_breakout_quality_v1", "rank_fundamental_quality_profitability_v1", "valuation_models", "table_liquidity_quality_v1"])
def test_like_duckdb(spark, con, name):
    assert same(spark, con, name)


def test_relational_like_duckdb(spark, con):
    for n in relational.SQL:
        same(spark, con, f"op_{n}")


def test_markets_have_their_own_as_of_dates(spark):
    """A market whose last bar is a day behind another's loses no ticker."""
    bars = panel.bars(spark, SF)
    behind = bars.filter("market = 'US' or bar_date < (date '2025-01-01' + 279)")
    for profile_id in ("sample_price_trend_v1", "trend_quality_v1"):
        p = catalog.PROFILES[profile_id]
        for market in ("US", "TW"):
            alone = engine.snapshot(p, behind.filter(f"market = '{market}'"))
            both = engine.snapshot(p, behind).filter(f"market = '{market}'")
            assert sorted(map(repr, both.collect())) == sorted(map(repr, alone.collect())) and alone.count() > 10


def test_metrics_that_are_no_numbers_go(spark):
    bars = panel.bars(spark, SF).filter("ticker in ('P1', 'P2', 'P5')")
    p = catalog.PROFILES["sample_price_trend_v1"]
    some = {r["ticker"] for r in engine.snapshot(p, bars).collect()}
    broken = bars.selectExpr("market", "ticker", "bar_date", "open", "high", "low", "close", "adjusted_close", "case when ticker = 'P1' then double('NaN') else volume end as volume")
    assert "P1" in some and {r["ticker"] for r in engine.snapshot(p, broken).collect()} == some - {"P1"}


def test_features_like_python(spark):
    bars = panel.bars(spark, SF).filter("ticker in ('P1', 'P3', 'P4', 'P9')")
    names = ["return_60d", "volatility_60d", "max_drawdown_120d", "slope_60d", "r2_60d", "sma_200d", "median_range_pct_20d", "days_since_60d_high", "amihud_60d", "above_ma60", "stale_close_59", "downside_std_60d"]
    got = {r["ticker"]: r for r in features.aggregate(bars, "A", 280, names).collect()}
    series = {}
    for r in bars.orderBy("bar_date").collect():
        series.setdefault(r["ticker"], []).append(r)
    for t, rows in series.items():
        ac = [r["adjusted_close"] for r in rows]
        ret = [b / a - 1 for a, b in zip(ac, ac[1:])]
        close = lambda key, x, tol=1e-9: got[t][f"f_{key}"] == pytest.approx(x, abs=tol)  # noqa: B023, E731
        assert close("return_60d", ac[-1] / ac[-61] - 1) and close("volatility_60d", statistics.stdev(ret[-60:])) and close("sma_200d", sum(ac[-200:]) / 200)
        peak, worst = ac[-120], 0.0
        for v in ac[-120:]:
            peak = max(peak, v)
            worst = min(worst, v / peak - 1)
        assert close("max_drawdown_120d", worst)
        y, x = [math.log(v) for v in ac[-60:]], list(range(60))
        slope, cut = statistics.linear_regression(x, y)
        total = sum((v - statistics.fmean(y)) ** 2 for v in y)
        assert close("slope_60d", slope) and close("r2_60d", 1 - sum((v - cut - slope * i) ** 2 for i, v in zip(x, y)) / total, 1e-7)
        assert close("median_range_pct_20d", statistics.median((r["high"] - r["low"]) / r["close"] for r in rows[-20:]))
        top = max(ac[-60:])
        assert got[t]["f_days_since_60d_high"] == next(k for k, v in enumerate(reversed(ac)) if v == top)
        tv = [r["close"] * r["volume"] for r in rows]
        parts = [abs(ret[-k]) / tv[-k] for k in range(1, 60) if tv[-k] > 0]
        assert close("amihud_60d", sum(parts) / len(parts), 1e-16)
        assert close("above_ma60", sum(ac[-k] > sum(ac[len(ac) - k - 59 : len(ac) - k + 1]) / 60 for k in range(1, 127)) / 126)
        assert got[t]["f_stale_close_59"] == sum(rows[-k]["close"] == rows[-k - 1]["close"] for k in range(1, 60))
        assert close("downside_std_60d", statistics.stdev(min(v, 0.0) for v in ret[-60:]))


def test_percentiles(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 3.0), ("a", -1.0), ("b", 5.0)], "market string, x double")
    got = {(r["market"], r["x"]): (r["h"], r["l"], r["p"]) for r in df.selectExpr("*", *[f"{sqlexpr.doubles(sqlexpr.percentile('x', b))} as {b[0]}" for b in ("high", "low", "positive")]).collect()}
    assert got["b", 5.0] == (1.0, 1.0, 1.0)
    assert got["a", 3.0] == pytest.approx((1 - 0.5 / 3, 1 - 2.5 / 3, 1 - 0.5 / 2))
    assert got["a", 1.0] == pytest.approx((1 - 2 / 3, 1 - 1 / 3, 0.0)) and got["a", -1.0][2] == 0.0


def test_bands_and_caps(spark):
    row = spark.sql(sqlexpr.doubles(f"SELECT {', '.join(sqlexpr.band(str(x), (1.0, 2.0), (0.0, 4.0)) for x in (0.0, 0.5, 1.0, 2.0, 3.0, 4.0))}")).first()
    assert list(row) == [0.0, 0.5, 1.0, 1.0, 0.5, 0.0]


def test_ranks_are_contiguous_and_horizons_complete(spark):
    for p in list(catalog.PROFILES.values())[:2]:
        rows = engine.rankings(p, engine.snapshot(p, panel.bars(spark, SF))).collect()
        for m in ("US", "TW"):
            sets = []
            for h in p.horizons:
                part = [r for r in rows if r["market"] == m and r["horizon"] == h]
                assert sorted(r["rank"] for r in part) == list(range(1, len(part) + 1))
                sets.append({r["ticker"] for r in part})
            assert all(s == sets[0] for s in sets)


def test_listing_restricts_and_empty_bars(spark):
    p, bars = catalog.PROFILES["sample_price_trend_v1"], panel.bars(spark, SF)
    listed = spark.createDataFrame([("US", "P1"), ("US", "P1")], "market string, ticker string")
    assert {r["ticker"] for r in engine.snapshot(p, bars, listed).collect()} <= {"P1"}
    assert engine.rankings(p, engine.snapshot(p, bars.limit(0))).count() == 0


def test_solved_rates_give_the_price(spark):
    rows = valuation.value(valuation.facts(spark, SF), valuation.scenarios(spark)).filter("solved is not null").collect()
    assert rows and all(abs(r["spread"]) < 1e-4 for r in rows)


@pytest.fixture(scope="module")
def some_bars(spark):
    return panel.bars(spark, SF).filter("cast(substring(ticker, 2) as int) <= 45").cache()


@pytest.mark.parametrize("profile_id", ["sample_price_trend_v1", "trend_quality_v1", "base_breakout_quality_v1", "relative_strength_leader_v1"])
def test_runs_in_one_plan_are_those_of_each_date(spark, some_bars, profile_id):
    """Each run of a calendar ranks what a run by itself ranks on bars that end on its date; a ticker's repeated or missing bars count up to that date only."""
    p = catalog.PROFILES[profile_id]
    again = some_bars.filter("ticker = 'P1' and bar_date = date'2025-10-06'")  # repeated from then on
    bars = some_bars.filter("not (ticker = 'P2' and bar_date > date'2025-10-05')").unionByName(again)
    dates = {"old": date(2025, 10, 5), "near": date(2025, 10, 6), "now": date(2025, 10, 7)}
    runs = spark.createDataFrame([(f"{m}-{n}", m, d) for m in ("US", "TW") for n, d in dates.items()], "run_id string, market string, run_date date")
    got = engine.rankings(p, engine.snapshot(p, bars, runs=runs)).collect()
    for name, day in dates.items():
        alone = engine.rankings(p, engine.snapshot(p, bars.filter(F.col("bar_date") <= F.lit(day)))).collect()
        assert sorted(map(tuple, alone)) == sorted(tuple(r)[1:] for r in got if r["run_id"].endswith(name)) and alone


def test_a_feed_that_stops_early(spark, some_bars):
    """On a run date without bars, rules A and the leaders' profile rank nobody; B and C take the last date that there is."""
    runs = spark.createDataFrame([("late", m, date(2025, 10, 9)) for m in ("US", "TW")], "run_id string, market string, run_date date")
    for profile_id, p in catalog.PROFILES.items():
        rows = engine.snapshot(p, some_bars, runs=runs, dated=True).select("as_of").distinct().collect()
        stops = p.rule == "A" or profile_id == "relative_strength_leader_v1"
        assert [r["as_of"] for r in rows] == ([] if stops else [date(2025, 10, 7)]), profile_id
    before = spark.createDataFrame([("early", "US", date(2024, 1, 1))], "run_id string, market string, run_date date")
    assert engine.snapshot(catalog.PROFILES["trend_quality_v1"], some_bars, runs=before).count() == 0


def test_runs_need_one_shuffle_of_bars(spark, some_bars):
    """Runs are joined after the bars are shuffled (not at all, if they are laid out by ticker), and only bars that a run keeps reach its windows."""
    p = catalog.PROFILES["sample_price_trend_v1"]
    runs = spark.createDataFrame([(f"r{i}", "US", date(2025, 10, 7 - i)) for i in range(5)], "run_id string, market string, run_date date")
    plan = lambda bars: engine.snapshot(p, bars, runs=runs)._jdf.queryExecution().executedPlan().toString()
    moved = lambda text: len(re.findall(r"Exchange hashpartitioning\(market#\d+, ticker#\d+, \d+\), ENSURE_REQUIREMENTS", text))
    dealt = plan(some_bars.select("*").repartition(3))
    assert moved(dealt) == 1 and "BroadcastHashJoin" in dealt
    assert moved(plan(panel.bars(spark, SF))) == 0
    held = features.windowed(some_bars.filter("ticker = 'P1'"), p.keep).join(runs, "market").filter(features.IN_RUN.replace("as_of", "run_date"))
    assert held.groupBy("run_id").count().filter(f"count <> {p.keep}").count() == 0


def test_runs_bars_are_neither_sorted_nor_windowed(spark, some_bars, monkeypatch):
    """A run's bars stream into one aggregation that no sort precedes, and a task's share of tickers is bounded, however many there are."""
    runs = spark.createDataFrame([("a", "US", date(2025, 10, 7)), ("b", "US", date(2025, 10, 5))], "run_id string, market string, run_date date")
    for name in ("trend_pullback_quality_v1", "defensive_compounder_quality_v1", "liquidity_quality_v1"):
        plan = engine.snapshot(catalog.PROFILES[name], some_bars, runs=runs)._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Sort [" not in plan
    monkeypatch.setattr(panel, "TASK_TICKERS", 10)
    assert panel.bars(spark, SF).rdd.getNumPartitions() == 20


@pytest.mark.parametrize("keep", [126, 280])
def test_features_of_odd_bars_are_those_of_the_sql(spark, some_bars, keep):
    """Repeated dates, gaps, nulls, NaN, bars without a date and runs between bars: the same as by the windows of the SQL."""
    odd = some_bars.filter("cast(substring(ticker, 2) as int) <= 16 AND NOT (ticker = 'P3' AND day(bar_date) % 3 = 0)").selectExpr(
        "market", "ticker", "bar_date", "CASE WHEN ticker = 'P1' AND day(bar_date) = 7 THEN NULL ELSE open END AS open", "high", "low", "CASE WHEN ticker = 'P4' AND day(bar_date) = 2 THEN double('NaN') ELSE close END AS close",
        "CASE WHEN ticker = 'P5' AND day(bar_date) = 3 THEN NULL WHEN ticker = 'P8' AND day(bar_date) = 4 THEN 0D ELSE adjusted_close END AS adjusted_close", "CASE WHEN ticker = 'P6' AND day(bar_date) = 5 THEN NULL ELSE volume END AS volume",
    )
    twice = some_bars.filter("ticker IN ('P9', 'P10') AND bar_date = DATE '2025-09-20'")
    undated = some_bars.filter("ticker IN ('P12', 'P10') AND bar_date = DATE '2025-10-06'").withColumn("bar_date", F.lit(None).cast("date"))
    odd = odd.unionByName(twice).unionByName(undated)
    odd.createOrReplaceTempView("odd_bars")
    runs = spark.createDataFrame([(f"{m}{d}", m, date(2025, 10, d)) for m in ("US", "TW") for d in (2, 5, 9)] + [("early", "US", date(2025, 3, 1)), ("none", "US", date(2024, 1, 1))], "run_id string, market string, run_date date")
    runs.createOrReplaceTempView("odd_runs")
    names = list(features.FEATURES)
    got = {(r["run_id"], r["ticker"]): r for r in features.aggregate(odd, "C", keep, names, runs).collect()}
    want = {(r["run_id"], r["ticker"]): r for r in spark.sql(features.aggregate_sql("SELECT * FROM odd_bars", "C", keep, names, "SELECT * FROM odd_runs")).collect()}
    assert got.keys() == want.keys() and len(got) > 50
    for key, row in want.items():
        for c, v in row.asDict().items():
            assert got[key][c] == v or (isinstance(v, float) and got[key][c] == pytest.approx(v, rel=1e-9, abs=1e-12, nan_ok=True)), (key, c)


def test_bars_are_looked_up_in_one_array(spark, some_bars):
    """No window adds up 60 values a bar, no arrays are zipped, and the bars' structs are made by generated code before they are collected."""
    for name in ("momentum_quality_v1", "mean_reversion_quality_v1", "defensive_compounder_quality_v1", "liquidity_quality_v1"):
        plan = engine.snapshot(catalog.PROFILES[name], some_bars)._jdf.queryExecution().executedPlan().toString()
        assert "collect_list(bar#" in plan and "Window" not in plan and "arrays_zip" not in plan, name


def test_means_of_60_bars_of_short_and_holed_series(spark):
    """Sums of moved halves against plain means of what there is."""
    values = {"short": [float(i) for i in range(7)], "long": [100.0 + i * i % 37 for i in range(150)], "holed": [None if i % 5 == 2 or 20 <= i < 90 else float(i) for i in range(160)], "none": [None] * 3}
    series = spark.createDataFrame([(k, [(v,) for v in vs]) for k, vs in values.items()], "k string, bars array<struct<adjusted_close: double>>")
    for r in features._with_ma60(series).select("k", "ma60").collect():
        vs = values[r["k"]]
        for i, got in enumerate(r["ma60"]):
            there = [v for v in vs[max(0, i - 59) : i + 1] if v is not None]
            assert got == (pytest.approx(sum(there) / len(there), rel=1e-12) if there else None), (r["k"], i)
