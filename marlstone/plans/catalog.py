"""The registered queries over the test tables, with their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import tables
from marlstone.sources import panel
from marlstone.sources.bar_table import BarTable

from . import engine, fundamentals, projections, relational, solvers, statement_facts, valuation
from .profiles import PROFILES as PLAIN
from .profiles_setups import SETUPS

if twice := PLAIN.keys() & SETUPS.keys():
    raise ValueError(f"profiles registered twice: {sorted(twice)}")
PROFILES = PLAIN | SETUPS
#: Profiles that are also ranked over a table of bars: one that keeps 63 bars, one that keeps 126.
TABLED = ("liquidity_quality_v1", "volatility_quality_v1")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of each market and horizon by the first profile."""
    return ranking("sample_price_trend_v1")(spark, sf_dir).filter("rank <= 10")


def ranking(profile_id: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = PROFILES[profile_id]
        return engine.rankings(p, engine.snapshot(p, panel.bars(spark, sf_dir)))

    return run


def over_runs(profile_id: str) -> Callable[[SparkSession, str], DataFrame]:
    """Rankings of all runs of the panel's calendar in one plan."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = PROFILES[profile_id]
        return engine.rankings(p, engine.snapshot(p, panel.bars(spark, sf_dir), runs=panel.runs(spark, sf_dir)))

    return run


#: From this day on, the panel's bars come to its table by a second append.
LATER = "2025-08-15"


def over_table(profile_id: str) -> Callable[[SparkSession, str], DataFrame]:
    """Rankings of the calendar's runs over bars kept as a table, to which the latest were appended; only the quarters that runs need are read."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p, bars, runs = PROFILES[profile_id], panel.bars(spark, sf_dir, by=("ticker",)), panel.runs(spark, sf_dir)
        path = tables.reserved(spark, "bars")
        held = BarTable(spark, os.path.basename(path).replace("-", "_"), path, panel.tasks(spark, sf_dir))
        held.append(bars.filter(F.col("bar_date") < LATER), dealt=True)
        held.append(bars.filter(F.col("bar_date") >= LATER), dealt=True)
        return engine.rankings(p, engine.snapshot(p, held.bars(p.keep, runs), runs=runs))

    return run


def valuation_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valuation.value(valuation.facts(spark, sf_dir), valuation.scenarios(spark))


def fundamental_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fundamentals.rankings(fundamentals.eligible(panel.bars(spark, sf_dir), spark.read.parquet(f"{sf_dir}/lineitem.parquet")))


def snapshot(profile_id: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine.rounded(engine.snapshot(PROFILES[profile_id], panel.bars(spark, sf_dir)))


def relation(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in relational.TABLES if f"{{{t}}}" in text})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {f"rank_{p}": ranking(p) for p in PROFILES} | {"rank_fundamental_quality_profitability_v1": fundamental_ranking}
    out |= {f"snapshot_{p}": snapshot(p) for p in PROFILES} | {"valuation_models": valuation_models}
    out |= {f"runs_{p}": over_runs(p) for p in PROFILES} | {f"table_{p}": over_table(p) for p in TABLED} | {"statement_facts": statement_facts.run, "valuation_solvers": solvers.run, "valuation_projections": projections.run}
    return out | {f"op_{n}": relation(x) for n, x in relational.SQL.items()}


def oracle_sql() -> dict[str, str]:
    bars = panel.bars_sql()
    out = {f"rank_{p}": engine.rankings_sql(PROFILES[p], bars) for p in PROFILES} | {"rank_fundamental_quality_profitability_v1": fundamentals.oracle(bars)}
    out |= {f"snapshot_{p}": engine.snapshot_sql(PROFILES[p], bars) for p in PROFILES} | {"valuation_models": valuation.value_sql()}
    out |= {f"{kind}_{p}": engine.rankings_sql(PROFILES[p], bars, panel.runs_sql()) for kind, ps in (("runs", PROFILES), ("table", TABLED)) for p in ps} | {"statement_facts": statement_facts.oracle(), "valuation_solvers": solvers.oracle(), "valuation_projections": projections.oracle()}
    return out | {f"op_{n}": x.format(**{t: t for t in relational.TABLES}) for n, x in relational.SQL.items()}
