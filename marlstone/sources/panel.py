"""A dense panel of daily bars, made from the keys of `part` by closed formulas that any SQL engine computes alike.

Closes are multiples of 1/256, so sums of them and of close times volume are exact. Regimes (key modulo 14) make some
tickers pass and some fail each gate; ties occur, as the formulas repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.sqlexpr import doubles

DAYS = 280
#: Bars of regime 9 repeat the close of this day from then on.
FROZEN = 273

_R, _PH = "(k % 14)", "(CAST(floor(k / 14.0) AS BIGINT) % 11)"
_I = f"CAST(CASE WHEN {_R} = 9 THEN least(i, {FROZEN}) ELSE i END AS DOUBLE)"


def _pow(base: float, exponent: str) -> str:
    return f"pow({base}, CAST({exponent} AS DOUBLE))"


#: The closes of each regime on day i before scaling: our own shapes, each meant to pass some setups' gates and to fail others'.
CLOSE = {
    1: f"33.0 + 0.24 * {_I} + 0.8 * sin({_I} / 5.0 + {_PH})",  # steady climb
    2: f"46.0 + 41.0 * (1.0 - {_pow(0.985, 'i')}) + 0.9 * sin(i / 6.0 + {_PH})",  # climb that levels off into a base
    3: f"36.0 * {_pow(1.0032, 'least(i, 248)')} * {_pow(0.9981, 'greatest(i - 248, 0)')} * (1.0 + 0.003 * sin(i / 3.0 + {_PH}))",  # pullback
    4: f"(61.0 + 0.1 * least(i, 246) + 0.5 * sin(least(i, 246) / 10.0 + {_PH})) * {_pow(0.9945, 'greatest(0, least(i, 273) - 246)')} * {_pow(1.005, 'greatest(0, i - 273)')}",  # slump that turns
    5: f"58.0 * {_pow(1.0025, 'least(i, 244)')} * {_pow(0.978, 'greatest(i - 244, 0)')}",  # slump that goes on
    6: f"72.0 * {_pow(1.0006, 'i')} * (1.0 + 0.0007 * (i % 3))",  # hardly moving
}
_ELSE = f"35.0 + 0.07 * {_I} + 0.45 * sin({_I} / 11.0 + {_PH})"
_RAW = f"CASE {' '.join(f'WHEN {_R} = {r} THEN {x}' for r, x in CLOSE.items())} ELSE {_ELSE} END"
_SCALE = f"((1.0 + (k % 17) / 20.0) * CASE WHEN {_R} = 12 THEN 0.05 ELSE 1.0 END)"

CLOSE_SQL = doubles(f"floor(({_RAW}) * {_SCALE} * 256.0) / 256.0")
VOLUME_SQL = doubles(f"CAST(CASE WHEN {_R} = 7 THEN 1000 WHEN {_R} = 8 AND i >= 274 THEN 0 ELSE 2150000 + (k * 7919 + i * 104729) % 600000 END AS DOUBLE)")
KEEP_SQL = f"NOT ({_R} = 10 AND i < 180) AND NOT ({_R} = 11 AND i = 279)"
MARKET_SQL = "CASE WHEN k % 3 = 0 THEN 'TW' ELSE 'US' END"
HIGH_SQL, LOW_SQL = doubles(f"CASE WHEN {_R} = 13 AND i = 277 THEN close * 0.94 ELSE close * 1.008 END"), doubles("close * 0.991")
COLUMNS = ["market", "ticker", "bar_date", "open", "high", "low", "close", "adjusted_close", "volume"]


#: Tickers whose bars a task sorts in memory: a million bars.
TASK_TICKERS = 4096


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks among which tickers are dealt: a key is few bytes, but stands for DAYS bars, so their number grows with the keys."""
    keys = spark.read.parquet(f"{sf_dir}/part.parquet").count()  # from the files' footers
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys // TASK_TICKERS))


def bars(spark: SparkSession, sf_dir: str, by: tuple[str, ...] = ("market", "ticker")) -> DataFrame:
    """The panel, laid out by market and ticker (or by ticker alone): keys are dealt before they become bars, so what groups by ticker moves no bar."""
    named = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k")).select("k", F.expr(MARKET_SQL).alias("market"), F.expr("concat('P', k)").alias("ticker"))
    keys = named.repartition(tasks(spark, sf_dir), *by).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DAYS - 1).cast("long"))).alias("i"))
    priced = keys.filter(KEEP_SQL).select("k", "market", "ticker", "i", F.expr(CLOSE_SQL).alias("close"), F.expr(VOLUME_SQL).alias("volume"))
    return priced.select(
        "market", "ticker", F.expr("date_add(DATE '2025-01-01', cast(i as int))").alias("bar_date"),
        F.col("close").alias("open"), F.expr(HIGH_SQL).alias("high"), F.expr(LOW_SQL).alias("low"), "close", F.col("close").alias("adjusted_close"), "volume",
    )


def bars_sql() -> str:
    """The same panel in SQL, as a subquery's text."""
    return (
        f"SELECT {MARKET_SQL} AS market, concat('P', k) AS ticker, DATE '2025-01-01' + CAST(i AS INT) AS bar_date, close AS open, {HIGH_SQL} AS high, {LOW_SQL} AS low, close, close AS adjusted_close, volume"
        f" FROM (SELECT k, i, {CLOSE_SQL} AS close, {VOLUME_SQL} AS volume FROM (SELECT p_partkey AS k, i FROM part CROSS JOIN range({DAYS}) t(i)) WHERE {KEEP_SQL})"
    )


#: Runs of a market by their distance in days from the last date of its bars: two that look back, one that is up to date, one whose feed stopped early.
RUN_DAYS = (-3, -1, 0, 1)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calendar of runs over the panel: run_id, market, run_date."""
    last = bars(spark, sf_dir).groupBy("market").agg(F.max("bar_date").alias("last"))
    days = last.select("market", "last", F.explode(F.array(*[F.lit(d) for d in RUN_DAYS])).alias("day"))
    return days.select(F.expr("concat(market, '-', cast(day as string))").alias("run_id"), "market", F.expr("date_add(last, day)").alias("run_date"))


def runs_sql() -> str:
    days = ", ".join(f"({d})" for d in RUN_DAYS)
    return f"SELECT concat(market, '-', CAST(day AS VARCHAR)) AS run_id, market, last + CAST(day AS INT) AS run_date FROM (SELECT market, max(bar_date) AS last FROM ({bars_sql()}) GROUP BY market) CROSS JOIN (VALUES {days}) v(day)"
