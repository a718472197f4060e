"""Roots between bounds, found row by row inside an expression, each with how the search ended.

A search is a fold over the steps allowed. A step evaluates the function once, at the middle; once a row is done its state is handed on as it is,
so later steps cost it nothing. How it ended: solved, same sign (both bounds lie on one side), width (the bracket became narrower than numbers tell apart
before the value came near), steps (they didn't suffice), no value (a bound or the function is null).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.sqlexpr import doubles

from . import valuation

SOLVED, SAME_SIGN, WIDTH, STEPS, NO_VALUE = "solved", "same sign", "width", "steps", "no value"


def bisected(off: Callable[[str], str], low: str, high: str, tolerance: str, steps: str, least_width: float | None = None) -> str:
    """A struct (root, residual, status, steps) of the root of off() between two expressions; a bound whose value is within the tolerance is the root."""
    none = "CAST(NULL AS DOUBLE)"
    end = lambda root, residual, status, n: f"named_struct('root', {root}, 'residual', {residual}, 'status', '{status}', 'steps', {n})"
    state = lambda lo, hi, f, root, residual, status, n: f"named_struct('lo', {lo}, 'hi', {hi}, 'f', {f}, 'root', {root}, 'residual', {residual}, 'status', {status}, 'n', {n})"
    narrow = lambda a, b: "''" if least_width is None else f"CASE WHEN abs({b} - {a}) <= CAST({least_width} AS DOUBLE) THEN '{WIDTH}' ELSE '' END"
    step = (
        f"CASE WHEN abs(p.y) <= {tolerance} THEN {state('s.lo', 's.hi', 's.f', 'p.x', 'p.y', f"'{SOLVED}'", 's.n + 1')}"
        f" WHEN s.f * p.y > 0.0 THEN {state('p.x', 's.hi', 'p.y', none, none, narrow('p.x', 's.hi'), 's.n + 1')}"
        f" ELSE {state('s.lo', 'p.x', 's.f', none, none, narrow('s.lo', 'p.x'), 's.n + 1')} END"
    )
    once = f"transform(transform(array((s.lo + s.hi) / 2.0), x -> named_struct('x', x, 'y', {off('x')})), p -> {step})[0]"
    begin = state(low, high, off(low), none, none, "''", "0")
    fold = f"aggregate(sequence(1, {steps}), {begin}, (s, i) -> CASE WHEN s.status <> '' THEN s ELSE {once} END, s -> named_struct('root', s.root, 'residual', s.residual, 'status', CASE WHEN s.status = '' THEN '{STEPS}' ELSE s.status END, 'steps', s.n))"
    return doubles(
        f"CASE WHEN ({off(low)}) IS NULL OR ({off(high)}) IS NULL THEN {end(none, none, NO_VALUE, 0)} WHEN abs({off(low)}) <= {tolerance} THEN {end(low, off(low), SOLVED, 0)}"
        f" WHEN abs({off(high)}) <= {tolerance} THEN {end(high, off(high), SOLVED, 0)} WHEN ({off(low)}) * ({off(high)}) > 0.0 THEN {end(none, none, SAME_SIGN, 0)} ELSE {fold} END"
    )


# ---------------------------------------------------------------- the query: growth that each part's price implies

LEAST_WIDTH = 1e-12
#: Bounds, tolerance and steps of each row, by its number, so that searches end in every way.
CASES = {
    "lo": "CASE WHEN k % 7 = 0 THEN 0.9 ELSE -0.5 END", "hi": "CASE WHEN k % 7 = 0 THEN 0.95 ELSE 1.0 END", "tolerance": "CASE WHEN k % 3 = 0 THEN 0.000000001 WHEN k % 11 = 0 THEN 50000000.0 ELSE 0.5 END",
    "most": "CASE WHEN k % 5 = 0 THEN 6 ELSE 200 END",
}


def _off(x: str) -> str:
    return f"({valuation.dcf(x, 'r')} - {valuation.TARGET})"


COLUMNS = {"root": "round(root, 8)", "residual": "round(abs(residual) / shares, 6)", "status": "status", "steps": "CAST(steps AS BIGINT)"}


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, scenario, root, residual of a share, status, steps."""
    known = valuation.facts(spark, sf_dir).withColumn("k", F.expr("cast(substring(ticker, 2) as bigint)"))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = known.repartition(tasks, "ticker").crossJoin(F.broadcast(valuation.scenarios(spark)))  # a few scenarios
    rows = rows.select("*", *[F.expr(doubles(x)).alias(n) for n, x in CASES.items()])
    found = rows.select("ticker", "scenario", "shares", F.expr(bisected(_off, "lo", "hi", "tolerance", "most", LEAST_WIDTH)).alias("s")).select("ticker", "scenario", "shares", "s.*")
    return found.select("ticker", "scenario", *[F.expr(doubles(x)).alias(n) for n, x in COLUMNS.items()])


def oracle() -> str:
    """The same as a recursive query, a row for each step."""
    table = " UNION ALL ".join(f"SELECT '{s}' AS scenario, CAST({valuation.DISCOUNT[i]} AS DOUBLE) AS r, CAST({valuation.TERMINAL[i]} AS DOUBLE) AS tg" for i, s in enumerate(valuation.SCENARIOS))
    source = ", ".join(f"{x} AS {n}" for n, x in valuation.FACTS.items())
    mid, none = "((lo + hi) / 2.0)", "CAST(NULL AS DOUBLE)"
    cases = ", ".join(f"{x} AS {n}" for n, x in CASES.items())
    return doubles(f"""
WITH RECURSIVE lines AS (SELECT l_partkey, sum(CAST(l_quantity AS BIGINT)) AS q, count(*) AS n FROM lineitem GROUP BY l_partkey), facts AS (SELECT {source}, p_partkey AS k FROM part JOIN lines ON p_partkey = l_partkey),
rows AS (SELECT *, {cases} FROM facts CROSS JOIN ({table})),
begun AS (SELECT *, {_off('lo')} AS f, {_off('hi')} AS g FROM rows),
b AS (
  SELECT * EXCLUDE (g), CASE WHEN f IS NULL OR g IS NULL THEN '{NO_VALUE}' WHEN abs(f) <= tolerance OR abs(g) <= tolerance THEN '{SOLVED}' WHEN f * g > 0.0 THEN '{SAME_SIGN}' ELSE '' END AS status,
    CASE WHEN abs(f) <= tolerance THEN lo WHEN abs(g) <= tolerance THEN hi END AS root, CASE WHEN abs(f) <= tolerance THEN f WHEN abs(g) <= tolerance THEN g END AS residual, CAST(0 AS BIGINT) AS steps FROM begun
  UNION ALL
  SELECT ticker, starting_fcf, net_debt, shares, price, k, scenario, r, tg, CASE WHEN f * y > 0.0 THEN x ELSE lo END AS lo, CASE WHEN f * y > 0.0 THEN hi ELSE x END AS hi, tolerance, most, CASE WHEN f * y > 0.0 THEN y ELSE f END AS f,
    CASE WHEN abs(y) <= tolerance THEN '{SOLVED}' WHEN abs(CASE WHEN f * y > 0.0 THEN hi - x ELSE x - lo END) <= {LEAST_WIDTH:.12f} THEN '{WIDTH}' WHEN steps + 1 = most THEN '{STEPS}' ELSE '' END AS status,
    CASE WHEN abs(y) <= tolerance THEN x ELSE {none} END AS root, CASE WHEN abs(y) <= tolerance THEN y ELSE {none} END AS residual, steps + 1 AS steps
  FROM (SELECT *, {mid} AS x, {_off(mid)} AS y FROM b WHERE status = '')
)
SELECT ticker, scenario, {', '.join(f'{x} AS {n}' for n, x in COLUMNS.items())} FROM b WHERE status <> ''
""")
