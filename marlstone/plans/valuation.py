"""Set-based valuation: facts of a whole universe times assumption scenarios, six models, two of them by bisection.

Projections are folds over years with higher-order functions, so a row never leaves its partition; scenarios are a table
of a few rows, joined as a broadcast. Bisection is a fold over a fixed number of steps that stands still once it is done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.sqlexpr import doubles

# Scenarios by model (rates, multiples, years), in the order conservative, base, upside.
SCENARIOS = ("conservative", "base", "upside")
YEARS, STAGE1, STAGE2 = 5, 3, 4
GROWTH, STAGE2_GROWTH = (0.02, 0.05, 0.08), (0.01, 0.03, 0.05)
DISCOUNT, TERMINAL = (0.10, 0.09, 0.08), (0.02, 0.025, 0.03)
EXIT_MULTIPLE, EV_MULTIPLE = (10.0, 14.0, 18.0), (12.0, 15.0, 20.0)
GROWTH_BOUNDS, DISCOUNT_BOUNDS = (-0.5, 1.0), (0.04, 0.5)
STEPS, PLACES = 60, 6
MODELS = ("fcf_dcf_v1", "two_stage_fcf_dcf_v1", "exit_multiple_dcf_v1", "multiple_valuation_v1", "reverse_dcf_v1", "implied_discount_rate_v1")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, starting_fcf, net_debt, shares, price of every part."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_partkey").agg(F.expr("sum(CAST(l_quantity AS BIGINT))").alias("q"), F.count("*").alias("n"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return parts.join(lines, F.col("p_partkey") == F.col("l_partkey")).select(*[F.expr(doubles(x)).alias(n) for n, x in FACTS.items()])


FACTS = {
    "ticker": "concat('P', p_partkey)",
    "starting_fcf": "CAST(1000 * q + 5000 * n AS DOUBLE)",
    "net_debt": "CAST(2000 * n - 300 * p_size AS DOUBLE)",
    "shares": "CAST(1000 + 10 * p_size AS DOUBLE)",
    "price": "CAST(5000 + p_partkey * 37 % 15000 AS DOUBLE)",
}


def scenarios(spark: SparkSession) -> DataFrame:
    rows = [(s, *[float(x[i]) for x in (GROWTH, STAGE2_GROWTH, DISCOUNT, TERMINAL, EXIT_MULTIPLE, EV_MULTIPLE)]) for i, s in enumerate(SCENARIOS)]
    return spark.createDataFrame(rows, "scenario string, g double, g2 double, r double, tg double, exit_multiple double, ev_multiple double")


def _present(flow: str, rate: str = "r", n: int = YEARS) -> str:
    """Sum of discounted flows of years 1 to n; flow is an expression of the year t."""
    return "(" + " + ".join(f"({flow.replace('{t}', str(t))}) / pow(1.0 + {rate}, {t}.0)" for t in range(1, n + 1)) + ")"


def _growing(g: str) -> str:
    return "starting_fcf * pow(1.0 + " + g + ", {t}.0)"


def dcf(g: str, r: str, years: int = YEARS) -> str:
    """Flows that grow by g, discounted by r, and what follows them: a nested product, as each flow is the one before times q."""
    q = f"((1.0 + {g}) / (1.0 + {r}))"
    out = f"(1.0 + (1.0 + tg) / ({r} - tg))"
    for _ in range(years - 1):
        out = f"(1.0 + {q} * {out})"
    return f"(starting_fcf * {q} * {out})"


def _two_stage(stage1: int = STAGE1, stage2: int = STAGE2) -> str:
    n = stage1 + stage2
    flow = [f"starting_fcf * pow(1.0 + g, {min(t, stage1)}.0) * pow(1.0 + g2, {max(t - stage1, 0)}.0)" for t in range(1, n + 1)]
    return "(" + " + ".join(f"({x}) / pow(1.0 + r, {t + 1}.0)" for t, x in enumerate(flow)) + f" + ({flow[-1]}) * (1.0 + tg) / (r - tg) / pow(1.0 + r, {n}.0))"


def _exit(years: int = YEARS) -> str:
    return f"({_present(_growing('g'), n=years)} + ({_growing('g').replace('{t}', str(years))}) * exit_multiple / pow(1.0 + r, {years}.0))"


VALUES = {
    "fcf_dcf_v1": dcf("g", "r"),
    "two_stage_fcf_dcf_v1": _two_stage(),
    "exit_multiple_dcf_v1": _exit(),
    "multiple_valuation_v1": "(starting_fcf * ev_multiple)",
}
#: Enterprise value that the market price implies.
TARGET = "(price * shares + net_debt)"


def _bisected(value: str, low: float, high: float, rising: bool) -> str:
    """A root between bounds, or null if both ends lie on one side: value is an expression of x."""
    at = lambda x: value.replace("{x}", x)
    mid = "((s.lo + s.hi) / 2.0)"
    up = f"({at(mid)}) {'<' if rising else '>'} {TARGET}"
    fold = f"aggregate(sequence(1, {STEPS}), named_struct('lo', {low}, 'hi', {high}), (s, i) -> CASE WHEN {up} THEN named_struct('lo', {mid}, 'hi', s.hi) ELSE named_struct('lo', s.lo, 'hi', {mid}) END, s -> {mid})"
    return f"CASE WHEN ({at(str(low))} - {TARGET}) * ({at(str(high))} - {TARGET}) <= 0.0 THEN {fold} END"


SOLVED = {
    "reverse_dcf_v1": _bisected(dcf("{x}", "r"), *GROWTH_BOUNDS, rising=True),
    "implied_discount_rate_v1": _bisected(dcf("g", "{x}"), *DISCOUNT_BOUNDS, rising=False),
}
SOLUTION = {"reverse_dcf_v1": dcf("{x}", "r"), "implied_discount_rate_v1": dcf("g", "{x}")}


def value(known: DataFrame, cases: DataFrame) -> DataFrame:
    """ticker, model_id, scenario, enterprise_value, equity_value, value_per_share, spread, solved (the rate found, if the model solves for one)."""
    # solving is the work here, so tickers are spread over all cores however few bytes they have
    tasks = max(known.sparkSession.sparkContext.defaultParallelism, int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = known.repartition(tasks, "ticker").crossJoin(F.broadcast(cases))  # a few scenarios
    rows = rows.select("*", *[F.expr(doubles(x)).alias(f"s_{m}") for m, x in SOLVED.items()])
    models = [F.struct(F.lit(m).alias("model_id"), F.expr(doubles(x)).alias("ev"), F.lit(None).cast("double").alias("solved")) for m, x in VALUES.items()]
    models += [F.struct(F.lit(m).alias("model_id"), F.expr(doubles(x.replace("{x}", f"s_{m}"))).alias("ev"), F.col(f"s_{m}").alias("solved")) for m, x in SOLUTION.items()]
    each = rows.select("ticker", "scenario", "net_debt", "shares", "price", F.explode(F.array(*models)).alias("m")).select("*", "m.*").filter("ev IS NOT NULL")
    return each.select("ticker", "model_id", "scenario", *[F.expr(doubles(x)).alias(n) for n, x in BRIDGE.items()])


BRIDGE = {
    "enterprise_value": f"round(ev, {PLACES - 3}) + 0.0",
    "equity_value": f"round(ev - net_debt, {PLACES - 3}) + 0.0",
    "value_per_share": f"round((ev - net_debt) / shares, {PLACES}) + 0.0",
    "spread": f"round((ev - net_debt) / shares / price - 1.0, {PLACES}) + 0.0",
    "solved": f"round(solved, {PLACES + 2})",
}


def value_sql() -> str:
    table = " UNION ALL ".join(
        f"SELECT '{s}' AS scenario, " + ", ".join(f"CAST({x[i]} AS DOUBLE) AS {n}" for n, x in zip(("g", "g2", "r", "tg", "exit_multiple", "ev_multiple"), (GROWTH, STAGE2_GROWTH, DISCOUNT, TERMINAL, EXIT_MULTIPLE, EV_MULTIPLE)))
        for i, s in enumerate(SCENARIOS)
    )
    parts = [f"SELECT ticker, '{m}' AS model_id, scenario, net_debt, shares, price, {doubles(x)} AS ev, CAST(NULL AS DOUBLE) AS solved FROM rows" for m, x in VALUES.items()]
    for m, (low, high), rising in (("reverse_dcf_v1", GROWTH_BOUNDS, True), ("implied_discount_rate_v1", DISCOUNT_BOUNDS, False)):
        at = lambda x, m=m: SOLUTION[m].replace("{x}", x)
        up = f"({at('((lo + hi) / 2.0)')}) {'<' if rising else '>'} {TARGET}"
        parts.append(doubles(
            f"SELECT ticker, '{m}' AS model_id, scenario, net_debt, shares, price, {at('((lo + hi) / 2.0)')} AS ev, (lo + hi) / 2.0 AS solved FROM ("
            f"WITH RECURSIVE b AS (SELECT *, 0 AS i, CAST({low} AS DOUBLE) AS lo, CAST({high} AS DOUBLE) AS hi FROM rows WHERE ({at(str(low))} - {TARGET}) * ({at(str(high))} - {TARGET}) <= 0.0"
            f" UNION ALL SELECT * EXCLUDE (i, lo, hi), i + 1, CASE WHEN {up} THEN (lo + hi) / 2.0 ELSE lo END, CASE WHEN {up} THEN hi ELSE (lo + hi) / 2.0 END FROM b WHERE i < {STEPS}) SELECT * FROM b WHERE i = {STEPS})"
        ))
    bridge = ", ".join(f"{doubles(x)} AS {n}" for n, x in BRIDGE.items())
    source = ", ".join(f"{doubles(x)} AS {n}" for n, x in FACTS.items())
    return (
        f"WITH lines AS (SELECT l_partkey, sum(CAST(l_quantity AS BIGINT)) AS q, count(*) AS n FROM lineitem GROUP BY l_partkey), facts AS (SELECT {source} FROM part JOIN lines ON p_partkey = l_partkey), "
        f"cases AS ({table}), rows AS (SELECT * FROM facts CROSS JOIN cases), m AS ({' UNION ALL '.join(parts)}) SELECT ticker, model_id, scenario, {bridge} FROM m WHERE ev IS NOT NULL"
    )
