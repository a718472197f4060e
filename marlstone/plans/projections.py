"""Flows of each forecast year as arrays, what follows them, and the measures that reports add: all within the row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.sqlexpr import doubles

from . import valuation

#: Models with forecast years. Solved models project like fcf_dcf_v1, with the rate found.
FORECAST = ("fcf_dcf_v1", "two_stage_fcf_dcf_v1", "exit_multiple_dcf_v1")
LIKE = {"reverse_dcf_v1": "fcf_dcf_v1", "implied_discount_rate_v1": "fcf_dcf_v1"}


def _growth(model_id: str, t: str, stage1: int) -> str:
    """By what the flow of year t grows over that of the year before."""
    return f"CASE WHEN {t} <= {stage1} THEN 1.0 + g ELSE 1.0 + g2 END" if model_id == "two_stage_fcf_dcf_v1" else "1.0 + g"


def _terminal(model_id: str) -> str:
    return "final_year_fcf * exit_multiple" if model_id == "exit_multiple_dcf_v1" else "final_year_fcf * (1.0 + tg) / (r - tg)"


def projected(rows: DataFrame, model_id: str, years: int, stage1: int = valuation.STAGE1) -> DataFrame:
    """rows (starting_fcf, g, g2, r, tg, exit_multiple as the model needs them) with `projection`, an array of (year, flow, factor, present_value), and the model's measures.

    final_year_fcf, terminal_value, present_value_terminal_value, projected_value (of the whole) and terminal_share; stage1_final_fcf where there are two stages. A model without
    forecast years gets an empty array and nulls.
    """
    model_id = LIKE.get(model_id, model_id)
    if model_id not in FORECAST:
        kind = "array<struct<year: int, flow: double, factor: double, present_value: double>>"
        return rows.withColumns({"projection": F.expr(f"cast(array() as {kind})")} | {k: F.lit(None).cast("double") for k in MEASURES})
    # year by year: a flow is the one before times its growth, a discount the one before times 1 + r
    year = f"named_struct('year', t, 'flow', s.flow * ({_growth(model_id, 't', stage1)}), 'discount', s.discount * (1.0 + r))"
    walk = f"aggregate(sequence(1, {years}), array(named_struct('year', 0, 'flow', starting_fcf, 'discount', 1.0)), (a, t) -> concat(a, transform(slice(a, -1, 1), s -> {year})))"
    kept = "s -> named_struct('year', s.year, 'flow', s.flow, 'factor', 1.0 / s.discount, 'present_value', s.flow / s.discount)"
    rows = rows.withColumn("projection", F.expr(doubles(f"transform(slice({walk}, 2, {years}), {kept})")))
    rows = rows.withColumns({"final_year_fcf": F.expr(f"projection[{years - 1}].flow"), "stage1_final_fcf": F.expr(f"projection[{stage1 - 1}].flow") if model_id == "two_stage_fcf_dcf_v1" else F.lit(None).cast("double")})
    rows = rows.withColumn("terminal_value", F.expr(doubles(_terminal(model_id))))
    rows = rows.withColumn("present_value_terminal_value", F.expr(f"terminal_value * projection[{years - 1}].factor"))
    rows = rows.withColumn("projected_value", F.expr("aggregate(projection, cast(0 as double), (s, y) -> s + y.present_value) + present_value_terminal_value"))
    return rows.withColumn("terminal_share", F.expr("present_value_terminal_value / nullif(projected_value, cast(0 as double))"))


MEASURES = ("final_year_fcf", "stage1_final_fcf", "terminal_value", "present_value_terminal_value", "projected_value", "terminal_share")
#: What the query shows: amounts to the cent, factors and shares to eight places.
SHOWN = {"flow": 2, "factor": 8, "present_value": 2, "present_value_terminal_value": 2, "projected_value": 2, "terminal_share": 8}


def _years(model_id: str) -> int:
    return valuation.STAGE1 + valuation.STAGE2 if model_id == "two_stage_fcf_dcf_v1" else valuation.YEARS


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each part, model, scenario and year."""
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = valuation.facts(spark, sf_dir).repartition(tasks, "ticker").crossJoin(F.broadcast(valuation.scenarios(spark)))  # a few scenarios
    each = [projected(rows, m, _years(m)).select("ticker", F.lit(m).alias("model_id"), "scenario", F.explode("projection").alias("y"), *MEASURES) for m in FORECAST]
    out = each[0].unionByName(each[1]).unionByName(each[2]).select("ticker", "model_id", "scenario", "y.*", *MEASURES)
    return out.select("ticker", "model_id", "scenario", F.col("year").cast("long").alias("year"), *[F.expr(doubles(f"floor({k} * {10.0**n:.1f} + 0.5) / {10.0**n:.1f}")).alias(k) for k, n in SHOWN.items()])


def oracle() -> str:
    """A recursive query with a row for each year, and sums over a model's years by windows."""
    names = ("g", "g2", "r", "tg", "exit_multiple")
    table = " UNION ALL ".join(f"SELECT '{s}' AS scenario, " + ", ".join(f"CAST({x[i]} AS DOUBLE) AS {n}" for n, x in zip(names, (valuation.GROWTH, valuation.STAGE2_GROWTH, valuation.DISCOUNT, valuation.TERMINAL, valuation.EXIT_MULTIPLE))) for i, s in enumerate(valuation.SCENARIOS))
    source = ", ".join(f"{x} AS {n}" for n, x in valuation.FACTS.items())
    shown = ", ".join(f"floor({k} * {10.0**n:.1f} + 0.5) / {10.0**n:.1f} AS {k}" for k, n in SHOWN.items())
    parts = []
    for m in FORECAST:
        n = _years(m)
        flows = (
            f"WITH RECURSIVE w AS (SELECT *, 0 AS year, starting_fcf AS flow, 1.0 AS discount FROM rows UNION ALL SELECT * EXCLUDE (year, flow, discount), year + 1, flow * ({_growth(m, '(year + 1)', valuation.STAGE1)}), discount * (1.0 + r) FROM w WHERE year < {n})"
            " SELECT *, 1.0 / discount AS factor, flow / discount AS present_value FROM w WHERE year > 0"
        )
        last = ", ".join(f"max(CASE WHEN year = {n} THEN {k} END) OVER (PARTITION BY ticker, scenario) AS {a}" for k, a in (("flow", "final_year_fcf"), ("factor", "last_factor")))
        tail = f"SELECT *, ({_terminal(m)}) * last_factor AS present_value_terminal_value FROM (SELECT *, {last} FROM ({flows}))"
        whole = f"SELECT *, sum(present_value) OVER (PARTITION BY ticker, scenario ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) + present_value_terminal_value AS projected_value FROM ({tail})"
        parts.append(f"SELECT '{m}' AS model_id, *, present_value_terminal_value / nullif(projected_value, 0.0) AS terminal_share FROM ({whole})")
    return doubles(f"""
WITH lines AS (SELECT l_partkey, sum(CAST(l_quantity AS BIGINT)) AS q, count(*) AS n FROM lineitem GROUP BY l_partkey), facts AS (SELECT {source} FROM part JOIN lines ON p_partkey = l_partkey),
rows AS (SELECT * FROM facts CROSS JOIN ({table})), p AS ({' UNION ALL '.join(parts)})
SELECT ticker, model_id, scenario, CAST(year AS BIGINT) AS year, {shown} FROM p
""")
