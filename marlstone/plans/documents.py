"""Valuation by an assumption document: a universe's or one ticker's facts under its scenarios, with the years behind each value and how solvers ended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.errors import Invalid, NotFound
from marlstone.functions.sqlexpr import doubles

from . import projections, solvers, valuation

#: Each model's names in documents for what expressions call by letters.
NAMES = {
    "g": ("growth_rate", "stage1_growth_rate"), "g2": ("stage2_growth_rate",), "r": ("discount_rate",), "tg": ("terminal_growth_rate",), "exit_multiple": ("terminal_ev_to_fcf_multiple",), "ev_multiple": ("ev_to_fcf_multiple",),
}
#: Models that solve for a rate: the rate, its bounds in documents, and the width at which a search ends.
SOLVING = {
    "reverse_dcf_v1": ("g", ("implied_growth_lower_bound", "implied_growth_upper_bound"), solvers.LEAST_WIDTH),
    "implied_discount_rate_v1": ("r", ("implied_discount_rate_lower_bound", "implied_discount_rate_upper_bound"), None),
}
COLUMNS = ["ticker", "model_id", "scenario", *valuation.BRIDGE]


def explained(known: DataFrame, document: dict, model_id: str) -> DataFrame:
    """A row for each row of known (ticker, starting_fcf, net_debt, shares, price) and scenario.

    The columns of by_document(), then status, residual (of a share) and steps of the solver (status is `solved` for models that need none), `projection` and the
    measures of projections.projected(). Where a solver found nothing, values are null and status says why.
    """
    model(model_id)
    m = document["models"][model_id]
    years = m["stage1_years"] + m["stage2_years"] if model_id == "two_stage_fcf_dcf_v1" else m.get("forecast_years", valuation.YEARS)
    rate, bounds, width = SOLVING.get(model_id, (None, (), None))
    names = NAMES | {n: (b,) for n, b in zip(("lo", "hi"), bounds)}
    held = [[s, *[next((float(m["scenarios"][s][k]) for k in ks if k in m["scenarios"][s]), None) for ks in names.values()]] for s in valuation.SCENARIOS]
    rows = known.crossJoin(F.broadcast(known.sparkSession.createDataFrame(held, "scenario string, " + ", ".join(f"{n} double" for n in names))))  # three rows
    none = F.lit(None).cast("double")
    if rate is None:
        rows = rows.withColumns({"solved": none, "status": F.lit(solvers.SOLVED), "steps": F.lit(0), "residual": none})
        ev = {"fcf_dcf_v1": valuation.dcf("g", "r", years), "two_stage_fcf_dcf_v1": valuation._two_stage(m["stage1_years"], m["stage2_years"]) if model_id == "two_stage_fcf_dcf_v1" else "", "exit_multiple_dcf_v1": valuation._exit(years), "multiple_valuation_v1": valuation.VALUES["multiple_valuation_v1"]}[model_id]
    else:
        at = (lambda x: valuation.dcf(x, "r", years)) if rate == "g" else (lambda x: valuation.dcf("g", x, years))
        # the tolerance is of the whole value for growth, of a share's for the discount rate
        off = (lambda x: f"({at(x)} - {valuation.TARGET})") if rate == "g" else (lambda x: f"(({at(x)} - {valuation.TARGET}) / shares)")
        found = solvers.bisected(off, "lo", "hi", f"CAST({m['solver_abs_tolerance']} AS DOUBLE)", str(int(m["solver_max_iterations"])), width)
        rows = rows.withColumn("s", F.expr(found)).select("*", F.col("s.root").alias("solved"), F.col("s.status").alias("status"), F.col("s.steps").alias("steps")).drop("s")
        ev = at("solved")
        rows = rows.withColumn("residual", F.expr(doubles(f"abs({at('solved')} - {valuation.TARGET}) / shares"))).withColumn(rate, F.col("solved"))
    rows = projections.projected(rows.withColumn("ev", F.expr(doubles(ev))), model_id, years, m.get("stage1_years", valuation.STAGE1))
    return rows.select(
        "ticker", F.lit(model_id).alias("model_id"), "scenario", *[F.expr(doubles(x)).alias(n) for n, x in valuation.BRIDGE.items()], "status", "residual", "steps", "projection", *projections.MEASURES
    )


def by_document(known: DataFrame, document: dict, model_id: str) -> DataFrame:
    """The columns of valuation.value() for one model, with years, scenarios, bounds and tolerance as an assumption document has them; no row where a solver found nothing."""
    return explained(known, document, model_id).filter((F.col("status") == solvers.SOLVED) & F.col("enterprise_value").isNotNull()).select(*COLUMNS)


def refusal(row, document: dict, model_id: str) -> str:
    """Why a scenario has no value, in words."""
    m = document["models"][model_id]
    bounds = [m["scenarios"][row["scenario"]].get(b) for b in SOLVING[model_id][1]]
    if row["status"] == solvers.SAME_SIGN:
        return f"{model_id} scenario {row['scenario']} has no solution between {bounds[0]:.4f} and {bounds[1]:.4f}: both values lie on one side of the price's"
    return f"{model_id} scenario {row['scenario']} didn't converge after {row['steps']} steps ({row['status']})"


# ---------------------------------------------------------------- models by name

#: What each model takes from a document beside its scenarios, and the measures that its reports show.
MODELS = {
    "fcf_dcf_v1": ("final_year_fcf", "present_value_terminal_value", "terminal_share"), "two_stage_fcf_dcf_v1": ("stage1_final_fcf", "final_year_fcf", "terminal_share"),
    "exit_multiple_dcf_v1": ("final_year_fcf", "present_value_terminal_value", "terminal_share"), "multiple_valuation_v1": (), "reverse_dcf_v1": ("final_year_fcf", "residual"), "implied_discount_rate_v1": ("terminal_share", "residual"),
}


def model(model_id: str) -> tuple[str, ...]:
    """A model's measures; a model that there isn't is an error."""
    if model_id not in MODELS:
        raise NotFound(f"there is no valuation model {model_id}; known are {', '.join(sorted(MODELS))}")
    return MODELS[model_id]


def register(model_id: str, measures: tuple[str, ...]) -> None:
    """Add a model of the user's (its value in valuation.VALUES) under a name that is free."""
    if not model_id.strip() or model_id in MODELS:
        raise Invalid(f"a valuation model named {model_id!r} is there already, or has no name")
    MODELS[model_id] = measures
