"""Assumption documents of a ticker's valuation: keys, ranges, the order of scenarios, and what stands in for provider facts."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.config import digest
from marlstone.errors import Invalid

from .valuation import SCENARIOS

# The keys of a document, and of each model's block beside its scenarios; ranges of rates; what must not fall (or rise) from scenario to scenario.
ROOT = (
    "schema_version market ticker default_model purpose as_of currency amount_unit share_basis valuation_basis_note facts_overrides facts_override_notes assumption_source prepared_by source_note models"
).split()
OVERRIDES = ("shares_outstanding", "net_debt", "reference_price")
BASES = {"discount_rate_basis": "nominal_wacc", "terminal_growth_basis": "nominal_perpetual_growth", "exit_multiple_basis": "ev_to_fcf", "multiple_basis": "ev_to_fcf"}
_GROWTH, _RATE, _TERMINAL, _MULTIPLE = (-1.0, 1.0, True), (0.0, 0.5, True), (-0.05, 0.05, False), (0.0, 100.0, True)
MODELS: dict[str, dict[str, Any]] = {
    "fcf_dcf_v1": {"terminal": "perpetual_growth", "rates": {"growth_rate": _GROWTH, "discount_rate": _RATE, "terminal_growth_rate": _TERMINAL}, "rise": (), "fall": ()},
    "two_stage_fcf_dcf_v1": {
        "terminal": "perpetual_growth", "rates": {"stage1_growth_rate": _GROWTH, "stage2_growth_rate": _GROWTH, "discount_rate": _RATE, "terminal_growth_rate": _TERMINAL},
        "rise": ("stage1_growth_rate", "stage2_growth_rate", "terminal_growth_rate"), "fall": ("discount_rate",),
    },
    "exit_multiple_dcf_v1": {"terminal": "exit_multiple", "rates": {"growth_rate": _GROWTH, "discount_rate": _RATE, "terminal_ev_to_fcf_multiple": _MULTIPLE}, "rise": ("growth_rate", "terminal_ev_to_fcf_multiple"), "fall": ("discount_rate",)},
    "multiple_valuation_v1": {"terminal": None, "rates": {"ev_to_fcf_multiple": _MULTIPLE}, "rise": ("ev_to_fcf_multiple",), "fall": ()},
    "reverse_dcf_v1": {"terminal": "perpetual_growth", "rates": {"discount_rate": _RATE, "terminal_growth_rate": _TERMINAL, "implied_growth_lower_bound": _GROWTH, "implied_growth_upper_bound": _GROWTH}, "rise": (), "fall": ()},
    "implied_discount_rate_v1": {
        "terminal": "perpetual_growth", "rates": {"growth_rate": _GROWTH, "terminal_growth_rate": _TERMINAL, "implied_discount_rate_lower_bound": _RATE, "implied_discount_rate_upper_bound": _RATE},
        "rise": ("growth_rate", "terminal_growth_rate"), "fall": (),
    },
}
MAX_ITERATIONS, LEAST_SPREAD = 1000, 0.03
_YEARS = {"fcf_dcf_v1": ("forecast_years",), "exit_multiple_dcf_v1": ("forecast_years",), "reverse_dcf_v1": ("forecast_years",), "implied_discount_rate_v1": ("forecast_years",), "two_stage_fcf_dcf_v1": ("stage1_years", "stage2_years"), "multiple_valuation_v1": ()}


def _number(x: Any, name: str) -> float:
    if isinstance(x, bool) or not isinstance(x, (int, float)) or x != x or abs(x) == float("inf"):
        raise Invalid(f"{name} must be a number")
    return float(x)


def _scenario(model_id: str, name: str, held: Any) -> None:
    rates = MODELS[model_id]["rates"]
    if not isinstance(held, dict) or set(held) != {*rates, "note"}:
        raise Invalid(f"{model_id}: scenario {name} has the keys {', '.join([*rates, 'note'])}")
    if not isinstance(held["note"], str) or not held["note"].strip():
        raise Invalid(f"{model_id}: scenario {name} needs a note")
    for key, (low, high, above) in rates.items():
        x = _number(held[key], f"{name}.{key}")
        if x > high or x < low or (above and x == low):
            raise Invalid(f"{model_id}: {name}.{key} must be {'above' if above else 'at least'} {low} and at most {high}")
    if {"discount_rate", "terminal_growth_rate"} <= set(rates) and held["discount_rate"] - held["terminal_growth_rate"] < LEAST_SPREAD:
        raise Invalid(f"{model_id}: {name}: the discount rate must exceed terminal growth by {LEAST_SPREAD}")
    bounds = [k for k in rates if k.endswith("_bound")]
    if bounds and held[bounds[0]] >= held[bounds[1]]:
        raise Invalid(f"{model_id}: {name}: the lower bound isn't below the upper one")
    if model_id == "implied_discount_rate_v1" and held[bounds[0]] - held["terminal_growth_rate"] < LEAST_SPREAD:
        raise Invalid(f"{model_id}: {name}: the lower bound must exceed terminal growth by {LEAST_SPREAD}")


def _block(model_id: str, held: Any) -> None:
    if model_id not in MODELS:
        raise Invalid(f"there is no model {model_id}")
    if not isinstance(held, dict):
        raise Invalid(f"{model_id} must be a mapping")
    for key in _YEARS[model_id]:
        if isinstance(held.get(key), bool) or not isinstance(held.get(key), int) or not 1 <= held[key] <= 10:
            raise Invalid(f"{model_id}: {key} is a whole number from 1 to 10")
    if held.get("terminal_method") != MODELS[model_id]["terminal"]:
        raise Invalid(f"{model_id}: terminal_method must be {MODELS[model_id]['terminal']}")
    for key, want in BASES.items():
        if held.get(key, want) != want:
            raise Invalid(f"{model_id}: {key} must be {want}")
    start = held.get("starting_fcf")
    if not isinstance(start, dict) or start.get("method") not in ("provider_ttm_fcf", "override"):
        raise Invalid(f"{model_id}: starting_fcf.method is provider_ttm_fcf or override")
    if start["method"] == "override":
        _number(start.get("value"), "starting_fcf.value")
        if not str(start.get("note") or "").strip():
            raise Invalid(f"{model_id}: an override needs a note")
    if any(k.endswith("_bound") for k in MODELS[model_id]["rates"]):
        if _number(held.get("solver_abs_tolerance"), "solver_abs_tolerance") <= 0:
            raise Invalid(f"{model_id}: solver_abs_tolerance must be above 0")
        steps = held.get("solver_max_iterations")
        if isinstance(steps, bool) or not isinstance(steps, int) or not 1 <= steps <= MAX_ITERATIONS:
            raise Invalid(f"{model_id}: solver_max_iterations is a whole number from 1 to {MAX_ITERATIONS}")
    cases = held.get("scenarios")
    if not isinstance(cases, dict) or set(cases) != set(SCENARIOS):
        raise Invalid(f"{model_id}: scenarios are {', '.join(SCENARIOS)}")
    for name in SCENARIOS:
        _scenario(model_id, name, cases[name])
    for keys, sign in ((MODELS[model_id]["rise"], 1), (MODELS[model_id]["fall"], -1)):
        for key in keys:
            x = [sign * cases[name][key] for name in SCENARIOS]
            if x != sorted(x):
                raise Invalid(f"{model_id}: {key} must {'rise' if sign > 0 else 'fall'} from scenario to scenario, or stay")


def checked(document: Any, market: str, ticker: str) -> dict:
    """The document, if all of it holds; every model's block is looked at, not only the default one."""
    if not isinstance(document, dict) or set(document) != set(ROOT):
        raise Invalid(f"an assumption document has the keys {', '.join(ROOT)}")
    if document["schema_version"] != 1:
        raise Invalid("schema_version must be 1")
    if (document["market"], str(document["ticker"]).upper()) != (market, ticker.upper()):
        raise Invalid(f"the document is of {document['market']} {document['ticker']}, not of {market} {ticker}")
    code = document["currency"]
    if not (isinstance(code, str) and len(code) == 3 and code.isascii() and code.isalpha() and code.isupper()):
        raise Invalid("currency is three capital letters")
    for part in ("facts_overrides", "facts_override_notes"):
        if not isinstance(document[part], dict) or set(document[part]) != set(OVERRIDES):
            raise Invalid(f"{part} has the keys {', '.join(OVERRIDES)}")
    for key, x in document["facts_overrides"].items():
        if x is not None:
            _number(x, f"facts_overrides.{key}")
            if not str(document["facts_override_notes"][key] or "").strip():
                raise Invalid(f"the override of {key} needs a note")
    if not isinstance(document["models"], dict) or document["default_model"] not in document["models"]:
        raise Invalid("default_model must be one of models")
    for model_id, held in document["models"].items():
        _block(model_id, held)
    return document


def load(path: str, market: str, ticker: str) -> tuple[dict, str]:
    """A checked document and its digest."""
    import yaml

    try:
        with open(path, encoding="utf-8") as f:
            document = checked(yaml.safe_load(f), market, ticker)
    except (OSError, yaml.YAMLError) as e:
        raise Invalid(f"{path} can't be read: {e}") from e
    return document, digest({k: v if not hasattr(v, "isoformat") else v.isoformat() for k, v in document.items()})


def resolved(facts: DataFrame, document: dict, model_id: str) -> DataFrame:
    """facts with the document's overrides, and where each value is from. facts: ticker, free_cash_flow, net_debt, shares, price, currency."""
    over = document["facts_overrides"]
    start = document["models"][model_id]["starting_fcf"]
    given = {"starting_fcf": (start.get("value") if start["method"] == "override" else None, "free_cash_flow"), "net_debt": (over["net_debt"], "net_debt"), "shares": (over["shares_outstanding"], "shares"), "price": (over["reference_price"], "price")}
    value = [F.coalesce(F.lit(x).cast("double"), F.col(c).cast("double")).alias(n) for n, (x, c) in given.items()]
    source = [F.lit("provider" if x is None else "assumption_override").alias(f"{n}_source") for n, (x, _) in given.items()]
    return facts.select("ticker", "currency", *value, *source)


def usable(inputs: DataFrame, document: dict, model_id: str) -> DataFrame:
    """inputs, if no value lacks and the currency is the document's; all models but fcf_dcf_v1 need a flow above zero, and all need shares and a price."""
    for r in inputs.limit(2).collect():
        if r["currency"] != document["currency"]:
            raise Invalid(f"facts are in {r['currency']}, assumptions in {document['currency']}")
        for n in ("starting_fcf", "net_debt", "shares", "price"):
            if r[n] is None:
                raise Invalid(f"{r['ticker']}: {n} is known neither from the provider nor from the document")
        if r["shares"] <= 0 or r["price"] <= 0 or (model_id != "fcf_dcf_v1" and r["starting_fcf"] <= 0):
            raise Invalid(f"{r['ticker']}: shares, price and (for {model_id}) the starting flow must be above zero")
    return inputs
