"""Expression text that Spark SQL and ANSI engines read alike, and builders of score expressions.

Numbers with a point would be decimals in both; doubles() turns them into doubles. Quotients guard against zero, logarithms
against what isn't positive, so that a bad ticker gives null and is filtered, in ANSI mode too.
"""

from __future__ import annotations

import re

_NUMBER = re.compile(r"(?<![\w.'])(\d+\.\d+(?:e-?\d+)?)(?![\w.'])")


def doubles(expr: str) -> str:
    return _NUMBER.sub(r"CAST(\1 AS DOUBLE)", expr)


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0.0))"


def ln(x: str) -> str:
    return f"ln(CASE WHEN {x} > 0.0 THEN {x} END)"


def clamp(x: str, low: float, high: float) -> str:
    return f"greatest({low}, least({high}, {x}))"


def band(x: str, ideal: tuple[float, float], outer: tuple[float, float]) -> str:
    """1 within the ideal band, falling to 0 at the outer edges on a line."""
    (a, b), (p, q) = ideal, outer
    return (
        f"CASE WHEN {x} >= {a:.6f} AND {x} <= {b:.6f} THEN 1.0 WHEN {x} < {a:.6f} THEN CASE WHEN {x} <= {p:.6f} THEN 0.0 ELSE ({x} - {p:.6f}) / ({a:.6f} - {p:.6f}) END"
        f" WHEN {x} >= {q:.6f} THEN 0.0 ELSE ({q:.6f} - {x}) / ({q:.6f} - {b:.6f}) END"
    ).replace("- -", "+ ")


def tag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1.0 ELSE 0.0 END"


def ladder(*steps: tuple[str, float], otherwise: float = 1.0) -> str:
    """The value of the first condition that holds."""
    return "CASE " + " ".join(f"WHEN {c} THEN {v:.6f}" for c, v in steps) + f" ELSE {otherwise:.6f} END"


def count_of(*conditions: str) -> str:
    return "(" + " + ".join(tag(c) for c in conditions) + ")"


def weighted(*parts: tuple[float, str]) -> str:
    """A sum from left to right."""
    return "(" + " + ".join(f"{w:.6f} * {x}" for w, x in parts) + ")"


def penalties(*parts: tuple[str, float]) -> str:
    return "(0.0 + " + " + ".join(f"CASE WHEN {c} THEN {v:.6f} ELSE 0.0 END" for c, v in parts) + ")"


class Percentile(str):
    """The SQL text of a percentile that knows what it is of, so that operators/ranks.py can find all of a layer's together."""

    x: str
    better: str

    def __new__(cls, text: str, x: str, better: str) -> Percentile:
        self = super().__new__(cls, text)
        self.x, self.better = x, better
        return self


def percentile(x: str, better: str = "high", group: str = "market") -> Percentile:
    """1 for the best of a group, 0 for the worst; ties share their mean place; alone: 1. positive: only among values over 0, others 0."""
    if better == "positive":
        keys = f"{group}, CASE WHEN {x} > 0.0 THEN 1 ELSE 0 END"
        return Percentile(f"CASE WHEN {x} > 0.0 THEN {_place(x, 'DESC', keys)} ELSE 0.0 END", x, better)
    return Percentile(_place(x, "DESC" if better == "high" else "ASC", group), x, better)


def _place(x: str, order: str, keys: str) -> str:
    n = f"count(*) OVER (PARTITION BY {keys})"
    w = f"PARTITION BY {keys} ORDER BY {x} {order}"  # one order for places and ties
    place = f"(rank() OVER ({w}) - 1 + (count(*) OVER ({w} RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1) / 2.0)"
    return f"CASE WHEN {n} = 1 THEN 1.0 ELSE 1.0 - {place} / nullif(CAST({n} - 1 AS DOUBLE), 0.0) END"
