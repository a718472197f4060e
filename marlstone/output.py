"""Reports as JSON, inspected tickers as text, and the formats of numbers in text."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What text for readers never says, and the units of large numbers.
REDACTED = re.compile(r"target price|fair value|undervalued|overvalued|expected return|\b(?:buy|sell|hold)\b", re.IGNORECASE)
UNITS = ((1e12, "T"), (1e9, "B"), (1e6, "M"))


def plain(value: Any) -> str:
    """One line of text, without advice, that can stand in a table."""
    return REDACTED.sub("[redacted]", " ".join(str(value).split())).replace("|", "\\|")


def number(x: float) -> str:
    unit, name = next(((u, n) for u, n in UNITS if abs(x) >= u), (1.0, ""))
    return f"{x / unit:.2f}{name}"


def money(x: float, currency: str, places: int | None = None) -> str:
    text, code = number(x) if places is None else f"{x:.{places}f}", plain(currency.upper())
    return f"${text}" if code == "USD" else f"{code} {text}".strip()


def multiple(x: float) -> str:
    whole, _, rest = f"{x:.4f}".partition(".")
    return f"{whole}.{rest.rstrip('0') or '0'}x"


def percent(x: float) -> str:
    return f"{x * 100:.2f}%"


def as_json(value: Any) -> str:
    """JSON that holds no NaN or infinity."""
    return json.dumps(value, sort_keys=True, allow_nan=False, ensure_ascii=False, indent=2)


def report(run: dict, snapshot: DataFrame, rankings: DataFrame, horizons: list[str], top_n: int) -> dict:
    """All of a run's rows with their metrics, horizons in the profile's order, and the best of each. A report holds a whole run: its size is that of the listed tickers."""
    numbers = F.from_json("metrics_json", "map<string, double>")
    row = lambda r, core: {**{c: r[c] for c in core}, "metrics": dict(sorted((r["metrics"] or {}).items()))}
    snaps = {r["ticker"]: row(r, ("market", "ticker", "close", "adjusted_close")) for r in snapshot.withColumn("metrics", numbers).orderBy("ticker").toLocalIterator()}
    ranks = [row(r, ("horizon", "rank", "ticker", "score")) for r in rankings.withColumn("metrics", numbers).toLocalIterator()]
    place = {h: i for i, h in enumerate(horizons)}
    ranks.sort(key=lambda r: (place.get(r["horizon"], len(place)), r["rank"], r["ticker"]))
    top = {h: [{"ticker": r["ticker"], "ranking": r, "snapshot": snaps.get(r["ticker"], {"ticker": r["ticker"]})} for r in ranks if r["horizon"] == h and r["rank"] <= top_n] for h in horizons}
    return {"run": {k: str(v) for k, v in run.items()}, "snapshots": list(snaps.values()), "rankings": ranks, "top_horizons": top, "notes": ["Ranks compare listed stocks with one another; they are no advice."]}


def inspected(found: dict) -> str:
    lines = [f"# {plain(found['ticker'])}", "", f"close {found['close']}, adjusted close {found['adjusted_close']}", ""]
    for r in found["rankings"]:
        lines.append(f"- {plain(r['horizon'])}: rank {r['rank']}, score {r['score']:.4f}")
    lines += ["", "| metric | value |", "|---|---|", *[f"| {plain(k)} | {v:.6g} |" for k, v in sorted((found["metrics"] or {}).items())]]
    return "\n".join(lines) + "\n"


# What a report tells of where its data came from, and of the facts' coverage where a profile needs them.
SUMMARY = ("data_mode", "listing_provider_id", "listing_source_id", "ohlcv_provider_id", "ohlcv_source_id", "provider_config_hash", "data_fetch_started_at", "market_timezone", "run_latest_bar_date")
COVERAGE = {"latest_source_date": "fundamentals_latest_source_date", "listed": "fundamentals_requested_count", "with_facts": "fundamentals_returned_count", "without_facts": "fundamentals_missing_count", "invalid": "fundamentals_invalid_count"}


def provider_summary(metadata: dict, profile_id: str, ranking_hash: str) -> dict[str, str]:
    """Where a run's data came from, by name, as text; what a provider doesn't tell is empty."""
    held = metadata | {"data_fetch_started_at": metadata.get("data_fetch_started_at") or metadata.get("fetched_at")}
    out = {k: str(held.get(k) or "") for k in SUMMARY} | {"ranking_profile": profile_id, "ranking_config_hash": ranking_hash}
    if "fundamentals" in metadata:
        out |= {name: str(metadata["fundamentals"].get(k, 0)) for k, name in COVERAGE.items()}
    return out


def context(about: dict, summary: dict[str, str], candidates: int) -> str:
    """A report's last part: the run, how many tickers it ranked, its providers, and how ranks are meant."""
    lines = ["", "## Run", "", *[f"- {k}: {plain(v)}" for k, v in about.items()], f"- candidates: {candidates}", "", "## Providers", "", *[f"- {k}: {plain(v)}" for k, v in summary.items()]]
    return "\n".join([*lines, "", "Ranks compare listed stocks with one another; they are no advice.", ""])
