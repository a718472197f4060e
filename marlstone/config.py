"""Configuration: a YAML document of fixed keys, and hashes of its parts."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from typing import Any

from .errors import Invalid

# The keys that a document must have, and what kind of value each holds.
KEYS = {
    "data_mode": str, "duckdb_path": str, "lock_path": str, "fixture_dir": str,
    "live": dict, "live.listing_provider": dict, "live.listing_provider.US": str, "live.listing_provider.TW": str,
    "live.ohlcv_provider": str, "live.fundamentals_provider": str, "live.ticker_limit": (int, type(None)),
    "live.yfinance": dict, "live.yfinance.batch_size": int,
    "ranking": dict, "ranking.profile": str, "report": dict, "report.top_n": int,
}
DATA_MODES = ("fixture", "live")
MARKETS = ("US", "TW")


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def digest(value: Any) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def market_of(name: str) -> str:
    if name.strip().upper() not in MARKETS:
        raise Invalid(f"markets are {', '.join(MARKETS)}, not {name!r}")
    return name.strip().upper()


def _flat(document: dict, before: str = "") -> dict[str, Any]:
    out: dict[str, Any] = {}
    for k, v in document.items():
        out[f"{before}{k}"] = v
        if isinstance(v, dict):
            out |= _flat(v, f"{before}{k}.")
    return out


@dataclass(frozen=True)
class Config:
    values: dict[str, Any]

    def __getitem__(self, key: str) -> Any:
        return self.values[key]

    def provider_payload(self, fundamentals: bool) -> dict[str, Any]:
        """What decides which data a run reads."""
        out = {"mode": self["data_mode"], "listings": {m: self[f"live.listing_provider.{m}"] for m in MARKETS}, "bars": {"id": self["live.ohlcv_provider"], "batch_size": self["live.yfinance.batch_size"]}, "ticker_limit": self["live.ticker_limit"]}
        return out | ({"fundamentals": self["live.fundamentals_provider"]} if fundamentals else {})


def parse(document: Any) -> Config:
    """A checked document: all keys, no others, of the right kinds, counts above zero."""
    if not isinstance(document, dict):
        raise Invalid("the configuration isn't a mapping")
    values = _flat(document)
    if missing := [k for k in KEYS if k not in values]:
        raise Invalid(f"the configuration lacks {', '.join(missing)}")
    if unknown := [k for k in values if k not in KEYS]:
        raise Invalid(f"the configuration has unknown keys: {', '.join(unknown)}")
    for k, kind in KEYS.items():
        if not isinstance(values[k], kind) or isinstance(values[k], bool):
            raise Invalid(f"{k} can't be {values[k]!r}")
    if values["data_mode"] not in DATA_MODES:
        raise Invalid(f"data_mode is one of {', '.join(DATA_MODES)}")
    for k in ("live.yfinance.batch_size", "report.top_n", "live.ticker_limit"):
        if values[k] is not None and values[k] < 1:
            raise Invalid(f"{k} must be above zero")
    return Config(values)


def load(path: str) -> Config:
    import yaml

    try:
        with open(path, encoding="utf-8") as f:
            return parse(yaml.safe_load(f))
    except (OSError, yaml.YAMLError) as e:
        raise Invalid(f"{path} can't be read: {e}") from e
