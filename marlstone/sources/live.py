"""Live runs: providers by kind and market, a feed of bars that is asked in batches, and a run's input put together from both.

A provider is a factory that takes the configuration. What it gives: for listings a function of the market that returns a
DataFrame; for bars an object with bars(listings, day); for fundamentals a function of listings and day that returns the facts
and a mapping that sums up their coverage.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.config import MARKETS, Config, digest, market_of
from marlstone.errors import DataError, Invalid, NotFound

from marlstone.operators import checks

from . import feed
from .bundle import RunData, market_date
from .feed import FIELDS
from .listings import request_symbols

KINDS = ("listings", "bars", "fundamentals")
# Each market's time zone, and the days of bars a run asks for.
ZONES = {"US": "America/New_York", "TW": "Asia/Taipei"}
LOOKBACK_DAYS = 420


class Registry:
    """Factories by kind and id, with the markets that each serves."""

    def __init__(self) -> None:
        self._held: dict[tuple[str, str], tuple[Callable[[Config], Any], tuple[str, ...]]] = {}

    def register(self, kind: str, provider_id: str, factory: Callable[[Config], Any], markets: tuple[str, ...] = MARKETS) -> None:
        if kind not in KINDS:
            raise Invalid(f"providers give {', '.join(KINDS)}, not {kind}")
        if (kind, provider_id) in self._held:
            raise Invalid(f"there are two providers of {kind} named {provider_id}")
        if not provider_id.strip() or not markets:
            raise Invalid("a provider needs an id and a market")
        self._held[kind, provider_id] = factory, tuple(market_of(m) for m in markets)

    def ids(self, kind: str, market: str) -> list[str]:
        return sorted(i for (k, i), (_, markets) in self._held.items() if k == kind and market in markets)

    def make(self, kind: str, provider_id: str, market: str, cfg: Config) -> Any:
        if (kind, provider_id) not in self._held:
            raise NotFound(f"there is no provider of {kind} named {provider_id}")
        factory, markets = self._held[kind, provider_id]
        if market not in markets:
            raise Invalid(f"{provider_id} has no {kind} of {market}")
        return factory(cfg)


#: What the command line uses; `--providers MODULE` lets a module of the user's fill it.
REGISTRY = Registry()


@dataclass(frozen=True)
class BarFeed:
    """Bars from fetch(symbols, first day, day after the last), called on the executors for batch_size symbols at most.

    Answers are written once to a new folder `landing`, which all executors must share, since a feed asked twice may answer
    differently. A batch may be empty; if all are, that is an error.
    """

    fetch: Callable[[list[str], date, date], pd.DataFrame]
    batch_size: int
    landing: str

    def bars(self, listings: DataFrame, day: date) -> DataFrame:
        if self.batch_size < 1:
            raise Invalid("batch_size must be 1 or more")
        spark, first, end = listings.sparkSession, day - timedelta(LOOKBACK_DAYS), day + timedelta(1)
        named = request_symbols(listings).select("market", "ticker", "request_symbol").distinct()
        symbols = sorted(r["request_symbol"] for r in named.select("request_symbol").distinct().toLocalIterator())  # a market's listings: tens of thousands of names
        asked = checks.Watch(feed.read(spark, self.fetch, symbols, first, end, self.batch_size), {"rows": F.count(F.lit(1))})
        asked.rows.write.parquet(self.landing)
        if not asked.seen()["rows"]:
            raise DataError(f"the feed has no bars from {first} to {day}")
        rows = spark.read.schema(feed.FETCHED).parquet(self.landing)
        return rows.join(named, "request_symbol").select("market", "ticker", "bar_date", *FIELDS.values())


def load(registry: Registry, cfg: Config, market: str, started: datetime, fundamentals: bool = False) -> RunData:
    """A run's input from the configured providers: listings by ticker, the first ticker_limit of them if one is set, and their bars."""
    market = market_of(market)
    ids = {"listings": cfg[f"live.listing_provider.{market}"], "bars": cfg["live.ohlcv_provider"]} | ({"fundamentals": cfg["live.fundamentals_provider"]} if fundamentals else {})
    made = {k: registry.make(k, i, market, cfg) for k, i in ids.items()}
    day = market_date(started, ZONES[market])
    listings = made["listings"](market).orderBy("ticker")
    if cfg["live.ticker_limit"] is not None:
        listings = listings.limit(cfg["live.ticker_limit"])
    bars = made["bars"].bars(listings, day).filter("bar_date is not null")
    latest = bars.agg(F.max("bar_date").alias("d")).first()["d"]
    if latest is None:
        raise DataError(f"no listing of {market} has a bar")
    facts, coverage = made["fundamentals"](listings, day) if fundamentals else (None, {})
    about = {
        "data_mode": cfg["data_mode"], "market_timezone": ZONES[market], "listing_provider_id": ids["listings"], "ohlcv_provider_id": ids["bars"],
        "provider_config_hash": digest(cfg.provider_payload(fundamentals)), "run_latest_bar_date": str(latest), "fetched_at": started.astimezone(timezone.utc).isoformat(),
    }
    return RunData(market, listings, bars, facts, latest, about | ({"fundamentals": coverage} if coverage else {}))
