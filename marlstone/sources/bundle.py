"""A bundle of files that holds all of a run's input: listings.csv, ohlcv.csv, fundamentals.csv, metadata.json.

Tables stay DataFrames; what must hold over whole tables (no repeated keys, no bar after the run's latest date) stands in the
plan of whatever reads them, and needs no job of its own.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.errors import DataError
from marlstone.operators import checks

# The columns of each file, and the keys of the metadata.
LISTINGS = "market string, ticker string, listing_symbol string, exchange_segment string, listing_status string, instrument_type string, source_id string"
BARS = "market string, ticker string, bar_date date, open double, high double, low double, close double, adjusted_close double, volume double"
FUNDAMENTALS = (
    "market string, ticker string, currency string, fiscal_period_end date, balance_sheet_as_of date, fiscal_period_type string, "
    + ", ".join(
        f"{x} double" for x in (
            "revenue_ttm gross_profit_ttm operating_income_ttm net_income_ttm operating_cash_flow_ttm capital_expenditures_ttm free_cash_flow_ttm total_assets shareholders_equity total_debt"
            " cash_and_cash_equivalents roe roa gross_margin operating_margin net_margin debt_to_equity fcf_margin tag_fundamentals_annual_fallback tag_negative_net_income tag_negative_fcf"
        ).split()
    )
)
METADATA = ("data_mode", "market_timezone", "listing_provider_id", "listing_source_id", "ohlcv_provider_id", "ohlcv_source_id", "provider_config_hash", "run_latest_bar_date")


def read_csv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """The columns of ddl by name, whatever their order in the file; a column that is missing, or a value that can't be read, is an error."""
    raw = spark.read.option("header", True).csv(path)
    wanted = [x.rsplit(" ", 1) for x in ddl.split(", ")]
    if missing := [n for n, _ in wanted if n not in raw.columns]:
        raise DataError(f"{path} lacks {', '.join(missing)}")
    bad = lambda n, t: F.expr(f"try_cast(trim(`{n}`) as {t})").isNull() & F.col(n).isNotNull() & (F.trim(n) != "")
    typed = [F.trim(n).alias(n) if t == "string" else F.when(bad(n, t), F.raise_error(F.concat(F.lit(f"{n} can't be "), F.col(n))).cast(t)).otherwise(F.expr(f"try_cast(trim(`{n}`) as {t})")).alias(n) for n, t in wanted]
    return raw.select(*typed)


@dataclass(frozen=True)
class RunData:
    """A market's input: DataFrames, and what was read when."""

    market: str
    listings: DataFrame
    bars: DataFrame
    fundamentals: DataFrame | None
    run_latest_bar_date: date
    metadata: dict


class Bundle:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def metadata(self) -> dict:
        text = self.spark.read.option("wholetext", True).text(f"{self.path}/metadata.json").first()
        try:
            held = json.loads(text["value"])
        except (TypeError, ValueError) as e:
            raise DataError(f"{self.path}/metadata.json can't be read") from e
        if missing := [k for k in METADATA if k not in held]:
            raise DataError(f"metadata.json lacks {', '.join(missing)}")
        return held | {"fetched_at": datetime.now(timezone.utc).isoformat()}

    def listings(self, market: str) -> DataFrame:
        rows = read_csv(self.spark, f"{self.path}/listings.csv", LISTINGS)
        return rows.filter(F.col("market") == market).withColumn("ticker", F.upper("ticker")).orderBy("ticker")

    def bars(self, market: str, listings: DataFrame, latest: date) -> DataFrame:
        """The bars of listed tickers. A bar after `latest`, or two of one day, end the job that reads them (checks.translated)."""
        rows = read_csv(self.spark, f"{self.path}/ohlcv.csv", BARS).withColumn("ticker", F.upper("ticker"))
        rows = rows.filter(F.col("market") == market).join(listings.select("ticker").distinct(), "ticker", "left_semi")
        day = F.col("bar_date").cast("string")
        rows = checks.must(rows, F.col("bar_date") <= F.lit(latest), F.concat("ticker", F.lit(" has a bar of "), F.coalesce(day, F.lit("no date")), F.lit(f", not up to {latest}")))
        return checks.unrepeated(rows, ["market", "ticker"], "bar_date", F.concat("ticker", F.lit(" has several bars of "), day))

    def fundamentals(self, market: str, listings: DataFrame, run_date: date) -> tuple[DataFrame, dict]:
        """The facts of listed tickers, and how many of these have some, with the latest date among them."""
        rows = read_csv(self.spark, f"{self.path}/fundamentals.csv", FUNDAMENTALS).withColumn("ticker", F.upper("ticker")).filter(F.col("market") == market)
        rows = rows.join(listings.select("ticker").distinct(), "ticker", "left_semi")
        found = rows.agg(F.count_distinct("ticker").alias("with_facts"), F.max(F.greatest("fiscal_period_end", "balance_sheet_as_of")).alias("latest")).first()
        listed = listings.select("ticker").distinct().count()
        return rows, {"listed": listed, "with_facts": found["with_facts"], "without_facts": listed - found["with_facts"], "latest_source_date": str(found["latest"] or run_date)}

    def load(self, market: str, fundamentals: bool = False) -> RunData:
        held = self.metadata()
        try:
            latest = date.fromisoformat(held["run_latest_bar_date"])
        except ValueError as e:
            raise DataError("run_latest_bar_date is no date") from e
        listings = self.listings(market)
        facts, coverage = self.fundamentals(market, listings, latest) if fundamentals else (None, {})
        return RunData(market, listings, self.bars(market, listings, latest), facts, latest, held | ({"fundamentals": coverage} if coverage else {}))


def long_bars(wide: DataFrame, tickers: list[str], fields: dict[str, str]) -> DataFrame:
    """Rows (ticker, bar_date, fields) from a table with a column `field|ticker` for each pair, as price feeds give it; rows that lack a field are dropped."""
    of = lambda t: F.struct(F.lit(t).alias("ticker"), *[(F.col(f"`{f}|{t}`") if f"{f}|{t}" in wide.columns else F.lit(None)).cast("double").alias(n) for f, n in fields.items()])
    rows = wide.select(F.expr("try_cast(bar_date as date)").alias("bar_date"), F.explode(F.array(*[of(t) for t in tickers])).alias("x")).select("x.ticker", "bar_date", *[f"x.{n}" for n in fields.values()])
    kept = [F.col(n).isNotNull() & ~F.isnan(n) for n in fields.values()]
    for k in kept:
        rows = rows.filter(k)
    return rows.filter("bar_date is not null")


def market_date(started: datetime, zone: str) -> date:
    """The local date of a market when a run starts."""
    from zoneinfo import ZoneInfo

    if started.tzinfo is None:
        raise DataError("a run's start needs a time zone")
    return started.astimezone(ZoneInfo(zone)).date()
