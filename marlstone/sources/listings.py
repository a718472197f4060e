"""Listings from pipe-delimited exchange files: which rows are listed stocks, under what symbol, and what a price feed calls them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.errors import DataError

# Words in a security's name that leave it out, that make it a depositary receipt, and that make it a common stock.
NOT_STOCK = r"(?i)\bwarrants?\b|\bunits?\b|\brights?\b|\bpreferred\s+(stock|shares?)\b|\bpreference\s+shares?\b|\bdepositary\s+shares?.*\bpreferred\s+stock\b"
RECEIPT = r"(?i)\bADR\b|\bADS\b|AMERICAN DEPOSITARY RECEIPTS?|AMERICAN DEPOSITARY SHARES?"
STOCK = r"(?i)common stock|ordinary shares|common shares"
FOOTER = "file creation time"


def read_pipes(spark: SparkSession, path: str) -> DataFrame:
    """All columns as trimmed strings; rows with a cell that begins like the footer are left out."""
    raw = spark.read.option("sep", "|").option("header", True).csv(path)
    rows = raw.select(*[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in raw.columns])
    footer = F.lit(False)
    for c in rows.columns:
        footer = footer | F.lower(F.col(f"`{c}`")).startswith(FOOTER)
    return rows.filter(~footer)


def _first_filled(df: DataFrame, *names: str):
    return F.coalesce(*[F.nullif(F.col(f"`{n}`"), F.lit("")) for n in names if n in df.columns], F.lit(""))


def classified(rows: DataFrame, source_id: str) -> DataFrame:
    """ticker, listing_symbol, exchange_segment, listing_status, instrument_type, source_id of the listed stocks of one file."""
    nasdaq = source_id == "nasdaqlisted"
    is_yes = lambda n: F.upper(F.col(f"`{n}`")) == "Y" if n in rows.columns else F.lit(False)
    is_no = lambda n: F.upper(F.col(f"`{n}`")) == "N" if n in rows.columns else F.lit(False)  # noqa: E731  a missing column is no answer
    symbol = _first_filled(rows, "Symbol") if nasdaq else _first_filled(rows, "NASDAQ Symbol", "ACT Symbol", "CQS Symbol")
    name = F.col("`Security Name`")
    kind = F.when(name.rlike(RECEIPT), "depositary_receipt").when(name.rlike(STOCK), "common_stock")
    keep = is_no("Test Issue") & is_no("ETF") & ~is_yes("NextShares") & (symbol != "") & (name != "") & ~name.rlike(NOT_STOCK) & kind.isNotNull()
    if nasdaq:
        keep = keep & F.upper(F.col("`Financial Status`")).isin("", "N")
    segment = F.lit("NASDAQ") if nasdaq else F.coalesce(F.nullif(_first_filled(rows, "Exchange"), F.lit("")), F.lit("OTHER"))
    return rows.filter(keep).select(F.upper(symbol).alias("ticker"), symbol.alias("listing_symbol"), segment.alias("exchange_segment"), F.lit("active").alias("listing_status"), kind.alias("instrument_type"), F.lit(source_id).alias("source_id"))


def unique(listings: DataFrame) -> DataFrame:
    """Identical repetitions are one listing; a ticker that stands for different listings is an error."""
    once = listings.distinct()
    clash = once.groupBy("ticker").count().filter("count > 1").orderBy("ticker").limit(1).collect()
    if clash:
        raise DataError(f"ticker {clash[0]['ticker']} stands for different listings")
    return once.orderBy("ticker")


def us_listings(spark: SparkSession, nasdaqlisted: str, otherlisted: str) -> DataFrame:
    both = classified(read_pipes(spark, nasdaqlisted), "nasdaqlisted").unionByName(classified(read_pipes(spark, otherlisted), "otherlisted"))
    return unique(both).withColumn("market", F.lit("US"))


def request_symbols(listings: DataFrame) -> DataFrame:
    """What the price feed calls each listing (request_symbol); listings without such a name are left out."""
    t = F.col("ticker")
    us = F.when(t.rlike("^[A-Z0-9]+$"), t).when(t.rlike(r"^[A-Z0-9]+\.[A-Z0-9]+$"), F.regexp_replace(t, r"\.", "-"))
    tw = F.when(t.rlike("^[A-Z0-9]+$"), F.concat(t, F.when(F.upper("exchange_segment") == "TWSE", ".TW").when(F.upper("exchange_segment") == "TPEX", ".TWO").otherwise(F.raise_error(F.concat(F.lit("unknown exchange segment of "), t)))))
    out = listings.withColumn("request_symbol", F.when(F.col("market") == "US", us).otherwise(tw)).filter("request_symbol is not null")
    if out.groupBy("request_symbol").agg(F.count_distinct("ticker").alias("n")).filter("n > 1").limit(1).collect():
        raise DataError("two listings have one request symbol")
    return out


# ---------------------------------------------------------------- listing pages in HTML, as bytes of code page 950

# The stock section's name, and per source the market's text and the exchange it stands for.
STOCK_SECTION = "股票"
TW_SOURCES = {"twse_isin_str_mode_2": ("上市", "TWSE"), "twse_isin_str_mode_4": ("上櫃", "TPEX")}
HEADER = "有價證券代號"


def table_rows(html: bytes) -> list[list[str]]:
    """Cells of each table row, with white space collapsed."""
    from html.parser import HTMLParser

    rows: list[list[str]] = []
    cell: list[str] | None = None

    class Rows(HTMLParser):
        def handle_starttag(self, tag, attrs):
            nonlocal cell
            if tag == "tr":
                rows.append([])
            elif tag in ("td", "th") and rows:
                cell = []

        def handle_endtag(self, tag):
            nonlocal cell
            if tag in ("td", "th") and cell is not None:
                if words := " ".join("".join(cell).split()):  # empty cells are no cells
                    rows[-1].append(words)
                cell = None

        def handle_data(self, data):
            if cell is not None:
                cell.append(data)

    parser = Rows()
    parser.feed(html.decode("cp950"))
    parser.close()
    return [r for r in rows if r]


def tw_listings(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Stocks of the pages in paths (source id -> path). A page's sections follow one another, so a page is read by one task."""
    parts = [spark.read.format("binaryFile").load(p).select(F.lit(s).alias("source_id"), "content") for s, p in paths.items()]
    pages = parts[0]
    for more in parts[1:]:
        pages = pages.unionByName(more)

    def cells(batches):
        import pandas as pd

        for pdf in batches:
            for source, content in zip(pdf["source_id"], pdf["content"]):
                rows = table_rows(bytes(content))
                yield pd.DataFrame({"source_id": source, "place": range(len(rows)), "cells": rows})

    rows = pages.mapInPandas(cells, "source_id string, place int, cells array<string>").withColumn("listed", F.expr(r"cells[0] rlike '^[0-9A-Za-z]+\\s'"))
    section = F.last(F.when((F.size("cells") == 1) & ~F.col("listed"), F.col("cells")[0]), ignorenulls=True).over(Window.partitionBy("source_id").orderBy("place"))
    expected, segment = F.lit(None), F.lit(None)
    for s, (text, exchange) in TW_SOURCES.items():
        expected, segment = F.when(F.col("source_id") == s, text).otherwise(expected), F.when(F.col("source_id") == s, exchange).otherwise(segment)
    stocks = rows.withColumn("section", section).filter((F.col("section") == STOCK_SECTION) & F.col("listed") & (F.size("cells") > 1) & ~F.col("cells")[0].startswith(HEADER)).withColumn("market_text", F.try_element_at(F.expr("filter(cells, c -> c in ('上市', '上櫃'))"), F.lit(1)))
    symbol = F.upper(F.regexp_extract(F.col("cells")[0], "^([0-9A-Za-z]+)", 1))
    out = stocks.filter(F.col("market_text") == expected).select(symbol.alias("ticker"), symbol.alias("listing_symbol"), segment.alias("exchange_segment"), F.lit("active").alias("listing_status"), F.lit("common_stock").alias("instrument_type"), "source_id")
    return unique(out).withColumn("market", F.lit("TW"))
