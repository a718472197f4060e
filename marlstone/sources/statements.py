"""Facts from a feed's statements and quotes, of any number of tickers at once: for valuation (facts), and of a universe for ranking (universe).

For valuation, cash flows are those of the latest four quarters, all complete, or else of the latest year; the balance is the latest one. A
ticker that lacks something keeps its row and says in `problem` what is wrong first; strict() makes that an error.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.errors import DataError, NotFound
from marlstone.operators import checks
from marlstone.operators.tables import written

# What statements call the lines of each fact, the first that a statement has; flows are of periods, balances of a day.
FLOWS = {
    "revenue_ttm": ("income", ("Total Revenue",)), "gross_profit_ttm": ("income", ("Gross Profit",)), "operating_income_ttm": ("income", ("Operating Income", "Operating Income Loss")),
    "net_income_ttm": ("income", ("Net Income", "Net Income Common Stockholders", "Net Income From Continuing Operation Net Minority Interest")),
    "operating_cash_flow_ttm": ("cash", ("Operating Cash Flow",)), "capital_expenditures_ttm": ("cash", ("Capital Expenditure", "Capital Expenditures")),
}
BALANCES = {
    "total_assets": ("balance", ("Total Assets",)), "shareholders_equity": ("balance", ("Stockholders Equity", "Total Equity Gross Minority Interest", "Common Stock Equity")),
    "total_debt": ("balance", ("Total Debt",)), "cash_and_cash_equivalents": ("balance", ("Cash And Cash Equivalents", "Cash Cash Equivalents And Short Term Investments")),
}
RATIOS = {
    "roe": ("net_income_ttm", "shareholders_equity"), "roa": ("net_income_ttm", "total_assets"), "gross_margin": ("gross_profit_ttm", "revenue_ttm"), "operating_margin": ("operating_income_ttm", "revenue_ttm"),
    "net_margin": ("net_income_ttm", "revenue_ttm"), "debt_to_equity": ("total_debt", "shareholders_equity"), "fcf_margin": ("free_cash_flow_ttm", "revenue_ttm"),
}
#: Columns of long statements: one row for each line and period that a statement has; the value may be null or no number.
LINES = "ticker string, statement string, freq string, item string, period_end date, value double"
MISSING, INVALID = "missing", "invalid"


def _finite(name: str) -> Column:
    return F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(name) != float("inf"))


def _latest(rows: DataFrame, periods: int, kind: str, *values: str) -> DataFrame:
    """Sums of values over each ticker's latest periods; a ticker with fewer of them, or with a gap in them, has no row."""
    order = Window.partitionBy("ticker").orderBy(F.desc("period_end"))  # a ticker has a few dozen periods
    whole = F.lit(True)
    for v in values:
        whole = whole & _finite(v)
    rows = rows.filter("period_end is not null").select("ticker", "period_end", *[F.col(v).cast("double").alias(v) for v in values])
    last = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= periods)
    return last.groupBy("ticker").agg(*[F.sum(v).alias(v) for v in values], F.max("period_end").alias("end"), F.count(F.when(whole, 1)).alias("n")).filter(F.col("n") == periods).drop("n").withColumn("kind", F.lit(kind))


def facts(quotes: DataFrame, quarters: DataFrame, years: DataFrame, balances: DataFrame, fetched: date) -> DataFrame:
    """A row for each row of quotes (ticker, currency, financial_currency, price, quoted_at, shares).

    quarters and years: ticker, period_end, operating_cash_flow, capital_expenditures; balances: ticker, period_end, cash, debt.
    A quote without a time counts as of the day it was fetched, and reference_price_as_of_source says so.
    """
    flow = ("operating_cash_flow", "capital_expenditures")
    ttm, annual = _latest(quarters, 4, "ttm", *flow), _latest(years, 1, "annual", *flow)
    flows = ttm.unionByName(annual.join(ttm.select("ticker"), "ticker", "left_anti")).withColumnRenamed("end", "fiscal_period_end").withColumnRenamed("kind", "fiscal_period_type")
    held = _latest(balances, 1, "", "cash", "debt").drop("kind").withColumnRenamed("end", "balance_sheet_as_of")
    rows = quotes.select("ticker", "currency", "financial_currency", "price", "quoted_at", "shares").join(flows, "ticker", "left").join(held, "ticker", "left")
    problem = (
        F.when(F.col("financial_currency").isNotNull() & ~F.col("currency").eqNullSafe(F.col("financial_currency")), "statements are in another currency")
        .when(F.col("fiscal_period_end").isNull(), "no usable cash flow")
        .when(F.col("balance_sheet_as_of").isNull(), "no usable balance")
        .when(F.coalesce(F.trim("currency"), F.lit("")) == "", "no currency")
        .when(~(_finite("price") & (F.col("price") > 0)), "price must be above zero")
        .when(~(_finite("shares") & (F.col("shares") > 0)), "shares must be above zero")
    )
    spent = F.abs("capital_expenditures")
    return rows.select(
        "ticker", "currency", F.col("price").alias("reference_price"), F.coalesce(F.to_date("quoted_at"), F.lit(fetched)).alias("reference_price_as_of"),
        F.when(F.col("quoted_at").isNull(), "fetch_date_fallback").otherwise("provider_reported").alias("reference_price_as_of_source"), F.col("shares").alias("shares_outstanding"),
        F.col("cash").alias("cash_and_cash_equivalents"), F.col("debt").alias("total_debt"), (F.col("debt") - F.col("cash")).alias("net_debt"), "balance_sheet_as_of",
        "operating_cash_flow", spent.alias("capital_expenditures"), (F.col("operating_cash_flow") - spent).alias("free_cash_flow"), "fiscal_period_end", "fiscal_period_type",
        F.greatest("fiscal_period_end", F.coalesce(F.to_date("quoted_at"), F.lit(fetched)), "balance_sheet_as_of").alias("latest_source_date"), problem.alias("problem"),
    )


def strict(found: DataFrame, ticker: str) -> dict:
    """One ticker's facts; what is wrong with them is an error."""
    row = found.filter(F.col("ticker") == ticker).limit(1).collect()
    if not row:
        raise NotFound(f"there are no facts of {ticker}")
    if row[0]["problem"]:
        raise DataError(f"{ticker}: {row[0]['problem']}")
    return {k: v for k, v in row[0].asDict().items() if k != "problem"}


# ---------------------------------------------------------------- a universe


def lines(frames: DataFrame) -> DataFrame:
    """Long statements (LINES) from frames that have a column for each period beside ticker, statement, freq and item.

    A column whose name is no date is left out. A null says that the ticker has no such period; a value that is no number (NaN) stays, as something that is there and unusable.
    """
    keys = ["ticker", "statement", "freq", "item"]
    periods = [c for c in frames.columns if c not in keys]
    long = frames.select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c in periods]).unpivot(keys, [f"`{c}`" for c in periods], "period", "value")
    return long.filter("value is not null").select(*keys, F.expr("try_cast(replace(period, '`', '') as date)").alias("period_end"), "value").filter("period_end is not null")


def _named(rows: DataFrame, facts: dict) -> DataFrame:
    """ticker, freq, period_end with the value of each fact by the first of its names that the ticker's statement has (has_<fact>: whether it has one)."""
    order = {(s, item): (fact, i) for fact, (s, items) in facts.items() for i, item in enumerate(items)}
    number = functools.reduce(lambda c, k: c.when((F.col("statement") == k[0]) & (F.col("item") == k[1]), order[k][1]), order, F)
    fact = functools.reduce(lambda c, k: c.when((F.col("statement") == k[0]) & (F.col("item") == k[1]), order[k][0]), order, F)
    told = rows.filter(F.col("statement").isin(sorted({s for s, _ in facts.values()}))).withColumns({"fact": fact, "nth": number})
    names = [(k, i) for k, (_, items) in facts.items() for i in range(len(items))]
    kinds = sorted({s for s, _ in facts.values()})
    whole = Window.partitionBy("ticker", "freq")  # of periods, as lines are many times more
    mine = lambda k, i: (F.col("fact") == k) & (F.col("nth") == i)
    per = told.groupBy("ticker", "freq", "period_end").agg(
        *[F.max(F.when(mine(k, i), F.col("value"))).alias(f"value_{k}_{i}") for k, i in names], *[F.max(F.coalesce(mine(k, i), F.lit(False))).alias(f"there_{k}_{i}") for k, i in names],
        *[F.max(F.col("fact").isNull() & (F.col("statement") == s)).alias(f"other_{s}") for s in kinds],
    )
    per = per.withColumns({f"known_{k}_{i}": F.max(f"there_{k}_{i}").over(whole) for k, i in names})
    first = lambda k, c: functools.reduce(lambda w, i: w.when(F.col(f"known_{k}_{i}"), F.col(f"{c}_{k}_{i}")), range(len(facts[k][1])), F)
    seen = lambda s: functools.reduce(lambda x, y: x | y, [F.coalesce(first(k, "there"), F.lit(False)) for k in facts if facts[k][0] == s], F.col(f"other_{s}"))
    return per.select("ticker", "freq", "period_end", *[first(k, "value").alias(k) for k in facts], *[F.coalesce(first(k, "known"), F.lit(False)).alias(f"has_{k}") for k in facts], *[seen(s).alias(f"in_{s}") for s in kinds])


def _summed(rows: DataFrame, facts: dict, periods: dict[str, int]) -> DataFrame:
    """ticker, freq, sums of the facts over the latest periods that all statements have, `end`, and `sound` (all of them numbers); no row where a line or a period is lacking.

    periods: how many of each freq. A ticker that has more than one of them whole gets the first in order of names.
    """
    both = functools.reduce(lambda a, b: a & b, [F.col(f"in_{s}") for s in sorted({s for s, _ in facts.values()})])
    known = functools.reduce(lambda a, b: a & b, [F.col(f"has_{k}") for k in facts])
    asked = functools.reduce(lambda c, f: c.when(F.col("freq") == f, periods[f]), periods, F)
    held = rows.filter(F.col("freq").isin(list(periods)) & both & known)
    last = held.withColumn("nth", F.row_number().over(Window.partitionBy("ticker", "freq").orderBy(F.desc("period_end")))).filter(F.col("nth") <= asked)
    sound = functools.reduce(lambda a, b: a & b, [checks.finite(k) for k in facts])
    out = last.groupBy("ticker", "freq").agg(*[F.sum(k).alias(k) for k in facts], F.max("period_end").alias("end"), F.min(sound).alias("sound"), F.count("*").alias("n")).filter(F.col("n") == asked).drop("n")
    return out.withColumn("best", F.min("freq").over(Window.partitionBy("ticker"))).filter("freq = best").drop("best")


def universe(listed: DataFrame, quotes: DataFrame, statements: DataFrame, dealt: bool = False) -> DataFrame:
    """A row for each ticker of listed (market, ticker): facts for ranking, or `problem` and its `kind` (missing or invalid).

    quotes: ticker, currency, financial_currency; statements: LINES. Flows are summed over the four latest quarters, or, where a line or a quarter is lacking, taken
    from the latest year; a value in them that is no number makes the ticker invalid. All steps share one shuffle of the statements by ticker;
    dealt: they come from one already.
    """
    by_ticker = statements if dealt else statements.repartition("ticker")
    flows = _named(by_ticker, FLOWS)
    either = _summed(flows, FLOWS, {"quarterly": 4, "yearly": 1}).withColumn("fiscal_period_type", F.when(F.col("freq") == "quarterly", "ttm").otherwise("annual")).drop("freq")
    either = either.withColumnsRenamed({"end": "fiscal_period_end", "sound": "flows_sound"})
    held = _summed(_named(by_ticker, BALANCES), BALANCES, {"quarterly": 1}).drop("freq").withColumnsRenamed({"end": "balance_sheet_as_of", "sound": "balance_sound"})
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    named = quotes.select("ticker", text("currency").alias("quoted"), text("financial_currency").alias("stated")).dropDuplicates(["ticker"])
    rows = listed.select("market", "ticker").distinct().join(named, "ticker", "left").join(either, "ticker", "left").join(held, "ticker", "left")
    spent = F.abs("capital_expenditures_ttm")
    rows = rows.withColumns({"capital_expenditures_ttm": spent, "free_cash_flow_ttm": F.col("operating_cash_flow_ttm") - spent, "currency": F.coalesce("stated", "quoted")})
    zero = F.lit(0.0)
    rows = rows.withColumns({k: F.col(a) / F.when(F.col(b) != zero, F.col(b)) for k, (a, b) in RATIOS.items()})
    rows = rows.withColumns(
        {"tag_fundamentals_annual_fallback": (F.col("fiscal_period_type") == "annual").cast("double"), "tag_negative_net_income": (F.col("net_income_ttm") < zero).cast("double"), "tag_negative_fcf": (F.col("free_cash_flow_ttm") < zero).cast("double")}
    )
    found = [
        (F.col("quoted") != F.col("stated"), INVALID, "statements are in another currency"), (F.col("currency").isNull(), INVALID, "no currency"),
        (F.col("fiscal_period_end").isNull(), MISSING, "no whole year of flows"), (~F.col("flows_sound"), INVALID, "a flow is no number"),
        (F.col("balance_sheet_as_of").isNull(), MISSING, "no balance"), (~F.col("balance_sound"), INVALID, "a balance is no number"),
        *[(F.col(k) <= zero, INVALID, f"{k} must be above zero") for k in ("revenue_ttm", "total_assets", "shareholders_equity")],
        *[(F.col(k) < zero, INVALID, f"{k} must not be below zero") for k in ("total_debt", "cash_and_cash_equivalents")],
        *[(~checks.finite(k), INVALID, f"{k} must be a number") for k in (*FLOWS, *BALANCES, "free_cash_flow_ttm", *RATIOS)],
    ]
    chain = lambda i: functools.reduce(lambda c, x: c.when(x[0], x[i]), found, F)
    tags = ("tag_fundamentals_annual_fallback", "tag_negative_net_income", "tag_negative_fcf")
    columns = ["market", "ticker", "currency", "fiscal_period_end", "balance_sheet_as_of", "fiscal_period_type", *FLOWS, "free_cash_flow_ttm", *BALANCES, *RATIOS, *tags]
    return rows.select(*columns, chain(1).alias("kind"), chain(2).alias("problem"))


def provider(read: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> Callable[[DataFrame, date], tuple[DataFrame, dict]]:
    """A provider of facts for live runs from read(listings), which gives quotes and statements (LINES).

    Facts are written once; how many tickers were asked for, came back, lack something or are invalid is counted by the job that writes.
    """

    def run(listings: DataFrame, day: date) -> tuple[DataFrame, dict]:
        quotes, statements = read(listings)
        usable = F.col("problem").isNull()
        latest = F.max(F.when(usable, F.greatest("fiscal_period_end", "balance_sheet_as_of")))
        watch = checks.Watch(universe(listings, quotes, statements), {"listed": F.count(F.lit(1)), "with_facts": checks.how_many(usable), "without_facts": checks.how_many(F.col("kind") == MISSING), "invalid": checks.how_many(F.col("kind") == INVALID), "latest": latest})
        held = written(watch.rows, "fundamentals")
        seen = watch.seen()
        coverage = {k: seen[k] for k in ("listed", "with_facts", "without_facts", "invalid")} | {"latest_source_date": str(seen["latest"] or day)}
        return held.filter("problem is null").drop("kind", "problem"), coverage

    return run
