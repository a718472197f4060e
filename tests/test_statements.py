"""Facts from statements and quotes."""

from datetime import date, datetime

import pytest

from marlstone import errors
from marlstone.sources import statements

DAY = date(2025, 6, 1)
ENDS = [date(2024, 3, 31), date(2024, 6, 30), date(2024, 9, 30), date(2024, 12, 31), date(2025, 3, 31)]


def test_facts(spark):
    flow = "ticker string, period_end date, operating_cash_flow double, capital_expenditures double"
    quarters = [("A", e, 10.0 + i, -float(i)) for i, e in enumerate(ENDS)] + [("A", None, 9e9, 0.0)]
    quarters += [("GAP", e, None if i == 3 else 1.0, 1.0) for i, e in enumerate(ENDS)] + [("FEW", e, 1.0, 1.0) for e in ENDS[:3]]
    years = [(t, date(2023, 12, 31), 90.0, -5.0) for t in ("A", "GAP")] + [("GAP", date(2024, 12, 31), 100.0, 30.0), ("USD", ENDS[3], 1.0, 1.0), ("FREE", ENDS[3], 1.0, float("nan"))]
    balances = [(t, e, 4.0, 7.0) for t in ("A", "GAP", "FEW", "FREE", "USD") for e in ENDS[:2]] + [("A", ENDS[3], 1.0, 3.0)]
    quotes = [("A", "USD", "USD", 5.0, datetime(2025, 5, 30, 12), 10.0), ("GAP", "USD", None, 5.0, None, 10.0), ("FEW", "USD", None, 5.0, None, 1.0), ("USD", "TWD", "USD", 5.0, None, 1.0), ("FREE", "USD", None, 0.0, None, 1.0)]
    found = statements.facts(
        spark.createDataFrame(quotes, "ticker string, currency string, financial_currency string, price double, quoted_at timestamp, shares double"),
        spark.createDataFrame(quarters, flow), spark.createDataFrame(years, flow), spark.createDataFrame(balances, "ticker string, period_end date, cash double, debt double"), DAY,
    )
    a = statements.strict(found, "A")
    assert (a["operating_cash_flow"], a["capital_expenditures"], a["free_cash_flow"], a["fiscal_period_type"], a["fiscal_period_end"]) == (50.0, 10.0, 40.0, "ttm", ENDS[4])
    assert (a["net_debt"], a["balance_sheet_as_of"], a["reference_price_as_of"], a["reference_price_as_of_source"], a["latest_source_date"]) == (2.0, ENDS[3], date(2025, 5, 30), "provider_reported", date(2025, 5, 30))
    gap = statements.strict(found, "GAP")
    assert (gap["free_cash_flow"], gap["fiscal_period_type"], gap["fiscal_period_end"], gap["reference_price_as_of"], gap["reference_price_as_of_source"]) == (70.0, "annual", ENDS[3], DAY, "fetch_date_fallback")
    assert {r["ticker"]: r["problem"] for r in found.collect() if r["problem"]} == {"FEW": "no usable cash flow", "FREE": "no usable cash flow", "USD": "statements are in another currency"}
    for ticker, kind in (("FEW", errors.DataError), ("NONE", errors.NotFound)):
        with pytest.raises(kind):
            statements.strict(found, ticker)


def test_lines_of_wide_frames(spark):
    """Period columns become rows; a null is no period, a value that is no number is one; other columns go."""
    rows = [("A", "income", "quarterly", "Total Revenue", 1.0, float("nan"), None, 9.0), ("B", "income", "yearly", "Net Income", None, 2.0, 3.0, None)]
    wide = spark.createDataFrame(rows, "ticker string, statement string, freq string, item string, `2025-03-31` double, `2024-12-31` double, `2024-09-30 00:00:00` double, TTM double")
    got = {(r["ticker"], r["item"], r["period_end"]): r["value"] for r in statements.lines(wide).collect()}
    assert set(got) == {("A", "Total Revenue", ENDS[4]), ("A", "Total Revenue", ENDS[3]), ("B", "Net Income", ENDS[3]), ("B", "Net Income", ENDS[2])}
    assert got["A", "Total Revenue", ENDS[4]] == 1.0 and got["A", "Total Revenue", ENDS[3]] != got["A", "Total Revenue", ENDS[3]]


FLOW_ITEMS = [("income", "Total Revenue", 100.0), ("income", "Gross Profit", 40.0), ("income", "Operating Income Loss", 20.0), ("income", "Net Income", 10.0), ("cash", "Operating Cash Flow", 15.0), ("cash", "Capital Expenditures", -5.0)]
BALANCE_ITEMS = [("balance", "Total Assets", 500.0), ("balance", "Total Equity Gross Minority Interest", 200.0), ("balance", "Total Debt", 50.0), ("balance", "Cash And Cash Equivalents", 30.0)]


def made(ticker, periods, freq="quarterly", items=(*FLOW_ITEMS, *BALANCE_ITEMS), **other):
    return [(ticker, s, freq, item, e, other.get(item.replace(" ", "_"), v)) for e in periods for s, item, v in items]


def test_universe(spark):
    """What each ticker's statements come to, worked out by hand, and what is said of those that won't do."""
    nan = float("nan")
    lines = made("A", ENDS) + [("A", "income", "quarterly", "Operating Income", e, 25.0) for e in ENDS]  # the better name is taken
    lines += made("YEAR", ENDS[:3]) + made("YEAR", ENDS[3:4], "yearly", FLOW_ITEMS, Net_Income=-7.0)
    lines += [x for x in made("CASH", ENDS) if x[1] != "cash" or x[4] in ENDS[:3]] + made("NAN", ENDS[:4]) + made("NAN", ENDS[4:], Gross_Profit=nan) + made("NAN", ENDS[3:4], "yearly")
    lines += [x for x in made("LINE", ENDS) if x[3] != "Gross Profit"] + [x for x in made("SHEET", ENDS) if x[3] != "Total Debt"] + made("HOLE", ENDS[:4]) + made("HOLE", ENDS[4:], Total_Debt=None)
    lines += made("DEBT", ENDS, Total_Debt=-1.0) + made("EQUITY", ENDS, Total_Equity_Gross_Minority_Interest=0.0) + made("TWD", ENDS) + made("BLANK", ENDS) + made("UNLISTED", ENDS) + made("SALES", ENDS, Total_Revenue=-1.0)
    tickers = ["A", "YEAR", "CASH", "NAN", "LINE", "SHEET", "HOLE", "DEBT", "EQUITY", "TWD", "BLANK", "NOQUOTE", "SALES"]
    listed = spark.createDataFrame([("US", t, 1) for t in [*tickers, "A"]], "market string, ticker string, more int")
    quotes = spark.createDataFrame([(t, "USD", {"TWD": "TWD", "BLANK": None}.get(t, " USD ")) if t != "BLANK" else (t, " ", None) for t in tickers if t != "NOQUOTE"], "ticker string, currency string, financial_currency string")
    table = spark.createDataFrame(lines, statements.LINES)
    got = {r["ticker"]: r for r in statements.universe(listed, quotes, table).collect()}
    a, year = got["A"], got["YEAR"]
    assert (a["revenue_ttm"], a["operating_income_ttm"], a["capital_expenditures_ttm"], a["free_cash_flow_ttm"], a["fiscal_period_end"], a["fiscal_period_type"]) == (400.0, 100.0, 20.0, 40.0, ENDS[4], "ttm")
    assert (a["roe"], a["debt_to_equity"], a["fcf_margin"], a["balance_sheet_as_of"], a["currency"], a["problem"]) == (0.2, 0.25, 0.1, ENDS[4], "USD", None)
    assert (year["revenue_ttm"], year["net_income_ttm"], year["fiscal_period_type"], year["tag_fundamentals_annual_fallback"], year["tag_negative_net_income"], year["balance_sheet_as_of"]) == (100.0, -7.0, "annual", 1.0, 1.0, ENDS[2])
    assert {t: (r["kind"], r["problem"]) for t, r in got.items() if r["problem"]} == {
        "CASH": ("missing", "no whole year of flows"), "LINE": ("missing", "no whole year of flows"), "SHEET": ("missing", "no balance"), "NAN": ("invalid", "a flow is no number"), "HOLE": ("invalid", "a balance is no number"),
        "DEBT": ("invalid", "total_debt must not be below zero"), "EQUITY": ("invalid", "shareholders_equity must be above zero"), "TWD": ("invalid", "statements are in another currency"),
        "BLANK": ("invalid", "no currency"), "NOQUOTE": ("invalid", "no currency"), "SALES": ("invalid", "revenue_ttm must be above zero"),
    }
    facts, coverage = statements.provider(lambda listings: (quotes, table))(listed, DAY)
    assert {r["ticker"] for r in facts.collect()} == {"A", "YEAR"} and "problem" not in facts.columns
    assert coverage == {"listed": 13, "with_facts": 2, "without_facts": 3, "invalid": 8, "latest_source_date": str(ENDS[4])}
    facts, coverage = statements.provider(lambda listings: (quotes.limit(0), table.limit(0)))(listed, DAY)
    assert facts.count() == 0 and coverage["invalid"] == 13 and coverage["latest_source_date"] == str(DAY)


def test_statements_are_gone_through_once_for_each_kind(spark):
    """Quarters and years of flows are summed together: two passes over the lines, one for flows and one for balances, not four."""
    lines = spark.range(3).selectExpr("concat('P', id) AS ticker", "'income' AS statement", "'yearly' AS freq", "'Total Revenue' AS item", "DATE '2025-12-31' AS period_end", "CAST(id AS DOUBLE) AS value")
    listed, quotes = lines.selectExpr("'US' AS market", "ticker"), lines.selectExpr("ticker", "'USD' AS currency", "'USD' AS financial_currency")
    plan = statements.universe(listed, quotes, lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number()") == 2


def test_line_items_are_what_is_moved(spark):
    """statement_facts reads line items and nothing that was written from them; its lines are those of its SQL."""
    from marlstone.plans import statement_facts

    data = "/root/testdata/sf0.001"
    plan = statement_facts.run(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert all("l_partkey" in x for x in plan.splitlines() if "Relation [" in x)
    items = spark.read.parquet(f"{data}/lineitem.parquet")
    ours, plain = statement_facts._lines(spark, items), spark.sql(statement_facts._sql("spark", "{lineitem}")[2], lineitem=items)
    told = [{tuple(r) for r in x.select("ticker", "statement", "freq", "item", "period_end", "value").collect()} for x in (ours, plain)]
    assert told[0] == told[1] and ours.count() == plain.count()
