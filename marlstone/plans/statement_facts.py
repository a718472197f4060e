"""Facts of a universe from statements that are made from line items, as a query with its SQL.

Every part is a listed ticker; a quarter's line items are its statements: a period for each quarter and each year with shipments. Some tickers lack a line, call it
by another name, hold a value that is no number, or quote another currency, so every outcome occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.sqlexpr import doubles
from marlstone.sources import statements

#: Sums of each part and period: in cents, so that all engines add alike. {last}: the last day of a quarter or year, in each engine's words.
_PERIODS = """
SELECT k, 'quarterly' AS freq, {quarter_end} AS period_end, sum(cents) AS cents, sum(net) AS net, count(*) AS n FROM ({items}) GROUP BY k, {quarter_end}
UNION ALL SELECT k, 'yearly' AS freq, {year_end} AS period_end, sum(cents) AS cents, sum(net) AS net, count(*) AS n FROM ({items}) GROUP BY k, {year_end}
"""
_ITEMS = "SELECT l_partkey AS k, CAST(l_shipdate AS DATE) AS day, CAST(round(l_extendedprice * 100.0) AS BIGINT) AS cents, CAST(round(l_extendedprice * 100.0 * (1.0 - l_discount)) AS BIGINT) AS net FROM {lineitem}"
_ENDS = {"spark": ("last_day(add_months(date_trunc('quarter', day), 2))", "make_date(year(day), 12, 31)"), "duckdb": ("last_day(CAST(date_trunc('quarter', day) + INTERVAL 2 MONTH AS DATE))", "make_date(year(day), 12, 31)")}
_KEY = "concat('P', CAST(k AS {text}))"
#: Statement, item and value of each line, and whether a ticker has it.
_LINES = [
    ("income", "Total Revenue", "cents / 100.0", "true"), ("income", "Gross Profit", "net / 100.0", "k % 11 <> 0 OR freq = 'yearly'"), ("income", "Operating Income", "(net - cents * 0.9) / 100.0", "k % 13 <> 0"),
    ("income", "Operating Income Loss", "(net - cents * 0.92) / 100.0", "k % 3 = 1 OR k % 13 = 0"), ("income", "Net Income Common Stockholders", "(net - cents * 0.94) / 100.0", "true"),
    ("cash", "Operating Cash Flow", "CASE WHEN k % 17 = 0 AND n = 1 THEN NULL ELSE (net - cents * 0.85) / 100.0 END", "true"), ("cash", "Capital Expenditure", "cents * CASE WHEN k % 2 = 0 THEN 0.1 ELSE -0.1 END / 100.0", "k % 23 <> 0"),
    ("balance", "Total Assets", "cents / 50.0 + k", "true"), ("balance", "Common Stock Equity", "cents / 100.0 - k * 60.0", "true"), ("balance", "Total Debt", "k % 7 * 1000.0", "k % 29 <> 0"),
    ("balance", "Cash And Cash Equivalents", "CASE WHEN k % 31 = 0 THEN NULL ELSE k % 5 * 500.0 END", "true"),
]


def _sql(engine: str, lineitem: str) -> tuple[str, str, str]:
    """Listed tickers, quotes and lines."""
    quarter, year = _ENDS[engine]
    key = _KEY.format(text="STRING" if engine == "spark" else "VARCHAR")
    periods = _PERIODS.format(items=_ITEMS.format(lineitem=lineitem), quarter_end=quarter, year_end=year)
    parts = f"SELECT DISTINCT l_partkey AS k FROM {lineitem}"
    listed = f"SELECT CASE WHEN k % 3 = 0 THEN 'TW' ELSE 'US' END AS market, {key} AS ticker FROM ({parts})"
    quotes = f"SELECT {key} AS ticker, CASE WHEN k % 37 = 0 THEN ' ' ELSE 'USD' END AS currency, CASE WHEN k % 19 = 0 THEN 'TWD' WHEN k % 37 = 0 THEN NULL ELSE ' USD' END AS financial_currency FROM ({parts}) WHERE k % 41 <> 0"
    lines = " UNION ALL ".join(f"SELECT {key} AS ticker, '{s}' AS statement, freq, '{item}' AS item, period_end, CAST({x} AS DOUBLE) AS value FROM p WHERE {has}" for s, item, x, has in _LINES)
    return listed, quotes, doubles(f"WITH p AS ({periods}) {lines}")


def _lines(spark: SparkSession, items: DataFrame) -> DataFrame:
    """Lines of _sql(), made where their ticker's line items are dealt to: only those are shuffled, and no line is written."""
    ends = F.array(*[F.struct(F.lit(freq).alias("freq"), F.expr(end).alias("period_end")) for freq, end in zip(("quarterly", "yearly"), _ENDS["spark"])])
    rows = spark.sql(doubles(_ITEMS), lineitem=items).withColumn("ticker", F.expr(_KEY.format(text="STRING"))).repartition("ticker")
    p = rows.select("ticker", "k", "cents", "net", F.inline(ends)).groupBy("ticker", "k", "freq", "period_end").agg(F.sum("cents").alias("cents"), F.sum("net").alias("net"), F.count("*").alias("n"))
    line = "named_struct('statement', '{}', 'item', '{}', 'value', CAST({} AS DOUBLE), 'has', {})"
    made = p.select("ticker", "freq", "period_end", F.expr(doubles(f"inline(array({', '.join(line.format(*x) for x in _LINES)}))")))
    return made.filter("has").select("ticker", "statement", "freq", "item", "period_end", "value")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts, or what is wrong with them, of every part."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    listed, quotes = (spark.sql(x, lineitem=items) for x in _sql("spark", "{lineitem}")[:2])
    found = statements.universe(listed, quotes, _lines(spark, items), dealt=True)
    kept = ["market", "ticker", "currency", "fiscal_period_end", "balance_sheet_as_of", "fiscal_period_type", "kind", "problem"]
    return found.selectExpr(*kept, *[doubles(f"{_cut(k)} AS {k}") for k in NUMBERS])


NUMBERS = [*statements.FLOWS, "free_cash_flow_ttm", *statements.BALANCES, *statements.RATIOS]


def _cut(x: str) -> str:
    return f"floor({x} * 10000.0 + 0.5) / 10000.0"


def oracle() -> str:
    """The same by plain SQL: names are chosen by a join with their list, periods by counting."""
    listed, quotes, lines = _sql("duckdb", "lineitem")
    names = ", ".join(f"('{fact}', '{s}', '{item}', {i})" for facts in (statements.FLOWS, statements.BALANCES) for fact, (s, items) in facts.items() for i, item in enumerate(items))
    value = lambda k: f"max(CASE WHEN fact = '{k}' THEN value END) AS {k}"
    have = lambda facts: " AND ".join(f"list_contains(facts, '{k}')" for k in facts)
    sums = lambda facts: ", ".join(f"sum({k}) AS {k}" for k in facts)
    fine = lambda facts: " AND ".join(f"count({k}) = count(*)" for k in facts)
    flow = lambda freq, n: f"SELECT ticker, {sums(statements.FLOWS)}, max(period_end) AS fiscal_period_end, {fine(statements.FLOWS)} AS flows_sound FROM f WHERE freq = '{freq}' AND nth <= {n} GROUP BY ticker HAVING count(*) = {n}"
    ratios = ", ".join(f"{a} / nullif({b}, 0.0) AS {k}" for k, (a, b) in statements.RATIOS.items())
    low = " ".join(f"WHEN {k} <= 0.0 THEN '{k} must be above zero'" for k in ("revenue_ttm", "total_assets", "shareholders_equity")) + " " + " ".join(f"WHEN {k} < 0.0 THEN '{k} must not be below zero'" for k in ("total_debt", "cash_and_cash_equivalents"))
    return doubles(f"""
WITH l AS ({lines}), a(fact, statement, item, i) AS (VALUES {names}), u AS (SELECT l.*, fact, i FROM l JOIN a ON l.statement = a.statement AND l.item = a.item),
c AS (SELECT ticker, freq, fact, min(i) AS i FROM u GROUP BY ticker, freq, fact), v AS (SELECT u.* FROM u JOIN c ON u.ticker = c.ticker AND u.freq = c.freq AND u.fact = c.fact AND u.i = c.i),
h AS (SELECT ticker, freq, list(fact) AS facts FROM c GROUP BY ticker, freq),
f AS (
  SELECT *, row_number() OVER (PARTITION BY ticker, freq ORDER BY period_end DESC) AS nth FROM (
    SELECT ticker, freq, period_end, {', '.join(value(k) for k in statements.FLOWS)} FROM v WHERE statement IN ('income', 'cash') GROUP BY ticker, freq, period_end HAVING count(DISTINCT statement) = 2
  ) JOIN h USING (ticker, freq) WHERE {have(statements.FLOWS)}
), t AS ({flow('quarterly', 4)}), y AS ({flow('yearly', 1)}),
e AS (SELECT *, 'ttm' AS fiscal_period_type FROM t UNION ALL SELECT *, 'annual' AS fiscal_period_type FROM y WHERE ticker NOT IN (SELECT ticker FROM t)),
b AS (
  SELECT ticker, {', '.join(statements.BALANCES)}, period_end AS balance_sheet_as_of, {' AND '.join(f'{k} IS NOT NULL' for k in statements.BALANCES)} AS balance_sound FROM (
    SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY period_end DESC) AS nth FROM (
      SELECT ticker, freq, period_end, {', '.join(value(k) for k in statements.BALANCES)} FROM v WHERE statement = 'balance' AND freq = 'quarterly' GROUP BY ticker, freq, period_end
    ) JOIN h USING (ticker, freq) WHERE {have(statements.BALANCES)}
  ) WHERE nth = 1
), q AS (SELECT ticker, nullif(trim(currency), '') AS quoted, nullif(trim(financial_currency), '') AS stated FROM ({quotes})),
w AS (
  SELECT market, g.ticker, quoted, stated, coalesce(stated, quoted) AS currency, fiscal_period_end, balance_sheet_as_of, fiscal_period_type, flows_sound, balance_sound, {', '.join(k if k != 'capital_expenditures_ttm' else 'abs(capital_expenditures_ttm) AS capital_expenditures_ttm' for k in statements.FLOWS)},
    operating_cash_flow_ttm - abs(capital_expenditures_ttm) AS free_cash_flow_ttm, {', '.join(statements.BALANCES)}
  FROM ({listed}) g LEFT JOIN q ON g.ticker = q.ticker LEFT JOIN e ON g.ticker = e.ticker LEFT JOIN b ON g.ticker = b.ticker
), r AS (SELECT *, {ratios} FROM w),
p AS (
  SELECT *, CASE WHEN quoted <> stated THEN 'statements are in another currency' WHEN currency IS NULL THEN 'no currency' WHEN fiscal_period_end IS NULL THEN 'no whole year of flows' WHEN NOT flows_sound THEN 'a flow is no number'
    WHEN balance_sheet_as_of IS NULL THEN 'no balance' WHEN NOT balance_sound THEN 'a balance is no number' {low} END AS problem FROM r
)
SELECT market, ticker, currency, fiscal_period_end, balance_sheet_as_of, fiscal_period_type, CASE WHEN problem IN ('no whole year of flows', 'no balance') THEN 'missing' WHEN problem IS NOT NULL THEN 'invalid' END AS kind, problem,
  {', '.join(f'{_cut(k)} AS {k}' for k in NUMBERS)} FROM p
""")
