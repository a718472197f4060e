"""Universe fundamentals from line items, and the profile that ranks them by quality and profitability."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.sqlexpr import div, doubles, percentile, tag, weighted
from marlstone.operators import checks, ranks
from marlstone.operators.tables import written

from .engine import cut

#: Days by which shipments are moved so that the last ones fall near the end of the bar panel; days after which facts are stale.
SHIFT, STALE_DAYS = 8_738, 550
PLACES = 8

#: Latest four quarters with shipments make the trailing year; with fewer, the latest year does (annual fallback).
FACTS_SQL = doubles(f"""
SELECT market, ticker, fiscal_period_end, balance_sheet_as_of, period, revenue_ttm, net_income_ttm, operating_income_ttm, total_assets, shareholders_equity, total_debt, cash_and_cash_equivalents, free_cash_flow_ttm,
  {div('net_income_ttm', 'shareholders_equity')} AS roe, {div('net_income_ttm', 'total_assets')} AS roa, {div('operating_income_ttm', 'revenue_ttm')} AS operating_margin, {div('net_income_ttm', 'revenue_ttm')} AS net_margin,
  {div('free_cash_flow_ttm', 'revenue_ttm')} AS fcf_margin, {div('total_debt', 'shareholders_equity')} AS debt_to_equity,
  {tag("period = 'annual'")} AS tag_fundamentals_annual_fallback, {tag('net_income_ttm < 0.0')} AS tag_negative_net_income, {tag('free_cash_flow_ttm < 0.0')} AS tag_negative_fcf
FROM (
  SELECT CASE WHEN k % 3 = 0 THEN 'TW' ELSE 'US' END AS market, concat('P', k) AS ticker, last_day AS fiscal_period_end, last_day AS balance_sheet_as_of, CASE WHEN quarters = 4 THEN 'ttm' ELSE 'annual' END AS period,
    CAST(cents AS DOUBLE) / 100.0 AS revenue_ttm, CAST(net - cents * 94 / 100.0 AS DOUBLE) / 100.0 AS net_income_ttm, CAST(net - cents * 91 / 100.0 AS DOUBLE) / 100.0 AS operating_income_ttm,
    CAST(cents + 100 * 1000 * k AS DOUBLE) / 100.0 AS total_assets, CAST(cents - k * 5000 AS DOUBLE) / 100.0 AS shareholders_equity, CAST(k % 7 * 100000 AS DOUBLE) AS total_debt, CAST(k % 5 * 50000 AS DOUBLE) AS cash_and_cash_equivalents,
    CAST(net - cents * 95 / 100.0 AS DOUBLE) / 100.0 AS free_cash_flow_ttm
  FROM (
    SELECT k, max(day) AS last_day, count(*) AS quarters, sum(cents) AS cents, sum(net) AS net FROM (
      SELECT k, max(day) AS day, sum(cents) AS cents, sum(net) AS net, row_number() OVER (PARTITION BY k ORDER BY quarter DESC) AS rn FROM (
        SELECT l_partkey AS k, CAST(l_shipdate AS DATE) AS day, year(l_shipdate) * 4 + quarter(l_shipdate) AS quarter, CAST(round(l_extendedprice * 100.0) AS BIGINT) AS cents, CAST(round(l_extendedprice * 100.0 * (1.0 - l_discount)) AS BIGINT) AS net FROM {{lineitem}}
      ) AS a GROUP BY k, quarter
    ) AS b WHERE rn <= 4 GROUP BY k
  ) AS c
) AS d
""")

REQUIRED = (
    "revenue_ttm net_income_ttm total_assets shareholders_equity total_debt cash_and_cash_equivalents free_cash_flow_ttm roe roa operating_margin net_margin fcf_margin debt_to_equity"
    " tag_fundamentals_annual_fallback tag_negative_net_income tag_negative_fcf"
).split()
SCORES = {f"score_{x}": (x, "high") for x in ("roe", "roa", "operating_margin", "net_margin", "fcf_margin")} | {"score_low_debt_to_equity": ("debt_to_equity", "low")}
DESCENDING = ("score", "score_profitability", "score_cash_generation", "score_balance_sheet", "roe", "free_cash_flow_ttm")
ORDER = ", ".join(f"{k} DESC" for k in DESCENDING) + ", ticker"
KEYS = [*SCORES, "score_positive_fcf", "score_profitability", "score_cash_generation", "score_balance_sheet", "tag_fundamentals_annual_fallback", "tag_negative_net_income", "tag_negative_fcf"]


#: What facts must hold, beside being fresh, for a ticker to be ranked.
ELIGIBLE = " AND ".join(f"{x} IS NOT NULL" for x in REQUIRED) + " AND revenue_ttm > 0.0 AND total_assets > 0.0 AND shareholders_equity > 0.0 AND total_debt >= 0.0 AND cash_and_cash_equivalents >= 0.0"


PARTS = {
    "score_profitability": weighted((0.35, "score_roe"), (0.25, "score_roa"), (0.25, "score_operating_margin"), (0.15, "score_net_margin")),
    "score_cash_generation": weighted((0.7, "score_fcf_margin"), (0.3, "score_positive_fcf")),
    "score_balance_sheet": "score_low_debt_to_equity",
}
SCORE = weighted((0.6, "score_profitability"), (0.25, "score_cash_generation"), (0.15, "score_balance_sheet"))
POSITIVE_FCF = "CASE WHEN free_cash_flow_ttm > 0.0 THEN 100.0 ELSE 0.0 END"


def scoring_sql(rows: str) -> str:
    """Scores and ranks of eligible facts in SQL: common table expressions and the query that ends them."""
    scores = ", ".join(f"CAST(100.0 * ({percentile(x, better)}) AS DOUBLE) AS {n}" for n, (x, better) in SCORES.items())
    return f"""
p AS (SELECT *, {scores}, {POSITIVE_FCF} AS score_positive_fcf FROM {rows}),
q AS (SELECT *, {', '.join(f'{x} AS {n}' for n, x in PARTS.items())} FROM p), t AS (SELECT *, {cut(SCORE, PLACES)} AS score FROM q)
SELECT market, 'composite' AS horizon, ticker, {', '.join(f'{cut(k, PLACES)} AS {k}' for k in KEYS)}, score, CAST(row_number() OVER (PARTITION BY market ORDER BY {ORDER}) AS BIGINT) AS rank FROM t
"""


def eligible_sql(day_added: str) -> str:
    """Common table expressions over {bars} and {lineitem} that end with s, the eligible facts of each market's run. day_added: how the engine adds SHIFT days to a date."""
    fresh = day_added.format(day="fiscal_period_end", n=SHIFT)
    return f"""
WITH facts AS ({FACTS_SQL}), latest AS (SELECT market, ticker, max(bar_date) AS last_date FROM {{bars}} GROUP BY market, ticker), run AS (SELECT market, max(last_date) AS as_of FROM latest GROUP BY market),
s AS (
  SELECT f.* FROM facts f JOIN latest l ON f.market = l.market AND f.ticker = l.ticker JOIN run r ON l.market = r.market AND l.last_date = r.as_of
  WHERE datediff_days(r.as_of, {fresh}) <= {STALE_DAYS} AND {ELIGIBLE}
)"""


def eligible(bars: DataFrame, lineitem: DataFrame) -> DataFrame:
    """The eligible facts of each market, made from line items."""
    text = eligible_sql("date_add({day}, {n})").replace("datediff_days(", "datediff(")
    return bars.sparkSession.sql(doubles(text) + " SELECT * FROM s", bars=bars, lineitem=lineitem)


def oracle(bars: str) -> str:
    return doubles(eligible_sql("{day} + {n}") + ", " + scoring_sql("s")).replace("datediff_days(r.as_of, ", "(r.as_of - (").replace(f"+ {SHIFT}) <=", f"+ {SHIFT})) <=").format(bars=f"({bars})", lineitem="lineitem")


PROFILE_ID, HORIZONS = "fundamental_quality_profitability_v1", ("composite",)
#: A snapshot's metrics; cash is asked for, but not kept.
SNAPSHOT = ["profile_metrics_version", *[x for x in REQUIRED if x != "cash_and_cash_equivalents"]]


def snapshot(facts: DataFrame, bars: DataFrame, listings: DataFrame, run_date: date) -> DataFrame:
    """Listed tickers with a bar on the run's date and fresh, complete and positive facts: market, ticker, close, adjusted_close, metrics."""
    day = F.lit(run_date)
    listed = listings.select("market", "ticker").distinct()
    priced = bars.filter(F.col("bar_date") == day).select("market", "ticker", "close", "adjusted_close").join(listed, ["market", "ticker"], "left_semi")
    fresh = F.greatest(F.datediff(day, "fiscal_period_end"), F.datediff(day, "balance_sheet_as_of")) <= STALE_DAYS
    dated = F.col("fiscal_period_end").isNotNull() & F.col("balance_sheet_as_of").isNotNull() & fresh
    held = facts.filter(dated).filter(doubles(ELIGIBLE)).join(priced, ["market", "ticker"])
    for k in (*REQUIRED, "close", "adjusted_close"):
        held = held.filter(checks.finite(k))
    return held.withColumn("profile_metrics_version", F.lit(1.0)).select("market", "ticker", "close", "adjusted_close", *SNAPSHOT)


def rankings(snap: DataFrame) -> DataFrame:
    """market, horizon, ticker, ranking metrics, score, rank of a snapshot."""
    exact = lambda x: F.expr(f"CAST({doubles(x)} AS DOUBLE)")
    rows = ranks.percentiles(written(snap, "snapshot"), ["market"], "ticker", {n: percentile(x, better) for n, (x, better) in SCORES.items()})
    rows = rows.withColumns({n: F.lit(100.0) * F.col(n) for n in SCORES} | {"score_positive_fcf": exact(POSITIVE_FCF)})
    rows = rows.withColumns({n: exact(x) for n, x in PARTS.items()})
    rows = rows.withColumn("score", exact(cut(SCORE, PLACES)))
    rows = written(rows.select("market", "ticker", *dict.fromkeys([*KEYS, *DESCENDING])), "scored")  # a partitioning by ranges looks at its rows twice
    placed = ranks.ranked(rows, ["market"], [*[F.desc(k) for k in DESCENDING], F.asc("ticker")])
    return placed.select("market", F.lit(HORIZONS[0]).alias("horizon"), "ticker", *[exact(cut(k, PLACES)).alias(k) for k in KEYS], "score", "rank")


def settle(market: str, seen: dict) -> None:
    """Unlike the price profiles', a run in which nobody is eligible is an error."""
    if not seen["rows"]:
        raise checks.DataError(f"no eligible fundamentals of {market}")
