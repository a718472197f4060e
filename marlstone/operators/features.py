"""Trailing-window features of a universe as it stood on the dates of runs.

A feature is the text of an aggregate over a run's bars, in which rn counts bars from the latest (1). A ticker's bars become one row with an
array for each column, in the order of dates, made once whatever the number of runs; what looks back from a bar is the array moved on. A run
takes from them the slice that its profile keeps. Medians, running peaks and tops come from slices; the others from the slice's bars, as rows
that stream into one aggregation. So bars are shuffled and sorted once, as they came, and neither looked-back values nor runs' bars are.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.sqlexpr import div, doubles, ln

_W = "PARTITION BY market, ticker ORDER BY bar_date"
_SOFAR = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

#: Columns of the windowed bars; the second step uses those of the first. {keep}: how many bars a run's ticker keeps.
FIRST = {
    "seq": f"row_number() OVER ({_W})",
    "out_date": f"lead(bar_date, {{keep}}) OVER ({_W})",
    "ac": "adjusted_close",
    "pdate": f"lag(bar_date) OVER ({_W})",
    "pac": f"lag(adjusted_close) OVER ({_W})",
    "pc": f"lag(close) OVER ({_W})",
    "ac21": f"lag(adjusted_close, 21) OVER ({_W})",
    "ma60_now": f"avg(adjusted_close) OVER ({_W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)",
}
SECOND = {
    "ret": f"({div('ac', 'pac')} - 1.0)",
    "ret21": f"({div('ac', 'ac21')} - 1.0)",
    "tv": "close * volume",
    "range_pct": div("high - low", "close"),
    "repeats": f"sum(CASE WHEN bar_date = pdate THEN 1 ELSE 0 END) OVER ({_W} {_SOFAR})",
    "fine": "(coalesce(abs(open) + abs(high) + abs(low) + abs(close) + abs(ac) + abs(volume) < 1e300, false) AND open > 0.0 AND high > 0.0 AND low > 0.0 AND close > 0.0 AND ac > 0.0 AND volume >= 0.0)",
    "fine_cav": "(coalesce(abs(close) + abs(ac) + abs(volume) < 1e300, false) AND close > 0.0 AND ac > 0.0 AND volume >= 0.0)",
    "ordered": "NOT (high < low OR high < open OR high < close OR low > open OR low > close)",
}


def _if(condition: str, x: str) -> str:
    return f"CASE WHEN {condition} THEN {x} END"


def _round(x: str, places: int = 10) -> str:
    return f"round({x}, {places})"


def _mean(x: str, n: int, least: int = 1) -> str:
    return f"avg({_if(f'rn BETWEEN {least} AND {n}', x)})"


def _std(x: str, a: int, b: int) -> str:
    return _round(f"stddev_samp({_if(f'rn BETWEEN {a} AND {b}', x)})")


def _bar(k: int, x: str = "ac") -> str:
    return f"max({_if(f'rn = {k}', x)})"


def _return(newer: int, older: int) -> str:
    return f"({div(_bar(newer), _bar(older))} - 1.0)"


def _count(condition: str) -> str:
    return f"CAST(count({_if(condition, '1')}) AS DOUBLE)"


FEATURES: dict[str, str] = {
    "bars": "max(seq)",
    "repeated_dates": "max(repeats)",
    "last_date": "max(bar_date)",
    "close": _bar(1, "close"),
    "adjusted_close": _bar(1),
    "volatility_12_1": _std("ret", 22, 273),
    "volatility_6_1": _std("ret", 22, 147),
    "momentum_return_12_1": _return(22, 274),
    "momentum_return_6_1": _return(22, 148),
    "return_120d_ex_recent_20d": _return(21, 121),
    "return_252d": _return(1, 252),
    "above_ma60": _round(div(_count("rn <= 126 AND ac > ma60_now"), "126.0")),
    "positive_blocks": _round(div(_count("rn IN (1, 22, 43, 64, 85, 106) AND ret21 > 0.0"), "6.0")),
    "positive_21d_return_ratio_252d": _round(div(_count("rn <= 231 AND ret21 > 0.0"), "231.0")),
    "downside_rms_60d": _round(f"sqrt({_mean('pow(least(ret, 0.0), 2.0)', 60)})"),
    "downside_std_20d": _std("least(ret, 0.0)", 1, 20),
    "downside_std_60d": _std("least(ret, 0.0)", 1, 60),
    "downside_std_120d": _std("least(ret, 0.0)", 1, 120),
    "low_10d": "min(CASE WHEN rn <= 10 THEN low END)",
    "positive_days_60d": _round(div(_count("rn <= 60 AND ret > 0.0"), "60.0")),
    "largest_return_60d": "max(CASE WHEN rn <= 60 THEN ret END)",
    "stale_both_20d": _count("rn <= 20 AND close = pc AND ac = pac"),
    "stale_adjusted_20d": _count("rn <= 20 AND ac = pac"),
    "stale_close_19": _count("rn <= 19 AND close = pc"),
    "stale_close_59": _count("rn <= 59 AND close = pc"),
    "active_days_60d": _count("rn <= 60 AND volume > 0.0"),
    "active_days_274d": _count("rn <= 274 AND volume > 0.0"),
    "zero_days_20d": _count("rn <= 20 AND volume = 0.0"),
    "zero_days_60d": _count("rn <= 60 AND volume = 0.0"),
    "amihud_20d": _round(f"avg({_if('rn <= 20 AND tv > 0.0', div('abs(ret)', 'tv'))})", 18),
    "amihud_60d": _round(f"avg({_if('rn <= 59 AND tv > 0.0', div('abs(ret)', 'tv'))})", 18),
    "traded_value_cv_60d": _round(div("stddev_pop(CASE WHEN rn <= 60 THEN tv END)", _mean("tv", 60))),
    "traded_value_concentration_60d": div("max(CASE WHEN rn <= 60 THEN tv END)", "sum(CASE WHEN rn <= 60 THEN tv END)"),
    "used_121": "count(CASE WHEN rn <= 121 AND coalesce(abs(ac) < 1e300, false) THEN 1 END) + count(CASE WHEN rn IN (1, 61, 121) AND ac > 0.0 THEN 1 END) + count(CASE WHEN rn <= 20 AND close > 0.0 AND volume >= 0.0 THEN 1 END)",
}
for _k in (5, 20, 60, 120):
    FEATURES[f"return_{_k}d"] = _return(1, _k + 1)
for _n in (20, 60, 120, 126):
    FEATURES[f"volatility_{_n}d"] = _std("ret", 1, _n)
for _n in (20, 50, 60, 120, 200):
    FEATURES[f"sma_{_n}d"] = _mean("ac", _n)
for _n in (60, 120, 200):
    FEATURES[f"sma_{_n}d_before"] = _mean("ac", _n + 20, 21)
for _n in (120, 252):
    FEATURES[f"max_drawdown_{_n}d"] = f"least(0.0, min(CASE WHEN rn <= {_n} THEN {div('ac', f'peak{_n}')} - 1.0 END))"
for _n in (60, 120):
    FEATURES[f"slope_{_n}d"] = _round(f"regr_slope({_if(f'rn <= {_n}', ln('ac'))}, CAST({_n} - rn AS DOUBLE))")
    FEATURES[f"r2_{_n}d"] = f"CASE WHEN min(CASE WHEN rn <= {_n} THEN ac END) = max(CASE WHEN rn <= {_n} THEN ac END) THEN 0.0 ELSE {_round(f'regr_r2({_if(f"rn <= {_n}", ln("ac"))}, CAST({_n} - rn AS DOUBLE))', 8)} END"
    FEATURES[f"high_{_n}d"] = f"max(CASE WHEN rn <= {_n} THEN ac END)"
    FEATURES[f"prior_high_{_n}d"] = f"max(CASE WHEN rn BETWEEN 2 AND {_n + 1} THEN ac END)"
    FEATURES[f"low_{_n}d"] = f"min(CASE WHEN rn <= {_n} THEN ac END)"
FEATURES |= {"top_20d": "max(CASE WHEN rn <= 20 THEN ac END)", "bottom_20d": "min(CASE WHEN rn <= 20 THEN ac END)"}
for _n in (5, 20, 60):
    FEATURES[f"avg_tv_{_n}d"] = _mean("tv", _n)
for _n in (20, 60):
    FEATURES[f"median_tv_{_n}d"] = f"median(CASE WHEN rn <= {_n} THEN tv END)"
    FEATURES[f"median_range_pct_{_n}d"] = f"median(CASE WHEN rn <= {_n} THEN range_pct END)"
for _n in (59, 60, 125, 200, 251, 273):
    FEATURES[f"extreme_{_n}"] = f"max(CASE WHEN rn <= {_n} THEN abs(ret) END)"
for _n in (63, 126, 252, 274):
    FEATURES[f"fine_{_n}"] = f"count(CASE WHEN rn <= {_n} AND fine THEN 1 END)"
    FEATURES[f"ordered_{_n}"] = f"count(CASE WHEN rn <= {_n} AND ordered THEN 1 END)"
FEATURES["fine_cav_274"] = "count(CASE WHEN rn <= 274 AND fine_cav THEN 1 END)"
#: The most recent of the highest closes: how many bars ago. Its peak is the running one seen from the end.
FOLLOWED = {n: (f"days_since_{n}d_high", f"CAST(min(CASE WHEN rn <= {n} AND ac = top{n} THEN rn END) - 1 AS DOUBLE)") for n in (60, 120)}
#: Of a run's bars: their number from the latest, then running peaks and tops. {keys} are the columns that tell a run's ticker.
THIRD = {"rn": "(max(seq) OVER (PARTITION BY {keys}) - seq + 1)"}
FOURTH = {f"peak{n}": f"max(CASE WHEN rn <= {n} THEN ac END) OVER (PARTITION BY {{keys}} ORDER BY bar_date {_SOFAR})" for n in (120, 252)}
FOURTH |= {f"top{n}": f"max(CASE WHEN rn <= {n} THEN ac END) OVER (PARTITION BY {{keys}})" for n in FOLLOWED}
FEATURES |= dict(FOLLOWED.values())


#: Run calendars of up to so many rows are sent to all tasks; longer ones are joined by their market.
SENT_RUNS = 100_000
IN_RUN = "bar_date <= as_of AND (out_date IS NULL OR out_date > as_of)"


def calendar(bars: DataFrame, rule: str, runs: DataFrame | None = None) -> DataFrame:
    """Runs (market, run_date, and run_id where there are several) with the as-of date by a profile's rule.

    A: the run's date. B: the last date of the market's bars before it, as the run's own may be incomplete. C: the last one up to it. A run without
    such a date is left out. Without runs there is one for each market, on the last date of its bars.
    """
    if runs is None:
        runs = bars.groupBy("market").agg(F.max("bar_date").alias("run_date"))
        if rule == "C":
            return runs.withColumn("as_of", F.col("run_date"))
    if rule == "A":
        return runs.withColumn("as_of", F.col("run_date"))
    dates = bars.select("market", "bar_date").distinct()  # a row a market and day
    return runs.join(dates, "market").filter("bar_date < run_date" if rule == "B" else "bar_date <= run_date").groupBy(*runs.columns).agg(F.max("bar_date").alias("as_of"))


def windowed(bars: DataFrame, keep: int) -> DataFrame:
    """Bars with what can be told by looking back from them, and the date from which they are no longer among the last `keep`."""
    for step in (FIRST, SECOND):
        bars = bars.select("*", *[F.expr(doubles(x.replace("{keep}", str(keep)))).alias(n) for n, x in step.items()])
    return bars


def keys_of(runs: DataFrame) -> list[str]:
    return [*(["run_id"] if "run_id" in runs.columns else []), "market", "ticker"]


def _last(column: str, n: int) -> str:
    """The array of a run's last n bars' values, oldest first; bars without a date come first and are no run's."""
    return f"slice({column}, seq - least(seq - undated, {n}, keep) + 1, least(seq - undated, {n}, keep))"


def _median(x: str, n: int) -> tuple[str, str]:
    return f"sort_array(array_compact({_last(f'bars.{x}', n)}))", "CASE WHEN size({0}) % 2 = 1 THEN {0}[size({0}) div 2] WHEN size({0}) > 0 THEN 0.5 * {0}[size({0}) div 2 - 1] + 0.5 * {0}[size({0}) div 2] END"


#: Features that need a run's bars in order: an array and what is made of it ({0}).
SLICED: dict[str, tuple[str, str]] = {}
for _n in (20, 60):
    SLICED[f"median_tv_{_n}d"] = _median("tv", _n)
    SLICED[f"median_range_pct_{_n}d"] = _median("range_pct", _n)
for _n in (120, 252):
    _peak = "greatest(s[0], x)"  # s: the peak so far and the worst fall from one; an array, as a struct costs a fold more
    SLICED[f"max_drawdown_{_n}d"] = (_last("bars.adjusted_close", _n), f"least(0.0, aggregate({{0}}, array(CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)), (s, x) -> array({_peak}, least(s[1], {div('x', _peak)} - 1.0)), s -> s[1]))")
for _n, (_name, _) in FOLLOWED.items():
    SLICED[_name] = (f"reverse({_last('bars.adjusted_close', _n)})", "CAST(array_position({0}, array_max({0})) - 1 AS DOUBLE)")
#: What looks back from a bar: the column, and how many bars before it.
MOVED = {"pdate": ("bar_date", 1), "pac": ("adjusted_close", 1), "pc": ("close", 1), "ac21": ("adjusted_close", 21)}
#: What a bar tells by itself is found before bars are collected, once whatever the number of runs.
_OWN = ("tv", "range_pct", "fine", "fine_cav", "ordered")
_BAR = ("bar_date", "low", "close", "adjusted_close", "volume", *_OWN)


def _needed(wanted: list[str]) -> set[str]:
    """Names that features use, down to the columns of collected bars."""
    texts = {**FIRST, **{k: x for k, x in SECOND.items() if k not in _OWN}, **{k: c for k, (c, _) in MOVED.items()}}
    todo = {w for n in wanted for w in re.findall(r"[a-z]\w*", " ".join(SLICED.get(n) or [FEATURES[n]]))}
    seen: set[str] = set()
    while todo:
        seen |= todo
        todo = {w for n in todo if n in texts for w in re.findall(r"[a-z]\w*", texts[n])} - seen
    return seen | {"bar_date"}


def _moved(column: str, k: int) -> str:
    return f"slice(concat(array_repeat(CAST(0 AS DOUBLE), {k}), {column}), 1, size({column}))"


def _with_ma60(series: DataFrame) -> DataFrame:
    """series with the array of ma60_now: sums of 60 are put together from sums of 2, 4, 8, 16 and 32, each of two moved halves; a window would add up 60 values a bar."""
    series = series.withColumn("sum1", F.expr("transform(bars.adjusted_close, x -> coalesce(x, CAST(0 AS DOUBLE)))"))
    for k in (1, 2, 4, 8, 16):
        series = series.withColumn(f"sum{2 * k}", F.expr(f"zip_with(sum{k}, {_moved(f'sum{k}', k)}, (a, b) -> a + b)"))
    total = "sum32"
    for column, k in (("sum16", 32), ("sum8", 48), ("sum4", 56)):
        total = f"zip_with({total}, {_moved(column, k)}, (a, b) -> a + b)"
    held = "size(array_compact(slice(bars.adjusted_close, greatest(i - 58, 1), least(i + 1, 60))))"
    n = f"CASE WHEN any_null THEN {held} ELSE least(i + 1, 60) END"
    series = series.withColumn("sum60", F.expr(total)).withColumn("any_null", F.expr("exists(bars.adjusted_close, x -> x IS NULL)"))
    return series.withColumn("ma60", F.expr(f"transform(sum60, (s, i) -> s / nullif({n}, 0))"))


def aggregate(bars: DataFrame, rule: str, keep: int, wanted: list[str], runs: DataFrame | None = None) -> DataFrame:
    """One row for each ticker (and run, if runs are given) that has bars by the as-of date: the wanted features, as_of and run_date.

    keep: how many of a ticker's last bars features look at; only the number of all bars and of repeated dates reach farther back.
    """
    dated = calendar(bars, rule, runs)
    if runs is None or runs.count() <= SENT_RUNS:
        dated = F.broadcast(dated)  # a row a market, or so many as counted
    keys, used = keys_of(dated), _needed(wanted)
    columns = [c for c in _BAR if c in used]
    own = bars.withColumn("ac", F.col("adjusted_close")).select("market", "ticker", *[F.expr(doubles(SECOND[c])).alias(c) if c in _OWN else F.col(c) for c in columns])
    # structs are made before the aggregate, which has no generated code
    series = own.select("market", "ticker", F.struct(*columns).alias("bar")).groupBy("market", "ticker").agg(F.sort_array(F.collect_list("bar")).alias("bars"))
    series = series.select("*", F.expr("CASE WHEN bars[0].bar_date IS NOT NULL THEN 0 ELSE size(filter(bars.bar_date, d -> d IS NULL)) END").alias("undated"), F.expr("size(bars) - size(array_distinct(bars.bar_date))").alias("again"))
    if averaged := "ma60_now" in used:
        series = _with_ma60(series)
    held = ["bars", *(["ma60"] if averaged else [])]
    each = series.select("market", "ticker", *held, "undated", "again").join(dated, "market")
    each = each.withColumn("seq", F.expr("CASE WHEN bars[size(bars) - 1].bar_date <= as_of THEN size(bars) ELSE size(filter(bars.bar_date, d -> d IS NULL OR d <= as_of)) END")).filter("seq > undated").withColumn("keep", F.lit(keep))
    sliced = [n for n in wanted if n in SLICED]
    dates = "filter(slice(bars.bar_date, 1, seq), d -> d IS NOT NULL)"
    repeats = [F.expr(f"CASE WHEN again = 0 THEN 0 ELSE size({dates}) - size(array_distinct({dates})) END").alias("repeats")] if "repeats" in used else []
    run = [*keys, "run_date", "as_of", "seq", *held]
    each = each.select(*run, *repeats, F.expr("least(seq - undated, keep)").alias("last"), *[F.expr(doubles(SLICED[n][0])).alias(f"a_{n}") for n in sliced])
    each = each.select(*run, *[c for c in ("repeats",) if repeats], "last", *[F.expr(doubles(SLICED[n][1].format(f"a_{n}"))).alias(f"s_{n}") for n in sliced])
    # bars are looked up by their numbers, so what looks back is no array of its own; not explode: numbers are never empty, and Spark would ask for that by making them twice
    rows = each.select(*each.columns, F.explode_outer(F.expr("sequence(1, last)")).alias("rn"))
    moved = {k: m for k, m in MOVED.items() if k in used and m[0] in columns}
    looked = [F.expr(f"get(bars, seq - rn).{c}").alias(c) for c in columns] + [F.expr(f"get(bars, seq - rn - {n}).{c}").alias(k) for k, (c, n) in moved.items()] + ([F.expr("get(ma60, seq - rn)").alias("ma60_now")] if averaged else [])
    rows = rows.select(*[c for c in rows.columns if c not in held], *looked)
    if "ac" in used:
        rows = rows.withColumn("ac", F.col("adjusted_close"))
    rows = rows.select("*", *[F.expr(doubles(x)).alias(n) for n, x in SECOND.items() if n in used and n not in ("repeats", *_OWN)])
    feature = lambda n: f"max(s_{n})" if n in SLICED else doubles(FEATURES[n])
    return rows.groupBy(*keys).agg(*[F.expr(feature(n)).alias(f"f_{n}") for n in wanted], F.max("as_of").alias("as_of"), F.max("run_date").alias("run_date"))


def aggregate_sql(bars: str, rule: str, keep: int, wanted: list[str], runs: str | None = None) -> str:
    """The same in SQL. runs: a query's text with run_id, market, run_date."""
    own = "run_id, " if runs else ""
    calendar = runs or f"SELECT market, max(bar_date) AS run_date FROM ({bars}) GROUP BY market"
    if rule == "A":
        dated = f"SELECT *, run_date AS as_of FROM ({calendar})"
    else:
        dated = f"SELECT {own}r.market, run_date, max(bar_date) AS as_of FROM ({calendar}) r JOIN ({bars}) d ON d.market = r.market WHERE bar_date {'<' if rule == 'B' else '<='} run_date GROUP BY {own}r.market, run_date"
    q = f"({bars})"
    for step in (FIRST, SECOND):
        q = f"(SELECT *, {', '.join(f'{doubles(x.replace("{keep}", str(keep)))} AS {n}' for n, x in step.items())} FROM {q})"
    q = f"(SELECT w.*, {own}run_date, as_of FROM {q} w JOIN ({dated}) c ON c.market = w.market WHERE {IN_RUN})"
    keys = f"{own}market, ticker"
    for step in (THIRD, FOURTH):
        q = f"(SELECT *, {', '.join(f'{doubles(x.replace("{keys}", keys))} AS {n}' for n, x in step.items())} FROM {q})"
    columns = ", ".join(f"{doubles(FEATURES[n])} AS f_{n}" for n in wanted)
    return f"SELECT {keys}, {columns}, max(as_of) AS as_of, max(run_date) AS run_date FROM {q} GROUP BY {keys}"
