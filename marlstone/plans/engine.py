"""Runs a profile: features, gates, snapshot, score layers, one ranked list per market and horizon; and writes it as SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.sqlexpr import Percentile, doubles
from marlstone.operators import features, ranks
from marlstone.operators.tables import written

from .profiles import Profile

#: Places to which metrics and scores are rounded in results; of traded values, which are large, fewer.
PLACES, VALUE_PLACES, SNAPSHOT_PLACES = 8, 2, 6


def wanted(p: Profile) -> list[str]:
    used = set(re.findall(r"\bf_(\w+)", " ".join([*p.gates, *p.snapshot.values()]))) | {"close", "adjusted_close"}
    return [n for n in features.FEATURES if n in used]


def run_keys(df: DataFrame) -> list[str]:
    """The columns that tell a run: its id, if there are several, and its market."""
    return [*(["run_id"] if "run_id" in df.columns else []), "market"]


def snapshot(p: Profile, bars: DataFrame, listings: DataFrame | None = None, runs: DataFrame | None = None, dated: bool = False) -> DataFrame:
    """One row per ticker that passes the gates: market, ticker, close, adjusted_close, metrics.

    runs (run_id, market, run_date) asks for each run by itself, with its run_id before the market; without it, each market is
    taken on the last date of its bars. dated adds as_of.
    """
    if listings is not None:
        bars = bars.join(listings.select("market", "ticker").distinct(), ["market", "ticker"], "left_semi")
    rows = features.aggregate(bars, p.rule, p.keep, wanted(p), runs)
    passed = rows.filter(" AND ".join(f"({doubles(g)})" for g in p.gates))
    out = passed.select(*run_keys(rows), "ticker", *(["as_of"] if dated else []), F.col("f_close").alias("close"), F.col("f_adjusted_close").alias("adjusted_close"), *[F.expr(f"CAST({doubles(x)} AS DOUBLE)").alias(n) for n, x in p.snapshot.items()])
    return out.filter(finite(p))


def finite(p: Profile) -> str:
    """No metric is null, infinite or not a number."""
    return " AND ".join(doubles(f"coalesce(abs({n}) < 1e300, false)") for n in p.snapshot)


def of_run(x: str, several: bool) -> str:
    """A score's SQL, in which places are taken among the tickers of a market: with several runs, among those of the run."""
    return x.replace("PARTITION BY market", "PARTITION BY run_id, market") if several else x


def scored(p: Profile, snap: DataFrame) -> DataFrame:
    """snap with all score layers. A layer's percentiles are found together, from a written table as they read it several times."""
    for layer in p.layers:
        asked = {n: x for n, x in layer.items() if isinstance(x, Percentile)}
        plain = [F.expr(f"CAST({doubles(x)} AS DOUBLE)").alias(n) for n, x in layer.items() if n not in asked]
        if asked:
            snap = ranks.percentiles(written(snap, "snapshot"), run_keys(snap), "ticker", asked)
        snap = snap.select("*", *plain)
    return snap


def rankings(p: Profile, snap: DataFrame) -> DataFrame:
    """market, horizon, ticker, ranking metrics, score, rank: a row for each ticker and horizon."""
    each = F.array(*[F.struct(F.lit(h).alias("horizon"), F.expr(doubles(cut(f"CAST({x} AS DOUBLE)", PLACES))).alias("score")) for h, x in p.horizons.items()]).alias("h")
    run = run_keys(snap)
    rows = scored(p, snap).select(*run, "ticker", *[F.expr(doubles(cut(k, PLACES))).alias(k) for k in p.ranking_keys], each)
    # written, as a partitioning by ranges looks at its rows twice
    rows = written(rows, "scored").withColumn("h", F.explode("h")).select(*run, "h.horizon", "ticker", *p.ranking_keys, "h.score")
    return ranks.ranked(rows, [*run, "horizon"], [F.desc("score"), F.asc("ticker")])


def places(name: str) -> int:
    if "amihud" in name:
        return 14
    return VALUE_PLACES if "_traded_value_" in name and not name.endswith(("_score", "_cv_60d", "_concentration_60d")) else SNAPSHOT_PLACES


def cut(x: str, n: int) -> str:
    """x to n places, by the same arithmetic in every engine (their own round() may treat halves of binary fractions differently)."""
    return f"(floor(({x}) * {10.0**n:.1f} + 0.5) / {10.0**n:.1f})"


def rounded(snap: DataFrame) -> DataFrame:
    return snap.select(*[F.expr(doubles(cut(c, places(c)))).alias(c) if t == "double" else F.col(c) for c, t in snap.dtypes])


def snapshot_sql(p: Profile, bars: str, runs: str | None = None) -> str:
    own = "run_id, " if runs else ""
    metrics = ", ".join(f"{doubles(cut(f'CAST({x} AS DOUBLE)', places(n)))} AS {n}" for n, x in p.snapshot.items())
    gates = " AND ".join(f"({doubles(g)})" for g in p.gates)
    heads = ", ".join(f"{doubles(cut(f'f_{c}', SNAPSHOT_PLACES))} AS {c}" for c in ("close", "adjusted_close"))
    return f"WITH f AS ({features.aggregate_sql(bars, p.rule, p.keep, wanted(p), runs)}), s AS (SELECT {own}market, ticker, {heads}, {metrics} FROM f WHERE {gates}) SELECT * FROM s WHERE {finite(p)}"


def rankings_sql(p: Profile, bars: str, runs: str | None = None) -> str:
    own, layers, last = "run_id, " if runs else "", [], "s"
    for i, layer in enumerate(p.layers):
        layers.append(f"l{i} AS (SELECT *, {', '.join(f'CAST({of_run(doubles(x), bool(runs))} AS DOUBLE) AS {n}' for n, x in layer.items())} FROM {last})")
        last = f"l{i}"
    keys = ", ".join(f"{doubles(cut(k, PLACES))} AS {k}" for k in p.ranking_keys)
    parts = " UNION ALL ".join(f"SELECT {own}market, '{h}' AS horizon, ticker, {keys}, {doubles(cut(f"CAST({x} AS DOUBLE)", PLACES))} AS score FROM {last}" for h, x in p.horizons.items())
    gates = " AND ".join(f"({doubles(g)})" for g in p.gates)
    metrics = ", ".join(f"CAST({doubles(x)} AS DOUBLE) AS {n}" for n, x in p.snapshot.items())
    return (
        f"WITH f AS ({features.aggregate_sql(bars, p.rule, p.keep, wanted(p), runs)}), s0 AS (SELECT {own}market, ticker, f_close AS close, f_adjusted_close AS adjusted_close, {metrics} FROM f WHERE {gates}), s AS (SELECT * FROM s0 WHERE {finite(p)}), "
        + ", ".join(layers)
        + f", r AS ({parts}) SELECT *, row_number() OVER (PARTITION BY {own}market, horizon ORDER BY score DESC, ticker) AS rank FROM r"
    )
