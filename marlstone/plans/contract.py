"""What a profile asks of the rows that it ranks: some drop what they can't use, others refuse the whole snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.errors import DataError

from marlstone.operators import checks

from . import engine
from .profiles import Profile

# Profiles that leave out rows with unusable metrics without a word; the others refuse them.
LENIENT = ("sample_price_trend_v1", "momentum_v1", "momentum_quality_v1")
#: Profiles that refuse a snapshot of several as-of dates.
ONE_DATE = ("trend_quality_v1", "trend_pullback_quality_v1", "base_breakout_quality_v1", "relative_strength_leader_v1", "mean_reversion_quality_v1", "defensive_compounder_quality_v1")
#: Those that look at close and adjusted_close too.
WITH_CLOSES = ("trend_pullback_quality_v1", "base_breakout_quality_v1", "relative_strength_leader_v1", "mean_reversion_quality_v1", "defensive_compounder_quality_v1")


_fine = checks.finite


def keys_of(profile_id: str, p: Profile) -> list[str]:
    """The numbers of a snapshot that a profile's ranking looks at."""
    return [*p.snapshot, *(("close", "adjusted_close") if profile_id in WITH_CLOSES else ())]


def watched(profile_id: str, p: Profile, snapshot: DataFrame) -> tuple[DataFrame, dict]:
    """A snapshot of one run, and the metrics by which settle() tells whether it keeps the contract once it is written; lenient profiles' unusable rows are left out."""
    keys = keys_of(profile_id, p)
    if missing := [k for k in keys if k not in snapshot.columns]:
        if profile_id in LENIENT:
            return snapshot.limit(0).select("*", *[F.lit(None).cast("double").alias(k) for k in missing]), {}
        raise DataError(f"{profile_id}: a snapshot needs numbers in {', '.join(missing)}")
    if profile_id in LENIENT:
        for k in keys:
            snapshot = snapshot.filter(_fine(k))
        return snapshot, {}
    metrics = {f"bad_{k}": checks.how_many(~_fine(k)) for k in keys}
    if profile_id in ONE_DATE and "as_of" in snapshot.columns:
        metrics |= {"first_as_of": F.min("as_of"), "last_as_of": F.max("as_of")}
    return snapshot, metrics


def settle(profile_id: str, market: str, seen: dict) -> None:
    """Refuse a snapshot by the metrics of watched()."""
    bad = [k.removeprefix("bad_") for k, v in seen.items() if k.startswith("bad_") and v]
    if bad:
        raise DataError(f"{profile_id}: {market} has values that are no numbers in {', '.join(bad)}")
    if seen.get("first_as_of") != seen.get("last_as_of"):
        raise DataError(f"{profile_id}: {market} has several as-of dates")


def ranked(profile_id: str, p: Profile, snapshot: DataFrame) -> DataFrame:
    """engine.rankings of a snapshot that keeps the contract; the lenient profiles rank what is left of it."""
    keys = keys_of(profile_id, p)
    missing = [k for k in keys if k not in snapshot.columns]
    wrong = [k for k, t in snapshot.dtypes if k in keys and t not in ("double", "float", "int", "bigint")]
    if profile_id in LENIENT:
        rows = snapshot.limit(0).select("*", *[F.lit(None).cast("double").alias(k) for k in missing]) if missing else snapshot
        for k in keys:
            rows = rows.filter(_fine(k))
        return engine.rankings(p, rows)
    if missing or wrong:
        raise DataError(f"{profile_id}: a snapshot needs numbers in {', '.join(missing + wrong)}")
    checks = [F.sum((~_fine(k)).cast("int")).alias(k) for k in keys]
    if "as_of" in snapshot.columns:
        checks.append(F.count_distinct("as_of").alias("as_of"))
    for r in snapshot.groupBy("market").agg(*checks).collect():  # a row a market
        bad = [k for k in keys if r[k]]
        if bad:
            raise DataError(f"{profile_id}: {r['market']} has values that are no numbers in {', '.join(bad)}")
        if "as_of" in snapshot.columns and r["as_of"] > 1:
            raise DataError(f"{profile_id}: {r['market']} has several as-of dates")
    out = engine.rankings(p, snapshot)
    if out.filter(~_fine("score")).limit(1).count():
        raise DataError(f"{profile_id}: a score is no number")
    return out
