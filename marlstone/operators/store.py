"""The run store: Parquet tables partitioned by run, and a manifest for each run, whose last write makes the run visible.

A run's data are written first; only when they hold together is its manifest put in place (manifest.py). Readers look at runs that have one and at the
files it names, so a run that broke off is never seen, whatever it has left behind. upgrade() brings a store of an older version to this one in steps.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.config import DATA_MODES, digest, market_of
from marlstone.errors import IntegrityError, Invalid, NotFound, SchemaMismatch

from . import checks, manifest

#: The store's version; a store that was made by another one is refused until upgrade() has been over it.
VERSION = 3
LOG = "run_id string, market string, profile_id string, status string, created_at timestamp, detail string"
ARTIFACTS = "run_id string, format string, content string"
FORMATS = ("markdown", "json")
TABLES = {
    "snapshot": "market string, ticker string, close double, adjusted_close double, metrics_json string, run_id string",
    "rankings": "market string, horizon string, ticker string, score double, rank long, metrics_json string, run_id string",
}
CORE = {"run_id", "market", "ticker", "horizon", "close", "adjusted_close", "score", "rank"}
#: The digest of the tables' columns in each version that upgrade() knows.
LAYOUTS = {2: digest([LOG, sorted(CORE), ARTIFACTS]), 3: digest([LOG, sorted(CORE), ARTIFACTS, manifest.SCHEMA])}
STORED = {name: dict(c.strip().split(" ") for c in ddl.split(",") if "run_id" not in c) for name, ddl in TABLES.items()}


def _ticker():
    return F.xxhash64("ticker").cast("decimal(38,0)")


def _of_horizon(name: str) -> dict:
    """Metrics of one horizon's rankings."""
    here = F.col("horizon").eqNullSafe(F.lit(name))
    whole = F.col("rank").cast("decimal(38,0)")
    total = lambda c: F.coalesce(F.sum(F.when(here, c)), F.lit(0))
    return {
        "n": checks.how_many(here), "low": F.coalesce(F.min(F.when(here, F.col("rank"))), F.lit(0)).cast("long"), "high": F.coalesce(F.max(F.when(here, F.col("rank"))), F.lit(0)).cast("long"),
        "sum": total(whole), "squares": total(whole * whole), "tickers": total(_ticker()),
    }


class RunStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._agree()

    def _agree(self) -> None:
        """A new store gets the version and the digest of its tables' columns; an old one must have the same."""
        held = versions(self.spark, self.path)
        if held is None:
            _to_version(self.spark, self.path, VERSION, "ignore")
        elif held != (VERSION, LAYOUTS[VERSION]):
            raise SchemaMismatch(f"{self.path} is of version {held[0]}, not {VERSION}" + ("; upgrade it first" if held[0] in STEPS else ""))

    def _append(self, run_id: str, market: str, profile_id: str, status: str, detail: str = "") -> None:
        row = [(run_id, market, profile_id, status, datetime.now(timezone.utc).replace(tzinfo=None), detail)]
        self.spark.createDataFrame(row, LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/run_log")

    def log(self) -> DataFrame:
        """The latest status of each run, and when it began."""
        log = _latest(self.spark, self.path)
        done = manifest.published(self.spark, self.path).select("run_id", F.lit("successful").alias("done"))
        return log.join(done, "run_id", "left").select("run_id", "market", "profile_id", F.coalesce("done", "status").alias("status"), "detail", "created_at")

    def begin(self, market: str, profile_id: str) -> str:
        run_id = f"{market_of(market).lower()}-{uuid.uuid4()}"
        self._append(run_id, market, profile_id, "running")
        return run_id

    def fail(self, run_id: str, market: str, profile_id: str, detail: str) -> None:
        """Mark a run as failed, if it is still running: a run that ended keeps its status."""
        if self.status(run_id) == "running":
            self._append(run_id, market, profile_id, "failed", detail)

    def status(self, run_id: str) -> str:
        found = self.log().filter(F.col("run_id") == run_id).limit(1).collect()
        if not found:
            raise NotFound(f"no run {run_id}")
        return found[0]["status"]

    def commit(
        self, run_id: str, market: str, profile_id: str, snapshot: DataFrame, rankings: DataFrame | Callable[[DataFrame], DataFrame], horizons: list[str],
        artifacts: Callable[[DataFrame, DataFrame], dict[str, str]] | None = None, watch: dict | None = None, settle: Callable[[dict], None] | None = None,
        metadata: dict[str, str] | None = None,
    ) -> None:
        """Write both tables of a run and make it visible; on any error it is marked as failed.

        Each table is computed once, in the job that writes it, and that job's metrics tell whether the table holds together. rankings may be a
        function of the written snapshot. watch: more metrics of the snapshot, which settle() judges with the count of rows. metadata: where the run's
        data came from, kept in its manifest.
        """
        if not run_id.startswith(f"{market.lower()}-"):
            raise IntegrityError(f"run {run_id} isn't one of {market}")
        if (mode := (metadata or {}).get("data_mode")) and mode not in DATA_MODES:
            raise Invalid(f"data_mode is one of {', '.join(DATA_MODES)}, not {mode!r}")
        begun = self.log().filter(F.col("run_id") == run_id).select("market", "profile_id", "status", F.unix_micros("created_at").alias("at")).first()
        if begun is None or begun["status"] != "running":
            raise IntegrityError(f"run {run_id} isn't running")
        if (begun["market"], begun["profile_id"]) != (market, profile_id):
            raise IntegrityError(f"run {run_id} was begun for {begun['market']} and {begun['profile_id']}")
        try:
            with checks.translated():
                held = self._write("snapshot", run_id, snapshot, market, {"tickers": F.coalesce(F.sum(_ticker()), F.lit(0))} | (watch or {}))
                if settle:
                    settle(held)
                ranked = rankings(self.metrics("snapshot", run_id, snapshot)) if callable(rankings) else rankings
                per = {f"{m}_{i}": c for i, h in enumerate(horizons) for m, c in _of_horizon(h).items()}
                listed = self._write("rankings", run_id, ranked, market, per | {"elsewhere": checks.how_many(~F.coalesce(F.col("horizon").isin(horizons), F.lit(False)))})
            self._agreed(held, listed, horizons)
            tables = self._written("snapshot", run_id), self._written("rankings", run_id)
            texts = [(run_id, k, v) for k, v in (artifacts(*tables) if artifacts else {}).items()]
            if other := sorted({k for _, k, _ in texts} - set(FORMATS)):
                raise Invalid(f"reports are {', '.join(FORMATS)}, not {', '.join(other)}")
            if texts:
                self.spark.createDataFrame(texts, ARTIFACTS).coalesce(1).write.mode("append").parquet(f"{self.path}/artifacts")
            named = {n: {"rows": s["rows"], "checksum": s["checksum"], "files": manifest.files(self.spark, self.path, n, run_id)} for n, s in (("snapshot", held), ("rankings", listed))}
            reports = {k: hashlib.sha256(text.encode()).hexdigest() for _, k, text in texts}
            about = {"run_id": run_id, "market": market, "profile_id": profile_id, "created_us": begun["at"], "metadata": metadata or {}}
            manifest.publish(self.spark, self.path, about | {"reports": reports, "tables": named})
        except Exception as e:
            self.fail(run_id, market, profile_id, str(e)[:500])
            raise

    def _write(self, name: str, run_id: str, df: DataFrame, market: str, watch: dict) -> dict:
        """Write a table of a run, with numbers beside the core columns as JSON; refuse it by the metrics of its rows."""
        metrics, doubles = [c for c in sorted(df.columns) if c not in CORE and c != "as_of"], [c for c, t in df.dtypes if t == "double"]
        fine = functools.reduce(lambda a, b: a & b, [checks.finite(c) for c in doubles], F.lit(True))
        own = {"rows": F.count(F.lit(1)), "not_finite": checks.how_many(~fine), "other_market": checks.how_many(~F.col("market").eqNullSafe(F.lit(market)))}
        if name == "snapshot":  # one row a ticker; a snapshot is grouped by market and ticker already, so this moves nothing
            df = df.withColumn("ticker_rows", F.count("*").over(Window.partitionBy("market", "ticker")))
            own["repeated"] = checks.how_many(F.col("ticker_rows") > 1)
        df = df.withColumn("metrics_json", F.to_json(F.struct(*metrics)) if metrics else F.lit("{}"))
        watched = checks.Watch(df, own | watch | {"checksum": manifest.checksum(STORED[name], df.columns)})
        packed = watched.rows.select(*[c for c in df.columns if c in CORE], "metrics_json")
        # by ticker within a file, with a bloom filter of tickers for each row group: a lookup reads the groups that may hold one
        by_ticker = packed.withColumn("run_id", F.lit(run_id)).sortWithinPartitions("run_id", "ticker")
        by_ticker.write.mode("append").partitionBy("run_id").option("parquet.bloom.filter.enabled#ticker", "true").parquet(f"{self.path}/{name}")
        seen = watched.seen()
        if seen["other_market"]:
            raise IntegrityError(f"{name}: rows of another market")
        if seen.get("repeated"):
            raise IntegrityError(f"{name}: repeated tickers")
        if seen["not_finite"] and not any(v for k, v in seen.items() if k.startswith("bad_")):
            raise IntegrityError(f"{name}: a number is missing or not finite")
        return seen

    def metrics(self, name: str, run_id: str, like: DataFrame) -> DataFrame:
        """A written table with its metrics as columns again, as in the table `like` that was written."""
        kinds = {c: t for c, t in like.dtypes if c not in CORE and c != "as_of"}
        m = F.from_json("metrics_json", ", ".join(f"`{c}` {t}" for c, t in kinds.items()) or "none double")
        rows = self._written(name, run_id).withColumn("m", m)
        return rows.select(*[c for c in like.columns if c in CORE and c != "run_id"], *[F.col(f"m.`{c}`") for c in like.columns if c in kinds])

    @staticmethod
    def _agreed(snapshot: dict, rankings: dict, horizons: list[str]) -> None:
        """Each horizon ranks the snapshot's tickers, from 1 on without a gap.

        By sums: as many rows, ranks between 1 and that number with the sum of 1 to n and of their squares, and the same sum of the tickers' hashes.
        check() looks at every row, for tables that come from elsewhere.
        """
        n = snapshot["rows"]
        if rankings["elsewhere"]:
            raise IntegrityError("rankings hold other horizons")
        for i, h in enumerate(horizons):
            got = tuple(rankings[f"{m}_{i}"] for m in ("n", "low", "high", "sum", "squares", "tickers"))
            if got != (n, 1 if n else 0, n, n * (n + 1) // 2, n * (n + 1) * (2 * n + 1) // 6, snapshot["tickers"]):
                raise IntegrityError(f"rankings of {h} are incomplete")

    @staticmethod
    def check(snapshot: DataFrame, rankings: DataFrame, market: str, horizons: list[str]) -> None:
        """One market; unique tickers; the same tickers in each horizon; ranks 1 to n without gaps; finite scores."""
        one = snapshot.agg(F.count("*").alias("n"), F.count_distinct("ticker").alias("t"), F.sum(F.when(F.col("market") == market, 0).otherwise(1)).alias("other")).first()
        if one["n"] != one["t"] or one["other"]:
            raise IntegrityError("snapshot: repeated tickers or another market")
        per = {r["horizon"]: r for r in rankings.groupBy("horizon").agg(F.count("*").alias("n"), F.count_distinct("rank").alias("ranks"), F.count_distinct("ticker").alias("t"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.sum(F.when((F.col("market") == market) & F.expr("abs(score) < double('Infinity')"), 0).otherwise(1)).alias("bad")).collect()}
        if one["n"] == 0 and not per:
            return
        if set(per) != set(horizons):
            raise IntegrityError(f"horizons are {sorted(per)}")
        for h, r in per.items():
            if not (r["n"] == r["ranks"] == r["t"] == r["high"] == one["n"] and r["low"] == 1) or r["bad"]:
                raise IntegrityError(f"rankings of {h} are incomplete")
        if rankings.join(snapshot, "ticker", "left_anti").limit(1).count():
            raise IntegrityError("rankings hold tickers that the snapshot lacks")

    def _written(self, name: str, run_id: str) -> DataFrame:
        """What a run that isn't visible yet has written."""
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}").filter(F.col("run_id") == run_id)

    def table(self, name: str, run_id: str) -> DataFrame:
        """A visible run's table: the files that its manifest names and no others."""
        return self._named(name, self.resolve(run_id))

    def _named(self, name: str, run: dict) -> DataFrame:
        paths = [f"{self.path}/{f['path']}" for f in run["tables"][name]["files"]]
        if not paths:
            return self.spark.createDataFrame([], TABLES[name])
        try:
            return self.spark.read.schema(TABLES[name]).option("basePath", f"{self.path}/{name}").parquet(*paths)
        except AnalysisException as e:
            raise IntegrityError(f"files of the {name} of run {run['run_id']} are missing") from e

    def verify(self, run_id: str) -> None:
        """Hold a run's files against its manifest: their lengths, and the number of rows and the checksum of each table, by one aggregation."""
        run = self.resolve(run_id)
        for name, held in run["tables"].items():
            now = manifest.lengths(self.spark, self.path, [f["path"] for f in held["files"]])
            if wrong := [f["path"] for f in held["files"] if now[f["path"]] != f["bytes"]]:
                raise IntegrityError(f"{', '.join(wrong)}: not there, or of another length than when run {run_id} ended")
            df = self._named(name, run)
            got = df.agg(F.count("*").alias("rows"), manifest.checksum(STORED[name], df.columns).alias("checksum")).first()
            if (got["rows"], got["checksum"]) != (held["rows"], held["checksum"]):
                raise IntegrityError(f"{name} of run {run_id}: other rows than when it ended")

    def artifact(self, run_id: str, form: str) -> str:
        """A successful run's report as it was when the run ended."""
        run = self.resolve(run_id)
        if form not in run["reports"]:
            raise IntegrityError(f"run {run_id} has no report in {form}")
        found = self.spark.read.schema(ARTIFACTS).parquet(f"{self.path}/artifacts").filter((F.col("run_id") == run_id) & (F.col("format") == form)).limit(2).collect()
        if len(found) != 1 or hashlib.sha256(found[0]["content"].encode()).hexdigest() != run["reports"][form]:
            raise IntegrityError(f"run {run_id}: its report in {form} is missing, repeated or changed")
        return found[0]["content"]

    def latest(self, market: str, profile_id: str | None = None) -> str:
        runs = manifest.published(self.spark, self.path).filter(F.col("market") == market)
        if profile_id:
            runs = runs.filter(F.col("profile_id") == profile_id)
        found = runs.orderBy(F.desc("created_us"), F.desc("run_id")).limit(1).collect()
        if not found:
            raise NotFound(f"no successful run of {market}")
        return found[0]["run_id"]

    def resolve(self, run_id: str) -> dict:
        """A visible run's manifest."""
        found = manifest.published(self.spark, self.path, run_id).limit(1).collect()
        if not found:
            raise NotFound(f"no successful run {run_id}")
        return found[0].asDict(True) | {"status": "successful"}

    def report(self, run_id: str, top_n: int = 100) -> DataFrame:
        """The best of each horizon with their closes: ranks are stored, so nothing is sorted over."""
        run = self.resolve(run_id)
        best = self._named("rankings", run).filter(F.col("rank") <= top_n)
        return best.join(self._named("snapshot", run).select("ticker", "close", "adjusted_close"), "ticker", "left").select("horizon", "rank", "ticker", "score", "close", "adjusted_close").orderBy("horizon", "rank")

    def inspect(self, run_id: str, ticker: str, snapshot_keys: list[str] | None = None, ranking_keys: list[str] | None = None, horizons: list[str] | None = None) -> dict:
        """A ticker's snapshot and rankings in one run, metrics as numbers. With the profile's keys and horizons, a lack of any is an error."""
        run, numbers = self.resolve(run_id), F.from_json("metrics_json", "map<string, double>")
        snap = self._named("snapshot", run).filter(F.col("ticker") == ticker).withColumn("metrics", numbers).limit(2).collect()
        if not snap:
            raise NotFound(f"{ticker} is not in run {run_id}")
        if len(snap) > 1:
            raise IntegrityError(f"{ticker} stands twice in run {run_id}")
        ranks = self._named("rankings", run).filter(F.col("ticker") == ticker).withColumn("metrics", numbers).orderBy("horizon").collect()
        held = [r["horizon"] for r in ranks]
        if horizons is not None and sorted(held) != sorted(horizons):
            raise IntegrityError(f"{ticker} is ranked in {', '.join(held) or 'no horizon'} of run {run_id}, not in {', '.join(horizons)}")
        for what, keys, rows in (("snapshot", snapshot_keys, snap), ("rankings", ranking_keys, ranks)):
            if keys is not None and (lacking := sorted({k for r in rows for k in keys if (r["metrics"] or {}).get(k) is None})):
                raise IntegrityError(f"{what} of {ticker} in run {run_id} lack {', '.join(lacking)}")
        return {"ticker": ticker, "close": snap[0]["close"], "adjusted_close": snap[0]["adjusted_close"], "metrics": snap[0]["metrics"], "rankings": [{"horizon": r["horizon"], "rank": r["rank"], "score": r["score"], "metrics": r["metrics"]} for r in ranks]}


def _latest(spark: SparkSession, path: str) -> DataFrame:
    """The latest row of each run in run_log, with the time of its first."""
    try:
        log = spark.read.schema(LOG).parquet(f"{path}/run_log")
    except AnalysisException:  # no run yet
        log = spark.createDataFrame([], LOG)
    return log.groupBy("run_id").agg(F.max_by(F.struct("market", "profile_id", "status", "detail"), "created_at").alias("s"), F.min("created_at").alias("created_at")).select("run_id", "s.*", "created_at")


def versions(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """A store's version and the digest of its tables: the highest that was written; None where there is no store."""
    try:
        held = spark.read.parquet(f"{path}/version").orderBy(F.desc("version")).select("version", "tables").first()
    except AnalysisException:  # nothing there yet
        return None
    return tuple(held) if held else None


def _to_version(spark: SparkSession, path: str, version: int, mode: str) -> None:
    spark.createDataFrame([(version, LAYOUTS[version])], "version int, tables string").coalesce(1).write.mode(mode).parquet(f"{path}/version")


def _manifests(spark: SparkSession, path: str) -> None:
    """Version 2 to 3: a manifest for each run whose status row made it visible. Tables are read once for all runs; runs come to the driver one by one."""
    runs = _latest(spark, path).filter("status = 'successful'").withColumn("at", F.unix_micros("created_at"))
    for name, ddl in TABLES.items():
        try:
            rows = spark.read.schema(ddl).parquet(f"{path}/{name}")
        except AnalysisException:  # no run wrote any row
            rows = spark.createDataFrame([], ddl)
        sums = rows.groupBy("run_id").agg(F.count("*").alias("rows"), manifest.checksum(STORED[name], rows.columns).alias("checksum"))
        runs = runs.join(sums.select("run_id", F.struct("rows", "checksum").alias(name)), "run_id", "left")
    try:
        texts = spark.read.schema(ARTIFACTS).parquet(f"{path}/artifacts")
    except AnalysisException:
        texts = spark.createDataFrame([], ARTIFACTS)
    reports = texts.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("format", F.sha2("content", 256)))).alias("reports"))  # two a run
    done = manifest.published(spark, path).select("run_id")  # by an upgrade that broke off
    for r in runs.join(reports, "run_id", "left").join(done, "run_id", "left_anti").toLocalIterator():
        tables = {n: {"rows": r[n]["rows"] if r[n] else 0, "checksum": r[n]["checksum"] if r[n] else "0", "files": manifest.files(spark, path, n, r["run_id"])} for n in TABLES}
        about = {k: r[k] for k in ("run_id", "market", "profile_id")} | {"created_us": r["at"], "metadata": {}, "reports": r["reports"] or {}}
        manifest.publish(spark, path, about | {"tables": tables})


#: What leads from a version to the next one.
STEPS = {2: _manifests}


def upgrade(spark: SparkSession, path: str) -> list[int]:
    """Bring a store to this version; the versions that it went through. A step ends with its version's row, so one that broke off is taken again."""
    path, through = path.rstrip("/"), []
    held = versions(spark, path)
    if held is None:
        raise NotFound(f"there is no store in {path}")
    while held[0] != VERSION:
        if held[0] not in STEPS or held[1] != LAYOUTS[held[0]]:
            raise SchemaMismatch(f"nothing leads from version {held[0]} of {path} to version {VERSION}")
        STEPS[held[0]](spark, path)
        _to_version(spark, path, held[0] + 1, "append")
        held = (held[0] + 1, LAYOUTS[held[0] + 1])
        through.append(held[0])
    return through


def markdown(report: DataFrame, title: str) -> str:
    """A report as text; its rows are bounded by top_n and the horizons."""
    out, last = [f"# {title}"], None
    for r in report.collect():
        if r["horizon"] != last:
            last = r["horizon"]
            out += ["", f"## {last}", "", "| rank | ticker | score | close |", "|---|---|---|---|"]
        out.append(f"| {r['rank']} | {r['ticker']} | {r['score']:.4f} | {'' if r['close'] is None else r['close']} |")
    return "\n".join(out if last else [*out, "", "No candidates."]) + "\n"
