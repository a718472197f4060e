"""What makes a run visible: a manifest, one JSON file a run, that names all that belongs to it.

It is written under a name that readers pass over and then renamed, so a run is there with everything or not at all. It has the run's metadata and, for
each table, its data files with their lengths, the number of rows and a checksum that doesn't depend on their order; for each report, its SHA-256. Files
that an attempt which broke off has left in a run's folder are named by no manifest and never read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import located

FILE = "struct<path string, bytes long>"
SCHEMA = f"""run_id string, market string, profile_id string, created_us long, metadata map<string, string>, reports map<string, string>,
  tables map<string, struct<rows long, checksum string, files array<{FILE}>>>"""


def checksum(columns: dict[str, str], held: list[str]) -> Column:
    """An aggregate over a table's rows: the sum of their hashes. columns: names and types as stored; one that isn't held counts as null."""
    return F.coalesce(F.sum(F.xxhash64(*[F.col(c).cast(t) for c, t in columns.items() if c in held]).cast("decimal(38,0)")), F.lit(0)).cast("string")


def files(spark: SparkSession, root: str, name: str, run_id: str) -> list[dict]:
    """The data files in a run's folder of a table, by their paths below root; an empty table has no folder."""
    folder = f"{name}/run_id={run_id}"
    at, system = located(spark, f"{root}/{folder}")
    if not system.exists(at):
        return []
    found = [(s.getPath().getName(), s.getLen()) for s in system.listStatus(at)]
    return [{"path": f"{folder}/{n}", "bytes": b} for n, b in sorted(found) if not n.startswith(("_", "."))]


def lengths(spark: SparkSession, root: str, paths: list[str]) -> dict[str, int | None]:
    """How long files are now; None where one is missing."""
    out: dict[str, int | None] = {}
    for p in paths:
        at, system = located(spark, f"{root}/{p}")
        out[p] = system.getFileStatus(at).getLen() if system.exists(at) else None
    return out


def publish(spark: SparkSession, root: str, held: dict) -> None:
    """Make a run visible. A run that is visible already keeps its manifest."""
    at, system = located(spark, f"{root}/manifests/{held['run_id']}.json")
    if system.exists(at):
        raise FileExistsError(at.toString())
    aside, _ = located(spark, f"{root}/manifests/_{held['run_id']}.json")
    out = system.create(aside, True)
    out.write(json.dumps(held, sort_keys=True, ensure_ascii=False).encode())
    out.close()
    if not system.rename(aside, at):
        raise OSError(f"{at.toString()} can't be written")


def published(spark: SparkSession, root: str, run_id: str | None = None) -> DataFrame:
    """The manifests of a store, or the one of a run; no rows where there is none."""
    path = f"{root}/manifests" + (f"/{run_id}.json" if run_id else "")
    at, system = located(spark, path)
    return spark.read.schema(SCHEMA).json(path) if system.exists(at) else spark.createDataFrame([], SCHEMA)
