"""Listings and the run store."""

import json
import os
import shutil
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from marlstone.errors import Invalid, SchemaMismatch
from marlstone.operators import manifest
from marlstone.operators import store as stores
from marlstone.operators.store import IntegrityError, NotFound, RunStore, markdown
from marlstone.plans import catalog, engine
from marlstone.sources import listings, panel

SF = "/root/testdata/sf0.001"
NASDAQ = """Symbol|Security Name|Market Category|Test Issue|Financial Status|Round Lot Size|ETF|NextShares
GOOD|Good Inc. Common Stock|Q|N|N|100|N|N
GOOD|Good Inc. Common Stock|Q|N|N|100|N|N
W|Single Letter Common Stock|Q|N||100|N|N
FUND|Some Fund ETF Common Stock|Q|N|N|100|Y|N
TEST|Test Common Stock|Q|Y|N|100|N|N
LATE|Late Inc. Common Stock|Q|N|D|100|N|N
WARR|Thing Warrants Common Stock|Q|N|N|100|N|N
ADRX|Foreign Co. American Depositary Shares|Q|N|N|100|N|N
NOTE|Some Notes due 2030|Q|N|N|100|N|N
File Creation Time: 0101202500:00|||||||
"""
OTHER = """ACT Symbol|Security Name|Exchange|CQS Symbol|ETF|Round Lot Size|Test Issue|NASDAQ Symbol
BRK.B|Holding Class B Common Stock|N|BRK.B|N|100|N|BRK.B
X-P|Preferred Stock Series A|N|X-P|N|100|N|X-P
ORD|Sea Ordinary Shares||ORD|N|100|N|
"""


def written(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_us_listings(spark, tmp_path):
    got = listings.us_listings(spark, written(tmp_path, "a.txt", NASDAQ), written(tmp_path, "b.txt", OTHER))
    rows = {r["ticker"]: (r["exchange_segment"], r["instrument_type"]) for r in got.collect()}
    assert rows == {"GOOD": ("NASDAQ", "common_stock"), "W": ("NASDAQ", "common_stock"), "ADRX": ("NASDAQ", "depositary_receipt"), "BRK.B": ("N", "common_stock"), "ORD": ("OTHER", "common_stock")}
    assert {r["ticker"]: r["request_symbol"] for r in listings.request_symbols(got).collect()}["BRK.B"] == "BRK-B"
    with pytest.raises(listings.DataError):
        listings.us_listings(spark, written(tmp_path, "a.txt", NASDAQ), written(tmp_path, "c.txt", OTHER + "GOOD|Other Good Common Stock|N|GOOD|N|100|N|GOOD\n"))


def test_tw_listings(spark, tmp_path):
    row = "<tr><td>{}</td><td>TW0001</td><td>2000/01/01</td><td>{}</td></tr>"
    page = "<table>" + row.format("9999　早", "上市") + "<tr><td> 股票 </td></tr>" + row.format("有價證券代號及名稱", "市場別") + row.format("2330　台積電", "上市") + row.format("1101　台泥", "上市") + row.format("6543　普通", "上櫃") + "<tr><td>上市認購(售)權證</td></tr>" + row.format("0300　權證", "上市") + "</table>"
    other = "<table><tr><td>股票</td></tr>" + row.format("1234　黑松", "上櫃") + "</table>"
    (tmp_path / "two.html").write_bytes(page.encode("cp950"))
    (tmp_path / "four.html").write_bytes(other.encode("cp950"))
    got = listings.tw_listings(spark, {"twse_isin_str_mode_2": str(tmp_path / "two.html"), "twse_isin_str_mode_4": str(tmp_path / "four.html")})
    assert [(r["ticker"], r["exchange_segment"]) for r in got.orderBy("ticker").collect()] == [("1101", "TWSE"), ("1234", "TPEX"), ("2330", "TWSE")]
    assert {r["request_symbol"] for r in listings.request_symbols(got).collect()} == {"1101.TW", "1234.TWO", "2330.TW"}


def test_store(spark, tmp_path):
    store, p = RunStore(spark, str(tmp_path / "store")), catalog.PROFILES["sample_price_trend_v1"]
    snap = engine.snapshot(p, panel.bars(spark, SF)).filter("market = 'US'").cache()
    ranks = engine.rankings(p, snap).cache()
    run = store.begin("US", p.profile_id)
    with pytest.raises(NotFound):
        store.latest("US")
    store.commit(run, "US", p.profile_id, snap, ranks, list(p.horizons))
    assert store.latest("US") == store.latest("US", p.profile_id) == run and store.resolve(run)["status"] == "successful"
    assert run.startswith("us-")
    report = store.report(run, 3)
    assert [r["rank"] for r in report.collect()] == [1, 2, 3, 1, 2, 3] and "| 1 |" in markdown(report, "US")
    best = report.first()["ticker"]
    seen = store.inspect(run, best)
    assert [x["horizon"] for x in seen["rankings"]] == sorted(p.horizons) and set(seen["metrics"]) == set(p.snapshot)
    assert store.inspect(run, best, list(p.snapshot), p.ranking_keys, list(p.horizons)) == seen
    for keys in ((["more"], None, None), (None, ["score_more"], None), (None, None, ["midterm"])):
        with pytest.raises(IntegrityError):
            store.inspect(run, best, *keys)
    lookup = store.table("snapshot", run).filter(F.col("ticker") == best)
    assert f"EqualTo(ticker,{best})" in lookup._jdf.queryExecution().executedPlan().toString()
    for f in lookup.inputFiles():
        groups = pq.ParquetFile(f.removeprefix("file://")).metadata
        columns = [groups.row_group(0).column(i) for i in range(groups.num_columns)]
        ticker = next(c for c in columns if c.path_in_schema == "ticker")
        assert [c.path_in_schema for c in columns if c.has_bloom_filter] == ["ticker"] if hasattr(ticker, "has_bloom_filter") else ticker.is_stats_set
        tickers = pq.read_table(f.removeprefix("file://"), columns=["ticker"])["ticker"].to_pylist()
        assert tickers == sorted(tickers)
    broken = store.begin("US", p.profile_id)
    with pytest.raises(IntegrityError):
        store.commit(broken, "US", p.profile_id, snap, ranks.filter("rank > 1"), list(p.horizons))
    assert store.latest("US") == run
    with pytest.raises(NotFound):
        store.resolve(broken)
    with pytest.raises(NotFound):
        store.inspect(run, "NONE")


SNAP = "market string, ticker string, close double, adjusted_close double, quality double"
ROWS = [("US", f"T{i}", 10.0 + i, 10.0, i / 4) for i in range(6)]


def ranked(snap):
    return snap.select("market", F.lit("short").alias("horizon"), "ticker", F.col("quality").alias("score"), F.expr("cast(substr(ticker, 2) as long) + 1").alias("rank"), F.col("quality").alias("score_quality"))


def commit(store, rows=ROWS, **more):
    run = store.begin("US", "p")
    store.commit(run, "US", "p", store.spark.createDataFrame(rows, SNAP), ranked, ["short"], lambda s, r: {"json": "{}", "markdown": "# é"}, **more)
    return run


def test_manifest_names_all_of_a_run(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "store"))
    run = commit(store, metadata={"data_mode": "live", "ohlcv_provider_id": "feed"})
    held = json.loads((tmp_path / "store" / "manifests" / f"{run}.json").read_text())
    assert held["metadata"] == store.resolve(run)["metadata"] == {"data_mode": "live", "ohlcv_provider_id": "feed"}
    assert held["tables"]["snapshot"]["rows"] == held["tables"]["rankings"]["rows"] == 6
    for t in held["tables"].values():
        assert sum(f["bytes"] for f in t["files"]) == sum(os.path.getsize(tmp_path / "store" / f["path"]) for f in t["files"]) > 0
    store.verify(run)
    assert store.artifact(run, "markdown") == "# é" and [r["status"] for r in store.log().collect()] == ["successful"]
    with pytest.raises(FileExistsError):
        manifest.publish(spark, store.path, held)
    empty = commit(store, [])
    store.verify(empty)
    assert store.table("snapshot", empty).count() == 0 and store.latest("US") == empty


def test_manifest_left_over_and_changed_files(spark, tmp_path):
    """Files that no manifest names aren't read; files that were changed, cut or taken away are found."""
    store = RunStore(spark, str(tmp_path / "store"))
    run = commit(store)
    named = tmp_path / "store" / store.resolve(run)["tables"]["snapshot"]["files"][0]["path"]
    shutil.copy(named, named.parent / "part-of-another-attempt.parquet")
    assert store.table("snapshot", run).count() == 6
    store.verify(run)
    was = named.read_bytes()
    rows = pq.ParquetFile(named).read()
    other = rows.set_column(rows.schema.get_field_index("close"), "close", pa.array([x + 1 for x in rows["close"].to_pylist()], pa.float64()))
    pq.write_table(other, named)
    (named.parent / f".{named.name}.crc").unlink()
    with pytest.raises(IntegrityError, match="another length"):
        store.verify(run)
    held = store.resolve(run)
    held["tables"]["snapshot"]["files"] = [f | ({"bytes": named.stat().st_size} if f["path"].endswith(named.name) else {}) for f in held["tables"]["snapshot"]["files"]]
    (tmp_path / "store" / "manifests" / f"{run}.json").write_text(json.dumps(held))
    (tmp_path / "store" / "manifests" / f".{run}.json.crc").unlink(missing_ok=True)
    with pytest.raises(IntegrityError, match="other rows"):
        store.verify(run)
    named.unlink()
    with pytest.raises(IntegrityError):
        store.verify(run)
    with pytest.raises(IntegrityError, match="missing"):
        store.inspect(run, "T1")
    named.write_bytes(was)


def test_a_run_that_breaks_off_is_never_seen(spark, tmp_path, monkeypatch):
    """Between any two writes: after the snapshot, after the rankings, after the reports, and before the manifest has its name."""
    store = RunStore(spark, str(tmp_path / "store"))

    class Gone(BaseException):
        """The driver is gone: nothing that handles errors runs any more."""

    def gone(*_, **__):
        raise Gone

    for where in (("RunStore", "metrics"), ("RunStore", "_agreed"), ("manifest", "files"), ("manifest", "publish")):
        with monkeypatch.context() as m, pytest.raises(Gone):
            m.setattr(getattr(stores, where[0]), where[1], gone)
            commit(store)
        with pytest.raises(NotFound):
            store.latest("US")
    aside = tmp_path / "store" / "manifests"
    aside.mkdir(exist_ok=True)
    (aside / "_us-1.json").write_text('{"run_id": "us-1", "market": "US"')
    assert {r["status"] for r in store.log().collect()} == {"running"}
    run = commit(store)
    assert store.latest("US") == run and store.table("snapshot", run).count() == 6


def test_what_a_run_may_not_be(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "store"))
    snap = spark.createDataFrame(ROWS, SNAP)
    with pytest.raises(Invalid):
        store.begin("JP", "p")
    run = store.begin("US", "p")
    for market, profile, kind in (("TW", "p", IntegrityError), ("US", "q", IntegrityError)):
        with pytest.raises(kind):
            store.commit(run, market, profile, snap, ranked, ["short"])
    with pytest.raises(Invalid, match="data_mode"):
        store.commit(run, "US", "p", snap, ranked, ["short"], metadata={"data_mode": "guess"})
    with pytest.raises(Invalid, match="html"):
        store.commit(run, "US", "p", snap, ranked, ["short"], lambda s, r: {"html": ""})
    assert store.status(run) == "failed"


def test_upgrade(spark, tmp_path):
    """A store of version 2: a status row made a run visible, and its reports stood in a table."""
    path = str(tmp_path / "store")
    at = datetime(2025, 1, 2, 3, 4, 5)
    for name, ddl, rows in (
        ("run_log", stores.LOG, [("us-a", "US", "p", "running", at, ""), ("us-a", "US", "p", "successful", at + timedelta(seconds=9), ""), ("us-b", "US", "p", "running", at + timedelta(1), ""), ("us-c", "US", "q", "running", at, ""), ("us-c", "US", "q", "successful", at + timedelta(1), "")]),
        ("artifacts", stores.ARTIFACTS, [("us-a", "json", "{}"), ("us-a", "markdown", "# a")]),
    ):
        spark.createDataFrame(rows, ddl).write.parquet(f"{path}/{name}")
    for name, rows in (
        ("snapshot", [("US", "T1", 1.0, 1.0, '{"x":1.5}', "us-a"), ("US", "T2", 2.0, None, '{"x":2.5}', "us-a"), ("US", "T1", 3.0, 3.0, "{}", "us-b")]),
        ("rankings", [("US", "short", "T1", 0.5, 1, "{}", "us-a"), ("US", "short", "T2", 0.25, 2, "{}", "us-a")]),
    ):
        spark.createDataFrame(rows, stores.TABLES[name]).write.partitionBy("run_id").parquet(f"{path}/{name}")
    spark.createDataFrame([(2, stores.LAYOUTS[2])], "version int, tables string").write.parquet(f"{path}/version")
    with pytest.raises(SchemaMismatch, match="upgrade it first"):
        RunStore(spark, path)
    assert stores.upgrade(spark, path) == [3] and stores.upgrade(spark, path) == []
    store = RunStore(spark, path)
    assert store.latest("US", "p") == "us-a" and store.latest("US", "q") == store.latest("US")  # us-b never ended
    with pytest.raises(NotFound):
        store.resolve("us-b")
    for run in ("us-a", "us-c"):
        store.verify(run)
    assert store.inspect("us-a", "T2")["metrics"] == {"x": 2.5} and store.artifact("us-a", "markdown") == "# a" and store.table("snapshot", "us-c").count() == 0
    assert {r["run_id"]: r["status"] for r in store.log().collect()} == {"us-a": "successful", "us-b": "running", "us-c": "successful"}
    # an upgrade that broke off after its first manifest, before its version's row
    shutil.rmtree(f"{path}/version")
    os.unlink(f"{path}/manifests/us-c.json")
    spark.createDataFrame([(2, stores.LAYOUTS[2])], "version int, tables string").write.parquet(f"{path}/version")
    assert stores.upgrade(spark, path) == [3]
    RunStore(spark, path).verify("us-c")
    spark.createDataFrame([(1, "other")], "version int, tables string").write.mode("overwrite").parquet(f"{path}/version")
    with pytest.raises(SchemaMismatch, match="nothing leads"):
        stores.upgrade(spark, path)
    with pytest.raises(NotFound):
        stores.upgrade(spark, str(tmp_path / "none"))
