"""Command line: batch, report, inspect, verify, value, upgrade. `python -m marlstone.cli --config FILE COMMAND ...`; the exit code tells the kind of error."""

from __future__ import annotations

import argparse
import importlib
import sys
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as configuration
from . import output
from .errors import Invalid, MarlstoneError, NotFound
from .locking import writer
from .operators import checks
from .operators.store import RunStore, markdown, upgrade
from .plans import assumptions, contract, documents, engine, fundamentals, solvers, valuation
from .plans.catalog import PROFILES
from .sources import live
from .sources.bundle import Bundle


def session() -> SparkSession:
    return SparkSession.builder.appName("marlstone").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _known(profile_id: str) -> None:
    if profile_id not in PROFILES and profile_id != fundamentals.PROFILE_ID:
        raise Invalid(f"there is no profile {profile_id}")


def run(spark: SparkSession, cfg: configuration.Config, market: str, profile_id: str) -> str:
    """One profile's run over one market, as of the run's date: snapshot, rankings and reports, visible only when all of it is written.

    The panel is computed once, by the job that writes the snapshot and carries its checks; rankings are made from what was written.
    """
    _known(profile_id)
    store, by_facts = RunStore(spark, cfg["duckdb_path"]), profile_id == fundamentals.PROFILE_ID
    data = live.load(live.REGISTRY, cfg, market, datetime.now(timezone.utc), by_facts) if cfg["data_mode"] == "live" else Bundle(spark, cfg["fixture_dir"]).load(market, by_facts)
    run_id = store.begin(market, profile_id)
    about = {"run_id": run_id, "market": market, "profile_id": profile_id, "as_of": data.run_latest_bar_date, "provider_hash": configuration.digest(cfg.provider_payload(by_facts)), "ranking_hash": configuration.digest({"profile": profile_id})}
    summary = output.provider_summary(data.metadata, profile_id, about["ranking_hash"])
    horizons = list(fundamentals.HORIZONS if by_facts else PROFILES[profile_id].horizons)

    def artifacts(snapshot: DataFrame, rankings: DataFrame) -> dict[str, str]:
        best = rankings.filter(F.col("rank") <= cfg["report.top_n"]).join(snapshot.select("ticker", "close"), "ticker", "left").orderBy("horizon", "rank")
        held = output.report(about, snapshot, rankings, horizons, cfg["report.top_n"]) | {"provider_summary": summary}
        return {"markdown": markdown(best, f"{market} {profile_id} {run_id}") + output.context(about, summary, len(held["snapshots"])), "json": output.as_json(held)}

    try:
        if by_facts:
            snap, watch = fundamentals.snapshot(data.fundamentals, data.bars, data.listings, data.run_latest_bar_date), {}
            rank, settle = fundamentals.rankings, lambda seen: fundamentals.settle(market, seen)
        else:
            p = PROFILES[profile_id]
            dates = spark.createDataFrame([(market, data.run_latest_bar_date)], "market string, run_date date")
            snap, watch = contract.watched(profile_id, p, engine.snapshot(p, data.bars, data.listings, dates, dated=True))
            rank, settle = lambda written: engine.rankings(p, written), lambda seen: contract.settle(profile_id, market, seen)
        store.commit(run_id, market, profile_id, snap, rank, horizons, artifacts, watch, settle, summary | {"data_mode": cfg["data_mode"]})
    except Exception as e:
        store.fail(run_id, market, profile_id, str(e)[:500])
        raise
    return run_id


def batch(spark: SparkSession, cfg: configuration.Config, market: str, profiles: list[str]) -> list[str]:
    market, ids = configuration.market_of(market), profiles or [cfg["ranking.profile"]]
    for i in ids:
        _known(i)
    done: list[str] = []
    with writer(cfg["lock_path"]):
        for i in ids:
            try:
                done.append(f"{i}: {run(spark, cfg, market, i)}")
            except MarlstoneError as e:
                if len(ids) > 1:
                    print("\n".join([*(f"completed {d}" for d in done), f"failed {i}: {e}"]), file=sys.stderr)
                raise
    return done


def chosen(store: RunStore, market: str | None, run_id: str | None, profile: str | None) -> str:
    """The run that is meant: a market's latest (of a profile) or the one of an id, never both."""
    if bool(market) == bool(run_id):
        raise Invalid("give either MARKET or --run-id")
    if run_id and profile:
        raise Invalid("--ranking-profile doesn't go with --run-id")
    return store.resolve(run_id)["run_id"] if run_id else store.latest(configuration.market_of(market), profile)


def value(spark: SparkSession, cfg: configuration.Config, market: str, ticker: str, model: str | None, path: str | None) -> dict:
    market, ticker = configuration.market_of(market), ticker.strip().upper()
    if "." in ticker and market == "TW":
        raise Invalid("give the ticker without its exchange's suffix")
    document, hashed = assumptions.load(path or f"valuation_assumptions/{market.lower()}/{ticker}.yaml", market, ticker)
    model_id = model or document["default_model"]
    if model_id not in document["models"]:
        raise Invalid(f"the document has no model {model_id}")
    data = live.load(live.REGISTRY, cfg, market, datetime.now(timezone.utc), True) if cfg["data_mode"] == "live" else Bundle(spark, cfg["fixture_dir"]).load(market, fundamentals=True)
    checks.only(data.listings.filter((F.col("market") == market) & (F.upper("ticker") == ticker)), f"listing of {market} {ticker}")
    price = data.bars.filter(F.col("ticker") == ticker).agg(F.max_by("close", "bar_date").alias("price"), F.max("bar_date").alias("as_of"))
    facts = data.fundamentals.filter(F.col("ticker") == ticker).crossJoin(F.broadcast(price)).select("ticker", "currency", F.col("free_cash_flow_ttm").alias("free_cash_flow"), F.expr("total_debt - cash_and_cash_equivalents").alias("net_debt"), F.lit(None).cast("double").alias("shares"), "price")  # one row
    if not facts.limit(1).count():
        raise NotFound(f"there are no facts of {market} {ticker}")
    inputs = assumptions.usable(assumptions.resolved(facts, document, model_id), document, model_id)
    rows = documents.explained(inputs, document, model_id).collect()  # three scenarios
    if bad := [r for r in rows if r["status"] != solvers.SOLVED]:
        raise Invalid("; ".join(documents.refusal(r, document, model_id) for r in sorted(bad, key=lambda r: valuation.SCENARIOS.index(r["scenario"]))))
    order = {s: i for i, s in enumerate(valuation.SCENARIOS)}
    return {"market": market, "ticker": ticker, "model": model_id, "assumptions": hashed, "inputs": inputs.first().asDict(), "scenarios": [r.asDict(True) for r in sorted(rows, key=lambda r: order[r["scenario"]])]}


def as_text(found: dict) -> str:
    """A valuation for readers."""
    code, lines = found["inputs"]["currency"], [f"# {found['market']} {found['ticker']}: {output.plain(found['model'])}", ""]
    lines += [f"- {n}: {output.number(found['inputs'][n])} ({found['inputs'][n + '_source']})" for n in ("starting_fcf", "net_debt", "shares", "price")]
    lines += ["", "| scenario | enterprise value | equity | per share | against price | solved |", "|---|---|---|---|---|---|"]
    for s in found["scenarios"]:
        lines.append(f"| {s['scenario']} | {output.money(s['enterprise_value'], code)} | {output.money(s['equity_value'], code)} | {output.money(s['value_per_share'], code, 4)} | {output.percent(s['spread'])} | {'' if s['solved'] is None else output.percent(s['solved'])} |")
    shown = {"residual": lambda x: f"{x:.6g}", "terminal_share": output.percent}
    names = documents.model(found["model"])
    if names:
        lines += ["", "| scenario | " + " | ".join(n.replace("_", " ") for n in names) + " |", "|---|" + "---|" * len(names)]
        lines += [f"| {s['scenario']} | " + " | ".join(shown.get(n, lambda x: output.money(x, code))(s[n]) for n in names) + " |" for s in found["scenarios"]]
    for s in found["scenarios"]:
        if s["projection"]:
            lines += ["", f"## {s['scenario']}, by year", "", "| year | flow | discount factor | present value |", "|---|---|---|---|"]
            lines += [f"| {y['year']} | {output.money(y['flow'], code)} | {y['factor']:.6f} | {output.money(y['present_value'], code)} |" for y in s["projection"]]
            lines += [f"| after | {output.money(s['terminal_value'], code)} | {s['projection'][-1]['factor']:.6f} | {output.money(s['present_value_terminal_value'], code)} |"]
    return "\n".join(lines) + "\n"


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    top = argparse.ArgumentParser(prog="marlstone")
    top.add_argument("--config", default="config.yaml")
    top.add_argument("--providers", help="a module whose register(registry) adds the providers of live runs")
    commands = top.add_subparsers(dest="command", required=True)
    b = commands.add_parser("batch")
    b.add_argument("market")
    b.add_argument("--ranking-profile", action="append", default=[])
    commands.add_parser("upgrade", help="bring the run store to this version")
    for name in ("report", "inspect", "verify"):
        c = commands.add_parser(name)
        c.add_argument("market", nargs="?")
        c.add_argument("--run-id")
        c.add_argument("--ranking-profile")
        if name != "verify":
            c.add_argument("--json", action="store_true")
        if name == "inspect":
            c.add_argument("--ticker", required=True)
    v = commands.add_parser("value")
    v.add_argument("market")
    v.add_argument("--ticker", required=True)
    v.add_argument("--model")
    v.add_argument("--assumptions")
    v.add_argument("--json", action="store_true")
    args = top.parse_args(argv)
    try:
        cfg = configuration.load(args.config)
        if args.providers:
            try:
                module = importlib.import_module(args.providers)
            except ModuleNotFoundError as e:
                raise Invalid(f"there is no module {e.name}") from e
            module.register(live.REGISTRY)
        spark = spark or session()
        if args.command == "batch":
            print("\n".join(batch(spark, cfg, args.market, args.ranking_profile)))
        elif args.command == "value":
            with checks.translated():
                found = value(spark, cfg, args.market, args.ticker, args.model, args.assumptions)
            print(output.as_json(found) if args.json else as_text(found))
        elif args.command == "upgrade":
            with writer(cfg["lock_path"]):
                print("\n".join(f"version {v}" for v in upgrade(spark, cfg["duckdb_path"])))
        else:
            store = RunStore(spark, cfg["duckdb_path"])
            run_id = chosen(store, args.market, args.run_id, args.ranking_profile)
            if args.command == "verify":
                store.verify(run_id)
                print(run_id)
            elif args.command == "report":
                print(store.artifact(run_id, "json" if args.json else "markdown"))
            else:
                profile_id = store.resolve(run_id)["profile_id"]
                if profile_id == fundamentals.PROFILE_ID:
                    keys = (fundamentals.SNAPSHOT, fundamentals.KEYS, list(fundamentals.HORIZONS))
                else:
                    p = PROFILES[profile_id]
                    keys = (list(p.snapshot), p.ranking_keys, list(p.horizons))
                found = store.inspect(run_id, args.ticker.strip().upper(), *keys)
                print(output.as_json(found) if args.json else output.inspected(found))
        return 0
    except MarlstoneError as e:
        print(f"error: {output.plain(e)}", file=sys.stderr)
        return e.exit_code


if __name__ == "__main__":
    sys.exit(main())
