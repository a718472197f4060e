"""Bundles, configuration, the ranking contract, assumption documents and the command line."""

import copy
import json
import math
from datetime import date, datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest
import yaml

from marlstone import cli, config, errors, locking, output
from marlstone.operators import checks, store
from marlstone.plans import assumptions, catalog, contract, documents, engine, fundamentals, solvers, valuation
from marlstone.sources import bundle, live

DAYS = 280
LAST = date(2025, 1, 1) + timedelta(DAYS - 1)
CONFIG = {
    "data_mode": "fixture", "duckdb_path": "", "lock_path": "", "fixture_dir": "",
    "live": {"listing_provider": {"US": "a", "TW": "b"}, "ohlcv_provider": "c", "fundamentals_provider": "d", "ticker_limit": None, "yfinance": {"batch_size": 5}},
    "ranking": {"profile": "sample_price_trend_v1"}, "report": {"top_n": 3},
}


def close(k, i):
    """A staircase of our own: a rise of a few cents a day, with a step of a seventh that comes and goes."""
    return round(31 + 2 * k + 0.03 * i * (k + 2) + 0.8 * ((i * (k + 3)) % 7) / 7, 4)


def scenarios(**rates):
    return {s: {**{k: v[i] for k, v in rates.items()}, "note": "n"} for i, s in enumerate(("conservative", "base", "upside"))}


START = {"method": "provider_ttm_fcf"}
DOCUMENT = {
    "schema_version": 1, "market": "US", "ticker": "T0", "default_model": "fcf_dcf_v1", "purpose": "p", "as_of": "2025-01-01", "currency": "USD", "amount_unit": "u", "share_basis": "s", "valuation_basis_note": "v",
    "facts_overrides": {"shares_outstanding": 100, "net_debt": None, "reference_price": None}, "facts_override_notes": {"shares_outstanding": "n", "net_debt": None, "reference_price": None},
    "assumption_source": "a", "prepared_by": "b", "source_note": "c",
    "models": {
        "fcf_dcf_v1": {"forecast_years": 3, "terminal_method": "perpetual_growth", "starting_fcf": START, "scenarios": scenarios(growth_rate=(0.01, 0.02, 0.03), discount_rate=(0.1, 0.09, 0.08), terminal_growth_rate=(0.01, 0.02, 0.02))},
        "reverse_dcf_v1": {"forecast_years": 3, "terminal_method": "perpetual_growth", "starting_fcf": START, "solver_abs_tolerance": 1e-6, "solver_max_iterations": 200, "scenarios": scenarios(discount_rate=(0.1, 0.09, 0.08), terminal_growth_rate=(0.01, 0.02, 0.02), implied_growth_lower_bound=(-0.9, -0.9, -0.9), implied_growth_upper_bound=(1.0, 1.0, 1.0))},
        "implied_discount_rate_v1": {"forecast_years": 3, "terminal_method": "perpetual_growth", "starting_fcf": START, "solver_abs_tolerance": 1e-9, "solver_max_iterations": 200, "scenarios": scenarios(growth_rate=(0.01, 0.02, 0.03), terminal_growth_rate=(0.01, 0.02, 0.02), implied_discount_rate_lower_bound=(0.06, 0.06, 0.06), implied_discount_rate_upper_bound=(0.5, 0.5, 0.5))},
    },
}


@pytest.fixture(scope="module")
def place(tmp_path_factory):
    root = tmp_path_factory.mktemp("bundle")
    data = root / "data"
    data.mkdir()
    (data / "metadata.json").write_text(json.dumps({k: "x" for k in bundle.METADATA} | {"run_latest_bar_date": str(LAST)}))
    tickers = [f"t{k}" for k in range(4)]
    (data / "listings.csv").write_text("source_id,market,ticker,listing_symbol,exchange_segment,listing_status,instrument_type\n" + "".join(f"s,US,{t},{t},NASDAQ,active,common_stock\n" for t in tickers) + "s,TW,9,9,TWSE,active,common_stock\n")
    rows = ["market,ticker,bar_date,open,high,low,close,adjusted_close,volume,more"]
    for k, t in enumerate([*tickers, "unlisted"]):
        for i in range(DAYS):
            c = close(k, i)
            rows.append(f"US,{t.upper()},{date(2025, 1, 1) + timedelta(i)},{c},{c * 1.006:.4f},{c * 0.995:.4f},{c},{c},{1700000 + 900 * i},1")
    (data / "ohlcv.csv").write_text("\n".join(rows) + "\n")
    names = [x.split()[0] for x in bundle.FUNDAMENTALS.split(", ")]
    fact = dict.fromkeys(names, "1") | {"market": "US", "ticker": "T0", "currency": "USD", "fiscal_period_end": "2025-06-30", "balance_sheet_as_of": "2025-07-31", "fiscal_period_type": "ttm", "free_cash_flow_ttm": "300", "total_debt": "50", "cash_and_cash_equivalents": "20"}
    (data / "fundamentals.csv").write_text(",".join(names) + "\n" + ",".join(fact[n] for n in names) + "\n")
    held = CONFIG | {"duckdb_path": str(root / "store"), "lock_path": str(root / "lock"), "fixture_dir": str(data)}
    (root / "config.yaml").write_text(yaml.safe_dump(held))
    (root / "T0.yaml").write_text(yaml.safe_dump(DOCUMENT))
    return root


def test_command_line(spark, place, capsys):
    go = lambda *a: cli.main(["--config", str(place / "config.yaml"), *a], spark)
    assert go("report", "US") == 2
    assert go("batch", "us", "--ranking-profile", "sample_price_trend_v1", "--ranking-profile", "momentum_v1") == 0
    done = capsys.readouterr().out.strip().splitlines()
    assert [x.split(":")[0] for x in done] == ["sample_price_trend_v1", "momentum_v1"]
    assert go("report", "US", "--ranking-profile", "momentum_v1", "--json") == 0
    held = json.loads(capsys.readouterr().out)
    assert set(held["top_horizons"]) == set(catalog.PROFILES["momentum_v1"].horizons) and len(held["snapshots"]) == 4
    assert all([r["rank"] for r in rows_of] == [r["ranking"]["rank"] for r in held["top_horizons"][h]] for h in held["top_horizons"] for rows_of in [[r for r in held["rankings"] if r["horizon"] == h][:3]])
    assert go("report", "US", "--ranking-profile", "momentum_v1") == 0 and "| rank |" in capsys.readouterr().out
    assert go("inspect", "US", "--ticker", "t1", "--json") == 0 and json.loads(capsys.readouterr().out)["ticker"] == "T1"
    assert go("verify", "US") == 0 and go("verify", "--run-id", "us-none") == 2 and go("upgrade") == 0 and capsys.readouterr().out.startswith("us-")
    assert go("inspect", "US", "--ticker", "none") == 2 and go("report") == 1 and go("report", "US", "--run-id", "x") == 1
    assert go("batch", "mars") == 1 and go("batch", "US", "--ranking-profile", "nothing") == 1
    assert go("batch", "US", "--ranking-profile", fundamentals.PROFILE_ID) == 0 and go("report", "US", "--ranking-profile", fundamentals.PROFILE_ID, "--json") == 0
    held = json.loads(capsys.readouterr().out.split("\n", 1)[1])
    assert [s["ticker"] for s in held["snapshots"]] == ["T0"] and set(held["snapshots"][0]["metrics"]) == set(fundamentals.SNAPSHOT)
    assert held["rankings"][0]["score"] == 100.0 and held["provider_summary"]["fundamentals_requested_count"] == "4" and held["provider_summary"]["ohlcv_provider_id"] == "x"
    assert go("batch", "TW", "--ranking-profile", fundamentals.PROFILE_ID) == 6 and "no eligible fundamentals of TW" in capsys.readouterr().err
    assert go("report", "US", "--ranking-profile", fundamentals.PROFILE_ID) == 0
    told = capsys.readouterr().out
    assert "- candidates: 1" in told and "- ohlcv_provider_id: x" in told
    with locking.writer(str(place / "lock")):
        assert go("batch", "US") == 4


def test_value(spark, place, capsys):
    go = lambda *a: cli.main(["--config", str(place / "config.yaml"), "value", "US", "--ticker", "T0", "--assumptions", str(place / "T0.yaml"), *a], spark)
    assert go("--json") == 0
    got = json.loads(capsys.readouterr().out)
    price = close(0, DAYS - 1)
    for s, g, r, tg in zip(got["scenarios"], (0.01, 0.02, 0.03), (0.1, 0.09, 0.08), (0.01, 0.02, 0.02)):
        flows = [300 * (1 + g) ** t for t in (1, 2, 3)]
        ev = sum(f / (1 + r) ** t for t, f in enumerate(flows, 1)) + flows[-1] * (1 + tg) / (r - tg) / (1 + r) ** 3
        assert s["enterprise_value"] == pytest.approx(ev, abs=1e-2) and s["spread"] == pytest.approx((ev - 30) / 100 / price - 1, abs=1e-5)
    assert got["inputs"]["shares_source"] == "assumption_override" and got["inputs"]["net_debt_source"] == "provider"
    for model in ("reverse_dcf_v1", "implied_discount_rate_v1"):
        assert go("--model", model, "--json") == 0
        for s in json.loads(capsys.readouterr().out)["scenarios"]:
            assert s["value_per_share"] == pytest.approx(price, abs=1e-5)
    assert go() == 0
    told = capsys.readouterr().out
    assert "per share" in told and "## base, by year" in told and told.count("| after |") == 3 and "terminal share" in told
    assert go("--model", "multiple_valuation_v1") == 1


def test_assumptions_are_checked():
    assert assumptions.checked(DOCUMENT, "US", "t0")
    for path, bad in [("schema_version", 2), ("currency", "usd"), ("market", "TW"), ("default_model", "x"), ("models.fcf_dcf_v1.forecast_years", 11), ("models.fcf_dcf_v1.scenarios.base.discount_rate", 0.04), ("models.fcf_dcf_v1.scenarios.base.growth_rate", 1.1), ("models.fcf_dcf_v1.scenarios.base.note", " "), ("models.reverse_dcf_v1.solver_max_iterations", 1001), ("models.implied_discount_rate_v1.scenarios.base.growth_rate", 0.5), ("facts_override_notes.shares_outstanding", None), ("models.fcf_dcf_v1.terminal_method", "exit_multiple")]:
        held = copy.deepcopy(DOCUMENT)
        *way, last = path.split(".")
        at = held
        for k in way:
            at = at[k]
        at[last] = bad
        with pytest.raises(errors.Invalid):
            assumptions.checked(held, "US", "T0")


def test_config_is_checked():
    assert config.parse(CONFIG)["live.yfinance.batch_size"] == 5
    for key, bad in [("data_mode", "x"), ("report", {"top_n": 0}), ("ranking", {}), ("more", 1), ("live", CONFIG["live"] | {"ticker_limit": 0})]:
        with pytest.raises(errors.Invalid):
            config.parse(CONFIG | {key: bad})
    assert config.digest({"b": 1, "a": "é"}) == config.digest({"a": "é", "b": 1}) and config.canonical({"b": [1], "a": None}) == '{"a":null,"b":[1]}'


def test_bundle_errors(spark, place, tmp_path):
    b = bundle.Bundle(spark, str(place / "data"))
    data = b.load("US", fundamentals=True)
    assert {r["ticker"] for r in data.bars.select("ticker").distinct().collect()} == {"T0", "T1", "T2", "T3"}
    assert data.metadata["fundamentals"] == {"listed": 4, "with_facts": 1, "without_facts": 3, "latest_source_date": "2025-07-31"}
    with pytest.raises(errors.DataError, match=f"a bar of {LAST}"), checks.translated():
        b.bars("US", data.listings, LAST - timedelta(1)).count()
    text = (place / "data" / "ohlcv.csv").read_text()
    for name, content in (("twice", text + text.splitlines()[1] + "\n"), ("lacks", text.replace("adjusted_close", "other", 1))):
        d = tmp_path / name
        d.mkdir()
        for f in ("metadata.json", "listings.csv", "fundamentals.csv"):
            (d / f).write_text((place / "data" / f).read_text())
        (d / "ohlcv.csv").write_text(content)
        with pytest.raises(errors.DataError, match="several bars of" if name == "twice" else "lacks"), checks.translated():
            bundle.Bundle(spark, str(d)).load("US").bars.count()


def test_wide_bars(spark):
    wide = spark.createDataFrame([("2025-01-01", 1.0, 2.0, None, 4.0), ("no date", 1.0, 2.0, 3.0, 4.0)], "bar_date string, `Close|A` double, `Open|A` double, `Close|B` double, `Open|B` double")
    got = bundle.long_bars(wide, ["A", "B"], {"Close": "close", "Open": "open"}).collect()
    assert [(r["ticker"], r["bar_date"], r["close"], r["open"]) for r in got] == [("A", date(2025, 1, 1), 1.0, 2.0)]


def feed():
    """Made inside a function, so that executors get it by value."""

    def answer(symbols, first, end):
        """A feed: a day of bars before `end` for all but GONE, one of them without a volume, and a row that has no date."""
        symbols = [s for s in symbols if s != "GONE"]
        columns = pd.MultiIndex.from_product([list(live.FIELDS), symbols])
        wide = pd.DataFrame(np.full((3, len(columns)), 2.0), index=[str(first), str(end - timedelta(1)), "no date"], columns=columns)
        if "B-C" in symbols:
            wide.loc[str(first), ("Volume", "B-C")] = np.nan
        return wide.swaplevel(axis=1) if len(symbols) % 2 else wide

    return answer


def live_config(**live_keys):
    return config.parse(CONFIG | {"data_mode": "live", "live": CONFIG["live"] | live_keys})


@pytest.fixture
def registry(spark, tmp_path):
    held = live.Registry()
    rows = [("US", t, "NASDAQ") for t in ("D", "A", "B.C", "X^Y", "GONE")]
    held.register("listings", "a", lambda cfg: lambda market: spark.createDataFrame(rows, "market string, ticker string, exchange_segment string"), ("us",))
    held.register("bars", "c", lambda cfg: live.BarFeed(feed(), cfg["live.yfinance.batch_size"], str(tmp_path / "bars")))
    return held


STARTED = datetime(2025, 6, 2, 2, tzinfo=timezone.utc)  # still the first of June in New York


@pytest.mark.parametrize("size", (1, 5))
def test_live_run(registry, size):
    data = live.load(registry, live_config(yfinance={"batch_size": size}), "US", STARTED)
    last, first = date(2025, 6, 1), date(2025, 6, 1) - timedelta(420)
    got = {(r["ticker"], r["bar_date"]) for r in data.bars.collect()}
    assert got == {("A", first), ("A", last), ("D", first), ("D", last), ("B.C", last)}
    assert data.run_latest_bar_date == last and data.metadata["market_timezone"] == "America/New_York" and data.fundamentals is None
    assert [r["ticker"] for r in data.listings.collect()] == ["A", "B.C", "D", "GONE", "X^Y"]


def test_live_limit_and_silence(registry, spark, tmp_path):
    data = live.load(registry, live_config(ticker_limit=1), "US", STARTED)
    assert {r["ticker"] for r in data.bars.collect()} == {"A"}
    silent = live.BarFeed(lambda *_: pd.DataFrame(), 2, str(tmp_path / "none"))
    with pytest.raises(errors.DataError):
        silent.bars(data.listings, date(2025, 6, 1))


def test_registry(registry):
    assert registry.ids("bars", "TW") == ["c"] and registry.ids("listings", "TW") == []
    for kind, name in (("bars", "c"), ("news", "x"), ("bars", " ")):
        with pytest.raises(errors.Invalid):
            registry.register(kind, name, lambda cfg: None)
    with pytest.raises(errors.Invalid):
        registry.make("listings", "a", "TW", live_config())
    with pytest.raises(errors.NotFound):
        registry.make("fundamentals", "a", "US", live_config())


def test_live_command(spark, tmp_path, monkeypatch, capsys):
    """--providers fills the registry; ids that nobody registers, and modules that aren't there, end with their codes."""
    monkeypatch.setattr(live, "REGISTRY", live.Registry())
    (tmp_path / "made_providers.py").write_text("def register(registry):\n    registry.register('listings', 'a', lambda cfg: None)\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(CONFIG | {"data_mode": "live", "duckdb_path": str(tmp_path / "store"), "lock_path": str(tmp_path / "lock"), "fixture_dir": "none"}))
    call = lambda module: cli.main(["--config", str(tmp_path / "c.yaml"), "--providers", module, "batch", "US"], spark)
    assert call("no_such_providers") == 1
    assert call("made_providers") == 2 and live.REGISTRY.ids("listings", "US") == ["a"]
    assert "no provider of bars named c" in capsys.readouterr().err


def test_contract(spark):
    for profile_id, lenient in (("sample_price_trend_v1", True), ("trend_quality_v1", False)):
        p = catalog.PROFILES[profile_id]
        ddl = "market string, ticker string, close double, adjusted_close double, " + ", ".join(f"{k} double" for k in p.snapshot)
        rows = [("US", f"T{i}", 10.0, 10.0, *[1.0 + i] * len(p.snapshot)) for i in range(3)]
        snap = spark.createDataFrame(rows, ddl)
        assert contract.ranked(profile_id, p, snap).count() == 3 * len(p.horizons)
        odd = spark.createDataFrame([*rows, ("US", "T9", 10.0, 10.0, math.nan, *[1.0] * (len(p.snapshot) - 1))], ddl)
        bad = snap.drop(next(iter(p.snapshot)))
        if lenient:
            assert contract.ranked(profile_id, p, odd).count() == 3 * len(p.horizons) and contract.ranked(profile_id, p, bad).count() == 0
        else:
            for x in (odd, bad, snap.withColumn("as_of", snap.ticker)):
                with pytest.raises(errors.DataError):
                    contract.ranked(profile_id, p, x)


def test_formats():
    assert (output.number(1.5e12), output.number(-2e9), output.number(12.345)) == ("1.50T", "-2.00B", f"{12.345:.2f}")
    assert (output.money(3e6, "usd"), output.money(3, "TWD"), output.multiple(12.0), output.multiple(1.25), output.percent(0.1234)) == ("$3.00M", "TWD 3.00", "12.0x", "1.25x", "12.34%")
    assert output.plain("a\n buy | Fair Value") == "a [redacted] \\| [redacted]"
    with pytest.raises(ValueError):
        output.as_json({"x": math.nan})


def test_valuation_of_a_universe_is_unchanged(spark):
    """by_document with the catalogue's rates gives what value() gives."""
    facts = spark.createDataFrame([("P1", 500.0, 20.0, 10.0, 400.0)], "ticker string, starting_fcf double, net_debt double, shares double, price double")
    m = {"forecast_years": valuation.YEARS, "scenarios": {s: {"growth_rate": valuation.GROWTH[i], "discount_rate": valuation.DISCOUNT[i], "terminal_growth_rate": valuation.TERMINAL[i]} for i, s in enumerate(valuation.SCENARIOS)}}
    one = documents.by_document(facts, {"models": {"fcf_dcf_v1": m}}, "fcf_dcf_v1").collect()
    all_of = valuation.value(facts, valuation.scenarios(spark)).filter("model_id = 'fcf_dcf_v1'").collect()
    key = lambda r: r["scenario"]
    assert sorted(map(tuple, one)) == sorted(map(tuple, all_of)) and len({key(r) for r in one}) == 3


def test_only_one_listing(spark, place, capsys):
    """A lookup that must match once tells how often it did."""
    df = spark.createDataFrame([("A", 1), ("B", 2), ("B", 3)], "ticker string, n int")
    assert checks.only(df.filter("ticker = 'A'"), "listing of A") == {"ticker": "A", "n": 1}
    for t, n in (("B", 2), ("C", 0)):
        with pytest.raises(errors.DataError, match=f"exactly one listing of {t}; found {n}"):
            checks.only(df.filter(f"ticker = '{t}'"), f"listing of {t}")
    assert cli.main(["--config", str(place / "config.yaml"), "value", "US", "--ticker", "NOBODY", "--assumptions", str(place / "T0.yaml")], spark) in (1, 6)


def test_runs_are_as_of_the_run_date(spark, place, tmp_path, capsys):
    """A bundle whose feed stopped before the run's date ranks nobody under rule A."""
    data = tmp_path / "late"
    data.mkdir()
    for f in ("listings.csv", "ohlcv.csv", "fundamentals.csv"):
        (data / f).write_text((place / "data" / f).read_text())
    (data / "metadata.json").write_text(json.dumps({k: "x" for k in bundle.METADATA} | {"run_latest_bar_date": str(LAST + timedelta(1))}))
    held = yaml.safe_load((place / "config.yaml").read_text()) | {"duckdb_path": str(tmp_path / "store"), "lock_path": str(tmp_path / "lock"), "fixture_dir": str(data)}
    (tmp_path / "config.yaml").write_text(yaml.safe_dump(held))
    go = lambda *a: cli.main(["--config", str(tmp_path / "config.yaml"), *a], spark)
    assert go("batch", "US") == 0 and go("report", "US", "--json") == 0
    assert json.loads(capsys.readouterr().out.split("\n", 1)[1])["snapshots"] == []


def test_a_run_is_computed_once(spark, place, tmp_path):
    """Each bar passes the plan once in a run: the checks ride on the job that writes the snapshot, and rankings start from what it wrote."""
    data = bundle.Bundle(spark, str(place / "data")).load("US")
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    bars = data.bars.mapInPandas(count, data.bars.schema)
    p, run = catalog.PROFILES["trend_quality_v1"], store.RunStore(spark, str(tmp_path / "store"))
    dates = spark.createDataFrame([("US", LAST)], "market string, run_date date")
    once = bars.select("market", "bar_date").distinct().count() and seen.value  # rule B asks for the dates besides
    snap, watch = contract.watched(p.profile_id, p, engine.snapshot(p, bars, data.listings, dates, dated=True))
    assert {"first_as_of", "last_as_of", "bad_return_20d"} <= set(watch)
    run_id = run.begin("US", p.profile_id)
    run.commit(run_id, "US", p.profile_id, snap, lambda written: engine.rankings(p, written), list(p.horizons), None, watch, lambda seen: contract.settle(p.profile_id, "US", seen))
    assert run.latest("US") == run_id and seen.value == 3 * once


def test_checks_ride_on_the_write(spark, tmp_path):
    """What settle() and the store refuse: no numbers, several as-of dates, repeated tickers, another market, gaps in ranks."""
    p = catalog.PROFILES["trend_quality_v1"]
    ddl = "market string, ticker string, as_of date, close double, adjusted_close double, " + ", ".join(f"{k} double" for k in p.snapshot)
    rows = [("US", f"T{i}", LAST, 10.0, 10.0, *[1.0 + i] * len(p.snapshot)) for i in range(4)]
    change = lambda i, k, v: [r if n != i else (*r[:k], v, *r[k + 1 :]) for n, r in enumerate(rows)]
    run = store.RunStore(spark, str(tmp_path / "store"))

    def commit(rows, rank=lambda snap: engine.rankings(p, snap)):
        run_id = run.begin("US", p.profile_id)
        snap, watch = contract.watched(p.profile_id, p, spark.createDataFrame(rows, ddl))
        run.commit(run_id, "US", p.profile_id, snap, rank, list(p.horizons), None, watch, lambda seen: contract.settle(p.profile_id, "US", seen))
        return run_id

    assert run.status(commit(rows)) == "successful" and run.status(commit([])) == "successful"
    for bad, kind, text in (
        (change(1, 6, math.nan), errors.DataError, "no numbers in"), (change(1, 6, None), errors.DataError, "no numbers in"), (change(2, 2, LAST - timedelta(1)), errors.DataError, "several as-of dates"),
        (change(2, 1, "T1"), errors.IntegrityError, "repeated tickers"), (change(2, 0, "TW"), errors.IntegrityError, "another market"),
    ):
        with pytest.raises(kind, match=text):
            commit(bad)
    for rank in (lambda s: engine.rankings(p, s).filter("rank > 1"), lambda s: engine.rankings(p, s).withColumn("rank", engine.F.col("rank") * 2), lambda s: engine.rankings(p, s).replace("composite", "other", ["horizon"])):
        with pytest.raises(errors.IntegrityError):
            commit(rows, rank)


def test_projections_by_hand(spark):
    """Two stages over three years, worked out by hand; and what a model without years gives."""
    facts = spark.createDataFrame([("P1", 100.0, 20.0, 10.0, 40.0)], "ticker string, starting_fcf double, net_debt double, shares double, price double")
    two = {"stage1_years": 2, "stage2_years": 1, "scenarios": {s: {"stage1_growth_rate": 0.5, "stage2_growth_rate": 0.0, "discount_rate": 0.25, "terminal_growth_rate": 0.0} for s in valuation.SCENARIOS}}
    row = documents.explained(facts, {"models": {"two_stage_fcf_dcf_v1": two}}, "two_stage_fcf_dcf_v1").filter("scenario = 'base'").first()
    assert [(y["year"], y["flow"], round(y["factor"], 12), round(y["present_value"], 9)) for y in row["projection"]] == [(1, 150.0, 0.8, 120.0), (2, 225.0, 0.64, 144.0), (3, 225.0, 0.512, 115.2)]
    assert (row["stage1_final_fcf"], row["final_year_fcf"], row["terminal_value"], round(row["present_value_terminal_value"], 9)) == (225.0, 225.0, 900.0, 460.8)
    assert row["enterprise_value"] == pytest.approx(840.0) and row["projected_value"] == pytest.approx(840.0) and row["terminal_share"] == pytest.approx(460.8 / 840) and row["status"] == "solved"
    plain = {"scenarios": {s: {"ev_to_fcf_multiple": 9.0} for s in valuation.SCENARIOS}}
    row = documents.explained(facts, {"models": {"multiple_valuation_v1": plain}}, "multiple_valuation_v1").first()
    assert row["projection"] == [] and row["terminal_value"] is None and row["enterprise_value"] == 900.0
    with pytest.raises(errors.NotFound):
        documents.model("other_v1")
    with pytest.raises(errors.Invalid):
        documents.register("fcf_dcf_v1", ())


def plain_search(off, lo, hi, tolerance, steps, width):
    """Bisection step by step, and how it ended."""
    a, b = off(lo), off(hi)
    if abs(a) <= tolerance or abs(b) <= tolerance:
        return (lo if abs(a) <= tolerance else hi), "solved", 0
    if a * b > 0:
        return None, "same sign", 0
    for n in range(1, steps + 1):
        x = (lo + hi) / 2
        y = off(x)
        if abs(y) <= tolerance:
            return x, "solved", n
        if a * y > 0:
            lo, a = x, y
        else:
            hi = x
        if width is not None and hi - lo <= width:
            return None, "width", n
    return None, "steps", steps


@pytest.mark.parametrize(("tolerance", "steps", "width", "bounds"), [(1e-6, 200, 1e-12, (-0.9, 1.0)), (1e-13, 200, 1e-12, (-0.9, 1.0)), (1e-6, 5, None, (-0.9, 1.0)), (1e-6, 100, None, (0.8, 1.0)), (50.0, 100, 1e-12, (-0.9, 1.0)), (1e-6, 1, 10.0, (-0.9, 1.0))])
def test_searches_end_as_they_should(spark, tolerance, steps, width, bounds):
    facts = [(f"P{i}", 100.0 + i, 20.0, 10.0, 300.0 + 40 * i) for i in range(12)]
    df = spark.createDataFrame(facts, "ticker string, starting_fcf double, net_debt double, shares double, price double").selectExpr("*", "cast(0.1 as double) r", "cast(0.02 as double) tg")
    text = solvers.bisected(lambda x: f"({valuation.dcf(x, 'r', 3)} - {valuation.TARGET})", f"CAST({bounds[0]} AS DOUBLE)", f"CAST({bounds[1]} AS DOUBLE)", f"CAST({tolerance} AS DOUBLE)", str(steps), width)
    got = {r["ticker"]: r["s"] for r in df.selectExpr("ticker", f"{text} AS s").collect()}
    for ticker, fcf, debt, shares, price in facts:

        def off(g, fcf=fcf, debt=debt, shares=shares, price=price):
            q = (1.0 + g) / (1.0 + 0.1)
            return fcf * q * (1.0 + q * (1.0 + q * (1.0 + (1.0 + 0.02) / (0.1 - 0.02)))) - (price * shares + debt)

        root, status, n = plain_search(off, *bounds, tolerance, steps, width)
        s = got[ticker]
        assert (s["status"], s["steps"]) == (status, n) and (root is None) == (s["root"] is None), ticker
        if root is not None:
            assert s["root"] == pytest.approx(root, abs=1e-12) and abs(s["residual"]) <= tolerance


def test_value_says_why_there_is_none(spark, place, tmp_path, capsys):
    held = copy.deepcopy(DOCUMENT)
    for s in held["models"]["reverse_dcf_v1"]["scenarios"].values():
        s |= {"implied_growth_lower_bound": -0.9, "implied_growth_upper_bound": -0.89}
    held["models"]["implied_discount_rate_v1"]["solver_max_iterations"] = 2
    (tmp_path / "d.yaml").write_text(yaml.safe_dump(held))
    go = lambda m: cli.main(["--config", str(place / "config.yaml"), "value", "US", "--ticker", "T0", "--assumptions", str(tmp_path / "d.yaml"), "--model", m], spark)
    assert go("reverse_dcf_v1") == 1 and "no solution between -0.9000 and -0.8900" in capsys.readouterr().err
    assert go("implied_discount_rate_v1") == 1 and "after 2 steps (steps)" in capsys.readouterr().err
