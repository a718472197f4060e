"""Percentiles and ranks that no task sees whole, against plain Python; written tables."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.errors import Invalid
from marlstone.functions.sqlexpr import percentile
from marlstone.operators import ranks, tables

RNG = random.Random(3)


def plain(values, better):
    """1 less the mean place among the others, over their number."""
    out = {}
    known = {k: (-v if better == "low" else v) for k, v in values.items() if v is not None and (better != "positive" or v > 0)}
    for k, v in known.items():
        higher, same = sum(x > v for x in known.values()), sum(x == v for x in known.values())
        out[k] = 1.0 if len(known) == 1 else 1.0 - (higher + (same - 1) / 2.0) / (len(known) - 1)
    return {k: out.get(k, 0.0 if better == "positive" else None) for k in values}


@pytest.mark.parametrize("ranges", [200, 4])
def test_percentiles(spark, monkeypatch, ranges):
    """Whatever the quantiles are: ties (one value that most rows share), zeros of both signs, nulls, groups of one, names that clash."""
    monkeypatch.setattr(ranks, "RANGES", ranges)
    rows = [(m, f"T{i}", RNG.choice([0.0, -0.0, 1.5, -2.0, RNG.uniform(-5, 5)]), 7.0 if i % 10 else float(i), None if i % 9 == 0 else RNG.gauss(0, 1)) for m in ("US", "TW") for i in range(300)]
    rows += [("ONE", "A", -1.0, 2.0, None)]
    df = tables.written(spark.createDataFrame(rows, "market string, ticker string, a double, b double, n double"), "t")
    asked = {"p": percentile("a"), "q": percentile("a", "positive"), "r": percentile("b", "low"), "s": percentile("a"), "v": percentile("n"), "held": percentile("b")}
    got = {(r["market"], r["ticker"]): r for r in ranks.percentiles(df, ["market"], "ticker", asked).collect()}
    assert len(got) == len(rows)
    for m in ("US", "TW", "ONE"):
        for name, column, better in (("p", 2, "high"), ("q", 2, "positive"), ("r", 3, "low"), ("s", 2, "high"), ("v", 4, "high"), ("held", 3, "high")):
            want = plain({r[1]: r[column] for r in rows if r[0] == m}, better)
            assert {t: got[m, t][name] for t in want} == want, (m, name)
    assert ranks.percentiles(df.limit(0), ["market"], "ticker", asked).count() == 0


def test_percentiles_are_like_windows(spark):
    """The SQL text of a percentile, which the oracles run, gives the same."""
    df = tables.written(spark.createDataFrame([("US", f"T{i}", float(i % 7 - 2)) for i in range(50)], "market string, ticker string, x double"), "t")
    for better in ("high", "low", "positive"):
        p = percentile("x", better)
        a = ranks.percentiles(df, ["market"], "ticker", {"y": p}).select("ticker", "y")
        b = df.select("ticker", F.expr(p.replace(" 0.0", " cast(0.0 as double)").replace(" 1.0", " cast(1.0 as double)").replace("2.0", "cast(2.0 as double)")).alias("y"))
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_no_window_sees_a_group(spark):
    """No window is partitioned by the group alone over rows: only over the ranges' sums."""
    df = tables.written(spark.createDataFrame([("US", f"T{i}", float(i)) for i in range(50)], "market string, ticker string, x double"), "t")
    plan = ranks.percentiles(df, ["market"], "ticker", {"y": percentile("x")})._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("range#" in w or "sum(held#" in w for w in windows)


def test_ranked(spark):
    """Row numbers of each group without gaps, with one group and one score that most rows share."""
    rows = [(RNG.choice(["A"] * 8 + ["B", None]), float(RNG.choice([5] * 6 + [1, 2, 3])), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, score double, ticker long").repartition(5)
    got = ranks.ranked(df, ["g"], [F.desc("score"), F.asc("ticker")]).collect()
    for g in ("A", "B", None):
        want = sorted((r[1:] for r in rows if r[0] == g), key=lambda r: (-r[0], r[1]))
        assert [(r["score"], r["ticker"], r["rank"]) for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])] == [(*w, i) for i, w in enumerate(want, 1)]
    assert ranks.ranked(df.limit(0), ["g"], [F.desc("score"), F.asc("ticker")]).count() == 0


def test_tables_need_a_shared_folder(monkeypatch):
    class Conf:
        get = staticmethod(lambda *a: None)

    class Context:
        master = "spark://somewhere"
        getConf = staticmethod(lambda: Conf)

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(Invalid):
        tables.shared(Session)
