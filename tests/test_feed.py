"""The data source for bars over a made feed."""

import os
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.errors import Invalid
from marlstone.sources import feed

FIRST, END = date(2025, 1, 1), date(2025, 2, 1)


def made(log):
    """A feed that notes what it is asked, fails at the first time it is asked for C, knows nothing of GONE, and answers with a day too many."""
    folder = str(log)

    def fetch(symbols, first, end):
        name = os.path.join(folder, f"{'-'.join(symbols)}_{first}_{end}")
        again = os.path.exists(name)
        with open(name, "a") as f:
            f.write("x")
        if "C" in symbols and not again:
            raise OSError("the line is busy")
        known = [s for s in symbols if s != "GONE"]
        days = [first + timedelta(i) for i in range((end - first).days + 1)]
        columns = pd.MultiIndex.from_product([["Open", "High", "Low", "Close", "Adj Close", "Volume"], known])
        return pd.DataFrame(np.arange(len(days) * len(columns), dtype=float).reshape(len(days), -1), index=[str(d) for d in days], columns=columns)

    return fetch


def asked(log):
    return sorted(os.listdir(log))


def test_batches(spark, tmp_path):
    bars = feed.read(spark, made(tmp_path), ["A", "B", "C", "GONE", "D"], FIRST, END, 2, pause=0.01)
    assert bars.rdd.getNumPartitions() == 3
    rows = bars.filter(F.col("bar_date") < F.lit(END)).collect()
    assert {r["request_symbol"] for r in rows} == {"A", "B", "C", "D"} and len(rows) == 4 * 31
    assert asked(tmp_path) == [f"{s}_{FIRST}_{END}" for s in ("A-B", "C-GONE", "D")]
    assert (tmp_path / f"C-GONE_{FIRST}_{END}").read_text() == "xx"


def test_filters_reach_the_feed(spark, tmp_path):
    bars = feed.read(spark, made(tmp_path), ["A", "B", "D", "E"], FIRST, END, 2, pause=0.01)
    rows = bars.filter("bar_date > date'2025-01-10' and bar_date <= date'2025-01-12' and request_symbol in ('A', 'E') and close >= 0").collect()
    assert sorted((r["request_symbol"], r["bar_date"].day) for r in rows) == [("A", 11), ("A", 12), ("E", 11), ("E", 12)]
    assert asked(tmp_path) == ["A-E_2025-01-11_2025-01-13"]
    one = bars.filter("bar_date = date'2025-01-05' and request_symbol = 'B'").collect()
    assert [r["bar_date"] for r in one] == [date(2025, 1, 5)] and "B_2025-01-05_2025-01-06" in asked(tmp_path)
    before = asked(tmp_path)
    assert bars.filter("bar_date < date'2024-01-01'").count() == 0 and bars.filter("request_symbol = 'Z'").count() == 0
    assert asked(tmp_path) == before


def test_a_batch_that_always_fails_ends_the_job(spark):
    def fetch(symbols, first, end):
        raise OSError("no line")

    with pytest.raises(Exception, match="no line"):
        feed.read(spark, fetch, ["A"], FIRST, END, attempts=2, pause=0.01).count()


def test_options(spark):
    for bad in ({"batch_size": 0}, {"attempts": 0}):
        with pytest.raises(Exception, match="1 or more"):
            feed.read(spark, print, ["A"], FIRST, END, **bad).count()
    with pytest.raises(Invalid, match="needs the option fetch"):
        feed.BarReader({})
