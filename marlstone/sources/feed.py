"""Bars of a price feed as a data source: spark.read.format("marlstone_bars").

A partition asks the feed for one batch of symbols and one span of days. Filters on bar_date narrow the span before anything is asked,
filters on request_symbol leave out symbols and so whole batches. A batch that fails is asked again after a pause, the last error ends its task (which
Spark then runs again). An empty answer is a batch without rows. Rows come as Arrow batches.
"""

from __future__ import annotations

import base64
import json
import time
from collections.abc import Callable, Iterable, Iterator
from datetime import date, timedelta

import pandas as pd
import pyarrow as pa
import pyspark.cloudpickle as cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from marlstone.errors import Invalid

# What price feeds call the fields.
FIELDS = {"Open": "open", "High": "high", "Low": "low", "Close": "close", "Adj Close": "adjusted_close", "Volume": "volume"}
FETCHED = "request_symbol string, bar_date date, " + ", ".join(f"{n} double" for n in FIELDS.values())
FORMAT = "marlstone_bars"
#: How often a batch is asked, and the first pause in seconds, which doubles.
ATTEMPTS, PAUSE = 3, 1.0
DAY = timedelta(1)


def by_row(wide: pd.DataFrame) -> pd.DataFrame:
    """Rows of FETCHED from a feed's answer, whose columns are pairs of field and symbol in either order; dates that can't be read are dropped."""
    names = [x.split()[0] for x in FETCHED.split(", ")]
    if wide is None or wide.empty:
        return pd.DataFrame(columns=names)
    fields = 0 if wide.columns.get_level_values(0).isin(list(FIELDS)).any() else 1
    if fields == 1:
        wide = wide.swaplevel(axis=1)
    days = pd.to_datetime(pd.Series(wide.index), errors="coerce").dt.date.to_numpy()
    parts = []
    for symbol in wide.columns.get_level_values(1).unique():
        held = {n: pd.to_numeric(wide[f, symbol], errors="coerce").to_numpy() if (f, symbol) in wide.columns else float("nan") for f, n in FIELDS.items()}
        parts.append(pd.DataFrame({"request_symbol": symbol, "bar_date": days, **held}))
    return pd.concat(parts)[names].dropna()


class Batch(InputPartition):
    def __init__(self, symbols: list[str], first: date, end: date) -> None:
        super().__init__((symbols, first, end))
        self.symbols, self.first, self.end = symbols, first, end


class BarReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        for k in ("fetch", "symbols", "first", "end"):
            if not options.get(k):
                raise Invalid(f"{FORMAT} needs the option {k}")
        self.fetch = options["fetch"]
        self.symbols: list[str] = json.loads(options["symbols"])
        self.first, self.end = date.fromisoformat(options["first"]), date.fromisoformat(options["end"])
        self.size, self.attempts, self.pause = int(options.get("batch_size", "200")), int(options.get("attempts", str(ATTEMPTS))), float(options.get("pause", str(PAUSE)))
        if self.size < 1 or self.attempts < 1:
            raise Invalid("batch_size and attempts must be 1 or more")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Take what bounds days or names symbols; the rest is left to Spark."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("bar_date",) and isinstance(f, GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual | EqualTo):
                if isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                    self.first = max(self.first, f.value + DAY if isinstance(f, GreaterThan) else f.value)
                if isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                    self.end = min(self.end, f.value if isinstance(f, LessThan) else f.value + DAY)
            elif column == ("request_symbol",) and isinstance(f, EqualTo | In):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.symbols = [s for s in self.symbols if s in asked]
                continue  # whole: no symbol but these is asked for
            yield f  # a feed may answer with days beyond the span, so Spark looks again

    def partitions(self) -> list[InputPartition]:
        if self.first >= self.end or not self.symbols:
            return [Batch([], self.first, self.end)]
        return [Batch(self.symbols[a : a + self.size], self.first, self.end) for a in range(0, len(self.symbols), self.size)]

    def read(self, partition: Batch) -> Iterator[pa.RecordBatch]:
        if not partition.symbols:
            return
        fetch: Callable = cloudpickle.loads(base64.b64decode(self.fetch))
        for attempt in range(1, self.attempts + 1):
            try:
                rows = by_row(fetch(partition.symbols, partition.first, partition.end))
                break
            except Exception:
                if attempt == self.attempts:
                    raise
                time.sleep(self.pause * 2 ** (attempt - 1))
        schema = pa.schema([("request_symbol", pa.string()), ("bar_date", pa.date32()), *[(n, pa.float64()) for n in FIELDS.values()]])
        if len(rows):
            yield from pa.Table.from_pandas(rows, schema, preserve_index=False).to_batches()


class BarSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return FETCHED

    def reader(self, schema) -> BarReader:
        return BarReader(dict(self.options))


def read(spark: SparkSession, fetch: Callable[[list[str], date, date], pd.DataFrame], symbols: list[str], first: date, end: date, batch_size: int = 200, **options: object) -> DataFrame:
    """Bars of symbols from `first` up to the day before `end`, from fetch(symbols, first, end), which runs on the executors.

    Switches the session to push filters into Python sources, without which Spark refuses sources that take them.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BarSource)
    held = {"fetch": base64.b64encode(cloudpickle.dumps(fetch)).decode(), "symbols": json.dumps(symbols), "first": str(first), "end": str(end), "batch_size": str(batch_size)}
    return spark.read.format(FORMAT).options(**held, **{k: str(v) for k, v in options.items()}).load()
