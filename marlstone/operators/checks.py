"""What must hold of rows, asked while they are on their way somewhere.

Watch takes metrics of a table's rows during the job that writes it (DataFrame.observe), so a check costs no job of its own.
Assertions that belong to single rows stand in the plan: the first row that breaks one ends the job with its message, and
translated() turns that into the library's error.
"""

from __future__ import annotations

import contextlib
import re
from collections.abc import Iterator

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from marlstone.errors import DataError, MarlstoneError


class Watch:
    """Metrics of df's rows, known once a job over .rows has ended."""

    def __init__(self, df: DataFrame, metrics: dict[str, Column]) -> None:
        self._seen = Observation()
        self.rows = df.observe(self._seen, *[c.alias(k) for k, c in metrics.items()])

    def seen(self) -> dict:
        return self._seen.get


def finite(name: str) -> Column:
    """Whether a number is there and neither infinite nor not a number."""
    return F.expr(f"coalesce(abs(`{name}`) < double('Infinity'), false)")


def how_many(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def must(df: DataFrame, holds: Column, message: Column) -> DataFrame:
    """df, whose job ends with the message at the first row for which `holds` isn't true."""
    return df.filter(F.when(F.coalesce(holds, F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit(RAISED), message, F.lit(END))).cast("boolean")))


def unrepeated(df: DataFrame, keys: list[str], order: str, message: Column) -> DataFrame:
    """df, whose job ends with the message where two rows agree in keys and order. Windows over the same keys and order share its shuffle and sort."""
    before = "order_before"
    held = df.withColumn(before, F.lag(order).over(Window.partitionBy(*keys).orderBy(order)))
    return must(held, ~F.col(before).eqNullSafe(F.col(order)) | F.col(before).isNull(), message).drop(before)


def only(df: DataFrame, what: str) -> dict:
    """The one row of df; else an error that tells how many there are. One job, of which a row comes to the driver."""
    found = df.agg(F.count("*").alias("n"), F.any_value(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("row")).first()
    if found["n"] != 1:
        raise DataError(f"expected exactly one {what}; found {found['n']}")
    return found["row"].asDict()


RAISED, END = "marlstone: ", " :marlstone"
_MESSAGE = re.compile(re.escape(RAISED) + "(.*?)" + re.escape(END), re.S)


@contextlib.contextmanager
def translated() -> Iterator[None]:
    """Errors that must() raised in a job leave as DataError."""
    try:
        yield
    except MarlstoneError:
        raise
    except PySparkException as e:
        told = _MESSAGE.search(str(e))
        if told is None:
            raise
        raise DataError(told[1]) from e
