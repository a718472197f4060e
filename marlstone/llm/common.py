"""Shared pieces: reading tables, shared intermediate tables, vectorised word hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import hashlib
import inspect
import os
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: the space and the controls 0x09 to 0x0D.
SPACE_BYTES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
WORD = r"[^\x20\x09-\x0D]+"
#: The same in a Spark SQL string literal, where a backslash is written twice.
WORD_SQL = r"[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a driver that runs all tasks itself (tests) may leave it unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not (spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (root or os.path.join(tempfile.gettempdir(), "marlstone-shared")).rstrip("/")


_WRITTEN: dict[str, SparkSession] = {}


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: it is computed once, lineage ends, and a lost executor costs a reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialise() that nothing reads any more: what came of them has been written too."""
    for df in tables:
        path = df.written_to
        spark = _WRITTEN.pop(path)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _discard_all() -> None:
    for path, spark in list(_WRITTEN.items()):
        with contextlib.suppress(Exception):  # the session may have ended
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def filed(docs: DataFrame) -> DataFrame:
    """docs if it is read from files, whose rows can be told apart by their place; else it is written first."""
    try:
        docs.select("_metadata.row_index")
        return docs
    except AnalysisException:
        return materialise(docs, "filed")


def keyed(docs: DataFrame, file: str = "row_file", at: str = "row_at") -> DataFrame:
    """docs with a key of each row: its file (hashed) and its place in that; the same at each reading of filed() tables."""
    return filed(docs).select("*", F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at))


def unused(name: str, df: DataFrame) -> str:
    """A column name like `name` that df doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def tasks_for(spark: SparkSession, least: int = 1) -> int:
    """Partitions for a wide step: the session's shuffle partitions."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


# ---------------------------------------------------------------- vectorised hashing of words

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each output bit depends on all input bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(30))
        x = x * U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U(27))
        x = x * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


class Powers:
    """Powers of the rolling base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[U(1)], np.full(m - 1, _BASE)]), dtype=np.uint64)
                self.down = np.cumprod(np.concatenate([[U(1)], np.full(m - 1, _BASE_INV)]), dtype=np.uint64)
        return self.up, self.down


POWERS = Powers()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """p with p[j] = sum of byte values times base**i for i < j, modulo 2**64; data: uint8."""
    up, _ = POWERS.to(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free 64-bit hashes of the byte spans [start, end)."""
    _, down = POWERS.to(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * down[start] + U(0x51ED270B) * (end - start).astype(np.uint64))


_LONG, _SALT = 1 << 12, U(0xA0761D6478BD642F)


def byte_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), by eight bytes at a time; spans of one length up to 8 never collide."""
    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    left = end - start
    h = mix(left.astype(np.uint64) ^ _SALT)
    live, at = np.flatnonzero(left <= _LONG), start
    if len(live) < len(left):
        for i in np.flatnonzero(left > _LONG):
            h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
        at, left = at[live], left[live]
    while len(live):
        chunk = eight[at]
        short = np.flatnonzero(left < 8)
        chunk[short] &= (U(1) << (U(8) * left[short].astype(np.uint64))) - U(1)
        h[live] = mix(h[live] ^ chunk)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return h


FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE_BYTES)] = True


def joined(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of texts with a line feed after each, and where each begins (one more entry for the end). None counts as empty."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=at[1:])
    return np.frombuffer(b"\n".join(raw) + b"\n", np.uint8) if raw else np.zeros(0, np.uint8), at


def word_spans(data: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes that are not separators; the last byte must be one."""
    sep = separator[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], sep]).astype(np.int8)))
    return edge[0::2], edge[1::2]


def hashed_words(texts: list, separator: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts (A-Z folded), and the index of each text's first word (one more entry for the end)."""
    data, at = joined(texts)
    data = FOLD[data]
    start, end = word_spans(data, separator)
    return byte_hash(data, start, end), np.searchsorted(start, at)


def slices(texts: list, limit: int = 4 << 20):
    """Index ranges of texts of about limit characters each, so that arrays stay small whatever the batch holds."""
    begin, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t or "") + 1
        if total >= limit:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def release() -> None:
    """Give freed memory back to the system: a worker process lives on beside the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries keep it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(f: Callable) -> Callable:
    """f, which is run by worker processes on groups or batches, with release() at its end."""
    if inspect.isgeneratorfunction(f):

        @functools.wraps(f)
        def run(*args, **kwargs):
            yield from f(*args, **kwargs)
            release()

        return run

    @functools.wraps(f)
    def once(*args, **kwargs):
        out = f(*args, **kwargs)
        release()
        return out

    return once


# ---------------------------------------------------------------- CRC-32 in DuckDB, for oracles

#: A one-row table whose column crc_table is the table of CRC-32, built by its rule.
CRC_TABLE_SQL = """(SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS crc_table FROM range(256) r(i))"""


def crc32_sql(text: str) -> str:
    """CRC-32 of a string's UTF-8 bytes, in DuckDB; crc_table must be in scope."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda p: CAST('0x' || p AS BIGINT))"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, crc_table[xor(c & 255, b) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"
