"""Sharding by Karmarkar-Karp differencing: equal texts stay together, shards come out near equal in bytes (law `bytes`).

Texts are grouped by digest and summed before any shuffle of rows; the groups are dealt into buckets by hash. Each bucket
is differenced by itself: the two partial partitions with the largest spread are combined, the larger parts of one with
the smaller parts of the other, until one is left. FAN buckets' partial partitions (16 sums each) are then differenced in
the same way in a task, and so on, level by level, until FAN or fewer are left, which the driver differences. Going back,
each bucket's parts get their shards.

Defined cases: a null text has size 1 and forms a group with other null texts; an empty text is another group; repeated
rows count each; ties in size are broken by digest; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SHARDS = 16
#: Groups in a bucket, about, and buckets that are differenced together: what the driver gets is bounded by FAN * SHARDS rows.
BUCKET_GROUPS, FAN = 16_384, 4_096
#: Rows in a run of slots, about.
SLOT_ROWS = 65_536


def difference(partitions: list[tuple[list[int], list]], k: int = SHARDS) -> list[list]:
    """Karmarkar-Karp: partitions are (sums of k parts, what each part holds); returns what each of k parts holds at the end.

    A part holds None, an item, or a pair of such; flatten() lists its items.
    """
    heap = []
    for n, (sums, parts) in enumerate(partitions):
        order = sorted(range(k), key=lambda i: (-sums[i], i))
        low = sums[order[-1]]
        heap.append((-(sums[order[0]] - low), n, [sums[i] - low for i in order], [parts[i] for i in order]))
    if not heap:
        return [None] * k
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        sums = [p + q for p, q in zip(a, reversed(b))]
        parts = [p if q is None else q if p is None else (p, q) for p, q in zip(x, reversed(y))]
        order = sorted(range(k), key=lambda i: -sums[i])
        low = sums[order[-1]]
        heapq.heappush(heap, (-(sums[order[0]] - low), n, [sums[i] - low for i in order], [parts[i] for i in order]))
        n += 1
    return heap[0][3]


def flatten(part) -> Iterator:
    stack = [part]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack += x
        elif x is not None:
            yield x


def _bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["total", "key"], ascending=[False, True], ignore_index=True)
    items = [([t] + [0] * (SHARDS - 1), [i] + [None] * (SHARDS - 1)) for i, t in enumerate(pdf["total"].tolist())]
    part = [0] * len(pdf)
    for p, held in enumerate(difference(items)):
        for i in flatten(held):
            part[i] = p
    return pdf.assign(part=part)[["bucket", "key", "total", "part"]]


def _combined(pdf: pd.DataFrame) -> pd.DataFrame:
    """The parts of FAN buckets, each with its part in what they are combined to."""
    sums: dict[int, list[int]] = {}
    for bucket, part, total in zip(pdf["bucket"].tolist(), pdf["part"].tolist(), pdf["total"].tolist()):
        sums.setdefault(bucket, [0] * SHARDS)[part] = total
    parts = difference([(s, [f"{b}:{p}" for p in range(SHARDS)]) for b, s in sorted(sums.items())])
    rows = [(*map(int, x.split(":")), up) for up, held in enumerate(parts) for x in flatten(held)]
    return pd.DataFrame([(b, p, up, sums[b][p]) for b, p, up in rows], columns=["bucket", "part", "up_part", "total"]).assign(up=int(pdf["up"].iloc[0]))


def shard(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    sized = materialise(
        docs.select(
            "doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
            F.when(F.col("text").isNull(), F.lit("null")).otherwise(F.md5(F.col("text").cast("binary"))).alias("key"),
        ),
        "shard-size",
    )
    groups = materialise(sized.groupBy("key").agg(F.sum("size").alias("total")), "shard-group")
    n = groups.count()
    buckets = max(1, -(-n // BUCKET_GROUPS))
    dealt = materialise(
        groups.withColumn("bucket", F.expr(f"cast(pmod(xxhash64(key), {buckets}) as int)")).groupBy("bucket").applyInPandas(_bucket, "bucket int, key string, total long, part int"), "shard-part"
    )
    sums, levels = dealt.groupBy("bucket", "part").agg(F.sum("total").alias("total")), []
    while buckets > FAN:
        buckets = -(-buckets // FAN)
        level = sums.withColumn("up", F.expr(f"cast(pmod(bucket, {buckets}) as int)")).groupBy("up").applyInPandas(_combined, "bucket int, part int, up int, up_part int, total long")
        levels.append(materialise(level, "shard-level"))
        sums = levels[-1].groupBy(F.col("up").alias("bucket"), F.col("up_part").alias("part")).agg(F.sum("total").alias("total"))
    last: dict[int, list[int]] = {}
    for r in sums.collect():  # at most FAN * SHARDS rows
        last.setdefault(r["bucket"], [0] * SHARDS)[r["part"]] = r["total"]
    parts = difference([(s, [f"{b}:{p}" for p in range(SHARDS)]) for b, s in sorted(last.items())])
    rows = [(*map(int, x.split(":")), s) for s, held in enumerate(parts) for x in flatten(held)]
    to = spark.createDataFrame(rows, "bucket int, part int, shard int")
    for level in reversed(levels):
        to = level.join(to.toDF("up", "up_part", "shard"), ["up", "up_part"]).select("bucket", "part", "shard")
    key_shard = dealt.join(to, ["bucket", "part"]).select("key", "shard")
    placed = sized.join(key_shard, "key")
    return slots(placed)


def slots(placed: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0 without gaps: rows are numbered within runs, a table of runs gives the offsets."""
    spark = placed.sparkSession
    placed = materialise(placed, "shard-row")
    runs = max(1, -(-placed.count() // (SLOT_ROWS * SHARDS)))
    placed = placed.withColumn("run", F.expr(f"pmod(xxhash64(doc_id, key), {runs})"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offset = placed.groupBy("shard", "run").count().withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0))).select("shard", "run", "offset")
    order = Window.partitionBy("shard", "run").orderBy("doc_id", "key")
    return placed.withColumn("rn", F.row_number().over(order)).join(offset, ["shard", "run"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("rn") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
