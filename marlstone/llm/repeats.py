"""Removal of repeated byte strings by suffix arrays of shards.

A byte is removed if a string of LENGTH bytes covers it that also starts earlier: in a document of smaller doc_id, or in
the same one further ahead. Every row is a document; rows of one doc_id come in the order of their places. Every such string (window) is told by its minimizer, the GRAM-byte string within it of the
least hash; so equal windows have equal minimizers, at equal places.

1. Each text falls into segments, runs of windows with one minimizer. A segment is sent on as a hash of its minimizer, 96
   bits of two independent hashes of its bytes, and its place. Of equal segments of a batch only the first is sent; the others' windows all start
   earlier there. What is sent is packed by ranges of minimizers, not by document, so a passage that a third of all
   documents share is one entry a batch; the places of the batch's other copies are marked, and dealt by batch.
2. In a pack, all but the first of equal segments are marked as repeated. Minimizers with segments of different bytes
   remain: their windows may be equal in part.
3. For those, the bytes are fetched and cut once more, by whether LEFT bytes before the minimizer or those after it are
   in the window, and are dealt to shards by a hash of these bytes and the minimizer. A shard's segments are joined with
   separators, in order of place, and sorted by induced sorting; windows whose common prefix is LENGTH or more are equal,
   and all but the first are marked.
4. The marked windows are merged to runs, which are cut from the texts.

Defined cases: a null text is empty; texts of fewer than LENGTH bytes are kept whole; rows that repeat a doc_id are told apart by
file and place in it, with the same text or another, so the later copy of a row goes; rows without doc_id come
last, in order of place; an empty table gives an empty result; other columns are neither read nor returned by digest().
"""

from __future__ import annotations

import contextlib
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, discard, filed, joined, materialise, mix, prefix_hash, span_hash, tidy
from .suffix_sort import common_prefixes, suffix_array

LENGTH, GRAM = 100, 24
LEFT = (LENGTH - GRAM) // 2
#: Bytes of text for one pack of segments and for one shard, about; a shard is sorted in pieces of PIECE bytes at most (unless one key has more).
PACK_BYTES, SHARD_BYTES, PIECE = 12 << 20, 8 << 20, 1 << 20
#: Rows that are handed to Python at once: whole texts are long.
BATCH_ROWS = 512
#: Bytes of text whose segments are found, or which are cut, at once.
SLICE = 1 << 19


#: Bytes in another order, for a second hash that is independent of the first.
OTHER = np.random.default_rng(77).permutation(256).astype(np.uint8)


def _least_ahead(key: np.ndarray, width: int) -> np.ndarray:
    """For each place the least of the `width` keys from there on."""
    done = 1
    while done * 2 <= width:
        key = np.minimum(key[:-done], key[done:])
        done *= 2
    return np.minimum(key[: len(key) - (width - done)], key[width - done :]) if done < width else key


def segments(texts: list) -> tuple[np.ndarray, ...]:
    """Of all texts: text number, start, length, the minimizer's place from the start, its hash, and two hashes of the bytes."""
    data, at = joined(texts)
    n = len(data)
    if n < LENGTH + 1:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(3))
    prefix = prefix_hash(data)
    grams = span_hash(prefix, np.arange(n - GRAM + 1), np.arange(GRAM, n + 1))
    bits = U(n.bit_length())
    key = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_least_ahead(key, LENGTH - GRAM + 1) & ((U(1) << bits) - U(1))).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(at))[: len(anchor)]
    inside = np.arange(len(anchor)) + LENGTH <= at[text + 1] - 1
    begins = inside & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | ~inside[:-1] | (text[1:] != text[:-1])])
    first = np.flatnonzero(begins)
    run = np.cumsum(begins) - 1
    size = np.bincount(run[inside], minlength=len(first)) + LENGTH - 1
    of = text[first]
    other = span_hash(prefix_hash(OTHER[data]), first, first + size)
    return of, first - at[of], size, anchor[first] - first, grams[anchor[first]], span_hash(prefix, first, first + size), other


def place(start: np.ndarray, size: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Start, length and minimizer's place in one number; lengths are under 256 and places under 128."""
    return start.astype(np.int64) << 16 | size << 8 | anchor


def _firsts(content: np.ndarray, other: np.ndarray, doc: np.ndarray, row: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries in order of content and place; which are first of their content."""
    order = np.lexsort((where, row, doc, other, content))
    c, o = content[order], other[order]
    return order, np.concatenate([[True], (c[1:] != c[:-1]) | (o[1:] != o[:-1])]) if len(c) else np.zeros(0, bool)


MARK, OPEN = 0, 1


def parts(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about limit bytes of a column's texts each, of which none is made a Python string before its turn."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    cuts = (np.flatnonzero(np.diff((ends - 1) // limit)) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, len(ends)]):
        if a < b:
            yield batch.slice(a, b - a)


def marks_of(lists: pa.ListArray) -> Iterator[list[tuple[int, int]]]:
    """Each text's marks (start, size), as numbers of one text at a time: a slice may hold very many."""
    start, size = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
        yield list(zip(start[a:b].tolist(), size[a:b].tolist()))


@tidy
def sent(batches: Iterator[pa.RecordBatch], packs: int) -> Iterator[pa.RecordBatch]:
    """Packed segments (pack, minimizers, contents, docs, rows, places) of slices of (doc, row, text); places of repeated ones come without the first two."""
    for batch in (part for whole in batches for part in parts(whole, 2, SLICE)):
        ids, keys = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
        of, start, size, anchor, gram, content, other = segments(batch.column(2).to_pylist())
        if not len(of):
            continue
        doc, key, where, other = ids[of], keys[of], place(start, size, anchor), (other >> U(32)).astype(np.uint32)
        order, first = _firsts(content, other, doc, key, where)
        repeated = np.ones(len(of), bool)
        repeated[order] = ~first
        pack = ((mix(gram) >> U(32)) * U(packs) >> U(32)).astype(np.int64)  # minimizers are small hashes: mixed again, they spread
        new = np.flatnonzero(~repeated)
        new = new[np.lexsort((where[new], key[new], doc[new], pack[new]))]
        ends = np.searchsorted(pack[new], np.arange(packs + 1))
        rows = [(p, new[ends[p] : ends[p + 1]], True) for p in np.flatnonzero(np.diff(ends)).tolist()]
        again = np.flatnonzero(repeated)
        if len(again):  # settled already: dealt by slice, so that a segment of many documents fills no pack
            again = again[np.lexsort((where[again], key[again], doc[again]))]
            rows.append((int(mix(doc[again[:1]].astype(np.uint64))[0] % U(packs)), again, False))
        deltas = lambda x: zlib.compress(np.diff(x, prepend=0).tobytes(), 1)
        rows = [
            (p, *((gram[k].astype(np.uint32).tobytes(), content[k].tobytes(), other[k].tobytes()) if fresh else (b"", b"", b"")), deltas(doc[k]), deltas(key[k]), zlib.compress(where[k].tobytes(), 1))
            for p, k, fresh in rows
        ]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 6))], ["pack", "grams", "contents", "others", "docs", "rows", "places"])


PACKED = "pack int, grams binary, contents binary, others binary, docs binary, rows binary, places binary"
FOUND = "kind int, doc long, row long, place long"


def settled(rows: pa.Table) -> pa.Table:
    """Of a pack: places of repeated segments (MARK), and first places of segments whose minimizers have others (OPEN)."""
    fresh, marks = [], []
    for g, c, o, d, r, w in zip(*(rows[x].to_pylist() for x in ("grams", "contents", "others", "docs", "rows", "places"))):
        g, c, o, w = np.frombuffer(g, np.uint32), np.frombuffer(c, np.uint64), np.frombuffer(o, np.uint32), np.frombuffer(zlib.decompress(w), np.int64)
        d, r = (np.cumsum(np.frombuffer(zlib.decompress(x), np.int64)) for x in (d, r))
        fresh.append((g, c, o, d[: len(g)], r[: len(g)], w[: len(g)]))
        marks.append((d[len(g) :], r[len(g) :], w[len(g) :]))
    gram, content, other, *at = (np.concatenate(x) for x in zip(*fresh))
    order, first = _firsts(content, other, *at)
    again, head = order[~first], order[first]
    _, back, count = np.unique(gram[head], return_inverse=True, return_counts=True)
    opened = head[count[back] > 1]
    doc, row, place = (np.concatenate([*known, x[again], x[opened]]) for known, x in zip(zip(*marks), at))
    kind = np.full(len(doc), MARK, np.int32)
    kind[len(doc) - len(opened) :] = OPEN
    return pa.table({"kind": kind, "doc": doc, "row": row, "place": place})


@tidy
def fetched(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """The bytes of open segments, cut by which side of the minimizer their windows hold, with key and shard."""
    for batch in batches:
        rows = []
        for d, r, t, ps in zip(*(c.to_pylist() for c in batch.columns)):
            raw = t.encode("utf-8", "surrogatepass")
            for p in set(ps):
                start, size = p >> 16, p >> 8 & 255
                a, end = start + (p & 255), start + size
                if start <= a - LEFT:
                    rows.append((raw[a - LEFT : a + GRAM] + b"<", d, r, start, raw[start : min(end, a - LEFT + LENGTH)]))
                right = max(start, a - LEFT + 1)
                if right + LENGTH <= end:
                    rows.append((raw[a : a + LENGTH - LEFT + 1] + b">", d, r, right, raw[right:end]))
        key = np.array([int.from_bytes(hashlib.blake2b(k, digest_size=8).digest(), "little") >> 1 for k, *_ in rows], np.int64)
        for a in range(0, max(len(rows), 1), 65_536):
            part = rows[a : a + 65_536]
            if part:
                yield pa.RecordBatch.from_arrays([pa.array((key[a : a + 65_536] % shards).astype(np.int32)), pa.array(key[a : a + 65_536]), *[pa.array([x[i] for x in part], pa.int64()) for i in (1, 2, 3)], pa.array([x[4] for x in part], pa.binary())], ["shard", "key", "doc", "row", "start", "bytes"])


def repeated_windows(doc: np.ndarray, row: np.ndarray, start: np.ndarray, parts: list[bytes]) -> list[tuple[int, int, int]]:
    """Runs (row, start, length) of windows that also start earlier among the parts, whose windows are all different in place."""
    order = np.lexsort((start, row, doc))
    row, start, parts = row[order], start[order], [parts[i] for i in order]
    size = np.array([len(x) for x in parts])
    at = np.concatenate([[0], np.cumsum(size + 1)])
    raw = np.frombuffer(b"\0".join(x.replace(b"\0", b"\xfe") for x in parts) + b"\0", np.uint8)  # 0xFE is in no UTF-8
    of = np.repeat(np.arange(len(parts)), size + 1)
    sa = suffix_array(raw)
    common = common_prefixes(raw, sa)
    group = np.cumsum(common < LENGTH) - 1
    heads = np.flatnonzero(common < LENGTH)
    earliest = np.minimum.reduceat(sa, heads)[group]
    late = np.sort(sa[(sa != earliest)])
    late = late[late + LENGTH <= at[of[late] + 1] - 1]
    if not len(late):
        return []
    cut = np.flatnonzero(np.concatenate([[True], (late[1:] != late[:-1] + 1) | (of[late[1:]] != of[late[:-1]])]))
    runs = np.diff(np.concatenate([cut, [len(late)]])) + LENGTH - 1
    head = late[cut]
    return list(zip(row[of[head]].tolist(), (start[of[head]] + head - at[of[head]]).tolist(), runs.tolist()))


def sorted_shard(rows: pa.Table) -> pa.Table:
    """Marks of a shard: its segments go to the sort in pieces that hold whole keys; keys of one segment are left out."""
    key, doc, row, start = (rows[x].to_numpy() for x in ("key", "doc", "row", "start"))
    order = np.argsort(key, kind="stable")
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    order = order[count[back][order] > 1]
    body, out, begin, size = rows["bytes"], [], 0, 0
    for i, k in enumerate(order):
        size += LENGTH * 3 // 2
        last = i + 1 == len(order)
        if last or (size >= PIECE and key[order[i + 1]] != key[k]):
            piece = order[begin : i + 1]
            out += repeated_windows(doc[piece], row[piece], start[piece], body.take(pa.array(piece)).to_pylist())
            begin, size = i + 1, 0
    return pa.table({"row": pa.array([x for x, _, _ in out], pa.int64()), "start": pa.array([x for _, x, _ in out], pa.int64()), "size": pa.array([x for _, _, x in out], pa.int64())})


def cut(text: str | None, marks: list | None) -> tuple[bytes, list[tuple[int, int]], int]:
    """What is left of a text, the runs that go, and its bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    runs: list[list[int]] = []
    for a, n in sorted(marks or ()):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], a + n)
        else:
            runs.append([a, a + n])
    kept, at = [], 0
    for a, b in runs:
        kept.append(raw[at:a])
        at = b
    return b"".join(kept) + raw[at:], [tuple(r) for r in runs], len(raw)


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, text, doc (doc_id, or the largest number where there is none) and row, a number of each row: its file's in the order of names, and its place in that."""
    docs = filed(docs)
    files = docs.select(F.col("_metadata.file_path").alias("file")).distinct().orderBy("file").toPandas()["file"]  # the driver has listed these files already
    numbers = docs.sparkSession.createDataFrame([(f, i << 36) for i, f in enumerate(files)], "repeat_file string, file_row long")
    thin = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("repeat_file"), F.col("_metadata.row_index").alias("row_at"))
    return thin.join(F.broadcast(numbers), "repeat_file").select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc"), (F.col("file_row") + F.col("row_at")).alias("row"))


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Few rows at once for Python while a job runs; the session's setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def remove(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, runs (array of start and end), kept (the bytes left)."""
    size = docs.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    packs, shards = max(1, -(-size // PACK_BYTES)), max(1, -(-size // SHARD_BYTES))
    thin = placed(docs)
    whole = thin.filter(f"octet_length(text) >= {LENGTH}").select("doc", "row", "text")
    with small_batches(docs.sparkSession):
        found = materialise(whole.mapInArrow(lambda it: sent(it, packs), PACKED).groupBy("pack").applyInArrow(lambda rows: tidy(settled)(rows), FOUND), "repeat-found")
        opened = found.filter(f"kind = {OPEN}").groupBy("row").agg(F.collect_list("place").alias("places"))  # bounded by the document's own length
        bytes_of = whole.join(opened, "row").select("doc", "row", "text", "places").mapInArrow(lambda it: fetched(it, shards), "shard int, key long, doc long, row long, start long, bytes binary")
        marks = bytes_of.groupBy("shard").applyInArrow(lambda rows: tidy(sorted_shard)(rows), "row long, start long, size long")
        all_marks = found.filter(f"kind = {MARK}").selectExpr("row", "shiftright(place, 16) as start", "shiftright(place, 8) & 255L as size").unionByName(marks)
        per = materialise(all_marks.groupBy("row").agg(F.collect_list(F.struct("start", "size")).alias("marks")), "repeat-marks")
    discard(found)

    @tidy
    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, 1, SLICE)):
            rows = [cut(t, m) for t, m in zip(batch.column(1).to_pylist(), marks_of(batch.column(2)))]
            runs = pa.array([[{"start": s, "end": e} for s, e in r] for _, r, _ in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, _, n in rows], pa.int64()), runs, pa.array([k for k, _, _ in rows], pa.binary())], ["doc_id", "n_bytes", "runs", "kept"])

    return thin.join(per, "row", "left").select("doc_id", "text", "marks").mapInArrow(done, "doc_id long, n_bytes long, runs array<struct<start: long, end: long>>, kept binary")


def digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("runs").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
