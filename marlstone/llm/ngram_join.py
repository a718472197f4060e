"""N-gram Jaccard join by prefix filters under several global token orders.

A document's set holds the 64-bit hashes of its distinct word shingles. Under any global order of tokens, two sets that
are alike enough share a token among the first n - ceil(t n) + 1 of each; candidates must do so under ORDERS orders at
once. All orders put tokens that no other text holds first, then go by frequency (ever more coarsely) and a hash of their
own; the frequencies are counted over all different texts.

1. Of rows with one text, told by SHA-256, one goes on for all. Rows are dealt into chunks of about CHUNK_BYTES. Each chunk
   sends its tokens' fingerprints to token buckets, which answer with a byte for each: how many texts hold it. So each text knows its prefixes. If tokens that it alone
   holds fill them, it has no partner. (A fingerprint shared by chance only makes a token look more frequent, which loses
   nothing.)
2. Equal sets are one class. Classes that share a prefix token under the first order are joined into clusters, by a star
   from each token's smallest class, so that rows stay linear in the prefixes. Clusters of more than TILE classes are
   split again in the same way under the second and third order: links need a shared token under each.
3. Small clusters are verified in packs. A large one is cut into tiles of TILE classes, each with the cluster's smallest
   class; only classes that are not linked with that one by then meet all other tiles. Within a task, the filters of all
   orders are intersected, what is left is verified exactly, and a spanning forest of the links is given back.
4. The forests' components are the result.

Defined cases: a null, empty or blank text has an empty set (n_shingles 0) and is linked with nothing; a text of fewer
words than a shingle has one shingle, its whole sequence; rows are told apart by their place in the table, so those that
repeat a doc_id, or have none, are each joined by their own text (component_id is the smallest doc_id that links lead to,
null if no row there has one); an empty table gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, discard, hashed_words, keyed, materialise, mix, release, slices, tidy
from .components import components

ORDERS = 3
SEEDS = [U(0x243F6A8885A308D3), U(0x13198A2E03707344), U(0xA4093822299F31D0)]
#: By what frequencies are divided under each order before hashes decide.
COARSE = (1, 4, 16)
#: Documents and bytes of text in a chunk, tokens in a bucket, about.
CHUNK_DOCS, CHUNK_BYTES, BUCKET_TOKENS = 2_048, 4 << 20, 2_000_000
#: Classes in a tile and in a pack of small clusters, about.
TILE, PACK = 512, 2_048


def shingles(texts: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text one after the other, and where each text's begin."""
    out, sizes = [np.zeros(0, np.uint64)], [0]
    for a, b in slices(texts, 1 << 19):
        words, first = hashed_words(texts[a:b])
        n = len(words)
        long = words[: max(n - width + 1, 0)].copy()
        for k in range(1, width):
            long = mix(long * U(3) + words[k : k + len(long)])
        for i, c in zip(first.tolist(), np.diff(first).tolist()):
            if c >= width:
                x = np.sort(long[i : i + c - width + 1])
                out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
            else:
                x = np.array([c] if c else [], np.uint64)
                for w in words[i : i + c]:
                    x = mix(x * U(5) + w)
                out.append(x)
            sizes.append(len(out[-1]))
    return np.concatenate(out), np.cumsum(sizes)


class Chunk:
    """A chunk's sets in order of their rows' keys, and its tokens by bucket."""

    def __init__(self, rows: pa.Table, width: int, buckets: int) -> None:
        keys = [rows[c].to_numpy() for c in ("row_file", "row_at")]
        self.order = np.lexsort(keys[::-1])
        self.tokens, self.at = shingles(rows["text"].take(pa.array(self.order)).to_pylist(), width)
        self.size = np.diff(self.at)
        bucket = ((self.tokens >> U(32)) * U(buckets) >> U(32)).astype(np.int32)
        self.by_bucket = np.argsort(bucket, kind="stable")
        self.ends = np.searchsorted(bucket[self.by_bucket], np.arange(buckets + 1))

    def digests(self) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            sums = [np.concatenate([[U(0)], np.cumsum(mix(self.tokens ^ s), dtype=np.uint64)]) for s in SEEDS[:2]]
            return [(x[self.at[1:]] - x[self.at[:-1]]).view(np.int64) for x in sums]


def chosen(rows: pa.Table, firsts: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Those rows that stand for their texts, and what is known of each, in one order."""
    pairs = lambda t: zip(t["row_file"].to_pylist(), t["row_at"].to_pylist())
    place = {key: i for i, key in enumerate(pairs(firsts))}
    at = [(i, place[key]) for i, key in enumerate(pairs(rows)) if key in place]
    return rows.take(pa.array([i for i, _ in at], pa.int64())), firsts.take(pa.array([i for _, i in at], pa.int64()))


@tidy
def requests(rows: pa.Table, firsts: pa.Table, width: int, buckets: int) -> pa.Table:
    if not rows.num_rows or not firsts.num_rows:
        return pa.table({"bucket": pa.array([], pa.int32()), "chunk": pa.array([], pa.int64()), "prints": pa.array([], pa.binary())})
    rows, _ = chosen(rows, firsts)
    c = Chunk(rows, width, buckets)
    prints = c.tokens[c.by_bucket].astype(np.uint32)
    some = np.flatnonzero(np.diff(c.ends))
    chunk = rows["chunk"][0].as_py()
    return pa.table({"bucket": pa.array(some.astype(np.int32)), "chunk": pa.array([chunk] * len(some), pa.int64()), "prints": pa.array([prints[c.ends[b] : c.ends[b + 1]].tobytes() for b in some], pa.binary())})


@tidy
def answers(rows: pa.Table) -> pa.Table:
    """For each fingerprint of a bucket a byte that grows with its number of texts; 0: only one."""
    parts = [np.frombuffer(x, np.uint32) for x in rows["prints"].to_pylist()]
    _, where, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    codes = np.minimum(255, np.round(16 * np.log2(count))).astype(np.uint8)[where]
    ends = np.cumsum([0, *map(len, parts)])
    return pa.table({"chunk": rows["chunk"], "bucket": rows["bucket"], "codes": pa.array([zlib.compress(codes[a:b].tobytes(), 1) for a, b in zip(ends, ends[1:])], pa.binary())})


def needed(n: int, percent: int) -> int:
    """The least intersection of a set of n with any set that it is linked with."""
    return -(-percent * n // 100)


def prefix(tokens: np.ndarray, codes: np.ndarray, order: int, length: int) -> np.ndarray:
    """The first `length` tokens under an order, without those that only this text holds."""
    rank = mix(tokens ^ SEEDS[order])
    band = np.where(codes == 0, 0, 1 + codes.astype(np.int64) // COARSE[order])
    first = np.lexsort((rank, band))[:length]
    return tokens[first[codes[first] > 0]]


MEMBERS = "copy binary, least long, copies long, n_shingles long, high long, low long, tokens binary, codes binary"
#: Stands for a bucket where replies hold what is known of a chunk's rows that stand for their texts.
FIRSTS = -1


@tidy
def members(rows: pa.Table, replies: pa.Table, width: int, buckets: int, percent: int) -> pa.Table:
    """All texts of a chunk; with tokens and codes if other texts hold tokens of their prefixes."""
    if not rows.num_rows:
        rows = pa.table({"row_file": pa.array([], pa.int64()), "row_at": pa.array([], pa.int64()), "text": pa.array([], pa.string())})
    is_first = pa.array(replies["bucket"].to_numpy() == FIRSTS)
    rows, firsts = chosen(rows, replies.filter(is_first))
    replies = replies.filter(pa.array(replies["bucket"].to_numpy() != FIRSTS))
    c = Chunk(rows, width, buckets)
    sorted_codes = np.zeros(len(c.tokens), np.uint8)
    for b, held in zip(replies["bucket"].to_pylist(), replies["codes"].to_pylist()):
        sorted_codes[c.ends[b] : c.ends[b + 1]] = np.frombuffer(zlib.decompress(held), np.uint8)
    codes = np.empty_like(sorted_codes)
    codes[c.by_bucket] = sorted_codes
    tokens_out, codes_out = [], []
    for i, n in enumerate(c.size.tolist()):
        a, b = c.at[i], c.at[i + 1]
        alone = int((codes[a:b] == 0).sum())
        keep = n > 0 and alone < n - needed(n, percent) + 1
        tokens_out.append(c.tokens[a:b].tobytes() if keep else None)
        codes_out.append(codes[a:b].tobytes() if keep else None)
    high, low = c.digests()
    own = firsts.take(pa.array(c.order))
    return pa.table({"copy": own["copy"], "least": own["least"], "copies": own["copies"], "n_shingles": pa.array(c.size), "high": pa.array(high), "low": pa.array(low), "tokens": pa.array(tokens_out, pa.binary()), "codes": pa.array(codes_out, pa.binary())})


def heads(batches, percent: int, order: int):
    """token, cls, part: the prefix of each class under an order."""
    for batch in batches:
        out_t, out_c, out_p = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for cls, t, k, part in zip(*(batch.column(i).to_pylist() for i in range(4))):
            t, k = np.frombuffer(t, np.uint64), np.frombuffer(k, np.uint8)
            p = prefix(t, k, order, len(t) - needed(len(t), percent) + 1)
            out_t.append(p.view(np.int64))
            out_c.append(np.full(len(p), cls, np.int64))
            out_p.append(np.full(len(p), part, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_t, out_c, out_p)], ["token", "cls", "part"])
    release()


def clusters(rows: DataFrame, percent: int, order: int) -> DataFrame:
    """cls, cluster: classes of one part that prefix tokens under an order lead to; those that share none are left out."""
    posted = materialise(rows.select("cls", "tokens", "codes", "part").mapInArrow(lambda it: heads(it, percent, order), "token long, cls long, part long"), "ngram-prefix")
    least = posted.groupBy("part", "token").agg(F.min("cls").alias("low"), F.count("*").alias("c")).filter("c > 1").select("part", "token", "low")
    stars = posted.join(least, ["part", "token"]).filter("cls <> low").select(F.col("cls").alias("a"), F.col("low").alias("b")).distinct()
    out = components(stars).selectExpr("node as cls", "root as cluster")
    discard(posted)
    return out


def _incidence(sets: list, least: int = 2):
    """Blocks of the 0/1 matrix of sets by tokens, only tokens that `least` sets hold."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, col, count = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(count >= least) - 1
    use = (count >= least)[col]
    row, col = row[use], number[col[use]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    step = 4096
    for begin in range(0, int(col[-1]) + 1 if len(col) else 0, step):
        a, b = np.searchsorted(col, [begin, begin + step])
        m = np.zeros((len(sets), min(step, int(col[-1]) + 1 - begin)), np.float32)
        m[row[a:b], col[a:b] - begin] = 1
        yield m


def links(sets: list, codes: list, percent: int) -> np.ndarray:
    """Which pairs of sets are linked: filters of all orders intersected, then verified."""
    size = np.array([len(s) for s in sets])
    mask = 100 * np.minimum.outer(size, size) >= percent * np.maximum.outer(size, size)
    for order in range(ORDERS):
        heads = [prefix(s, c, order, len(s) - needed(len(s), percent) + 1) for s, c in zip(sets, codes)]
        shared = np.zeros(mask.shape, bool)
        for m in _incidence(heads):
            shared |= (m @ m.T) > 0
        mask &= shared
    np.fill_diagonal(mask, False)
    if not mask.any():
        return mask
    some = np.flatnonzero(mask.any(1))
    both = np.zeros((len(some), len(some)), np.float32)
    for m in _incidence([sets[i] for i in some]):
        both += m @ m.T
    both = both.astype(np.int64)
    union = size[some][:, None] + size[some][None, :] - both
    out = np.zeros(mask.shape, bool)
    out[np.ix_(some, some)] = (100 * both >= percent * union) & mask[np.ix_(some, some)]
    return out


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links, by searching from each vertex in turn."""
    left, out = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root] = False
        front = [root]
        while front:
            new = np.flatnonzero(linked[front.pop()] & left)
            left[new] = False
            out += [(root, int(i)) for i in new]
            front += new.tolist()
    return out


@tidy
def verified(rows: pa.Table, percent: int) -> pa.Table:
    """Spanning links within each cluster of a group of rows."""
    cluster, ids = rows["cluster"].to_numpy(), rows["cls"].to_numpy()
    order = np.lexsort((ids, cluster))
    cluster, ids = cluster[order], ids[order]
    edges: list[tuple[int, int]] = []
    ends = np.flatnonzero(np.concatenate([cluster[1:] != cluster[:-1], [True]])) + 1
    tokens, codes = rows["tokens"], rows["codes"]
    for a, b in zip(np.concatenate([[0], ends[:-1]]), ends):
        at = [i for k, i in enumerate(order[a:b]) if k == 0 or ids[a + k] != ids[a + k - 1]]
        if len(at) > 1:
            own = rows["cls"].take(pa.array(at)).to_numpy()
            found = links([np.frombuffer(tokens[int(i)].as_py(), np.uint64) for i in at], [np.frombuffer(codes[int(i)].as_py(), np.uint8) for i in at], percent)
            edges += [(int(own[x]), int(own[y])) for x, y in forest(found)]
    return pa.table({"a": pa.array([x for x, _ in edges], pa.int64()), "b": pa.array([y for _, y in edges], pa.int64())})


def groups(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """row_file, row_at, doc_id, n_shingles, component_id, component: one row per row of docs; component is null for a row without links."""
    own = keyed(docs.select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    thin = materialise(own.select("row_file", "row_at", "doc_id", F.unhex(F.sha2(text, 256)).alias("copy"), F.octet_length(text).cast("long").alias("bytes")), "ngram-rows")
    firsts = materialise(thin.groupBy("copy").agg(*[F.first(c).alias(c) for c in ("row_file", "row_at", "bytes")], F.min("doc_id").alias("least"), F.count("*").alias("copies")), "ngram-firsts")
    total = lambda t: t.select(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()
    size = total(thin)
    chunks, buckets = max(1, -(-size["n"] // CHUNK_DOCS), -(-size["b"] // CHUNK_BYTES)), max(1, -(-total(firsts)["b"] // (6 * BUCKET_TOKENS)))
    chunk = F.expr(f"pmod(xxhash64(row_file, row_at), {chunks})").alias("chunk")
    dealt, known = own.select("row_file", "row_at", "text", chunk), firsts.select(chunk, "row_file", "row_at", "copy", "least", "copies")
    asked = dealt.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(lambda t, k: requests(t, k, width, buckets), "bucket int, chunk long, prints binary")
    told = asked.groupBy("bucket").applyInArrow(lambda t: answers(t), "chunk long, bucket int, codes binary")
    told = told.unionByName(known.withColumn("bucket", F.lit(FIRSTS)), allowMissingColumns=True)
    rows = materialise(dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(lambda t, r: members(t, r, width, buckets, percent), MEMBERS), "ngram-members")
    discard(firsts)
    digest = ["high", "low", "n_shingles"]
    classes = rows.filter("tokens is not null").groupBy(digest).agg(F.min("least").alias("least"), F.first("tokens").alias("tokens"), F.first("codes").alias("codes"))
    held = materialise(classes.withColumn("cls", F.monotonically_increasing_id()), "ngram-classes")
    texts = materialise(rows.select("copy", "least", "copies", *digest, F.col("tokens").isNotNull().alias("some")), "ngram-texts")
    named = materialise(held.select(*digest, "cls", "least"), "ngram-names")
    discard(rows)
    cluster = materialise(clusters(held.withColumn("part", F.lit(0).cast("long")), percent, 0), "ngram-cluster")
    large = lambda: cluster.groupBy("cluster").count().filter(f"count > {TILE}").select("cluster")
    for order in range(1, ORDERS):
        if not large().head(1):
            break
        inside = cluster.join(large(), "cluster", "left_semi").withColumnRenamed("cluster", "part")
        finer = materialise(cluster.join(large(), "cluster", "left_anti").select("cls", "cluster").unionByName(clusters(held.join(inside, "cls"), percent, order)), "ngram-cluster")
        discard(cluster)
        cluster = finer
    placed = materialise(held.select("cls", "tokens", "codes").join(cluster, "cls"), "ngram-placed")
    discard(held, cluster)
    sizes = placed.groupBy("cluster").agg(F.count("*").alias("m"))
    tiles = materialise(sizes.filter(f"m > {TILE}").selectExpr("cluster", f"cast(ceil(m / {TILE}D) as int) as tiles"), "ngram-large")
    packs = max(1, -(-placed.count() // PACK))
    check = lambda t: verified(t, percent)
    edge = "a long, b long"
    small = placed.join(tiles, "cluster", "left_anti").withColumn("pack", F.expr(f"pmod(xxhash64(cluster), {packs})"))
    found = [materialise(small.groupBy("pack").applyInArrow(check, edge), "ngram-links")]
    tiled = placed.join(tiles, "cluster").withColumn("tile", F.expr("pmod(xxhash64(cls), tiles)"))
    pivots = placed.join(tiles, "cluster").filter("cls = cluster").withColumn("tile", F.explode(F.expr("sequence(0L, tiles - 1L)")))
    found.append(materialise(tiled.unionByName(pivots).groupBy("cluster", "tile").applyInArrow(check, edge), "ngram-links"))
    near = components(found[1]).selectExpr("node as cls", "root")
    rest = tiled.join(near, "cls", "left").filter("coalesce(root, cls) <> cluster").drop("root")
    many = rest.groupBy("cluster").agg(F.expr(f"cast(ceil(count(*) / {TILE}D) as int)").alias("rests"))
    left = rest.join(many, "cluster").withColumn("part", F.expr("pmod(xxhash64(cls, 1), rests)"))
    with_all = left.withColumn("tile", F.explode(F.expr("sequence(0L, tiles - 1L)"))).unionByName(tiled.join(many, "cluster").withColumn("part", F.explode(F.expr("sequence(0L, rests - 1L)"))))
    found.append(materialise(with_all.groupBy("cluster", "part", "tile").applyInArrow(check, edge), "ngram-links"))
    linked = components(found[0].unionByName(found[1]).unionByName(found[2])).selectExpr("node as cls", "root")
    rooted = named.join(linked, "cls", "left").withColumn("component", F.coalesce("root", "cls"))
    names = rooted.groupBy("component").agg(F.min("least").alias("name"))
    root = rooted.join(names, "component").select(*[F.col(c).alias(f"k_{c}") for c in digest], "component", "name")
    on = (F.col("some")) & (F.col("high") == F.col("k_high")) & (F.col("low") == F.col("k_low")) & (F.col("n_shingles") == F.col("k_n_shingles"))
    # a text that is linked with its own copies only is a component of its own, below all numbers of classes
    alone = F.when((F.col("copies") > 1) & (F.col("n_shingles") > 0), -1 - F.monotonically_increasing_id())
    told = materialise(texts.join(root, on, "left").select("copy", "n_shingles", F.coalesce("component", alone).alias("component"), F.when(F.col("component").isNotNull(), F.col("name")).when(alone.isNotNull(), F.col("least")).alias("name")), "ngram-told")
    out = materialise(thin.join(told, "copy").select("row_file", "row_at", "doc_id", "n_shingles", F.coalesce("name", "doc_id").alias("component_id"), "component"), "ngram-groups")
    discard(thin, texts, told, named, placed, tiles, *found)
    return out


def join(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links lead to)."""
    return groups(docs, width, percent).select("doc_id", "n_shingles", "component_id")


def repeated(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """row_file, row_at (of keyed()) of all rows but one of each component: that with the smallest doc_id stays, none being the largest."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_file", "row_at")
    rows = groups(docs, width, percent)
    linked = rows.filter("component is not null")
    stays = linked.groupBy("component").agg(F.min(order).alias("stays"))
    return linked.join(stays, "component").filter(order != F.col("stays")).select("row_file", "row_at")
