"""Importance resampling towards a target distribution: hashed word and bigram features, gains, Gumbel top-k.

Each task puts its words into a trie: under the root the words, under each word the words that follow it. A node holds how often
its path occurs and the CRC-32 of the path's bytes, from which that of a longer path is continued. Counts go into buckets by that CRC;
the buckets' totals over all documents and all target texts give each bucket its gain. Then documents walk tries
whose nodes have their bucket's gain attached. A trie is dropped once it has NODES words, and second levels after each slice of
texts, so memory is bounded; what was counted is in the buckets by then.

Defined cases: a null or empty text has no features and weighs 0; a null doc_id counts as empty text in the hash and comes first among ties;
repeated rows are counted, scored and drawn each for itself; without target texts all gains follow from T = 0; an empty table gives an
empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CRC_TABLE_SQL, crc32_sql, materialise, slices, tidy
from .ordering import ranked

BUCKETS, MIN_WORDS, SEED = 10_000, 20, 7
#: Hundredths of the documents with enough words that are drawn.
PERCENT = 25
#: Words of lower-cased UTF-8: digits, letters and all that isn't ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: A task's trie is begun anew after so many words, and a slice has so many characters.
NODES, SLICE = 1 << 18, 4 << 20
#: Words up to this length have their CRC continued for all edges at once.
SHORT = 48


def _crc_step() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


CRC_STEP = _crc_step()


class WordTrie(dict):
    """The first level: words with their node's number. crc: of each node's bytes; tail: of a space and the word; size: bytes of that tail."""

    def __init__(self) -> None:
        super().__init__()
        self.crc, self.tail, self.size = [], [], []

    def __missing__(self, word: bytes) -> int:
        node = self[word] = len(self)
        self.crc.append(zlib.crc32(word))
        self.tail.append(zlib.crc32(b" " + word))
        self.size.append(len(word) + 1)
        return node

    def walk(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The words' nodes of all texts with where each text begins, the CRCs of the second level's nodes, and the
        second-level node of each word but the first of its text (whose places come last)."""
        words, at = [], np.zeros(len(texts) + 1, np.int64)
        for i, t in enumerate(texts):
            if t:
                words += WORD.findall(t.encode("utf-8", "surrogatepass").lower())
            at[i + 1] = len(words)
        node = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        follows = np.ones(len(node), bool)
        follows[at[:-1][at[:-1] < len(node)]] = False
        place = np.flatnonzero(follows)
        edges, edge = np.unique((node[place - 1] << 32) | node[place], return_inverse=True)
        return node, at, self.continued(edges >> 32, edges & 0xFFFFFFFF), edge, place

    def continued(self, parent: np.ndarray, child: np.ndarray) -> np.ndarray:
        """CRC-32 of parent's word, a space and child's word: the parent's state passes the child's bytes (their number moves it, their own CRC is added)."""
        state, size = np.array(self.crc, np.uint32)[parent], np.array(self.size, np.int64)[child]
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            if n <= SHORT:
                c = state[at]
                for _ in range(n):
                    c = CRC_STEP[c & 255] ^ (c >> np.uint32(8))
                state[at] = c
            else:
                zeros = bytes(int(n))
                blank = zlib.crc32(zeros)
                state[at] = [zlib.crc32(zeros, int(c)) ^ blank for c in state[at]]
        return state ^ np.array(self.tail, np.uint32)[child]


@tidy
def _count(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    trie, total = WordTrie(), np.zeros(buckets, np.int64)
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for a, b in slices(texts, SLICE):
            node, _, crc, edge, _ = trie.walk(texts[a:b])
            seen = np.bincount(node, minlength=len(trie))
            total += np.bincount(np.array(trie.crc, np.int64) % buckets, weights=seen, minlength=buckets).astype(np.int64) if len(trie) else 0
            total += np.bincount(crc.astype(np.int64) % buckets, weights=np.bincount(edge, minlength=len(crc)), minlength=buckets).astype(np.int64) if len(crc) else 0
            if len(trie) > NODES:
                trie = WordTrie()
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])


def bucket_totals(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """How many features of the texts (column text) fall in each bucket: at most one row a bucket and task is shuffled."""
    counted = texts.select("text").mapInArrow(lambda batches: _count(batches, buckets), "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain: floor(1000 ln of the smoothed ratio of the bucket's shares in target and docs)."""
    both = bucket_totals(docs, buckets).withColumn("s", F.col("n")).withColumn("t", F.lit(0)).unionByName(bucket_totals(target, buckets).withColumn("s", F.lit(0)).withColumn("t", F.col("n")))
    held = docs.sparkSession.range(buckets).selectExpr("id as bucket", "0L as s", "0L as t").unionByName(both.selectExpr("bucket", "cast(s as long) s", "cast(t as long) t"))
    per = materialise(held.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "bucket-totals")
    ratio = f"(cast(t as double) + 1) * (cast(all_s as double) + {buckets}) / ((cast(s as double) + 1) * (cast(all_t as double) + {buckets}))"
    return per.crossJoin(F.broadcast(per.selectExpr("sum(s) as all_s", "sum(t) as all_t"))).selectExpr("bucket", f"cast(floor(1000 * ln({ratio})) as long) as gain")  # one row


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of each whole text, from a gain for each bucket."""
    held = docs.sparkSession.sparkContext.broadcast(gain)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, gain = WordTrie(), held.value
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts, SLICE):
                node, at, crc, edge, place = trie.walk(texts[a:b])
                each = gain[np.array(trie.crc, np.int64) % len(gain)][node] if len(node) else np.zeros(0, np.int64)
                each[place] += gain[crc.astype(np.int64) % len(gain)][edge]
                sums = np.concatenate([[0], np.cumsum(each)])
                words = np.diff(at)
                features = np.maximum(2 * words - 1, 0)
                weight = (sums[at[1:]] - sums[at[:-1]]) // np.maximum(features, 1)
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), *map(pa.array, (words, features, weight))], ["doc_id", "n_words", "n_features", "weight"])
                if len(trie) > NODES:
                    trie = WordTrie()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(seed: int = SEED) -> str:
    """A standard Gumbel variable in thousandths, from the hash of seed and doc_id."""
    h = f"cast(conv(substring(sha2(concat('{seed}:', coalesce(cast(doc_id as string), '')), 256), 1, 8), 16, 10) as double)"
    return f"cast(floor(-1000 * ln(-ln(({h} + cast(0.5 as double)) / 4294967296))) as long)"


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Every document's doc_id, n_features, weight, score, and rank (from 1) if it is drawn: the floor(percent * N / 100) highest scores of the N documents with enough words."""
    table = gains(docs, target, buckets).toArrow()  # one row a bucket
    gain = np.zeros(buckets, np.int64)
    gain[table["bucket"].to_numpy()] = table["gain"].to_numpy()
    scored = materialise(weigh(docs, gain).withColumn("score", F.col("weight") + F.expr(noise(seed))), "importance")
    enough = ranked(scored.filter(f"n_words >= {min_words}"), [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("n_features"), F.asc("weight")], "rank")
    drawn = scored.agg(F.expr(f"count_if(n_words >= {min_words}) * {percent} div 100").alias("drawn"))
    placed = enough.crossJoin(F.broadcast(drawn)).withColumn("rank", F.expr("case when rank <= drawn then rank end"))  # one row
    short = scored.filter(f"n_words < {min_words}").withColumn("rank", F.lit(None).cast("long"))
    return placed.drop("drawn").unionByName(short).select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents
), f AS (
  SELECT r, CAST(len(w) AS BIGINT) AS n_words, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS x FROM d
), per AS (
  SELECT r, x, count(*) AS n FROM f GROUP BY ALL
), b AS (
  SELECT x, count(*) AS n FROM (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS x FROM (SELECT coalesce({_WORDS}, []) AS w FROM benchmark)) GROUP BY x
), known AS (
  SELECT x, {crc32_sql("x")} % {BUCKETS} AS bucket FROM (SELECT x FROM per UNION SELECT x FROM b), {CRC_TABLE_SQL}
), s AS (
  SELECT bucket, sum(n) AS n FROM per JOIN known USING (x) GROUP BY bucket
), t AS (
  SELECT bucket, sum(n) AS n FROM b JOIN known USING (x) GROUP BY bucket
), g AS (
  SELECT bucket, floor(1000 * ln((CAST(coalesce(t.n, 0) AS DOUBLE) + 1) * (CAST((SELECT coalesce(sum(n), 0) FROM s) AS DOUBLE) + {BUCKETS})
    / ((CAST(coalesce(s.n, 0) AS DOUBLE) + 1) * (CAST((SELECT coalesce(sum(n), 0) FROM t) AS DOUBLE) + {BUCKETS})))) AS gain
  FROM s FULL JOIN t USING (bucket)
), w AS (
  SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / sum(n)) AS BIGINT) AS weight FROM per JOIN known USING (x) JOIN g USING (bucket) GROUP BY r
), scored AS (
  SELECT doc_id, len(d.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
    (CAST(CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM d LEFT JOIN w USING (r)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= {MIN_WORDS} ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS k, count(*) OVER (PARTITION BY n_words >= {MIN_WORDS}) AS c FROM scored
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CASE WHEN n_words >= {MIN_WORDS} AND k <= {PERCENT} * c // 100 THEN CAST(k AS BIGINT) END AS rank FROM placed
"""
