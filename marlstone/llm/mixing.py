"""Mixing sources to target weights, in DataFrame and SQL functions only.

Each source's target is found by water filling. Whole passes over a source come first; the rest of its quota is drawn as
whole blocks of documents in a permuted order, and the block on the edge of the quota is drawn document by document, up to
the document that brings the words taken nearest to the target: no text is cut. A splitting tree deals the drawn blocks
to the output shards: each node orders its blocks by a keyed hash and gives the first half to its left child, which is a
multivariate-hypergeometric draw of the sources' quotas without replacement. Within a shard, documents are ordered by a
keyed hash (the local shuffle).

Defined cases: a null text has no words; a null source is a source of its own, last in the order; documents without
words are never taken; keys of documents hold their text's digest, so rows without doc_id and rows that repeat one are
dealt and drawn each for itself (of rows that repeat both, any may be drawn); an empty table gives an empty result; mix()
neither reads nor returns other columns, arranged() keeps all, whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SQL, filed, keyed, materialise

WEIGHTS = (3, 1, 2)
#: Words to take, as a multiple of all words, and the most of one source, as a multiple of its words.
TOTAL, CAP = 1.5, 2
#: Documents in a block, about.
BLOCK_DOCS = 4096
#: Documents of a shard that are shuffled together, about.
RUN_DOCS = 65_536
#: 2**DEPTH output shards.
DEPTH = 4
SEED = "mix-1"


def _key(*parts: str) -> Column:
    return F.expr(f"md5(concat_ws('|', '{SEED}', {', '.join(parts)}))")


def sizes(docs: DataFrame, *carry: str) -> DataFrame:
    return docs.select("doc_id", "source", F.expr(f"cast(size(regexp_extract_all(coalesce(text, ''), '{WORD_SQL}', 0)) as long)").alias("size"), F.expr("md5(cast(coalesce(text, '') as binary))").alias("digest"), *carry)


def targets(sized: DataFrame) -> DataFrame:
    """One row per source: source_size, target, n_docs. Tables of sources only; their number is that of the sources."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = per.withColumn("at", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.expr(f"element_at(array({', '.join(f'{w}D' for w in WEIGHTS)}), cast(at % {len(WEIGHTS)} as int) + 1)")
    )
    order = Window.orderBy("ratio", "at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0.0)
    level = (
        ranked.withColumn("cap", F.expr(f"cast({CAP} * source_size as double)")).withColumn("ratio", F.expr("cap / weight"))
        .withColumn("left", F.lit(TOTAL) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), zero))
        .withColumn("w_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero))
        .withColumn("level", F.expr("left / w_left"))
        .withColumn("n", F.row_number().over(order))
        .withColumn("level", F.expr("min_by(case when level <= ratio then level end, case when level <= ratio then n end)").over(everything))
    )
    return level.selectExpr("source", "source_size", "n_docs", "least(cap, level * weight) as target").selectExpr(
        "source", "source_size", "n_docs", "target",
        "case when source_size > 0 then cast(floor(target / source_size) as int) else 0 end as passes",
        "case when source_size > 0 then cast(round(target - floor(target / source_size) * source_size) as long) else 0L end as rest",
    )


def draws(sized: DataFrame) -> DataFrame:
    """Every document with its block, its whole passes and the words drawn besides (extra)."""
    t = targets(sized).withColumnRenamed("source", "s")
    placed = sized.join(t, F.col("source").eqNullSafe(F.col("s"))).withColumn(
        "block", F.expr(f"cast(pmod(cast(conv(substr(md5(concat_ws('|', '{SEED}', 'block', doc_id, digest)), 1, 12), 16, 10) as long), cast(ceil(n_docs / {BLOCK_DOCS}D) as long)) as long)")
    )
    per = placed.groupBy("source", "block").agg(F.sum("size").alias("block_size"), F.max("rest").alias("block_rest"))
    w = Window.partitionBy("source").orderBy(_key("'order'", "coalesce(source, '')", "block"), "block")
    drawn = per.withColumn("from_block", F.coalesce(F.sum("block_size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).selectExpr(
        "source as bs", "block as bb", "block_rest - from_block as room", "block_size"
    )
    all_of = placed.join(drawn, F.col("source").eqNullSafe(F.col("bs")) & (F.col("block") == F.col("bb"))).drop("bs", "bb")
    edge = F.expr("room > 0 and room < block_size")
    d = Window.partitionBy("source", "block").orderBy(_key("'doc'", "doc_id", "digest"), "doc_id", "size")
    in_block, sofar = Window.partitionBy("source", "block"), d.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (
        all_of.filter(edge).withColumn("upto", F.sum("size").over(sofar)).withColumn("gap", F.expr("room") - F.coalesce(F.max(F.expr("case when upto <= room then upto end")).over(in_block), F.lit(0)))
        .withColumn("fits", F.expr("upto > room and size > 0 and size < 2 * gap")).withColumn("filled", F.sum(F.expr("case when fits then size else 0L end")).over(sofar))
        .withColumn("extra", F.expr("case when upto <= room or (fits and 2 * filled - size < 2 * gap) then size else 0L end")).drop("upto", "gap", "fits", "filled")
    )
    whole = all_of.filter(~edge).withColumn("extra", F.expr("case when room >= block_size then size else 0L end"))
    return whole.unionByName(cut)


def split_tree(units: DataFrame) -> DataFrame:
    """Deal units (source, block, pass) to 2**DEPTH shards; units are blocks, so this table is a few thousandths of the input."""
    t = units.withColumn("node", F.lit(0))
    for level in range(DEPTH):
        w = Window.partitionBy("node")
        order = w.orderBy(_key(f"'level{level}'", "coalesce(source, '')", "block", "pass"), "source", "block", "pass")
        t = t.withColumn("rn", F.row_number().over(order)).withColumn("cnt", F.count("*").over(w)).withColumn("node", F.expr("node * 2 + case when 2 * rn > cnt + cnt % 2 then 1 else 0 end")).drop("rn", "cnt")
    return t.withColumnRenamed("node", "shard")


def planned(sized: DataFrame, *carry: str) -> DataFrame:
    drawn = materialise(draws(materialise(sized, "mix-size")), "mix-draw")
    per = drawn.groupBy("source", "block").agg(F.max("passes").alias("passes"), F.max((F.col("extra") > 0).cast("int")).alias("more"))
    units = per.select("source", "block", F.explode(F.expr("case when passes + more > 0 then sequence(1, passes + more) else cast(array() as array<int>) end")).alias("pass"))
    dealt = split_tree(units).groupBy("source", "block").agg(F.expr("transform(sort_array(collect_list(struct(pass, shard))), x -> x.shard)").alias("all_shards")).withColumnsRenamed({"source": "us", "block": "ub"})
    return drawn.join(dealt, F.col("source").eqNullSafe(F.col("us")) & (F.col("block") == F.col("ub")), "left").selectExpr(
        "doc_id", "size", "source_size", "target", "passes * size + extra as taken",
        "case when size > 0 and passes + cast(extra > 0 as int) > 0 then slice(all_shards, 1, passes + cast(extra > 0 as int)) else cast(array() as array<int>) end as shards",
        "digest", *carry,
    )


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: size, source_size, target, taken, and the shards that its passes go to."""
    return planned(sizes(docs)).drop("digest")


def arranged(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of docs, once for each time they are drawn, dealt to shards and shuffled within them. The plan is joined to rows by their place in the table."""
    docs = filed(docs)
    key = ["row_file", "row_at"]
    plan = planned(sizes(keyed(docs.select("doc_id", "source", "text")), *key), *key)
    runs = max(1, -(-docs.count() // (RUN_DOCS << DEPTH)))
    drawn = plan.filter("taken > 0").select(*key, "doc_id", "digest", F.posexplode("shards").alias("copy", "shard"))
    dealt = drawn.withColumn("run", F.expr(f"pmod(xxhash64(doc_id, digest, copy), {runs})")).withColumn("order", _key("'shuffle'", "doc_id", "digest", "copy")).drop("doc_id", "digest")
    # the key comes from the file, beside the row as a struct, so that no name clashes
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("_metadata.file_path").alias("row_file"), F.col("_metadata.row_index").alias("row_at"))
    return row.join(dealt, key).repartition("shard", "run").sortWithinPartitions("shard", "run", "order").select("row.*")


def digest(mixed: DataFrame) -> DataFrame:
    return mixed.selectExpr("doc_id", "size", "source_size", "target", "taken", "array_join(shards, ',') as shards")


def _levels() -> str:
    """The splitting tree in SQL, a level at a time."""
    out = ["t0 AS (SELECT *, 0 AS node FROM u)"]
    for k in range(DEPTH):
        key = f"md5('{SEED}|level{k}|' || coalesce(source, '') || '|' || block || '|' || pass)"
        out.append(
            f"t{k + 1} AS (SELECT source, block, pass, node * 2 + CASE WHEN 2 * rn > cnt + cnt % 2 THEN 1 ELSE 0 END AS node FROM (SELECT *, count(*) OVER (PARTITION BY node) AS cnt, "
            f"row_number() OVER (PARTITION BY node ORDER BY {key}, source NULLS FIRST, block, pass) AS rn FROM t{k}))"
        )
    return ", ".join(out)


DOC_ORDER = f"md5(concat_ws('|', '{SEED}', 'doc', doc_id, digest)), doc_id, size"

SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS pos FROM d GROUP BY source
), r AS (
  SELECT *, CAST({CAP} * source_size AS DOUBLE) AS cap, CAST(CASE pos % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS DOUBLE) AS weight FROM per
), o AS (
  SELECT *, cap / weight AS ratio, ({TOTAL} * sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level,
    row_number() OVER (ORDER BY cap / weight, pos) AS n
  FROM r WINDOW w AS (ORDER BY cap / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT level AS lam FROM o WHERE level <= ratio ORDER BY n LIMIT 1
), t AS (
  SELECT source, source_size, n_docs, least(cap, lam * weight) AS target FROM o LEFT JOIN l ON true
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS INT) ELSE 0 END AS passes,
    CASE WHEN source_size > 0 THEN CAST(round(target - floor(target / source_size) * source_size) AS BIGINT) ELSE 0 END AS rest FROM t
), p AS (
  SELECT d.doc_id, d.size, d.digest, q.*, CAST(('0x' || substr(md5(concat_ws('|', '{SEED}', 'block', d.doc_id, d.digest)), 1, 12)) AS BIGINT) % CAST(ceil(n_docs / {BLOCK_DOCS}.0) AS BIGINT) AS block
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
), b AS (
  SELECT source, block, CAST(sum(size) AS BIGINT) AS block_size, max(rest) - coalesce(sum(CAST(sum(size) AS BIGINT)) OVER (PARTITION BY source ORDER BY md5('{SEED}|order|' || coalesce(source, '') || '|' || block), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
  FROM p GROUP BY source, block
), e AS (
  SELECT p.*, room, block_size, sum(size) OVER (PARTITION BY p.source, p.block ORDER BY {DOC_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source AND p.block = b.block
), g AS (
  SELECT *, room - coalesce(max(CASE WHEN upto <= room THEN upto END) OVER (PARTITION BY source, block), 0) AS gap FROM e
), f AS (
  SELECT *, upto > room AND size > 0 AND size < 2 * gap AS fits FROM g
), y AS (
  SELECT *, sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY source, block ORDER BY {DOC_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM f
), x AS (
  SELECT *, CASE WHEN room >= block_size THEN size WHEN room > 0 AND (upto <= room OR (fits AND 2 * filled - size < 2 * gap)) THEN size ELSE 0 END AS extra FROM y
), u AS (
  SELECT source, block, unnest(range(1, 1 + passes + more)) AS pass FROM (
    SELECT source, block, max(passes) AS passes, max(CASE WHEN extra > 0 THEN 1 ELSE 0 END) AS more FROM x GROUP BY source, block)
), {_levels()}, s AS (
  SELECT source, block, list(node ORDER BY pass) AS nodes FROM t{DEPTH} GROUP BY source, block
)
SELECT doc_id, size, source_size, target, CAST(passes * size + extra AS BIGINT) AS taken,
  CASE WHEN size > 0 AND passes + CASE WHEN extra > 0 THEN 1 ELSE 0 END > 0 THEN array_to_string(nodes[1:passes + CASE WHEN extra > 0 THEN 1 ELSE 0 END], ',') ELSE '' END AS shards
FROM x LEFT JOIN s ON x.source IS NOT DISTINCT FROM s.source AND x.block = s.block
"""
