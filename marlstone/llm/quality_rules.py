"""Quality rules with host verdicts, in DataFrame and SQL functions only.

Rules are measured per document; each rule's failures are counted per host (the column source), the hosts' failure rates
are shrunk towards that rule's empirical beta prior, fitted by moments over all hosts, and the hosts' verdicts are joined
back: a host whose shrunk rate under any rule is above MAX_HOST_RATE is rejected as a whole.

Defined cases: a null text counts as empty (no word, base_failed); a null source is a host of its own; repeated rows are
each judged and counted; an empty table gives an empty result; judge() neither reads nor returns other columns, keep()
keeps all, whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_SQL, materialise

#: A document with fewer words fails.
MIN_WORDS = 20
#: A document with more than this share (in hundredths) of its words in repeated windows fails.
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: A host whose shrunk failure rate is above this is rejected as a whole.
MAX_HOST_RATE = 0.8
#: Rules that hosts are judged by, in terms of a document's measures; the first two make base_failed.
RULES = {
    "few_words": f"n_words < {MIN_WORDS}", "repeated_words": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": "10 * n_symbols > word_chars", "repeated_lines": "n_dup_lines > 2",
}
#: Bounds of the prior's weight, in documents.
PRIOR_WEIGHT = (1.0, 1e6)
SYMBOLS = "#*$%&|<>"


def metrics(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, the columns in carry, and the base measures of every whole text.

    A window is a 64-bit hash of its words' hashes. Only a text with a repeated window sorts its windows with their
    positions: neighbours in that order with equal hashes are repeated, and their positions are merged into covered words.
    """
    h = ", ".join(f"h[i + {k}]" for k in range(WINDOW))
    own = ("doc_id", "source", *carry)
    return (
        docs.select(*own, F.coalesce("text", F.lit("")).alias("t"))
        .select(*own, "t", F.expr(f"regexp_extract_all(t, '{WORD_SQL}', 0)").alias("w"))
        .selectExpr(
            *own,
            "cast(size(w) as long) as n_words",
            "cast(length(translate(t, ' \\t\\n\\u000B\\u000C\\r', '')) as long) as word_chars",
            f"cast(length(t) - length(translate(t, '{SYMBOLS}', '')) as long) as n_symbols",
            r"filter(split(t, '\\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]') as lines",
            "transform(w, x -> xxhash64(x)) as h",
        )
        .selectExpr(
            *own, "n_words", "word_chars", "n_symbols",
            "cast(size(lines) - size(array_distinct(lines)) as long) as n_dup_lines",
            f"case when n_words >= {WINDOW} then transform(sequence(0, cast(n_words as int) - {WINDOW}), i -> xxhash64({h})) end as wins",
        )
        .selectExpr(
            *own, "n_words", "word_chars", "n_symbols", "n_dup_lines",
            "case when size(wins) > size(array_distinct(wins)) then sort_array(transform(wins, (x, i) -> struct(x as h, i as p))) end as s",
        )
        .selectExpr(
            *own, "n_words", "word_chars", "n_symbols", "n_dup_lines",
            "sort_array(array_distinct(flatten(zip_with(s, slice(s, 2, size(s)), (a, b) -> case when a.h = b.h then array(a.p, b.p) else cast(array() as array<int>) end)))) as p",
        )
        .selectExpr(
            *own, "n_words", "word_chars", "n_symbols", "n_dup_lines",
            f"coalesce(aggregate(zip_with(p, slice(p, 2, greatest(size(p), 1)), (a, b) -> case when b is null then {WINDOW} else least({WINDOW}, b - a) end), 0L, (t, x) -> t + x), 0L) as n_repeat_words",
        )
        .withColumn("base_failed", F.expr(f"{RULES['few_words']} or {RULES['repeated_words']}"))
    )


def _double(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def _weight(rule: str) -> str:
    """The weight of a rule's prior from sums over the hosts: n documents, k hosts, f_ failures, q_ sum of failures squared per document."""
    mean, (low, high) = f"{_double(f'f_{rule}')} / n", PRIOR_WEIGHT
    spread = f"(q_{rule} / n - ({mean}) * ({mean}) - ({mean}) * (1 - {mean}) * k / n)"
    return f"CASE WHEN {spread} > {_double('1e-9')} THEN greatest({_double(low)}, least({_double(high)}, ({mean}) * (1 - {mean}) / {spread} - 1)) ELSE {_double(high)} END"


COUNTED = ", ".join(f"CAST(sum(CASE WHEN {x} THEN 1 ELSE 0 END) AS BIGINT) AS host_{r}" for r, x in RULES.items())
SUMMED = "CAST(sum(host_docs) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS k, " + ", ".join(f"CAST(sum(host_{r}) AS BIGINT) AS f_{r}, sum(host_{r} * {_double(f'host_{r}')} / host_docs) AS q_{r}" for r in RULES)
PRIORS = ", ".join(f"{_double(f'f_{r}')} / n AS m_{r}, {_weight(r)} AS w_{r}" for r in RULES)
HOST_OK = " AND ".join(f"(host_{r} + m_{r} * w_{r}) / (host_docs + w_{r}) <= {_double(MAX_HOST_RATE)}" for r in RULES)
HOST_COLUMNS = ["host_docs", *[f"host_{r}" for r in RULES]]


def hosts(measured: DataFrame) -> DataFrame:
    """One row per host: documents, failures of each rule, and the verdict on the shrunk rates."""
    per = measured.groupBy("source").agg(F.count("*").alias("host_docs"), *[F.expr(x) for x in COUNTED.split(", ")])
    prior = per.agg(*[F.expr(x) for x in SUMMED.split(", ")]).select("*", *[F.expr(f"{_double(f'f_{r}')} / n").alias(f"m_{r}") for r in RULES], *[F.expr(_weight(r)).alias(f"w_{r}") for r in RULES])
    return per.crossJoin(F.broadcast(prior)).select(F.col("source").alias("host"), *HOST_COLUMNS, F.expr(HOST_OK).alias("host_ok"))  # one row


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(docs: DataFrame) -> DataFrame:
    """The measures of each document with base_failed, kept and its host's counts."""
    measured = materialise(metrics(docs), "quality")
    h = hosts(measured)
    return measured.join(h, F.col("source").eqNullSafe(F.col("host")), "left").select(
        "doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & F.coalesce("host_ok", F.lit(True))).alias("kept"), *HOST_COLUMNS
    )


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns. Texts are measured once: what passes the base rules is written beside its measures."""
    row = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole_row"))
    measured = metrics(row, ("whole_row",)).select("source", *MEASURES, "base_failed", F.expr("case when not base_failed then whole_row end").alias("whole_row"))
    judged = materialise(measured, "quality")
    bad = hosts(judged).filter("not host_ok").select("host")
    return judged.filter("not base_failed").join(bad, F.col("source").eqNullSafe(F.col("host")), "left_anti").select("whole_row.*")


SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (
    SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
  )
), rep AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM win WHERE c > 1) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
), m AS (
  SELECT d.doc_id, d.source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
    CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)
), b AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m
), h AS (
  SELECT source, count(*) AS host_docs, {COUNTED} FROM b GROUP BY source
), p AS (
  SELECT {PRIORS} FROM (SELECT {SUMMED} FROM h)
)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {HOST_OK} AS kept, {", ".join(HOST_COLUMNS)}
FROM b JOIN h ON b.source IS NOT DISTINCT FROM h.source CROSS JOIN p
"""
