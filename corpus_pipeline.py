"""Corpus pipeline: quality rules, near duplicates, personal data, mixing, encoding.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents. SQL can't express the
surrogates and the encoding, so ORACLE_SQL is None. The near-duplicate stage is tested against brute force; the others by what they promise (rows kept,
columns, surrogates of each text, round trips), as their operators have tests of their own.

Stages take nulls in any column and repeated rows as their operators do; an empty table passes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import mixing, ngram_join, pieces, quality_rules, surrogates
from marlstone.llm.common import filed, keyed, materialise, table, unused

#: Near duplicates share so many hundredths of their shingles of so many words.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their host's verdict reject go."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, that with the smallest doc_id; rows that repeat a doc_id are told apart by their place."""
    docs = filed(docs)
    gone = materialise(ngram_join.repeated(docs, NEAR_WORDS, NEAR_PERCENT), "near-gone")
    file, at = unused("row_file", docs), unused("row_at", docs)
    return keyed(docs, file, at).join(gone.withColumnsRenamed({"row_file": file, "row_at": at}), [file, at], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates take the place of personal data; n_chars follows."""
    out = surrogates.replace(docs, spans=None)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))) if "n_chars" in out.columns else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix draws it, dealt to shards and shuffled."""
    return mixing.arranged(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every whole text."""
    return pieces.encode(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("PII surrogates", personal_data),
    ("mixing sources", mixed),
    ("SentencePiece encoding", encoded),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
