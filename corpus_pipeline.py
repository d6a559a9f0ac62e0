"""From raw documents to token ids: quality rules, line dedup, near duplicates,
benchmark decontamination, byte-level BPE.

Every stage reads what its predecessor wrote.  Stages before the last return the
columns of documents; n_chars follows the text.  Texts that line dedup leaves
without a word held nothing of their own and go.  Rows without doc_id pass the
stages that decide by doc_id unchanged, except the near-duplicate stage, which
keeps one row of them per text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm import bpe, decontaminate, line_dedup, ngram_join, quality_rules
from orderloom.llm._plan import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None  # the sketches, the trees and the merges have no SQL form; tests hold stages against brute force


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.judged(docs, ("text", "n_chars")).filter("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(docs, carry=("lang", "source"))
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each class stays; five-word shingles, a similarity of 0.8."""
    first = ngram_join.joined(docs, size=5, percent=80).filter("doc_id = component_id").select("doc_id")
    named = docs.join(first, "doc_id", "left_semi").select(*COLUMNS)
    return named.unionByName(docs.filter("doc_id is null").dropDuplicates(["text"]).select(*COLUMNS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, the byte offset of each token, and the
    digest of what the ids decode to."""
    rows = bpe.encode(docs, with_offsets=True, with_digest=True, carry=("lang", "source"))
    return rows.select("doc_id", "lang", "source", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", "offsets", "decoded_sha256")


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_join", near_duplicates),
    ("decontamination", benchmark),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
