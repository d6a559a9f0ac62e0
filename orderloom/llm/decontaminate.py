"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Words are lower-cased and lose ASCII punctuation.  A mask keeps some positions of
``SPAN`` consecutive words and ignores the others, so a substituted word breaks
only the seeds that keep its position.  Every place of every document and
benchmark item gives one 64-bit hash a mask; equal hashes are hits.  A hit fixes an
alignment (document place minus item place).  Every alignment is verified once: the
item's words are compared with the document's along it, and the item contaminates
the document if

- at least ``PERCENT`` of all of the item's words agree, or
- around a hit ``RUN`` consecutive words agree but for ``RUN - LEAST`` substitutions,
  however long the item is: a quoted part of a long item, or an item into which a
  word was put or from which one was taken.

Items of fewer than ``SPAN`` words give no seeds.  They are found as exact runs of
words: documents give the hashes of all runs of the lengths that such items have.

Documents don't shuffle for the search: hashes of their words stay in the row,
places are exploded inside one generated stage and probe the item seeds there.  A
seed row is three numbers; words of items and of documents with a hit join the
distinct alignments afterwards.  The seeds' size follows the benchmark, not the
corpus; they are broadcast only below a size that is checked, and joined by shuffle
beyond it.

Defined cases: null or empty text has no words; rows of one doc_id are one document
(the best of their alignments counts); rows without doc_id are told apart by their
text and reported with a null doc_id; several items may hit a document, each gives a
row; empty tables give no rows; only doc_id, text and item_id are read, so other
columns may clash.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._plan import broadcastable, table, written

#: Fixed masks (1: the position counts); span, share of an item's words that must agree.
MASKS = ("110100111", "101110011")
SPAN, PERCENT = 9, 60
#: Of so many consecutive words so many agree.
RUN, LEAST = 13, 11

_SPACE = r"[\x20\x09-\x0D]+"
_KEY = ["id", "own"]


def word_hashes(text: Column) -> Column:
    words = F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), string.punctuation, ""), _SPACE)
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def seeds(words: Column, size: Column) -> Column:
    """Hashes of all places under the first mask, then under the next, ..."""
    places = F.when(size >= SPAN, F.sequence(F.lit(0), size - SPAN)).otherwise(F.array().cast("array<int>"))

    def under(m: int) -> Column:
        kept = [i for i, c in enumerate(MASKS[m]) if c == "1"]
        return F.transform(places, lambda p: F.xxhash64(F.lit(m), *(F.get(words, p + i) for i in kept)))

    return F.concat(*(under(m) for m in range(len(MASKS))))


def runs(words: Column, size: Column, lengths: list[int]) -> Column:
    """Hashes of all runs of so many words."""
    none = F.array().cast("array<bigint>")
    of = lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(0), size - n), lambda p: F.xxhash64(F.lit(n), *(F.get(words, p + i) for i in range(n))))).otherwise(none)
    return F.concat(*map(of, lengths))


def _worded(df: DataFrame, key: list[str]) -> DataFrame:
    return df.select(*key, word_hashes(F.col("text")).alias("words")).withColumn("size", F.size("words"))


def _seeded(df: DataFrame, key: list[str]) -> DataFrame:
    """One row a place and mask.  The outer explode keeps the optimizer from adding a
    non-empty filter below, which would compute every seed a second time."""
    rows = _worded(df, key).withColumn("seeds", seeds(F.col("words"), F.col("size")))
    rows = rows.select(*key, "size", F.posexplode_outer("seeds").alias("at", "seed"))
    return rows.select(*key, "seed", (F.col("at") % (F.col("size") - SPAN + 1)).alias("place"))


def _keyed(docs: DataFrame) -> DataFrame:
    """id and own name a document: its doc_id, or the hash of its text where it has none."""
    zero = F.lit(0).cast(docs.schema["doc_id"].dataType)
    return docs.select(F.coalesce("doc_id", zero).alias("id"), F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0).alias("own"), "text")


def _agreement(shift: Column) -> Column:
    """The item's words, one by one: does the document's at that place agree?"""
    at = lambda j: F.try_element_at("words", F.when(shift + j >= 0, shift + j + 1))
    return F.transform(F.sequence(F.lit(0), F.col("item_words") - 1), lambda j: F.coalesce(at(j) == F.get("item", j), F.lit(False)).cast("int"))


def _run(agree: Column) -> Column:
    """RUN consecutive words of which LEAST agree: the last RUN are bits of a number."""
    kind, last = "struct<bits:int,found:boolean>", (1 << RUN) - 1

    def step(state: Column, x: Column) -> Column:
        bits = (state["bits"] * 2 + x).bitwiseAND(F.lit(last))
        return F.struct(bits.alias("bits"), (state["found"] | (F.bit_count(bits) >= LEAST)).alias("found")).cast(kind)

    return F.aggregate(agree, F.struct(F.lit(0).alias("bits"), F.lit(False).alias("found")).cast(kind), step, lambda s: s["found"])


def _found(docs: DataFrame, benchmark: DataFrame, percent: int) -> DataFrame:
    """(id, own, item_id, matched, item_words)."""
    bench = benchmark.select("item_id", "text")
    items = written(_worded(bench, ["item_id"]))
    index = written(_seeded(bench, ["item_id"]).filter("seed is not null").select("seed", "item_id", F.col("place").alias("item_place")))
    rows = _keyed(docs)
    hits = _seeded(rows, _KEY).join(broadcastable(index), "seed")
    hits = written(hits.select(*_KEY, "item_id", (F.col("place") - F.col("item_place")).alias("shift")).distinct())

    some = rows.join(broadcastable(hits.select(*_KEY).distinct()), _KEY, "left_semi")
    aligned = _worded(some, _KEY).join(broadcastable(hits), _KEY)
    aligned = aligned.join(broadcastable(items.select("item_id", F.col("words").alias("item"), F.col("size").alias("item_words"))), "item_id")
    verified = aligned.select(*_KEY, "item_id", "item_words", _agreement(F.col("shift")).alias("agree"))
    verified = verified.select(
        *_KEY, "item_id", F.col("item_words").cast("bigint").alias("item_words"), _run(F.col("agree")).alias("run"),
        F.aggregate("agree", F.lit(0), lambda s, x: s + x).cast("bigint").alias("matched"),
    )
    best = verified.groupBy(*_KEY, "item_id").agg(F.max("matched").alias("matched"), F.max("item_words").alias("item_words"), F.max("run").alias("run"))
    long = best.filter((100 * F.col("matched") >= percent * F.col("item_words")) | F.col("run")).drop("run")

    short = items.filter((F.col("size") > 0) & (F.col("size") < SPAN))
    lengths = sorted(r[0] for r in short.select("size").distinct().collect())  # fewer than SPAN numbers
    if not lengths:
        return long
    exact = lambda df, key: df.select(*key, "size", F.explode_outer(runs(F.col("words"), F.col("size"), lengths)).alias("seed"))
    whole = short.select("item_id", F.col("size").cast("bigint").alias("item_words"), F.concat(*(
        F.when(F.col("size") == n, runs(F.col("words"), F.col("size"), [n])).otherwise(F.array().cast("array<bigint>")) for n in lengths
    ))[0].alias("seed"))
    quoted = exact(_worded(rows, _KEY), _KEY).join(broadcastable(written(whole)), "seed").select(*_KEY, "item_id", F.col("item_words").alias("matched"), "item_words")
    return long.unionByName(quoted.distinct())


def overlaps(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, matched, item_words): each item that contaminates a document, with
    the words that agree along the best alignment."""
    kind = docs.schema["doc_id"].dataType
    return _found(docs, benchmark, percent).select(F.when(F.col("own") == 0, F.col("id")).cast(kind).alias("doc_id"), "item_id", "matched", "item_words")


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents without an overlap, all their columns; those without doc_id by their text."""
    found = written(_found(docs, benchmark, percent).select(*_KEY).distinct())
    named = found.filter("own = 0").select(F.col("id").alias("doc_id"))
    kept = docs.join(broadcastable(named, 8 << 20), "doc_id", "left_anti").select(*docs.columns)
    other = found.filter("own != 0").select("own")
    without = kept.filter("doc_id is null").join(broadcastable(other, 8 << 20), F.xxhash64(kept["text"]) == F.col("own"), "left_anti")
    return kept.filter("doc_id is not null").unionByName(without.select(*docs.columns))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _oracle() -> str:
    drop = string.punctuation.replace("'", "''")
    words = f"list_filter(regexp_split_to_array(translate(lower(coalesce(text, '')), '{drop}', ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    key = lambda m, at: f"'{m}' || " + " || ' ' || ".join(f"words[p + {i}]" for i in at)
    masks = [key(m, [i for i, c in enumerate(mask) if c == "1"]) for m, mask in enumerate(MASKS)]
    seeded = lambda t, k: " UNION ALL ".join(
        f"SELECT {k}, words, p, {m} AS seed FROM (SELECT {k}, words, unnest(range(1, len(words) - {SPAN} + 2)) AS p FROM {t} WHERE len(words) >= {SPAN})" for m in masks
    )
    return f"""
WITH d AS (SELECT doc_id, {words} AS words FROM documents),
b AS (SELECT item_id, {words} AS words FROM benchmark),
ds AS ({seeded('d', 'doc_id')}),
bs AS ({seeded('b', 'item_id')}),
hits AS (SELECT DISTINCT doc_id, item_id, ds.p - bs.p AS shift FROM ds JOIN bs USING (seed)),
a AS (SELECT hits.doc_id, hits.item_id, len(b.words) AS item_words,
      list_transform(range(1, len(b.words) + 1), lambda j: CASE WHEN shift + j >= 1 AND d.words[shift + j] = b.words[j] THEN 1 ELSE 0 END) AS agree
      FROM hits JOIN d USING (doc_id) JOIN b USING (item_id)),
m AS (SELECT doc_id, item_id, item_words, list_sum(agree) AS matched,
      coalesce(list_max(list_transform(range(1, item_words - {RUN} + 2), lambda j: list_sum(agree[j:j + {RUN - 1}]))), 0) >= {LEAST} AS run FROM a),
best AS (SELECT doc_id, item_id, max(matched) AS matched, max(item_words) AS item_words, bool_or(run) AS run FROM m GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(matched AS BIGINT) AS matched, CAST(item_words AS BIGINT) AS item_words
FROM best WHERE 100 * matched >= {PERCENT} * item_words OR run
UNION
SELECT doc_id, item_id, CAST(len(b.words) AS BIGINT), CAST(len(b.words) AS BIGINT) FROM d, b
WHERE len(b.words) BETWEEN 1 AND {SPAN - 1} AND len(list_filter(range(1, len(d.words) - len(b.words) + 2), lambda p: d.words[p:p + len(b.words) - 1] = b.words)) > 0"""


ORACLE_SQL = _oracle()
