"""Line dedup: two Bloom filters, then an exact pass over the suspects only.

``key`` of a line: the line without white space at its ends, A-Z lower-cased.
A key of at least ``min_chars`` code points that occurs in two documents or more
stays only in the smallest doc_id that holds it (all its lines there stay).

1. Every task sends the bit positions of its keys, dealt by filter shard.  A
   shard's task ORs them into a *once-seen* filter and, where two tasks (or two
   documents of one task) set the same bit, into a *twice-seen* filter.  That
   merge is associative, has no false negatives and needs no lines.
2. The twice-seen filter is the only thing broadcast.  Its size is a parameter
   with a hard bound (``_bloom.MAX_BITS``, 32 MB); beyond the corpus size it was meant
   for it only lets more suspects through, results stay exact.
3. Suspects (key digest, doc_id) shuffle once.  A task resolves repeats among
   its own documents first, so a line that a third of the corpus holds reaches
   its group once a task, not once a document.

Defined cases: null or empty text is one empty line; rows with one doc_id count
as one document; rows without doc_id are returned unchanged and take no part;
other columns are kept out, so names may clash; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _bloom
from . import _bytes as B
from ._plan import table, texts

MIN_CHARS = 10


def _keys(data: np.ndarray, offsets: np.ndarray, min_chars: int):
    """Lines of a chunk: (start, end, first, key start, key end, long enough)."""
    start, end, first = B.line_bounds(data, offsets)
    lo, hi = B.strip_bounds(data, start, end)
    points = B.code_points(data)
    return start, end, first, lo, hi, points[hi] - points[lo] >= min_chars


def _line_keys(min_chars: int):
    def extract(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, _, first, lo, hi, good = _keys(data, offsets, min_chars)
        line = np.flatnonzero(good)
        return B.Rolling(data, fold=True).spans(lo[line], hi[line]), np.searchsorted(first, line, "right") - 1

    return extract


def _suspects(shared, bits: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for batch in batches:
            ids, known = _bloom.batch_ids(batch.column(0))
            data, offsets = B.text_buffers(batch.column(1))
            best: dict[bytes, int] = {}
            rows: set[tuple[bytes, int]] = set()
            for a, b in B.chunks(offsets):
                part, at = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                _, _, first, lo, hi, good = _keys(part, at, min_chars)
                line = np.flatnonzero(good & np.repeat(known[a:b], np.diff(first)))
                line = line[_bloom.contains(seen, B.Rolling(part, fold=True).spans(lo[line], hi[line]), bits)]
                folded = B.LOWER[part].tobytes()
                owner = ids[a + np.searchsorted(first, line, "right") - 1]
                for s, e, doc in zip(lo[line].tolist(), hi[line].tolist(), owner.tolist(), strict=True):
                    key = hashlib.blake2b(folded[s:e], digest_size=16).digest()
                    rows.add((key, doc))
                    if best.get(key, doc) >= doc:
                        best[key] = doc
            if rows:
                keys, docs = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array(docs, pa.int64()), pa.array([best[k] != d for k, d in rows])],
                    names=["key", "doc_id", "later"],
                )

    return run


def dropped_keys(docs: DataFrame, min_chars: int = MIN_CHARS, bits: int | None = None) -> DataFrame:
    """(doc_id, keys): digests of the keys whose lines the document loses.

    Rows that a task already knows to be later than another of its documents are
    spread by doc_id; only one row a task and key meets at the key's group.
    """
    bits = bits or _bloom.filter_bits(docs, 64)
    shared = docs.sparkSession.sparkContext.broadcast(_bloom.twice_seen(docs, _line_keys(min_chars), bits))
    suspects = texts(docs).mapInArrow(_suspects(shared, bits, min_chars), "key binary, doc_id bigint, later boolean")
    group = Window.partitionBy("key", F.when(F.col("later"), F.col("doc_id")))
    return (
        suspects.withColumn("least", F.min("doc_id").over(group))
        .filter(F.col("later") | (F.col("doc_id") > F.col("least")))
        .groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    )


def _rebuild(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.text_buffers(batch.column("text"))
            start, end, first = B.line_bounds(data, offsets)
            lo, hi = B.strip_bounds(data, start, end)
            whole, gone, kept = data.tobytes(), [], []
            for i, keys in enumerate(batch.column("keys")):
                if not keys.is_valid:
                    gone.append(0)
                    kept.append(whole[offsets[i]:offsets[i + 1]])
                    continue
                drop, stay = set(keys.as_py()), []
                for k in range(first[i], first[i + 1]):
                    digest = hashlib.blake2b(whole[lo[k]:hi[k]].translate(B.LOWER.tobytes()), digest_size=16).digest()
                    if digest not in drop:
                        stay.append(whole[start[k]:end[k]])
                gone.append(int(first[i + 1] - first[i]) - len(stay))
                kept.append(b"\n".join(stay))
            rest = [batch.column(c) for c in batch.schema.names if c not in ("text", "keys")]
            names = [c for c in batch.schema.names if c not in ("text", "keys")]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(kept, pa.binary()).cast(pa.string()), pa.array(np.diff(first), pa.int64()), pa.array(gone, pa.int64())],
                names=[*names, "text", "n_lines", "n_dropped"],
            )

    return run


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, bits: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the ``carry`` columns, text without the later repeats, n_lines, n_dropped."""
    found = dropped_keys(docs, min_chars, bits)
    held = texts(docs, *carry).join(found, "doc_id", "left").select("doc_id", *carry, "text", "keys")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema if f.name not in ("text", "keys"))
    return held.mapInArrow(_rebuild(min_chars), f"{kinds}, text string, n_lines bigint, n_dropped bigint")


def digest(column: str) -> Column:
    """Lowercase hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(F.col(column).cast("binary"), 256)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", digest("text").alias("kept_sha256")
    )


#: The query's result stated in SQL.
ORACLE_SQL = """
WITH l AS (SELECT doc_id, u.i, u.line, length(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS n,
  translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM documents, (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i) u),
 f AS (SELECT key, min(doc_id) AS first FROM l GROUP BY key),
 k AS (SELECT doc_id, i, line, n >= 10 AND doc_id > first AS gone FROM l JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM k GROUP BY doc_id"""
