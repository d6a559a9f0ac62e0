"""Substring dedup: relative Lempel-Ziv factors against every earlier document.

A *window* is ``WINDOW`` consecutive words of one document.  The reference of a
document is every document with a smaller doc_id.  A document is parsed left to
right: where the reference holds the window at the current word, a factor (start,
windows, source, source start) begins at the source's place and grows word by word
while the window that comes next in the source is the next one of the document;
where it doesn't, the parse takes one literal word.  When a factor's source ends or
goes on otherwise, the window across the boundary is looked up again and, if the
reference holds it elsewhere, the next factor begins there, so a passage that one
source ends and another continues loses no word.  Factors are at least one window
long by construction; their words are the duplicates.

The index is distributed.  Every window belongs to the least hash among its
10-word sequences (its *anchor*), so equal windows share an anchor, and
consecutive windows mostly do: they form one reference block.  Blocks whose
anchor a twice-seen Bloom filter has not seen twice cannot match and are never
sent.  Blocks are dealt by anchor; a bucket's task indexes the windows by their
first place in the smallest document and parses its blocks against that.  Equal
blocks of one task collapse first: those of larger documents are factors of the
smallest one's already and only these travel, so a passage that a third of the
documents hold reaches its bucket from one document a task, at every place where
that document holds it.  Factors of neighbouring blocks meet again by document.

Windows are compared by 64-bit hashes.  Defined cases: null or empty text has no
words; rows of one doc_id count as one document, and should their texts differ each
loses the words at the places found in any of them; rows without doc_id are no
reference and lose nothing; only doc_id and text are read, other columns may clash;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bloom
from . import _bytes as B
from ._plan import bucket_count, table, texts

WINDOW, SHORT = 50, 10
#: Columns of dealt blocks: windows of those to parse; sources and their places of known factors.
_SENT = ("docs", "starts", "lengths", "windows", "sources", "places")


def anchors(data: np.ndarray, offsets: np.ndarray):
    """(word hashes, words before each document, window starts, anchor of each window)."""
    start, end, first = B.word_bounds(data, offsets)
    words = B.Rolling(data).spans(start, end)
    if len(words) < WINDOW:
        return words, first, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = B.sliding_min(B.windows(words, SHORT), WINDOW - SHORT + 1)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(owner[WINDOW - 1:] == owner[:len(owner) - WINDOW + 1])
    return words, first, at, least[at]


def _anchor_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, first, at, least = anchors(data, offsets)
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
    return least[new], np.searchsorted(first, at[new], "right") - 1


def runs_of(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of first, length) of the runs of consecutive positions with one key."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)])
    return new, np.diff(np.r_[new, len(at)])


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for every range in turn."""
    total = np.cumsum(length)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(start - total + length, length)


def _blocks(shared, bits: int, buckets: int):
    """Reference blocks by bucket (hashes of their windows), and known duplicates by a negative bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for batch in batches:
            ids, known = _bloom.batch_ids(batch.column(0))
            data, offsets = B.text_buffers(batch.column(1))
            parts: list[list[np.ndarray]] = [[] for _ in range(6)]
            for a, b in B.chunks(offsets):
                words, first, at, least = anchors(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                if not len(at):
                    continue
                begin, length = runs_of(at, least)
                doc = np.searchsorted(first, at[begin], "right") - 1
                use = known[a + doc] & _bloom.contains(seen, least[begin], bits)
                begin, length, doc = begin[use], length[use], doc[use]
                if not len(begin):
                    continue
                window = B.windows(words, WINDOW)[at[ranges(begin, length)]]
                cut = np.r_[0, np.cumsum(length)]
                with np.errstate(over="ignore"):
                    total = np.add.reduceat(B.mix64(window + (np.arange(len(window)) - np.repeat(cut[:-1], length)).astype(np.uint64)), cut[:-1])
                for held, x in zip(parts, (ids[a + doc], at[begin] - first[doc], length, least[begin], B.mix64(total), window), strict=True):
                    held.append(x)
            if not parts[0]:
                continue
            doc, start, length, least, content, window = (np.concatenate(x) for x in parts)
            cut = np.r_[0, np.cumsum(length)]
            order = np.lexsort((start, doc, content))
            same = np.r_[False, content[order][1:] == content[order][:-1]]
            group = np.cumsum(~same) - 1
            smallest = doc[order][np.flatnonzero(~same)][group]
            source, place = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
            source[order], place[order] = smallest, start[order][np.flatnonzero(~same)][group]
            # another batch may hold an earlier document, so every place of the smallest one here is asked for
            asked = np.zeros(len(doc), bool)
            asked[order] = (doc[order] == smallest) & ~(same & np.r_[False, start[order][1:] == start[order][:-1]])
            later = np.zeros(len(doc), bool)
            later[order] = doc[order] > smallest
            bucket = (least % np.uint64(buckets)).astype(np.int64)
            rows = []
            send = np.flatnonzero(asked)
            send = send[np.argsort(bucket[send], kind="stable")]
            edge = np.flatnonzero(np.r_[True, np.diff(bucket[send]) != 0, True]) if len(send) else []
            for lo, hi in zip(edge[:-1], edge[1:]):
                part = send[lo:hi]
                rows.append((int(bucket[part[0]]), doc[part], start[part], length[part], window[ranges(cut[:-1][part], length[part])], doc[:0], start[:0]))
            gone = np.flatnonzero(later)
            if len(gone):
                rows.append((-1 - int(doc[gone[0]] % buckets), doc[gone], start[gone], length[gone], window[:0], source[gone], place[gone]))
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int64()),
                *(pa.array([r[i].astype(kind).tobytes() for r in rows], pa.binary()) for i, kind in enumerate(("<i8", "<u4", "<u4", "<u8", "<i8", "<u4"), 1)),
            ], names=["bucket", *_SENT])

    return run


def spans_by_document(doc: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One row a document: its spans as tuples of 32-bit numbers, (start, length) or longer."""
    order = np.argsort(doc, kind="stable")
    doc, rows = doc[order], np.stack([c[order] for c in columns], axis=1).astype("<u4")
    edge = np.flatnonzero(np.r_[True, np.diff(doc) != 0, True]) if len(doc) else np.zeros(1, np.int64)
    return pa.RecordBatch.from_arrays([
        pa.array(doc[edge[:-1]] if len(doc) else [], pa.int64()),
        pa.array([rows[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])], pa.binary()),
    ], names=["doc_id", "spans"])


def parse(of: np.ndarray, at: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, ...]:
    """Relative Lempel-Ziv parse of the windows (document, place, hash), ordered by document
    and place within each block: (document, start, windows, source, source start) of each factor."""
    order = np.lexsort((at, of, window))
    head = np.flatnonzero(np.r_[True, window[order][1:] != window[order][:-1]]) if len(of) else np.zeros(0, np.int64)
    first = np.empty(len(of), np.int64)  # the window's first place in the smallest document
    first[order] = np.repeat(order[head], np.diff(np.r_[head, len(of)]))
    source, place = of[first], at[first]
    hit = np.flatnonzero(of > source)
    if not len(hit):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    # the factor goes on while document and source both do
    same = lambda x, step: x[hit][1:] == x[hit][:-1] + step
    on = same(of, 0) & same(at, 1) & same(source, 0) & same(place, 1)
    begin = np.flatnonzero(np.r_[True, ~on])
    count = np.diff(np.r_[begin, len(hit)])
    at_begin = hit[begin]
    return of[at_begin], at[at_begin], count, source[at_begin], place[at_begin]


def _factor(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Factors of a bucket's blocks against the index of the same blocks."""
    parts: list[list[np.ndarray]] = [[], [], [], [], [], []]
    for batch in batches:
        for name, kind, held in zip(("docs", "starts", "lengths", "windows", "sources", "places"), ("<i8", "<u4", "<u4", "<u8", "<i8", "<u4"), parts, strict=True):
            held += [np.frombuffer(x.as_py(), kind) for x in batch.column(name)]
    doc, start, length, window, source, place = (np.concatenate(x) for x in parts)
    start, length = start.astype(np.int64), length.astype(np.int64)
    if key[0].as_py() >= 0:
        doc, start, length, source, place = parse(np.repeat(doc, length), ranges(start, length), window)
    yield spans_by_document(doc, start, length, *_halves(source), place)


def _halves(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit ids as two 32-bit columns."""
    both = np.ascontiguousarray(ids, np.int64).view("<u4").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _joined_factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's factors in order, those that go on across blocks as one."""
    for batch in batches:
        names, columns = [], []
        for doc, spans in zip(batch.column("doc_id").to_pylist(), batch.column("spans"), strict=True):
            rows = np.unique(factors_of(spans.as_py()), axis=0)
            end = rows[:, 0] + rows[:, 1]
            on = (rows[1:, 0] == end[:-1]) & (rows[1:, 2] == rows[:-1, 2]) & (rows[1:, 3] == rows[:-1, 3] + rows[:-1, 1])
            begin = np.flatnonzero(np.r_[True, ~on])
            rows[begin, 1] = np.add.reduceat(rows[:, 1], begin)
            names.append(np.full(len(begin), doc))
            columns.append(rows[begin])
        rows = np.concatenate(columns) if columns else np.zeros((0, 4), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(names) if names else rows[:, 0], pa.int64()), *(pa.array(rows[:, i], pa.int64()) for i in range(4))],
            names=["doc_id", "start", "windows", "source", "source_start"],
        )


def _spans(docs: DataFrame, bits: int | None) -> DataFrame:
    """(doc_id, spans): the factors of each document, packed, of one row or several."""
    bits = bits or _bloom.filter_bits(docs, 64)
    seen = _bloom.twice_seen(docs, _anchor_keys, bits)
    shared = docs.sparkSession.sparkContext.broadcast(seen)
    buckets = bucket_count(docs)
    rows = texts(docs).mapInArrow(_blocks(shared, bits, buckets), "bucket bigint, " + ", ".join(f"{c} binary" for c in _SENT))
    found = rows.groupBy("bucket").applyInArrow(_factor, "doc_id bigint, spans binary")
    return found.groupBy("doc_id").agg(F.collect_list("spans").alias("spans"))


def factors(docs: DataFrame, bits: int | None = None) -> DataFrame:
    """(doc_id, start, windows, source, source_start): the factors of each document in word places;
    the words of one are [start, start + windows + WINDOW - 1)."""
    return _spans(docs, bits).mapInArrow(_joined_factors, "doc_id bigint, start bigint, windows bigint, source bigint, source_start bigint")


def factors_of(spans) -> np.ndarray:
    """(start, windows, source, source start) rows from a row's list of binary spans."""
    raw = np.concatenate([np.frombuffer(x, "<u4").reshape(-1, 5) for x in spans])
    source = np.ascontiguousarray(raw[:, 2:4]).view("<i8")[:, 0]
    return np.stack([raw[:, 0].astype(np.int64), raw[:, 1].astype(np.int64), source, raw[:, 4].astype(np.int64)], axis=1)


def pairs_of(spans) -> np.ndarray:
    """(start, length) rows from a row's list of binary spans."""
    return np.concatenate([np.frombuffer(x, "<u4").reshape(-1, 2) for x in spans]).astype(np.int64)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = B.text_buffers(batch.column("text"))
        whole, kept, gone, total = data.tobytes(), [], [], []
        for i, spans in enumerate(batch.column("spans")):
            words = whole[offsets[i]:offsets[i + 1]].translate(_TO_SPACE).split(b" ")
            words = [w for w in words if w]
            total.append(len(words))
            if spans.is_valid:
                found = factors_of(spans.as_py())
                drop = B.covered(len(words), np.minimum(found[:, 0], len(words)), found[:, 1] + WINDOW - 1).tolist()
                words = [w for w, d in zip(words, drop, strict=True) if not d]
            gone.append(total[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "n_removed", "text"],
        )


_TO_SPACE = bytes(0x20 if i in B.SPACE_BYTES else i for i in range(256))


def dedup_substrings(docs: DataFrame, bits: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, text (the kept words joined by one space)."""
    held = texts(docs).join(_spans(docs, bits), "doc_id", "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return held.mapInArrow(_remove, f"doc_id {kind}, n_words bigint, n_removed bigint, text string")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


#: The query's result stated in SQL.
ORACLE_SQL = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
 p AS (SELECT doc_id, unnest(range(1, len(words) - 48)) AS i, words FROM w WHERE len(words) >= 50),
 h AS (SELECT doc_id, i, md5_number(array_to_string(words[i:i + 49], ' ')) AS key FROM p),
 f AS (SELECT key, min(doc_id) AS first FROM h GROUP BY key),
 g AS (SELECT doc_id, list(i) AS starts FROM h JOIN f USING (key) WHERE doc_id > first GROUP BY doc_id),
 r AS (SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda s: range(s, s + 50)))) AS gone FROM g),
 k AS (SELECT doc_id, words, list_filter(range(1, len(words) + 1), lambda j: gone IS NULL OR NOT list_contains(gone, j)) AS kept FROM w LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - len(kept) AS BIGINT) AS n_removed, sha256(array_to_string(list_transform(kept, lambda j: words[j]), ' ')) AS kept_sha256 FROM k"""
