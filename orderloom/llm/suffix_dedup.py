"""Suffix-array dedup: a logarithmic family of sparse suffix arrays finds repeats of 400 bytes.

Every ``WIDTH``-byte window of a document belongs to the least hash among its
``SHORT``-byte strings (its *anchor*); equal windows share it.  Stretches whose
anchor a twice-seen Bloom filter (occurrences count, also within one document)
hasn't seen twice can't match and are never sent.  The rest are dealt by anchor,
bytes and all; equal stretches of one task collapse, all their windows are then
known repeats and one of them stands for all.

A bucket's task keeps an index family.  Stretches come in batches.  A batch gets a
suffix array: its window starts in lexicographic order of the ``WIDTH`` bytes that
follow.  Suffixes are ordered by eight bytes at a time; those still tied go on behind
their longest common prefix, which a binary search over hashes of the text gives.
Neighbours whose common prefix is ``WIDTH`` bytes long repeat each other.  The array
is then merge-scanned against every level: each suffix is located in the level's
order and compared with the suffix there; matches mark both sides.  Last it joins
the family: it merges with the smallest level while that is less than twice its
size, so levels grow geometrically and a suffix is merged a logarithmic number of
times.  The family lives as long as its bucket's task.

Bytes of marked windows are removed, whichever occurrence comes first.

Defined cases: null or empty text is no bytes; matches never cross rows; rows
that share a doc_id are separate occurrences of their text and both lose what
either repeats; a null doc_id takes no part; only doc_id and text are read, other
columns may clash; an empty table gives no rows.
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
from .substring_dedup import pairs_of, ranges, runs_of, spans_by_document

WIDTH, SHORT = 400, 128
BATCH_BYTES = 1 << 20


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, B.Rolling]:
    """(window starts, anchor of each window, hashes of the chunk)."""
    rolling = B.Rolling(data)
    if len(data) < WIDTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), rolling
    least = B.sliding_min(rolling.every(SHORT), WIDTH - SHORT + 1)
    room = np.maximum(np.diff(offsets) - WIDTH + 1, 0)
    at = ranges(offsets[:-1], room)
    return at, least[at], rolling


def _anchor_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every place that is the least of some window: equal windows of one
    periodic stretch have the anchor at two places."""
    at, least, rolling = anchors(data, offsets)
    if not len(at):
        return least, at
    short, slack = rolling.every(SHORT), WIDTH - SHORT
    held = np.zeros(len(short) + slack, np.uint64)
    held[at + slack] = least
    place = np.flatnonzero(~B.sliding_min(~held, slack + 1) == short)
    return short[place], np.searchsorted(offsets, place, "right") - 1


def _stretches(shared, bits: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for batch in batches:
            ids, known = _bloom.batch_ids(batch.column(0))
            data, offsets = B.text_buffers(batch.column(1))
            parts: list[list[np.ndarray]] = [[] for _ in range(6)]
            for a, b in B.chunks(offsets):
                base = offsets[a]
                near = offsets[a:b + 1] - base
                at, least, rolling = anchors(data[base:offsets[b]], near)
                begin, length = runs_of(at, least)
                doc = np.searchsorted(near, at[begin], "right") - 1
                use = known[a + doc] & _bloom.contains(seen, least[begin], bits)
                begin, length, doc = begin[use], length[use], doc[use]
                start = at[begin]
                content = rolling.spans(start, start + length + WIDTH - 1)
                for held, x in zip(parts, (ids[a + doc], start - near[doc], length, least[begin], content, start + base), strict=True):
                    held.append(x)
            if not parts or not sum(map(len, parts[0])):
                continue
            doc, start, length, least, content, place = (np.concatenate(x) for x in parts)
            order = np.argsort(content, kind="stable")
            head = np.r_[True, content[order][1:] != content[order][:-1]]
            group = np.cumsum(head) - 1
            repeated = np.empty(len(doc), bool)
            repeated[order] = np.bincount(group)[group] > 1
            first = np.zeros(len(doc), bool)
            first[order] = head
            bucket = (least % np.uint64(buckets)).astype(np.int64)
            rows = []
            send = np.flatnonzero(first)
            send = send[np.argsort(bucket[send], kind="stable")]
            edge = np.flatnonzero(np.r_[True, np.diff(bucket[send]) != 0, True])
            for lo, hi in zip(edge[:-1], edge[1:]):
                part = send[lo:hi]
                rows.append((int(bucket[part[0]]), part, data[ranges(place[part], length[part] + WIDTH - 1)]))
            gone = np.flatnonzero(~first)
            if len(gone):
                rows.append((-1 - int(doc[gone[0]] % buckets), gone, data[:0]))
            pick = lambda x, kind: pa.array([x[r[1]].astype(kind).tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int64()), pick(doc, "<i8"), pick(start, "<u4"), pick(length, "<u4"), pick(repeated, "u1"),
                pa.array([r[2].tobytes() for r in rows], pa.binary()),
            ], names=["bucket", "docs", "starts", "lengths", "repeated", "bytes"])

    return run


class Text:
    """A bucket's bytes, compared by the ``width`` bytes from a place on."""

    def __init__(self, data: np.ndarray, width: int = WIDTH):
        self.data, self.width, self.rolling = np.concatenate([data, np.zeros(8, np.uint8)]), width, B.Rolling(data)

    def eight(self, at: np.ndarray, depth: np.ndarray | int = 0) -> np.ndarray:
        """The next eight bytes as numbers in byte order; those beyond the width are 0."""
        keys = self.data[(at + depth)[:, None] + np.arange(8)].view(">u8")[:, 0].astype(np.uint64)
        beyond = np.maximum(np.int64(8) - (self.width - depth), 0).astype(np.uint64) * np.uint64(8)
        return keys >> beyond << beyond

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of two suffixes, ``width`` at most."""
        prefix, inverse = self.rolling.prefix, self.rolling.inverse
        out = np.zeros(len(x), np.int64)
        step = 1 << (self.width.bit_length() - 1)
        with np.errstate(over="ignore"):
            while step:
                a, b = x + out, y + out
                fits = np.flatnonzero(out + step <= self.width)
                a, b = a[fits], b[fits]
                same = (prefix[a + step] - prefix[a]) * inverse[a] == (prefix[b + step] - prefix[b]) * inverse[b]
                out[fits[same]] += step
                step >>= 1
        return out

    def suffix_array(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the places in the order of their suffixes, whether each equals the one before)."""
        keys = self.eight(at)
        order = np.argsort(keys, kind="stable")
        at, keys = at[order], keys[order]
        equal = np.zeros(len(at), bool)
        tied = np.r_[False, keys[1:] == keys[:-1]]  # with the one before, as far as is known
        while True:
            member = tied | np.r_[tied[1:], False]
            here = np.flatnonzero(member & ~equal)
            here = here[tied[here] | ~np.r_[equal[1:], False][here]]
            if not len(here):
                return at, equal
            head = np.flatnonzero(~tied[here])
            group = np.cumsum(~tied[here]) - 1
            places = at[here]
            depth = np.minimum.reduceat(self.common(places, places[head][group]), head)
            done = depth == self.width  # a whole group repeats
            if done.any():
                last = here[done[group]]
                equal[last] = tied[last]
            part = np.flatnonzero(~done[group])
            if not len(part):
                tied[here] = False
                continue
            keys = self.eight(places[part], depth[group[part]])
            order = np.lexsort((keys, group[part]))
            at[here[part]], keys, of = places[part][order], keys[order], group[part][order]
            tied[here] = False
            tied[here[part]] = np.r_[False, (keys[1:] == keys[:-1]) & (of[1:] == of[:-1])]

    def locate(self, level: np.ndarray, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which places have an equal suffix in the level, where it is), by binary search from
        the level's eight-byte keys on."""
        want = self.eight(at)
        lo, hi = np.searchsorted(keys, want), np.searchsorted(keys, want, "right")
        todo, found = np.flatnonzero(lo < hi), np.full(len(at), -1, np.int64)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            x, y = at[todo], level[mid]
            length = self.common(x, y)
            hit = length == self.width
            found[todo[hit]] = mid[hit]
            left = self.data[x + length] < self.data[y + length]
            hi[todo] = np.where(left, mid, hi[todo])
            lo[todo] = np.where(left, lo[todo], mid + 1)
            todo = todo[~hit & (lo[todo] < hi[todo])]
        which = np.flatnonzero(found >= 0)
        return which, found[which]


class Family:
    """Levels of suffix arrays over the places of one text added so far, each at least
    twice as large as the next; ``marked`` tells the places whose suffix repeats."""

    def __init__(self, text: Text):
        self.text, self.levels = text, []
        self.marked = np.zeros(len(text.data), bool)

    def add(self, at: np.ndarray) -> None:
        """One batch: builds its array, scans the levels, merges levels of like size."""
        at, equal = self.text.suffix_array(at)
        self.marked[at[equal]] = True
        self.marked[at[np.flatnonzero(equal) - 1]] = True
        new = at[~equal]  # one of those that repeat stands for all
        fresh = np.ones(len(new), bool)
        for level, keys in self.levels:
            which, where = self.text.locate(level, keys, new)
            self.marked[level[where]] = True
            fresh[which] = False
        repeats = np.cumsum(~equal) - 1
        self.marked[at[~fresh[repeats]]] = True
        new = new[fresh]
        while self.levels and len(self.levels[-1][0]) < 2 * len(new):
            new, _ = self.text.suffix_array(np.concatenate([self.levels.pop()[0], new]))  # two sorted runs: the sort merges
        if len(new):
            self.levels.append((new, self.text.eight(new)))


def _index(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[list[np.ndarray]] = [[], [], [], [], []]
    for batch in batches:
        for name, kind, held in zip(("docs", "starts", "lengths", "repeated", "bytes"), ("<i8", "<u4", "<u4", "u1", "u1"), parts, strict=True):
            held += [np.frombuffer(x.as_py(), kind) for x in batch.column(name)]
    doc, start, length, repeated, data = (np.concatenate(x) for x in parts)
    start, length = start.astype(np.int64), length.astype(np.int64)
    if key[0].as_py() < 0:
        yield spans_by_document(doc, start, length)
        return
    cut = np.r_[0, np.cumsum(length + WIDTH - 1)]
    family, lo = Family(Text(data)), 0
    while lo < len(doc):
        hi = max(lo + 1, int(np.searchsorted(cut, cut[lo] + BATCH_BYTES, "right")) - 1)
        family.add(ranges(cut[lo:hi], length[lo:hi]))
        lo = hi
    hit = np.flatnonzero(family.marked[ranges(cut[:-1], length)] | np.repeat(repeated > 0, length))
    of, at = np.repeat(doc, length)[hit], ranges(start, length)[hit]
    begin, count = runs_of(at, of)
    yield spans_by_document(of[begin], at[begin], count)


def duplicate_spans(docs: DataFrame, bits: int | None = None) -> DataFrame:
    """(doc_id, spans): (first start, number of starts) of repeated windows, in bytes."""
    bits = bits or _bloom.filter_bits(docs, 64)
    shared = docs.sparkSession.sparkContext.broadcast(_bloom.twice_seen(docs, _anchor_keys, bits, within=True))
    rows = texts(docs).mapInArrow(
        _stretches(shared, bits, bucket_count(docs, 4 << 20)),
        "bucket bigint, docs binary, starts binary, lengths binary, repeated binary, bytes binary",
    )
    found = rows.groupBy("bucket").applyInArrow(_index, "doc_id bigint, spans binary")
    return found.groupBy("doc_id").agg(F.collect_list("spans").alias("spans"))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = B.text_buffers(batch.column("text"))
        kept, gone, runs = [], [], []
        for i, spans in enumerate(batch.column("spans")):
            text = data[offsets[i]:offsets[i + 1]]
            drop = np.zeros(len(text), bool)
            if spans.is_valid:
                pairs = pairs_of(spans.as_py())
                drop = B.covered(len(text), pairs[:, 0], pairs[:, 1] + WIDTH - 1)
            gone.append(int(drop.sum()))
            runs.append(int((drop[1:] & ~drop[:-1]).sum() + drop[:1].sum()))
            kept.append(text[~drop].tobytes())
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary()),
        ], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def dedup_suffixes(docs: DataFrame, bits: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    held = texts(docs).join(duplicate_spans(docs, bits), "doc_id", "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return held.mapInArrow(_remove, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_suffixes(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


#: The query's result stated in SQL.
ORACLE_SQL = """
WITH n AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
 p AS (SELECT doc_id, hx, unnest(range(1, n - 398)) AS i FROM n WHERE n >= 400),
 h AS (SELECT doc_id, i, md5_number(substr(hx, 2 * i - 1, 800)) AS key FROM p),
 d AS (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY key) > 1),
 m AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 1 ELSE 0 END AS new FROM d),
 g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m),
 r AS (SELECT doc_id, min(i) AS a, max(i) + 399 AS b FROM g GROUP BY doc_id, run),
 q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
 k AS (SELECT doc_id, count(*) AS spans, sum(b - a + 1) AS gone, max(b) AS last, string_agg(substr(hx, 2 * before + 1, 2 * (a - 1 - before)), '' ORDER BY a) AS head FROM q JOIN n USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
 sha256(unhex(coalesce(head, '') || substr(hx, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM n LEFT JOIN k USING (doc_id)"""
