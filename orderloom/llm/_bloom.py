"""Once-seen and twice-seen Bloom filters over a corpus, built where the rows are.

``extract(data, offsets) -> (hashes, document index)`` yields the keys of a chunk
of whole documents.  Each task sends the filter positions of its keys, dealt by
shard; a shard's task ORs them into the once-seen filter and, where two tasks or
two documents of one task set a bit, into the twice-seen filter.  The merge is
associative and has no false negatives.  Only the twice-seen filter is broadcast;
``MAX_BITS`` bounds it (32 MB) whatever the corpus, and beyond the size it was
meant for it only lets more suspects through: exact passes follow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _bytes as B
from ._plan import size_in_bytes, texts

MAX_BITS = 1 << 28
SHARD_BITS = 1 << 20

Extract = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def filter_bits(docs: DataFrame, bytes_a_key: int, bits_a_key: int = 16) -> int:
    """Filter size from the scanned bytes: a power of two, MAX_BITS at most."""
    keys = max(1, 2 * size_in_bytes(docs) // bytes_a_key)
    return min(MAX_BITS, max(SHARD_BITS, 1 << int(keys * bits_a_key - 1).bit_length()))


def positions(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two filter positions of each hash."""
    mask = np.uint64(bits - 1)
    return (hashes & mask).astype(np.uint32), ((hashes >> np.uint64(32)) & mask).astype(np.uint32)


def contains(seen: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    x, y = positions(hashes, bits)
    hit = (seen[x >> 3] >> (x & 7).astype(np.uint8)) & (seen[y >> 3] >> (y & 7).astype(np.uint8)) & 1
    return hit.astype(bool)


def distinct_in_documents(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, and whether two documents have them."""
    order = np.lexsort((doc, hashes))
    h, d = hashes[order], doc[order]
    if not len(h):
        return h, np.zeros(0, bool)
    other = np.r_[False, (h[1:] == h[:-1]) & (d[1:] != d[:-1])]
    at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return h[at], np.logical_or.reduceat(other, at)


def batch_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """doc_ids with -1 for null, and which are known."""
    return column.fill_null(-1).to_numpy(zero_copy_only=False), ~np.asarray(column.is_null())


def _spread(extract: Extract, bits: int, within: bool):
    shards = bits // SHARD_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, known = batch_ids(batch.column(0))
            data, offsets = B.text_buffers(batch.column(1))
            hashes, owner = [], []
            for a, b in B.chunks(offsets):
                found, doc = extract(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                ok = known[a + doc]
                hashes.append(found[ok])
                owner.append(np.arange(len(found))[ok] if within else ids[a + doc[ok]])
            if not hashes:
                continue
            if within:  # every occurrence counts, also of one document
                distinct, count = np.unique(np.concatenate(hashes), return_counts=True)
                twice = count > 1
            else:
                distinct, twice = distinct_in_documents(np.concatenate(hashes), np.concatenate(owner))
            at = np.concatenate(positions(distinct, bits))
            order = np.argsort(at, kind="stable")
            at, again = at[order], np.concatenate([twice, twice])[order]
            cut = np.searchsorted(at, np.arange(shards + 1, dtype=np.uint64) * SHARD_BITS)
            some = np.flatnonzero(np.diff(cut))
            local = at % np.uint32(SHARD_BITS)
            part = lambda s: slice(cut[s], cut[s + 1])
            yield pa.RecordBatch.from_arrays([
                pa.array(some, pa.int32()),
                pa.array([np.unique(local[part(s)]).tobytes() for s in some], pa.binary()),
                pa.array([np.unique(local[part(s)][again[part(s)]]).tobytes() for s in some], pa.binary()),
            ], names=["shard", "once", "twice"])

    return run


def _merge_shard(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    once, twice = np.zeros(SHARD_BITS, bool), np.zeros(SHARD_BITS, bool)
    for batch in batches:
        for a, b in zip(batch.column("once"), batch.column("twice"), strict=True):
            at = np.frombuffer(a.as_py(), np.uint32)
            twice[at[once[at]]] = True
            once[at] = True
            twice[np.frombuffer(b.as_py(), np.uint32)] = True
    yield pa.RecordBatch.from_arrays(
        [pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())],
        names=["shard", "bits"],
    )


def twice_seen(docs: DataFrame, extract: Extract, bits: int, within: bool = False) -> np.ndarray:
    """The twice-seen filter as packed bytes, bits / 8 of them.  Keys count once a
    document, or once an occurrence if ``within``."""
    rows = (
        texts(docs).mapInArrow(_spread(extract, bits, within), "shard int, once binary, twice binary")
        .groupBy("shard").applyInArrow(_merge_shard, "shard int, bits binary")
    )
    out = np.zeros(bits // 8, np.uint8)
    step = SHARD_BITS // 8
    for row in rows.toLocalIterator():
        out[row.shard * step:(row.shard + 1) * step] = np.frombuffer(row.bits, np.uint8)
    return out
