"""N-gram Jaccard join: globally ordered shingle sets in prefix trees.

A text's set is its distinct 4-word shingles (A-Z lower-cased; fewer words: the
whole sequence).  Two texts link if 100 * intersection >= 85 * union.  Equal sets
are one set from the first step on, named by their digest, so copies cost nothing.

1. Sets are ordered by hash.  Two that link share at least ``l`` of the first
   ``n - ceil(0.85 n) + l`` shingles of both, with l = ``LEAD`` of the smaller set.
   Tasks deal only those, by hash; a bucket tells how many of each set's are in
   another set.  A shingle that a task sees in two of its own sets needs no answer:
   one stands for it, so a shingle that everybody has meets its bucket once a task.
   Sets with too few shared ones link with nobody; few others remain.
2. The whole sets of those are dealt likewise.  The order is now: shingles of one
   set only first, then the rest by hash, then those that more than ``COMMON`` sets
   have, the rarest first.  A pair that links shares one of the first
   ``n - ceil(0.85 n) + 1`` of both, and the shingles of one set only needn't travel on.
3. Sets joined by a shared prefix shingle form groups (connected components), cut
   into blocks of like size class and at most about ``BLOCK`` sets, those with the
   same first shingle together.  Each block meets ``PIVOTS`` sets of its group and
   class first, which puts a large group of near copies into one class at once.
4. In groups of several blocks, sets of different classes pair up where they share
   as many shingles as step 1 asks for, none of them common; such pairs are compared.
   A pair with a common one among those is left to blocks formed anew, large classes
   apart, of the sets with common shingles in the prefix.  Two blocks meet where they
   share one, their size classes are neighbours and they aren't of one class already:
   n sets of one class and m others cost n m / BLOCK and not n squared.
5. A task puts the sets of its blocks into a prefix tree.  Every set traverses it:
   the overlap with a shared path is counted once for all sets below, subtrees are
   pruned when overlap plus remaining length can't reach the threshold or their
   sizes can't, and when all below are in the set's class already.
6. Links become components.

Sets are exact up to 64-bit hashes of shingles and sets.  Defined cases: null or
blank text has an empty set and links with nothing; every row is judged by its own
text, so rows that share a doc_id may fall into different classes; a class is named
by its smallest doc_id; a null doc_id gets a null class and links nobody; only
doc_id and text are read, other columns may clash; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bloom
from . import _bytes as B
from ._plan import broadcastable, bucket_count, discard, small_batches, table, texts, written
from .components import UnionFind, connected

SIZE, PERCENT, BLOCK, PIVOTS = 4, 85, 512, 4
#: Share of a set that the first step looks at beyond the shortest prefix.
LEAD = 0.08
#: A shingle that more sets have is common: it ends the order of shingles.  At most MOST are told apart.
COMMON, MOST = 64, 1 << 18
#: A task deals so many shingles at a time.
FLUSH = 1 << 20


def needed(n: int, m: int, percent: int = PERCENT) -> int:
    """Least intersection of sets of n and m: 100 i >= percent (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n, percent: int = PERCENT):
    return n - -(-percent * n // 100) + 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    start, end, first = B.word_bounds(data, offsets)
    words = B.Rolling(data, fold=True).spans(start, end)
    grams = B.windows(words, size)
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= size:
            yield np.unique(grams[lo:hi - size + 1])
        elif hi > lo:
            yield B.windows(words[lo:hi], hi - lo)
        else:
            yield words[:0]


def set_id(grams: np.ndarray) -> tuple[bytes, int]:
    """A set's digest, and its first 64 bits as the set's name."""
    digest = hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
    return digest, int.from_bytes(digest[:8], "little", signed=True)


def least_shared(n, percent: int = PERCENT):
    """Shingles that a set of n shares with each partner among the first of both."""
    return np.maximum(1, np.ceil(LEAD * -(-percent * n // 100)).astype(np.int64))


def first_part(n, percent: int = PERCENT):
    """How many of a set's first shingles step 1 deals."""
    return np.minimum(n, n - -(-percent * n // 100) + np.maximum(1, np.ceil(LEAD * n).astype(np.int64)))


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.text_buffers(batch.column(1))
            sizes, keys = [], []
            for a, b in B.chunks(offsets):
                for grams in shingle_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], size):
                    sizes.append(len(grams))
                    keys.append(set_id(grams))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()), pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.int64()),
            ], names=["doc_id", "n_shingles", "set_key", "sid"])

    return run


def _sets(batches: Iterator[pa.RecordBatch], size: int, cut) -> Iterator[tuple[np.ndarray, ...]]:
    """(names, numbers of shingles, shingles, whole sizes) of the distinct sets of some texts,
    about FLUSH shingles at a time; ``cut`` tells how many of a set's first ones are wanted."""
    held: dict[int, tuple[np.ndarray, int]] = {}
    weight = 0

    def flush():
        names = np.fromiter(held, np.int64, len(held))
        grams, sizes = [x[0] for x in held.values()], np.array([x[1] for x in held.values()], np.int64)
        return names, np.array([len(g) for g in grams], np.int64), np.concatenate(grams), sizes

    for batch in batches:
        _, known = _bloom.batch_ids(batch.column(0))
        data, offsets = B.text_buffers(batch.column(1))
        for a, b in B.chunks(offsets):
            for i, grams in enumerate(shingle_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], size), a):
                if not known[i] or not len(grams) or (name := set_id(grams)[1]) in held:
                    continue
                held[name] = grams[:cut(len(grams))].copy(), len(grams)
                weight += len(held[name][0])
            if weight >= FLUSH:
                yield flush()
                held, weight = {}, 0
    if held:
        yield flush()


#: Columns of dealt shingles: documents, how many shingles of each follow, sizes of their whole sets.
_PARTS = ("docs", "counts", "sizes", "grams")
_KINDS = ("<i8", "<u4", "<u4", "<u8")


def _deal(rows: Iterator[tuple[np.ndarray, ...]], buckets: int) -> Iterator[pa.RecordBatch]:
    """(doc ids, numbers of shingles, shingles, whole set sizes) of a batch -> shingles by bucket; those of two
    documents of the batch by a negative bucket, and one of each for the others' sake."""
    for ids, count, grams, sizes in rows:
        if not len(grams):
            continue
        doc = np.repeat(np.arange(len(ids)), count)
        order = np.argsort(grams, kind="stable")
        same = grams[order][1:] == grams[order][:-1]
        shared = np.zeros(len(grams), bool)
        shared[order[1:][same]] = True
        shared[order[:-1][same]] = True
        first = order[np.r_[True, ~same]]
        first = first[shared[first]]
        bucket = (grams % np.uint64(buckets)).astype(np.int64)
        stand_in = bucket[first]
        bucket[shared] = -1 - ids[doc[shared]] % buckets
        bucket, doc, grams = np.r_[bucket, stand_in], np.r_[doc, doc[first]], np.r_[grams, grams[first]]
        order = np.lexsort((doc, bucket))
        bucket, doc, grams = bucket[order], doc[order], grams[order]
        edge = np.flatnonzero(np.r_[True, np.diff(bucket) != 0, True])
        out: tuple[list, list, list, list, list] = ([], [], [], [], [])
        for lo, hi in zip(edge[:-1], edge[1:]):
            cut = np.flatnonzero(np.r_[True, np.diff(doc[lo:hi]) != 0, True])
            out[0].append(int(bucket[lo]))
            out[1].append(ids[doc[lo:hi][cut[:-1]]].astype("<i8").tobytes())
            out[2].append(np.diff(cut).astype("<u4").tobytes())
            out[3].append(sizes[doc[lo:hi][cut[:-1]]].astype("<u4").tobytes())
            out[4].append(grams[lo:hi].astype("<u8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["bucket", *_PARTS])
        del doc, order, same, shared, bucket, grams, out
        B.release()


def _deal_texts(buckets: int, size: int, cut=lambda n: n):
    return lambda batches: _deal(_sets(batches, size, cut), buckets)


def _tally(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of each set's shingles in the bucket another set has."""
    ids, counts, _, grams = _parts(batches)
    doc = np.repeat(ids, counts.astype(np.int64))
    if key[0].as_py() >= 0:
        order = np.argsort(grams, kind="stable")
        g, d = grams[order], doc[order]
        head = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        many = np.minimum.reduceat(d, head) != np.maximum.reduceat(d, head)
        doc = d[np.repeat(many, np.diff(np.r_[head, len(g)]))]
    names, count = np.unique(doc, return_counts=True)
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(count, pa.int64())], names=["sid", "n"])


def _parts(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    B.release()
    held: list[list[np.ndarray]] = [[] for _ in _PARTS]
    for batch in batches:
        for name, kind, into in zip(_PARTS, _KINDS, held, strict=True):
            into += [np.frombuffer(x.as_py(), kind) for x in batch.column(name)]
    return [np.concatenate(x) for x in held]


def _shared(homes: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bucket's shingles that two documents have, packed by the documents' homes."""
        ids, counts, sizes, grams = _parts(batches)
        doc, size = np.repeat(ids, counts.astype(np.int64)), np.repeat(sizes, counts.astype(np.int64))
        if key[0].as_py() >= 0:
            order = np.argsort(grams, kind="stable")
            g, d = grams[order], doc[order]
            head = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            many = np.minimum.reduceat(d, head) != np.maximum.reduceat(d, head)
            keep = order[np.repeat(many, np.diff(np.r_[head, len(g)]))]
            doc, size, grams = doc[keep], size[keep], grams[keep]
        home = doc % homes
        order = np.lexsort((doc, home))
        home, doc, size, grams = home[order], doc[order], size[order], grams[order]
        edge = np.flatnonzero(np.r_[True, np.diff(home) != 0, True]) if len(home) else np.zeros(1, np.int64)
        out: tuple[list, list, list, list, list] = ([], [], [], [], [])
        for lo, hi in zip(edge[:-1], edge[1:]):
            cut = np.flatnonzero(np.r_[True, np.diff(doc[lo:hi]) != 0, True])
            out[0].append(int(home[lo]))
            for into, x, kind in zip(out[1:], (doc[lo:hi][cut[:-1]], np.diff(cut), size[lo:hi][cut[:-1]], grams[lo:hi]), _KINDS, strict=True):
                into.append(x.astype(kind).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["home", *_PARTS])

    return _hinted(run)


def _hinted(run):
    run.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def _assembled(percent: int):
    """A home's documents whose prefix holds a shared shingle: their shared shingles in
    order, and how many of those are in the prefix."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, sizes, grams = _parts(batches)
        doc, size = np.repeat(ids, counts.astype(np.int64)), np.repeat(sizes, counts.astype(np.int64))
        order = np.lexsort((grams, doc))
        doc, size, grams = doc[order], size[order].astype(np.int64), grams[order]
        new = np.r_[True, (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])] if len(doc) else np.zeros(0, bool)
        doc, size, grams = doc[new], size[new], grams[new]
        edge = np.flatnonzero(np.r_[True, np.diff(doc) != 0, True]) if len(doc) else np.zeros(1, np.int64)
        n = size[edge[:-1]] if len(doc) else size
        lead = prefix_length(n, percent) - (n - np.diff(edge))
        some = np.flatnonzero(lead > 0)
        yield pa.RecordBatch.from_arrays([
            pa.array(doc[edge[some]], pa.int64()), pa.array(n[some], pa.int64()),
            pa.array([grams[edge[i]:edge[i + 1]].tobytes() for i in some], pa.binary()), pa.array(lead[some], pa.int64()),
        ], names=["doc_id", "n", "grams", "lead"])

    return _hinted(run)


def _candidates(dealt: DataFrame, buckets: int, percent: int) -> DataFrame:
    """(doc_id, n, grams, lead) from dealt shingles.  Answers travel packed by home, a
    share of the sets as large as a bucket."""
    homes = buckets
    packed = dealt.groupBy("bucket").applyInArrow(_shared(homes), "home bigint, docs binary, counts binary, sizes binary, grams binary")
    return packed.groupBy("home").applyInArrow(_assembled(percent), "doc_id bigint, n bigint, grams binary, lead bigint")


_DEALT = "bucket bigint, docs binary, counts binary, sizes binary, grams binary"


class Node:
    """A path segment of the tree; what is below it, for pruning."""

    __slots__ = ("segment", "children", "ends", "below", "least", "most", "rest", "last")

    def __init__(self, segment, children, ends, below, least, most, rest, last):
        self.segment, self.children, self.ends, self.below = segment, children, ends, below
        self.least, self.most, self.rest, self.last = least, most, rest, last

    def inside(self, classes: UnionFind, own) -> bool:
        """All sets below are in the class.  Classes only grow, so of members found
        together one stands for all from then on."""
        roots = {classes.find(i) for i in self.below}
        if len(roots) < len(self.below):
            self.below = list(roots)
        return roots == {own}


def build(sets: list[np.ndarray], sizes: list[int], members: list[int], rank: list[int], depth: int = 0) -> list[Node]:
    """Compressed prefix tree over the members' ordered sets from ``depth`` on; rank is
    each member's turn as a probe."""
    heads: dict[int, list[int]] = {}
    for i in members:
        heads.setdefault(int(sets[i][depth]), []).append(i)
    nodes: list[Node] = []
    todo = [(group, depth, nodes) for group in heads.values()]
    while todo:
        group, at, into = todo.pop()
        first, stop = sets[group[0]], min(len(sets[i]) for i in group)
        same = stop - at
        for i in group[1:]:
            differ = np.flatnonzero(sets[i][at:at + same] != first[at:at + same])
            if len(differ):
                same = int(differ[0])
        cut = at + same
        ends = [i for i in group if len(sets[i]) == cut]
        size = [sizes[i] for i in group]
        node = Node(first[at:cut], [], ends, list(group), min(size), max(size), max(len(sets[i]) for i in group) - cut, max(rank[i] for i in group))
        into.append(node)
        split: dict[int, list[int]] = {}
        for i in group:
            if len(sets[i]) > cut:
                split.setdefault(int(sets[i][cut]), []).append(i)
        todo += [(g, cut, node.children) for g in split.values()]
    return nodes


def tree_links(ids: list[int], sets: list[np.ndarray], sizes: list[int], percent: int = PERCENT, labels: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join classes, found by sending every set through the tree of all;
    sets of one label are in one class from the start."""
    classes, links = UnionFind(), []
    order = sorted(range(len(ids)), key=lambda i: (sizes[i], ids[i]))
    rank = [0] * len(ids)
    for turn, i in enumerate(order):
        rank[i] = turn
    roots, apart, of_label = build(sets, sizes, order, rank), len(ids), {}
    for i, label in enumerate(labels or ()):
        apart -= label != 0 and classes.union(of_label.setdefault(label, i), i)
    for x in order:
        mine, n = sets[x], sizes[x]
        low, high = -(-percent * n // 100), 100 * n // percent
        stack = [(node, 0) for node in roots]
        while stack and apart > 1:
            node, overlap = stack.pop()
            # a pair is tried once, from its earlier probe
            if node.last <= rank[x] or node.most < low or node.least > high or node.inside(classes, classes.find(x)):
                continue
            want = needed(n, max(node.least, low), percent)
            done = 0
            while done < len(node.segment):
                part = node.segment[done:done + 128]
                at = np.searchsorted(mine, part)
                overlap += int(np.count_nonzero(mine[np.minimum(at, len(mine) - 1)] == part))
                done += len(part)
                if overlap + len(node.segment) - done + node.rest < want or overlap + len(mine) - int(at[-1]) < want:
                    overlap = -1
                    break
            if overlap < 0:
                continue
            for i in node.ends:
                if overlap >= needed(n, sizes[i], percent) and classes.union(x, i):
                    links.append((ids[x], ids[i]))
                    apart -= 1
            stack += [(child, overlap) for child in node.children]
    return links


def _tree_join(percent: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, tuple[np.ndarray, int, int]] = {}
        for batch in batches:
            for doc, n, grams, label in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "grams", "label")), strict=True):
                rows[doc] = (np.frombuffer(grams, "<u8"), n, label)
        ids = sorted(rows)
        links = tree_links(ids, *([rows[i][k] for i in ids] for k in (0, 1)), percent, [rows[i][2] for i in ids])
        rows.clear()
        B.release()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

    return _hinted(run)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a batch's sets have each shingle."""
    for batch in batches:
        if batch.num_rows:
            gram, n = np.unique(np.concatenate([np.frombuffer(g.as_py(), "<i8") for g in batch.column(0)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(n, pa.int64())], names=["gram", "n"])


def common_shingles(held: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, ranks) of those that more than COMMON of the sets have, the rarest first; the
    bound doubles until at most MOST are left.  They only order the sets, so the table stays small."""
    counts = written(held.select("grams").mapInArrow(_gram_counts, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") > COMMON))
    many, bound = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).count().collect(), COMMON
    while sum(r["count"] for r in many if 2 << r.b > bound) > MOST:
        bound *= 2
    rows = counts.filter(F.col("n") > bound).toPandas()
    discard(counts)
    gram, n = rows["gram"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    rank = np.empty(len(gram), np.int64)
    rank[np.lexsort((gram, n))] = np.arange(len(gram))
    order = np.argsort(gram)
    return gram[order], rank[order]


def _leads(common, percent: int):
    """One row for each shared shingle of a prefix long enough for ``least_shared`` common
    ones; the common shingles come last.  near: in the shortest prefix; first: the first of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, rank = common.value
        for batch in batches:
            out, sizes, near, many = [], [], [], []
            for raw, n, lead in zip(batch.column("grams"), batch.column("n").to_pylist(), batch.column("lead").to_pylist(), strict=True):
                mine = np.frombuffer(raw.as_py(), "<i8")
                at = np.minimum(np.searchsorted(grams, mine), max(len(grams) - 1, 0))
                hot = grams[at] == mine if len(grams) else np.zeros(len(mine), bool)
                stop = min(len(mine), lead + int(least_shared(n, percent)) - 1)
                rare = mine[~hot][:stop]
                out += [rare, mine[hot][np.argsort(rank[at[hot]])][:stop - len(rare)]] if len(rare) < stop else [rare]
                sizes.append(stop)
                near.append(np.arange(stop) < lead)
                many.append(np.arange(stop) >= len(rare))
            first = np.zeros(sum(sizes), bool)
            first[np.cumsum([0, *sizes[:-1]])] = True
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(batch.column("doc_id").to_numpy(), sizes), pa.int64()), pa.array(np.repeat(batch.column("n").to_numpy(), sizes), pa.int64()),
                pa.array(np.concatenate(out), pa.int64()), *(pa.array(np.concatenate(x), pa.bool_()) for x in (near, many)), pa.array(first, pa.bool_()),
            ], names=["doc_id", "n", "gram", "near", "common", "first"])

    return lambda batches: run(b for b in batches if b.num_rows)


def _verified(percent: int):
    """Of pairs (a, b) with their sizes and shared shingles, those that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("n").to_pylist(), batch.column("m").to_pylist()
            grams = [[np.frombuffer(x.as_py(), "<u8") for x in batch.column(c)] for c in ("x", "y")]
            keep = pa.array([len(np.intersect1d(x, y, assume_unique=True)) >= needed(i, j, percent) for x, y, i, j in zip(*grams, n, m, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    return run


def suspects(docs: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles): the first document of each set that may link with another."""
    buckets = bucket_count(docs, 32 << 20)
    dealt = texts(docs).mapInArrow(_deal_texts(buckets, size, lambda n: int(first_part(n, percent))), _DEALT)
    told = dealt.groupBy("bucket").applyInArrow(_hinted(_tally), "sid bigint, n bigint").groupBy("sid").agg(F.sum("n").alias("n_shared"))
    need = F.greatest(F.lit(1), F.ceil(LEAD * F.ceil(F.col("n_shingles") * percent / 100)))
    first = sets.filter("n_shingles > 0 and doc_id is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"))
    return first.join(told, "sid").filter(F.col("n_shared") >= need).select("doc_id", "n_shingles")


def _groups(lead: DataFrame) -> DataFrame:
    """(id, component) of the sets that shared prefix shingles join; a shingle's sets meet in
    shares first, so that a very common one isn't one task's."""
    part = lead.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    near = part.groupBy("gram", "share").agg(F.min("doc_id").alias("hub"))
    far = near.groupBy("gram").agg(F.min("hub").alias("centre"))
    one = part.join(near, ["gram", "share"]).filter("doc_id != hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))
    two = near.join(far, "gram").filter("hub != centre").select(F.col("hub").alias("a"), F.col("centre").alias("b"))
    return connected(one.unionByName(two).distinct())


def links(docs: DataFrame, sets: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between sets, by name: enough for the components."""
    spark = docs.sparkSession
    some = written(suspects(docs, sets, size, percent))
    weight = some.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-weight // FLUSH))
    dealt = texts(docs).join(broadcastable(some.select("doc_id")), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_deal_texts(buckets, size), _DEALT)
    held = written(_candidates(dealt, buckets, percent))
    common = spark.sparkContext.broadcast(common_shingles(held))
    lead = written(held.select("doc_id", "n", "grams", "lead").mapInArrow(_leads(common, percent), "doc_id bigint, n bigint, gram bigint, near boolean, common boolean, first boolean"))
    placed = lead.filter("first").select("doc_id", "n", F.col("gram").alias("key")).join(_groups(lead.filter("near").select("doc_id", "gram")), F.col("doc_id") == F.col("id")).select(
        "doc_id", "component", F.floor(F.log(F.col("n")) / F.log(F.lit(100.0 / percent))).alias("class"), "key"
    )
    # sets with the same first shingle are cut into one block, if they aren't more than a block
    alike = placed.groupBy("component", "class", "key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    placed = written(placed.join(alike, ["component", "class", "key"]).withColumn("spot", F.xxhash64("key", F.pmod(F.xxhash64("doc_id"), F.col("parts")))).drop("key", "parts"))
    whole = held.select("doc_id", "n", "grams")

    # first every block by itself, with some sets of its group and of the size classes beside
    group = placed.groupBy("component", "class").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).alias("cuts"),
        *(F.min_by("doc_id", F.xxhash64(F.lit(i), F.col("doc_id"))).alias(f"p{i}") for i in range(PIVOTS)),
    )
    own = placed.join(group.select("component", "class", "cuts"), ["component", "class"]).select("doc_id", "component", "class", F.pmod("spot", "cuts").alias("cut"))
    pivots = group.select(
        "component", "class", F.explode(F.array_distinct(F.array(*(f"p{i}" for i in range(PIVOTS))))).alias("doc_id")
    ).select("component", "doc_id", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("class"))
    guests = pivots.join(group.select("component", "class", "cuts"), ["component", "class"]).select(
        "doc_id", "component", "class", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut")
    )
    routed = own.unionByName(guests).distinct().join(whole, "doc_id").withColumn("label", F.lit(0).cast("bigint"))
    near = written(routed.groupBy("component", "class", "cut").applyInArrow(_tree_join(percent), "a bigint, b bigint"))

    # then sets of different classes: pairs that share enough shingles of their prefixes, none of them common
    several = group.groupBy("component").agg(F.sum("cuts").alias("blocks")).filter("blocks > 1").select("component")
    rest = placed.join(several, "component").join(connected(near).select(F.col("id").alias("doc_id"), F.col("component").alias("label")), "doc_id", "left")
    rest = written(rest.withColumn("label", F.coalesce("label", "doc_id")))
    one = lead.join(rest.select("doc_id", "label"), "doc_id").filter("not common").select("gram", F.col("doc_id").alias("a"), "n", F.col("label").alias("p"))
    two = one.select("gram", F.col("a").alias("b"), F.col("n").alias("m"), F.col("p").alias("q"))
    fits = (F.col("a") < F.col("b")) & (F.col("p") != F.col("q")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    enough = F.greatest(F.lit(1), F.ceil(LEAD * F.ceil(F.least("n", "m") * percent / 100)))
    pairs = one.join(two, "gram").filter(fits).groupBy("a", "n", "b", "m").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= enough).drop("c")
    sides = [held.select(F.col("doc_id").alias(c), F.col("grams").alias(g)) for c, g in (("a", "x"), ("b", "y"))]
    few = written(pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(_verified(percent), "a bigint, b bigint"))

    # and the blocks of sets with a common shingle in the prefix, except those of one class already
    lead = lead.filter("common").select("doc_id", "gram")
    rest = rest.join(lead.select("doc_id").distinct(), "doc_id", "left_semi")
    kin = rest.groupBy("component", "class", "label").agg(F.count(F.lit(1)).alias("n"))
    kin = kin.withColumn("kind", F.when(F.col("n") >= BLOCK, F.col("label")).otherwise(0))  # 0: all the small ones
    kinds = kin.groupBy("component", "class", "kind").agg(F.ceil(F.sum("n") / BLOCK).alias("cuts"))
    told = rest.join(kin.select("component", "class", "label", "kind"), ["component", "class", "label"])
    at = ["component", "class", "kind"]
    cut = F.pmod(F.when(F.col("kind") == 0, F.col("spot")).otherwise(F.xxhash64("doc_id")), F.col("cuts")).alias("cut")
    blocks = written(told.join(kinds, at).select("doc_id", "label", F.struct(*at, cut).alias("block")))
    # a class that fills several blocks is one partner; its blocks part again below
    face = F.struct(*(F.col(f"block.{c}") for c in at), F.when(F.col("block.kind") == 0, F.col("block.cut")).otherwise(-1).alias("cut"))
    holds = lead.join(blocks, "doc_id").select("gram", face.alias("x")).distinct()
    fits = (F.col("x.class") - F.col("y.class")).between(-1, 0) & (F.col("x") <= F.col("y")) & ((F.col("x.kind") != F.col("y.kind")) | (F.col("x.kind") == 0))
    pairs = holds.join(holds.withColumnRenamed("x", "y"), "gram").filter(fits).select("x", "y").distinct()
    faces = blocks.select(face.alias("face"), "block").distinct()
    units = pairs.join(faces.select(F.col("face").alias("x"), F.col("block").alias("p")), "x").join(faces.select(F.col("face").alias("y"), F.col("block").alias("q")), "y").select("p", "q")
    routes = units.select(F.col("p").alias("block"), "p", "q").unionByName(units.filter("p != q").select(F.col("q").alias("block"), "p", "q"))
    routed = blocks.select("doc_id", "label", "block").join(routes, "block").select("doc_id", "label", "p", "q").join(whole, "doc_id")
    far = routed.groupBy("p", "q").applyInArrow(_tree_join(percent), "a bigint, b bigint")
    return near.unionByName(few).unionByName(far)


def joined(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, one row a row of docs."""
    small_batches(docs.sparkSession)
    sets = written(texts(docs).mapInArrow(_sketch(size), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles bigint, set_key binary, sid bigint"))
    full = sets.filter("n_shingles > 0 and doc_id is not null")
    equal = full.groupBy("set_key", "sid").agg(F.min("doc_id").alias("first"))
    classes = connected(links(docs, sets, size, percent))
    linked = equal.join(classes, F.col("sid") == F.col("id")).select("set_key", "component", "first")
    named = linked.join(linked.groupBy("component").agg(F.min("first").alias("least")), "component").select("set_key", "least")
    by_set = equal.join(named, "set_key", "left").select("set_key", F.coalesce("least", "first").alias("component_id"))
    rest = sets.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.join(by_set, "set_key").select("doc_id", "n_shingles", "component_id").unionByName(rest)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))


#: The query's result stated in SQL.
ORACLE_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
   ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS grams FROM w),
 g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
 c AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS i FROM g a JOIN g b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
 e AS MATERIALIZED (SELECT x, y FROM c WHERE 100 * i >= 85 * (n + m - i)),
 r AS (SELECT doc_id AS id, doc_id AS root FROM s UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.id)
SELECT doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, (SELECT min(root) FROM r WHERE r.id = s.doc_id) AS component_id FROM s"""
