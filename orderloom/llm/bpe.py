"""Byte-level BPE: pre-tokenisation by an associative scan, cached pair merging, decoding.

No regular expression runs over the text.  Every code point becomes a class
(letter, number, apostrophe that opens a contraction, last space before a word,
...; the look-ahead of at most three characters is in the class).  A class is a
transition function on the five states of the pre-tokeniser.  Functions compose
associatively, so the state before every code point comes from a scan over
functions: the text is laid out in rows, rows are scanned side by side, the row
totals are scanned in turn, and one look-up joins both.  A table of (state,
class) says where a slice begins.  Slices then go through a cache of merged
pairs.  Ids and token byte offsets are kept; decoding gathers from them.

The classes come from the interpreter's Unicode tables by a rule, the rank file
is a parameter.  Defined cases: null text is empty and has no tokens; texts of
any length are encoded whole; rows may repeat and a null doc_id is carried along;
columns other than those asked for are kept out, so names may clash; an empty
table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bytes as B
from ._plan import small_batches, table

#: Classes.  BREAK stands between two texts.
LETTER, NUMBER, OTHER, OPEN2, OPEN3, GLUE, LONE, RUN, BREAK = range(9)
#: States before a code point: a slice ended; in letters, numbers, others; after a
#: space that the next slice takes; one or two letters of a contraction to come; in white space.
START, IN_LETTER, IN_NUMBER, IN_OTHER, AFTER_GLUE, ONE_LEFT, TWO_LEFT, IN_SPACE = range(8)

#: The contractions of the pattern.
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")

MAX_CACHE = 250_000
#: Slices beyond so many bytes merge one at a time, by a heap.
LONG_SLICE = 64
NO_PAIR = np.int32(1 << 30)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, does a slice begin) for each [class, state]."""
    step, begin = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for kind, inside in ((LETTER, IN_LETTER), (NUMBER, IN_NUMBER), (OTHER, IN_OTHER)):
        step[kind] = inside
        begin[kind, [inside, AFTER_GLUE]] = False
    step[LETTER, ONE_LEFT], step[LETTER, TWO_LEFT] = START, ONE_LEFT
    begin[LETTER, [ONE_LEFT, TWO_LEFT]] = False
    for kind, then in ((OPEN2, ONE_LEFT), (OPEN3, TWO_LEFT)):
        step[kind] = then
        step[kind, [IN_OTHER, AFTER_GLUE]] = IN_OTHER
        begin[kind, [IN_OTHER, AFTER_GLUE]] = False
    step[GLUE], step[LONE], step[RUN], step[BREAK] = AFTER_GLUE, START, IN_SPACE, START
    begin[RUN, IN_SPACE] = False
    return step, begin


_STEP, _BEGIN = _automaton()


@functools.cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The functions that arise from the classes: (of each class, composition, image of START)."""
    seen = {bytes(range(8)): 0}
    todo = [bytes(range(8))]
    for f in todo:
        for c in range(9):
            g = bytes(_STEP[c][s] for s in f)
            if g not in seen:
                seen[g] = len(seen)
                todo.append(g)
    n = len(todo)
    compose = np.array([[seen[bytes(g[s] for s in f)] for g in todo] for f in todo], np.uint16 if n > 255 else np.uint8)
    of_class = np.array([seen[bytes(_STEP[c])] for c in range(9)], compose.dtype)
    return of_class, compose, np.array([f[START] for f in todo], np.uint8)


def scan(functions: np.ndarray, compose: np.ndarray, width: int = 64) -> np.ndarray:
    """Inclusive prefix compositions, left to right."""
    n = len(functions)
    if n <= width:
        out = functions.copy()
        for i in range(1, n):
            out[i] = compose[out[i - 1], out[i]]
        return out
    rows = -(-n // width)
    grid = np.zeros((rows, width), functions.dtype)  # 0 is the identity
    grid.ravel()[:n] = functions
    grid = np.ascontiguousarray(grid.T)
    for i in range(1, width):
        grid[i] = compose[grid[i - 1], grid[i]]
    before = np.zeros(rows, functions.dtype)
    before[1:] = scan(grid[-1], compose, width)[:-1]
    return compose[before, grid].T.ravel()[:n]


@functools.cache
def _point_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or RUN (white space) of every code point, and BREAK above them."""
    out = np.full(0x110001, OTHER, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            out[point] = LETTER
        elif kind == "N":
            out[point] = NUMBER
    space = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    out[space] = RUN
    out[0x110000] = BREAK
    return out


def slice_starts(points: np.ndarray) -> np.ndarray:
    """Mask of the code points at which a slice begins; 0x110000 stands between texts."""
    kind = _point_classes()[points]
    n = len(points)
    after = np.full(n + 3, 0x110000, points.dtype)
    after[:n] = points
    space = kind == RUN
    solid_next = np.zeros(n, bool)
    solid_next[:-1] = (kind[1:] != RUN) & (kind[1:] != BREAK)
    last = space & solid_next
    kind[last] = LONE
    kind[last & (points == 0x20)] = GLUE
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        one, two = after[quote + 1], after[quote + 2]
        for letters in CONTRACTIONS:
            hit = one == ord(letters[0])
            if len(letters) == 2:
                hit &= two == ord(letters[1])
            kind[quote[hit]] = OPEN2 if len(letters) == 1 else OPEN3
    of_class, compose, image = _monoid()
    before = np.zeros(n, np.uint8)
    before[1:] = image[scan(of_class[kind], compose)][:-1]
    return _BEGIN[kind, before] & (kind != BREAK)


class PairTable:
    """Open addressing in two arrays; looks up arrays of pairs."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, int(3 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - (size.bit_length() - 1)), size - 1
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NO_PAIR, np.int32)
        todo, home, self.probes = np.arange(len(keys)), self._home(keys), 0
        while len(todo):
            slot = (home[todo] + self.probes) & self.mask
            free = np.flatnonzero(self.keys[slot] == -1)
            first = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[first]], self.values[slot[first]] = keys[todo[first]], values[todo[first]]
            todo = np.delete(todo, first)
            self.probes += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids; NO_PAIR where the two don't merge or one is missing (-1)."""
        key = (left << 32 | right).ravel()
        out = np.full(len(key), NO_PAIR, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self._home(key[todo])
        for _ in range(self.probes):
            held = self.keys[slot]
            hit = held == key[todo]
            out[todo[hit]] = self.values[slot[hit]]
            more = ~hit & (held != -1)
            if not more.any():
                break
            todo, slot = todo[more], (slot[more] + 1) & self.mask
        return out.reshape(left.shape)


class Vocabulary:
    """Ranks from a rank file's bytes; merges slices with a bounded cache."""

    def __init__(self, raw: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}
        self.size = max(self.ranks.values()) + 1
        tokens = [b""] * self.size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.length)])
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.cache: dict[bytes, bytes] = {}

    @functools.cached_property
    def pairs(self) -> "PairTable":
        """(left id, right id) -> id of every two tokens that make a third."""
        keys, out = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    out.append(rank)
        return PairTable(np.array(keys, np.int64), np.array(out, np.int32))

    def merge_all(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of slices: the pair of lowest rank merges, leftmost first, until none
        is left; slices of like length go through their merges side by side."""
        out, short = {}, []
        for piece in pieces:
            whole = self.ranks.get(piece)
            if whole is not None:
                out[piece] = whole.to_bytes(4, "little")
            elif len(piece) > LONG_SLICE:
                out[piece] = np.array(self._merge_long(piece), "<u4").tobytes()
            else:
                short.append(piece)
        short.sort(key=len)
        for i in range(0, len(short), 4096):
            self._merge_rows(short[i:i + 4096], out)
        return out

    def _merge_rows(self, pieces: list[bytes], out: dict[bytes, bytes]) -> None:
        sizes = np.array([len(p) for p in pieces])
        row, width = np.arange(len(pieces)), int(sizes[-1])
        tokens = np.full((len(pieces), width), -1, np.int64)
        tokens[np.arange(width) < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.pairs.find(tokens[:, :-1], tokens[:, 1:])
        while len(row):
            if ranks.shape[1]:
                at = ranks.argmin(axis=1)
                low = ranks[np.arange(len(row)), at]
            else:
                at, low = np.zeros(len(row), np.int64), np.full(len(row), NO_PAIR, np.int32)
            done = low == NO_PAIR
            if done.any():
                kept = tokens[done] >= 0
                flat, ends = tokens[done][kept].astype("<u4").tobytes(), np.cumsum(kept.sum(axis=1)).tolist()
                for i, a, b in zip(row[done].tolist(), [0, *ends], ends):
                    out[pieces[i]] = flat[4 * a:4 * b]
                row, tokens, ranks, at, low = row[~done], tokens[~done], ranks[~done], at[~done], low[~done]
                if not len(row):
                    return
            n, width = tokens.shape
            line, columns = np.arange(n), np.arange(width - 1)
            tokens[line, at] = low
            tokens = np.take_along_axis(tokens, columns + (columns > at[:, None]), axis=1)
            columns = columns[:-1]
            ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), axis=1)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
            ranks[left, at[left] - 1] = self.pairs.find(tokens[left, at[left] - 1], tokens[left, at[left]])
            ranks[right, at[right]] = self.pairs.find(tokens[right, at[right]], tokens[right, at[right] + 1])

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges by a heap and linked neighbours, n log n for a slice of any length."""
        import heapq

        n, ranks = len(piece), self.ranks
        end, prev, nxt = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            if not alive[i] or end[i] != mid or mid >= n or not alive[mid] or end[mid] != stop:
                continue
            alive[mid], end[i], nxt[i] = False, stop, nxt[mid]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if (r := ranks.get(piece[i:end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (r, i, stop, end[nxt[i]]))
            if prev[i] >= 0 and (r := ranks.get(piece[prev[i]:stop])) is not None:
                heapq.heappush(heap, (r, prev[i], i, stop))
        return [ranks[piece[i:end[i]]] for i in range(n) if alive[i]]

    def ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each slice."""
        cache = self.cache
        if len(cache) > MAX_CACHE:
            cache.clear()
        missing = set(pieces).difference(cache)
        if missing:
            cache.update(self.merge_all(list(missing)))
        return [cache[p] for p in pieces]

    def offsets_of(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each token in the decoded bytes, and the total."""
        out = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.length[ids], out=out[1:])
        return out

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bytes of the tokens, gathered by their offsets."""
        shift = (self.begin[ids] - offsets[:-1]).astype(np.int64)
        return self.flat[np.repeat(shift, np.diff(offsets)) + np.arange(offsets[-1])]


def encode_chunk(vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, number of ids of each)."""
    docs = len(offsets) - 1
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    if not len(at):
        return np.zeros(0, np.uint32), np.zeros(docs, np.int64)
    whole = data.tobytes()
    points = np.frombuffer(whole.decode("utf-8").encode("utf-32-le"), np.uint32)
    doc = np.searchsorted(offsets, at, "right") - 1
    # a BREAK before every text
    spread = np.full(len(points) + docs, 0x110000, np.uint32)
    place = np.arange(len(points)) + doc + 1
    spread[place] = points
    start = at[slice_starts(spread)[place]]
    cuts = start.tolist()
    pieces = [whole[a:b] for a, b in zip(cuts, [*cuts[1:], len(whole)])]
    ids = vocabulary.ids_of(pieces)
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
    total = np.concatenate([[0], np.cumsum(sizes)])
    return np.frombuffer(b"".join(ids), "<u4"), np.diff(total[np.searchsorted(start, offsets)])


_LOADED: dict[int, Vocabulary] = {}


def _encode(shared, with_offsets: bool, with_decoded: bool, with_digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = shared.value
        key = hash(raw)
        if key not in _LOADED:  # one a worker process, with its cache
            _LOADED[key] = Vocabulary(raw)
        vocabulary = _LOADED[key]
        for batch in batches:
            data, offsets = B.text_buffers(batch.column("text"))
            rest = [c for c in batch.schema.names if c != "text"]
            for a, b in B.chunks(offsets, 1 << 20):  # a batch leaves as it goes, a chunk at a time
                found, counts = encode_chunk(vocabulary, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                ends = np.concatenate([[0], np.cumsum(counts)])
                places = vocabulary.offsets_of(found)
                out = vocabulary.decode(found, places).tobytes() if with_decoded or with_digest else b""
                raw_ids = found.tobytes()
                spans = list(zip(ends[:-1].tolist(), ends[1:].tolist()))
                columns, names = [batch.column(c).slice(a, b - a) for c in rest], list(rest)
                columns.append(pa.array([raw_ids[4 * lo:4 * hi] for lo, hi in spans], pa.binary()))
                names.append("ids")
                if with_offsets:
                    columns.append(pa.array([(places[lo:hi] - places[lo]).astype("<u4").tobytes() for lo, hi in spans], pa.binary()))
                    names.append("offsets")
                if with_decoded:
                    columns.append(pa.array([out[places[lo]:places[hi]] for lo, hi in spans], pa.binary()))
                    names.append("decoded")
                if with_digest:
                    columns.append(pa.array([hashlib.sha256(out[places[lo]:places[hi]]).hexdigest() for lo, hi in spans]))
                    names.append("decoded_sha256")
                yield pa.RecordBatch.from_arrays(columns, names=names)
        vocabulary.cache.clear()  # worker processes live on and serve other stages
        B.release()

    return run


def encode(
    docs: DataFrame, vocabulary_path: str | None = None, with_offsets: bool = False, with_decoded: bool = False,
    carry: tuple[str, ...] = (), with_digest: bool = False,
) -> DataFrame:
    """doc_id, the ``carry`` columns, ids (little-endian unsigned 32-bit), and, where asked for, the byte
    offset of each token (likewise), the bytes that the ids decode to, and those bytes' SHA-256.

    The rank file (under a megabyte) is read here and sent to the executors once.
    """
    if vocabulary_path is None:
        import public_tokenizers

        vocabulary_path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    small_batches(docs.sparkSession)
    with open(vocabulary_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *carry))
    schema = f"{kinds}, ids binary" + ", offsets binary" * with_offsets + ", decoded binary" * with_decoded + ", decoded_sha256 string" * with_digest
    return docs.select("doc_id", *carry, "text").mapInArrow(_encode(shared, with_offsets, with_decoded, with_digest), schema)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents"), with_digest=True))
