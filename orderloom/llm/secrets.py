"""Secret scans: a worklist of decoded layers, rescanned until nothing new appears.

Layer 0 is the text itself; its matches are the base spans.  A layer is scanned,
then every way to unwrap it is tried: percent escapes, \\uXXXX and \\xXX escapes,
base64 and, inside base64, gzip, zlib, bzip2 and xz.  What comes out is a new layer
on the worklist unless the document had it before (cycle detection by digest), so
nesting of any depth ends at a fixpoint.  Each layer keeps, for every character,
the range of the original text it came from, so a match in it becomes a span of the
original.  Spans of layers add to the base ones.

A run of base64 is read in both alphabets at once, at each of its four alignments,
so a word, a path or a prefix glued to its front hides nothing; runs that go on over
line ends are read joined as well.  Compressed streams are looked for by their first
bytes anywhere in what base64 gives and are decompressed through all members to
their end, again until nothing unwraps.  A decoded layer counts if it holds
``MIN_PLAIN`` printable ASCII characters in a row, without which it can hold neither
a match nor a wrapping.

Documents that hold none of the bytes a match or a wrapping needs are told apart
for a whole batch at once and never reach a regular expression.

Defined cases: null text is empty; texts are scanned whole; rows may repeat and
doc_id may be null; only doc_id and text are read, other columns may clash; an empty
table gives no rows.  A layer is held whole, so nothing guards a worker's memory
from a decompression bomb.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import _bytes as B
from ._plan import table, texts

#: Fixed values of the contract: kinds in order, patterns, least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})+")
ESCAPED = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)+={0,2}")
BREAKS = re.compile(r"[\r\n\x20\t=]+")
MIN_WRAPPED = 16
#: First bytes of gzip, zlib, bzip2 and xz.
MAGIC = re.compile(rb"\x1f\x8b|\x78[\x01\x5e\x9c\xda]|BZh|\xfd7zXZ\x00")
#: The shortest match, and the shortest wrapping that can hold one, are as long.
MIN_PLAIN = 12
PLAIN = re.compile(rb"[\x20-\x7e]{%d}" % MIN_PLAIN)


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of a text's matches, in contract order."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    return sorted(found)


@dataclass
class Layer:
    """A decoded text; ``low`` and ``high`` give each character's range in the original."""

    text: str
    low: np.ndarray
    high: np.ndarray

    def origin(self, start: int, end: int) -> tuple[int, int]:
        return int(self.low[start:end].min()), int(self.high[start:end].max())


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match replaced by what decode gives for it: [(text, start, end) in the match]."""
    out, low, high, at = [], [], [], 0
    for m in pattern.finditer(layer.text):
        out.append(layer.text[at:m.start()])
        low.append(layer.low[at:m.start()])
        high.append(layer.high[at:m.start()])
        for text, start, end in decode(m.group()):
            a, b = layer.origin(m.start() + start, m.start() + end)
            out.append(text)
            low.append(np.full(len(text), a))
            high.append(np.full(len(text), b))
        at = m.end()
    if not at:
        return None
    return Layer("".join([*out, layer.text[at:]]), np.concatenate([*low, layer.low[at:]]), np.concatenate([*high, layer.high[at:]]))


def _percent(run: str) -> Iterator[tuple[str, int, int]]:
    """Characters of a run of percent escapes; bytes that aren't UTF-8 stay as they are."""
    data, i = bytes.fromhex(run.replace("%", "")), 0
    while i < len(data):
        for size in (1, 2, 3, 4):
            try:
                text = data[i:i + size].decode()
            except UnicodeDecodeError:
                continue
            if text:
                break
        else:
            text, size = run[3 * i:3 * i + 3], 1
        yield text, 3 * i, 3 * (i + size)
        i += size


def _escapes(run: str) -> Iterator[tuple[str, int, int]]:
    units = [(int(m[1] or m[2], 16), m.start(), m.end()) for m in ESCAPED.finditer(run)]
    i = 0
    while i < len(units):
        code, start, end = units[i]
        if 0xD800 <= code < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1][0] < 0xE000:
            code, end = 0x10000 + ((code - 0xD800) << 10) + units[i + 1][0] - 0xDC00, units[i + 1][2]
            i += 1
        yield (run[start:end] if 0xD800 <= code < 0xE000 else chr(code)), start, end
        i += 1


def _codec(data: bytes):
    """What makes a decompressor for data that begin like a compressed stream."""
    if data[:2] == b"\x1f\x8b":
        return lambda: zlib.decompressobj(31)
    if data[:1] == b"\x78" and len(data) > 1 and (data[0] * 256 + data[1]) % 31 == 0:
        return zlib.decompressobj
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor
    return None


def _inflate(data: bytes) -> tuple[bytes, int]:
    """All members decompressed of data that begin like a compressed stream, and how many bytes
    they took; of a damaged one what comes before."""
    out, used = [], 0
    while (make := _codec(data[used:used + 8])) is not None:
        stream = make()
        try:
            for at in range(used, len(data), 1 << 12):
                out.append(stream.decompress(data[at:at + (1 << 12)]))
                if stream.eof:
                    used = min(at + (1 << 12), len(data)) - len(stream.unused_data)
                    break
            else:
                return b"".join(out), len(data)
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
            return b"".join(out), max(used, 1)
    return b"".join(out), max(used, 1)


def _unpacked(data: bytes) -> Iterator[bytes]:
    """What the compressed streams in the data hold, and those in them, until nothing unwraps."""
    seen, todo = set(), [data]
    while todo:
        data, at = todo.pop(), 0
        while (m := MAGIC.search(data, at)) is not None:
            out, used = _inflate(data[m.start():])
            at = m.start() + used
            if out and (digest := hashlib.blake2b(out, digest_size=16).digest()) not in seen:
                seen.add(digest)
                todo.append(out)
                yield out


def _readable(data: bytes) -> tuple[str, np.ndarray] | None:
    """The bytes as text and the bytes of each character, if it can hold anything."""
    if PLAIN.search(data) is None:
        return None
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1"), np.ones(len(data), np.int64)
    if len(text) == len(data):
        return text, np.ones(len(data), np.int64)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return text, 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000).astype(np.int64)


def _unwrapped(layer: Layer) -> Iterator[Layer]:
    """Every layer one step below."""
    if "%" in layer.text and (below := _replaced(layer, PERCENT, _percent)):
        yield below
    if "\\" in layer.text and (below := _replaced(layer, ESCAPE, _escapes)):
        yield below
    for whole, places in _runs(layer.text):
        for shift in range(4):
            body, held = whole[shift:], places[shift:]
            if len(body) % 4 == 1:
                body = body[:-1]
            if len(body) < MIN_WRAPPED:
                break
            data = base64.b64decode(body + "=" * (-len(body) % 4))
            for text, _ in filter(None, map(_readable, _unpacked(data))):  # a compressed stream's characters come from all of it
                a, b = layer.origin(int(places[0]), int(places[-1]) + 1)
                yield Layer(text, np.broadcast_to(np.int64(a), len(text)), np.broadcast_to(np.int64(b), len(text)))
            plain = _readable(data)
            if plain is None:
                continue
            text, sizes = plain
            end = np.cumsum(sizes)
            first, last = held[(end - sizes) * 4 // 3], held[np.minimum((end - 1) * 4 // 3 + 1, len(body) - 1)]
            yield Layer(text, layer.low[first], layer.high[last])


def _runs(text: str) -> Iterator[tuple[str, np.ndarray]]:
    """What may be base64, in the standard alphabet, and the place of each of its characters."""
    standard = lambda run: run.replace("-", "+").replace("_", "/")
    for m in BASE64.finditer(text):
        body = m.group().rstrip("=")
        yield standard(body), np.arange(m.start(), m.start() + len(body))
    if "\n" in text:
        for m in WRAPPED.finditer(text):
            cuts = [x.span() for x in BREAKS.finditer(m.group())]
            keep = np.ones(len(m.group()), bool)
            for a, b in cuts:
                keep[a:b] = False
            yield standard(BREAKS.sub("", m.group())), m.start() + np.flatnonzero(keep)


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a text as (start, kind, end)."""
    base = scan(text)
    spans, seen = set(base), {hashlib.blake2b(text.encode(), digest_size=16).digest()}
    places = np.arange(len(text))
    todo = [Layer(text, places, places + 1)]
    while todo:
        layer = todo.pop()
        for below in _unwrapped(layer):
            digest = hashlib.blake2b(below.text.encode("utf-8", "surrogatepass") + b"\0" + below.low.tobytes(), digest_size=16).digest()
            if digest in seen:
                continue
            seen.add(digest)
            todo.append(below)
            for start, kind, end in scan(below.text):
                a, b = below.origin(start, end)
                spans.add((a, kind, b))
    return base, sorted(spans)


def _long_runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, least: int) -> np.ndarray:
    """Starts of the runs of at least so many bytes of a class within a document."""
    mask = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(mask & (np.r_[True, ~mask[:-1]] | edge[:-1]))
    end = np.flatnonzero(mask & (np.r_[~mask[1:], True] | edge[1:])) + 1
    return start[end - start >= least]


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HEX = _class("0123456789abcdef")
_WRAPPED = _class("0123456789+/_-" + _LETTERS + _LETTERS.lower())
_SIGNS = _class(":=%\\")


def suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents that may hold a match or a wrapped layer."""
    if not len(data):
        return np.zeros(0, np.int64)
    key = np.flatnonzero((data[:-3] == 65) & (data[1:-2] == 75) & (data[2:-1] == 73) & (data[3:] == 65)) if len(data) > 3 else data[:0]
    at = np.concatenate([np.flatnonzero(_SIGNS[data]), key, _long_runs(data, offsets, _HEX, MIN_HEX), _long_runs(data, offsets, _WRAPPED, MIN_WRAPPED)])
    return np.unique(np.searchsorted(offsets, at, "right") - 1)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_NOTHING = hashlib.sha256(b"").hexdigest()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = B.text_buffers(batch.column(1))
        n = batch.num_rows
        counts, digest, spans = np.zeros((3, n), np.int64), [_NOTHING] * n, [""] * n
        for a, b in B.chunks(offsets):
            for i in (a + suspects(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])).tolist():
                base, every = find(data[offsets[i]:offsets[i + 1]].tobytes().decode())
                for _, kind, _ in base:
                    counts[kind, i] += 1
                digest[i] = hashlib.sha256(_joined(base).encode()).hexdigest()
                spans[i] = _joined(every)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c) for c in counts), pa.array(digest), pa.array(spans)],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, their digest, all spans."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(_scan, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))
