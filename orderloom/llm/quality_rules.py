"""Quality rules: base rules, then thresholds that the corpus itself sets.

One pass measures every text.  The ratios of all texts that pass the base rules
feed mergeable quantile sketches (KLL), one a language, source and feature:
partial sketches are built where the rows are and only merged ones move, so a
source with a third of the rows costs no more than a small one.

A group's sketch gives a centre (the median) and a spread to each side (the 0.9 and
0.1 quantiles' distance from it, in standard deviations of a normal law).  Every
source has one vote in its language's centre and spread (medians over the sources),
and every language in the corpus's; a language is drawn towards the corpus as if it
held two more votes of it.  A group of n texts is drawn towards its language as if
it held ``SHRINK`` more texts of it, and its centre and spread stay within
``BOUND`` spreads of the language's, so a source full of junk doesn't set its own
fence.  Nothing switches by a group's size.

A text fails where a ratio is more than ``SPREADS`` of (spread + noise) above the
centre; the mean word length also below.  The noise is the ratio's own error in a
text of that length: a share of c over m units has the error of counting it,
sqrt((c + u / m) u / m), where u is how many units one event adds at least.

Defined cases: null or empty text has no words and fails the base; a null
language or source is a group of its own; rows may repeat, doc_id may be null; an
empty table gives no rows; only doc_id, text, lang, source and the columns asked
for are read, other columns may clash.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bytes as B
from ._plan import broadcastable, small_batches, table, written

#: Fixed values of the contract: symbols, shortest text, window, largest share of repeated words.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30

#: Feature -> what is counted, over what, and how many units one event adds at least
#: (two windows of a repeat; None: a mean of word lengths, whose error follows from half the mean a word).
FEATURES = {
    "symbols": ("n_symbols", "n_words", 1), "capitals": ("n_capitals", "word_chars", 1), "marks": ("n_marks", "n_words", 1),
    "dup_lines": ("n_dup_lines", "n_lines", 1), "repeats": ("n_repeat_words", "n_words", 2 * WINDOW), "length": ("word_chars", "n_words", None),
}
SPREADS, SHRINK, BOUND, SKETCH_K = 4.0, 50, 3.0, 200
#: Standard normal quantile of 0.9.
_NORMAL = 1.2816

_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_SYMBOL, _CAPITAL, _MARK = _flags(SYMBOLS), _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _flags("!?")


def repeated(keys: np.ndarray) -> np.ndarray:
    """Mask of the keys that occur twice or more."""
    ordered = np.sort(keys)
    many = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(many):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(many, keys)
    return many[np.minimum(at, len(many) - 1)] == keys


def measure_chunk(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """_MEASURES of each document, one row a measure."""
    docs = len(offsets) - 1
    out = np.zeros((len(_MEASURES), docs), np.int64)
    if not len(data):
        return out
    per_doc = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    start, end, first = B.word_bounds(data, offsets)
    out[0] = np.diff(first)
    out[1] = per_doc(((data & 0xC0) != 0x80) & ~B.IS_SPACE[data])
    out[2], out[6], out[7] = per_doc(_SYMBOL[data]), per_doc(_CAPITAL[data]), per_doc(_MARK[data])

    rolling = B.Rolling(data)
    a, b, lines = B.line_bounds(data, offsets)
    lo, hi = B.strip_bounds(data, a, b)
    owner = np.repeat(np.arange(docs), np.diff(lines))
    real = hi > lo
    out[5] = np.bincount(owner[real], minlength=docs)
    keys = B.mix64(rolling.spans(a[real], b[real]) + owner[real].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    again = np.ones(len(keys), bool)
    again[np.unique(keys, return_index=True)[1]] = False
    out[3] = np.bincount(owner[real][again], minlength=docs)

    if len(start) >= WINDOW:
        word_doc = np.repeat(np.arange(docs), out[0])
        inside = word_doc[WINDOW - 1:] == word_doc[:len(word_doc) - WINDOW + 1]
        at = np.flatnonzero(inside)
        keys = B.windows(rolling.spans(start, end), WINDOW)[at]
        keys = B.mix64(keys + word_doc[at].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        hit = at[repeated(keys)]
        if len(hit):
            out[4] = np.bincount(word_doc[B.covered(len(start), hit, WINDOW)], minlength=docs)
    return out


def _measure(keep_text: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = B.text_buffers(batch.column("text"))
        parts = [measure_chunk(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]) for a, b in B.chunks(offsets)]
        found = np.concatenate(parts, axis=1) if parts else np.zeros((len(_MEASURES), 0), np.int64)
        rest = [c for c in batch.schema.names if keep_text or c != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in rest), *(pa.array(x) for x in found)], names=[*rest, *_MEASURES]
        )
        del data, parts, found
    B.release()


def measured(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, source, the ``carry`` columns (text may be one), the measures,
    the ratios and base_failed."""
    small_batches(docs.sparkSession)
    held = docs.select("doc_id", "text", "lang", "source", *(c for c in carry if c != "text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema if f.name != "text" or "text" in carry)
    run = functools.partial(_measure, "text" in carry)
    rows = held.mapInArrow(run, ", ".join([kinds, *(f"{m} bigint" for m in _MEASURES)]))
    return rows.withColumns({
        **{f: F.col(top) / F.greatest(F.col(per), F.lit(1)) for f, (top, per, _) in FEATURES.items()},
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    })


def fences(rows: DataFrame) -> DataFrame:
    """(f_lang, f_source, and of each feature a centre, a spread above and one below)."""
    k, parts = F.lit(SKETCH_K), ("centre", "above", "below")
    sketch = written(rows.filter(~F.col("base_failed")).groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"), *(F.kll_sketch_agg_double(F.col(f), k).alias(f) for f in FEATURES)
    ))
    q = lambda f, r: F.kll_sketch_get_quantile_double(F.col(f), F.lit(r))
    own = [F.col("lang"), F.col("source"), F.col("n")]
    for f in FEATURES:
        own += [q(f, 0.5).alias(f"centre_{f}"), ((q(f, 0.9) - q(f, 0.5)) / _NORMAL).alias(f"above_{f}"), ((q(f, 0.5) - q(f, 0.1)) / _NORMAL).alias(f"below_{f}")]
    group = sketch.select(*own)
    names = [f"{part}_{f}" for f in FEATURES for part in parts]
    votes = group.groupBy("lang").agg(F.count(F.lit(1)).alias("votes"), *(F.median(c).alias(f"l_{c}") for c in names))
    corpus = votes.agg(*(F.median(f"l_{c}").alias(f"c_{c}") for c in names))
    language = votes.join(F.broadcast(corpus)).select(
        F.col("lang").alias("of_lang"), *(((F.col("votes") * F.col(f"l_{c}") + 2 * F.col(f"c_{c}")) / (F.col("votes") + 2)).alias(f"l_{c}") for c in names)
    )
    drawn = lambda c: (F.col("n") * F.col(c) + SHRINK * F.col(f"l_{c}")) / (F.col("n") + SHRINK)
    out = [F.col("lang").alias("f_lang"), F.col("source").alias("f_source")]
    for f in FEATURES:
        centre, above, below = (F.col(f"l_{p}_{f}") for p in parts)
        out.append(F.greatest(F.least(drawn(f"centre_{f}"), centre + BOUND * above), centre - BOUND * below).alias(f"centre_{f}"))
        out += [F.least(drawn(f"above_{f}"), BOUND * above).alias(f"above_{f}"), F.least(drawn(f"below_{f}"), BOUND * below).alias(f"below_{f}")]
    return group.join(language, F.col("lang").eqNullSafe(F.col("of_lang"))).select(*out)


def _within(f: str) -> Column:
    """The text's ratio is inside of its group's fence."""
    _, per, unit = FEATURES[f]
    m, centre = F.greatest(F.col(per), F.lit(1)), F.col(f"centre_{f}")
    noise = centre / 2 / F.sqrt(m) if unit is None else F.sqrt((centre + unit / m) * unit / m)
    inside = F.col(f) <= centre + SPREADS * (F.col(f"above_{f}") + noise)
    return inside & (F.col(f) >= centre - SPREADS * (F.col(f"below_{f}") + noise)) if unit is None else inside


def judged(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every document with its measures, base_failed and kept.  Texts are measured once,
    into a table.  Only groups with a text that passes the base have fences; the others
    hold nothing to keep."""
    rows = written(measured(docs, carry))
    bound = written(fences(rows))
    match = F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source"))
    within = functools.reduce(lambda x, y: x & y, map(_within, FEATURES))
    return rows.join(broadcastable(bound), match, "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(False)))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
