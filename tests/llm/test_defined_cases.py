"""Cases that the operators' docstrings define: long texts, repeated and nameless rows,
clashing columns, empty tables; and every pipeline stage against plain Python."""

import random

import corpus_pipeline
import numpy as np
import pytest
from brute import classes, contaminations, kept, lines, measures, pii, quality, sha, substrings, suffixes, without_lines
from brute import secrets as brute_secrets
from pyspark.sql import functions as F
from test_llm_operators import _tiktoken, corpus, frame

from orderloom.llm import bpe, decontaminate, line_dedup, ngram_join, pii as pii_ops, quality_rules, secrets, substring_dedup, suffix_dedup, url_filter


@pytest.fixture(scope="module")
def long_docs():
    """Texts beyond the chunks that operators work in, with what they look for near both ends."""
    r = random.Random(11)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    text = lambda n: "".join(r.choice(words) + r.choice("    \n") for _ in range(n))
    passage = text(90)
    big = f"token = abcdef123 {passage}\nthe very same line of text\n{text(260_000)}\nthe very same line of text\n{passage} mail bob@example.org"
    assert len(big) > 1 << 20
    return [(1, text(50)), (2, big), (3, passage + text(30)), (4, big[:300]), (5, "the very same line of text")]


def test_long_texts(spark, long_docs):
    df = frame(spark, long_docs).cache()
    found = line_dedup.dedup_lines(df).withColumn("d", line_dedup.digest("text")).collect()
    assert {x.doc_id: (x.n_lines, x.n_dropped, x.d) for x in found} == lines(long_docs)
    for x in quality_rules.judged(df).collect():
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == quality(dict(long_docs)[x.doc_id])
    found = substring_dedup.dedup_substrings(df).collect()
    assert {x.doc_id: (x.n_words, x.n_removed, sha(x.text)) for x in found} == substrings(long_docs)
    for x in secrets.scanned(df).collect():
        assert x.base_sha256 == sha(brute_secrets(dict(long_docs)[x.doc_id]))
    for x in pii_ops.identified(df).collect():
        assert ",".join(f"{pii_ops.KINDS[s.rank]}:{s.start}:{s.stop}" for s in x.base) == pii(dict(long_docs)[x.doc_id])
    found = {x.doc_id: x.component_id for x in ngram_join.joined(df).collect()}
    assert found == classes(long_docs, 4, 85)
    _, library = _tiktoken()
    for x in bpe.encode(df, with_digest=True).collect():
        assert np.frombuffer(x.ids, "<u4").tolist() == library.encode_ordinary(dict(long_docs)[x.doc_id])
        assert x.decoded_sha256 == sha(dict(long_docs)[x.doc_id])


def test_long_texts_by_bytes(spark, long_docs):
    some = [(d, t[:120_000] + t[-2000:]) for d, t in long_docs]
    found = suffix_dedup.dedup_suffixes(frame(spark, some)).collect()
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, sha(bytes(x.kept))) for x in found} == suffixes(some)


def test_one_doc_id_with_two_texts(spark):
    """Operators by text judge each row by itself."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    df = frame(spark, [(7, a), (7, b), (3, b + " more"), (9, a)])
    assert sorted((x.doc_id, x.component_id) for x in ngram_join.joined(df).collect()) == [(3, 3), (7, 3), (7, 7), (9, 7)]
    assert sorted(x.n_words for x in quality_rules.judged(df).collect()) == [60, 60, 60, 61]
    assert len(bpe.encode(df).collect()) == len(secrets.scanned(df).collect()) == 4
    assert sorted((x.doc_id, x.n_removed) for x in substring_dedup.dedup_substrings(df).collect())[0] == (3, 0)
    # rows that share a doc_id are separate occurrences of their bytes
    same = frame(spark, [(7, "x" * 500), (7, "x" * 500)])
    assert [x.n_removed for x in suffix_dedup.dedup_suffixes(same).collect()] == [500, 500]


def test_benchmark_rows_without_names(spark):
    item = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([(1, item, "x"), (1, item, "x"), (2, None, "y"), (None, "short one here", "z")], "item_id bigint, text string, doc_id string")
    docs = [(5, item), (5, item), (None, item), (None, "clean"), (None, None), (6, "a short one, here!"), (8, "")]
    df = spark.createDataFrame([(d, t, "en", "s", 1, "w", 3) for d, t in docs], "doc_id bigint, text string, lang string, source string, item_id int, words string, shift int")
    found = sorted((str(x.doc_id), str(x.item_id), x.matched) for x in decontaminate.overlaps(df, bench).collect())
    assert found == [("5", "1", 30), ("6", "None", 3), ("None", "1", 30)]
    left = decontaminate.clean(df, bench)
    assert left.columns == df.columns and sorted((str(x.doc_id), x.text) for x in left.collect() if x.text is not None) == [("8", ""), ("None", "clean")] and left.count() == 3


def test_pages_without_names(spark):
    rows = [(1, "http://a.com/en/1"), (1, "http://a.com/en/1"), (None, "http://a.com/en/2"), (None, None), (4, "http://a.com" + "/x" * 40), (5, "http://a.com" + "/x" * 39 + "/y")]
    df = spark.createDataFrame([(*r, "h", 1, "t") for r in rows], "page_id bigint, url string, host string, n int, template string")
    found = url_filter.judged(df).collect()
    assert len(found) == 6 and sorted(x.host for x in found) == ["", *["a.com"] * 5]
    assert all(x.verdict == "block" for x in found if x.rule)


def test_decontamination_by_brute_force(spark):
    r = random.Random(12)
    words = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(r.choices(words, k=r.choice([3, 8, 9, 15, 40])))) for i in range(25)]
    docs = []
    for d in range(120):
        w = r.choices(words, k=r.randint(0, 40))
        if r.random() < 0.7:
            u = r.choice(items)[1].split(" ")
            a = r.randint(0, len(u) // 2)
            u = [x if r.random() < 0.9 else "other" for x in u[a:len(u) - r.randint(0, len(u) // 2)]]
            if r.random() < 0.2:
                u.insert(len(u) // 2, "put")
            w[3:3] = u
        docs.append((d, " ".join(w)))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(x.doc_id, x.item_id): x.matched for x in decontaminate.overlaps(frame(spark, docs), bench).collect()}
    told = contaminations(docs, items, decontaminate.MASKS, decontaminate.SPAN, decontaminate.PERCENT, decontaminate.RUN, decontaminate.LEAST)
    assert found == told and len(told) > 10


def test_pipeline_by_brute_force(spark, tmp_path):
    docs = corpus(21, 150)
    rows = [(d, t, "en" if d % 3 else "de", f"s{d % 4}", len(t or "")) for d, t in docs]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    leak = next(t for d, t in docs if t and 60 < len(t.split()) < 200)
    items = [(1, leak), (2, "no such passage in any of these documents at all")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    good = kept({d: (lang, source, measures(t)) for d, t, lang, source, _ in rows}, quality_rules.FEATURES, quality_rules.SPREADS, quality_rules.SHRINK, quality_rules.BOUND)
    left = [(d, t) for d, t in docs if good[d]]
    left = [(d, t) for d, t in without_lines(left).items() if t.strip(" \t\n\x0b\x0c\r")]
    first = classes(left, 5, 80)
    left = [(d, t) for d, t in left if first[d] == d]
    bad = {d for d, _ in contaminations(left, items, decontaminate.MASKS, decontaminate.SPAN, decontaminate.PERCENT, decontaminate.RUN, decontaminate.LEAST)}
    assert bad and len(left) > len(bad)
    _, library = _tiktoken()
    told = {d: library.encode_ordinary(t) for d, t in left if d not in bad}
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id: np.frombuffer(x.ids, "<u4").tolist() for x in found} == told
    assert all(x.n_tokens == len(told[x.doc_id]) for x in found)


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Empty; repeated and nameless rows; columns that clash with the operators' own."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, ids string, sid int"
    bench = spark.createDataFrame([], "item_id bigint, text string")
    good = " ".join(f"word{i % 37} other{i}" for i in range(60))
    rows = [(1, good, "en", "a", 9, True, "x", 1)] * 2 + [(None, good + " tail", "en", "a", None, None, None, None)] * 2 + [(None, None, None, None, None, None, None, None), (3, "", "en", None, 0, None, None, None)]
    for name, some in (("empty", []), ("odd", rows)):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        found = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert sorted(str(x.doc_id) for x in found) == ([] if name == "empty" else ["1", "1", "None"])


def test_queries_keep_their_rows(spark):
    """Ties and repeated rows: as many rows as there were, of operators that return one a row."""
    docs = [(1, "same text here"), (1, "same text here"), (2, "same text here"), (None, "same text here")]
    df = frame(spark, docs)
    for f in (line_dedup.dedup_lines, substring_dedup.dedup_substrings, suffix_dedup.dedup_suffixes, ngram_join.joined, quality_rules.judged, secrets.scanned, pii_ops.sanitised):
        assert f(df).count() == 4
    assert df.filter(F.col("doc_id").isNull()).count() == 1
