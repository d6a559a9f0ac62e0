"""Inputs on which an operator once did less than its whole job."""

import base64
import bz2
import gzip
import lzma
import random
import zlib

import corpus_pipeline
import pytest
from brute import components, sha, substrings
from pyspark.sql import functions as F
from test_llm_operators import frame

from orderloom.llm import ngram_join, pii, secrets, substring_dedup


def words(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


def test_substrings_repeated_in_the_smallest_document_of_a_batch(spark):
    for n in (80, 120, 400):
        passage = words("p", n)
        docs = [(2, f"{words('a', 30)} {passage}"), (5, f"{words('b', 30)} {passage} {words('c', 30)} {passage} {words('d', 9)} {passage}"), (7, passage)]
        df = frame(spark, docs).repartitionByRange(3, "doc_id")
        assert df.rdd.getNumPartitions() == 3
        rows = substring_dedup.dedup_substrings(df).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, sha(r.text)) for r in rows} == substrings(docs)


def test_substrings_of_repeated_rows(spark):
    passage = words("p", 120)
    docs = [(2, passage), (5, f"{passage} and {passage}")]
    rows = substring_dedup.dedup_substrings(frame(spark, docs + docs[1:]).coalesce(1)).withColumn("d", F.sha2("text", 256)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(2, 0), (5, 240), (5, 240)]


def test_pii_terms_of_copied_documents(spark):
    text = lambda i: f"foo{i} zebrafish is at bob@example.org today bar{i}"
    docs = [(i, text(i)) for i in range(5)] + [(1000 + i, text(0)) for i in range(1000)]
    docs += [(5000 + i, f"some other text number {i} that is at home today") for i in range(4000)]
    rows = {x.doc_id: x.added for x in pii.identified(frame(spark, docs + docs[:9])).collect()}
    found = {d: [t[s.start:s.stop] for s in rows[d]] for d, t in docs}
    assert all(("zebrafish" in found[d]) == (d < 5000) for d, _ in docs)
    assert not any("today" in found[d] for d, _ in docs)


def test_pii_terms_far_off_and_without_the_value(spark):
    away = " ".join(f"filler{k}" for k in range(40))
    docs = [(i, f"Zebrafish {i} {away} foo{i} is at bob@example.org today bar{i}") for i in range(6)]
    docs += [(50, f"another one on the zebrafish and xzebrafish {away}")]
    docs += [(100 + i, f"some other text number {i} that is at home today {away}") for i in range(300)]
    rows = {x.doc_id: x.added for x in pii.identified(frame(spark, docs)).collect()}
    found = {d: [t[s.start:s.stop] for s in rows[d]] for d, t in docs}
    assert found == {d: ["Zebrafish"] if d < 6 else ["zebrafish"] if d == 50 else [] for d, _ in docs}


def _assigned(packed, encode=base64.b64encode):
    return any(k == 0 for _, k, _ in secrets.find(f"x {encode(packed).decode()} y")[1])


def test_secrets_in_nested_streams():
    inner = b'secret: "hunter2hunter2"'
    assert all(map(_assigned, (gzip.compress(gzip.compress(inner)), gzip.compress(lzma.compress(inner)), bz2.compress(zlib.compress(gzip.compress(inner))))))


def test_secrets_in_url_safe_runs():
    r = random.Random(1)
    for pack in (zlib.compress, bz2.compress):
        for _ in range(50):
            noise = "".join(r.choice("abcdefghijklmnop ") for _ in range(200))
            assert _assigned(pack(f"{noise} secret: hunter2hunter2".encode()), base64.urlsafe_b64encode)


def test_secrets_behind_the_first_member_and_far_in():
    late = b" secret: hunter2hunter2"
    for pack in (gzip.compress, bz2.compress, lzma.compress):
        assert _assigned(pack(b"nothing here") + pack(late))
    assert _assigned(zlib.compress(b"! " * (1 << 23) + b"!" + late))


def test_near_duplicate_stage_takes_five_words_and_four_fifths(spark):
    text = words("w", 1000).split(" ")
    changed = ["other" if i % 47 == 20 else w for i, w in enumerate(text)]
    grams = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    assert len(grams(text) & grams(changed)) >= 0.8 * len(grams(text) | grams(changed))
    df = frame(spark, [(1, " ".join(text)), (2, " ".join(changed)), (3, words("v", 50))])
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()} == {1, 3}


def test_substring_factors_are_chains_of_their_sources(spark):
    r = random.Random(9)
    passages = [words(f"p{k}_", r.randint(55, 160)).split(" ") for k in range(5)]
    docs = []
    for d in range(40):
        w = []
        for _ in range(r.randint(1, 4)):
            p = r.choice(passages)
            a = r.randint(0, 20)
            w += [*(f"own{d}_{r.random()}" for _ in range(r.randint(0, 30))), *p[a:len(p) - r.randint(0, 20)]]
        docs.append((d * 3 + 1, " ".join(w)))
    held = {d: t.split(" ") for d, t in docs}
    found = substring_dedup.factors(frame(spark, docs)).collect()
    drop = {d: set() for d in held}
    for f in found:
        n = f.windows + substring_dedup.WINDOW - 1
        assert f.source < f.doc_id and held[f.doc_id][f.start:f.start + n] == held[f.source][f.source_start:f.source_start + n]
        drop[f.doc_id].update(range(f.start, f.start + n))
    told = substrings(docs)
    assert all(len(drop[d]) == told[d][1] for d in held)


def test_secrets_behind_glued_prefixes_and_over_lines():
    inner = b'first line, then secret: "hunter2hunter2" and the rest of a longer text that goes on'
    for encode in (base64.b64encode, base64.urlsafe_b64encode):
        for pack in (bytes, zlib.compress, gzip.compress, lzma.compress):
            run = encode(pack(inner)).decode()
            for prefix in ("", "https://h.example/a/", "x/ab/", "x/abc/", "x-", "id_", "q", "zz"):
                base, every = secrets.find(f"see {prefix}{run} end")
                assert any(k == 0 for _, k, _ in set(every) - set(base)), (encode, pack, prefix)
            lines = "\n".join(run[i:i + 40] for i in range(0, len(run), 40))
            assert any(k == 0 for _, k, _ in secrets.find(f"see {lines} end")[1]), (encode, pack)


def test_secrets_beside_bytes_that_are_no_text():
    assert _assigned(bytes(range(128, 256)) + b" secret: hunter2hunter2" + bytes(range(128, 256)))


def test_secret_spans_map_back():
    inner = "é plain words and token=abcdef0123 behind"
    run = base64.b64encode(inner.encode()).decode()
    text = f"漢 x/{run[:20]}\n  {run[20:]} end"
    base, every = secrets.find(text)
    assert base == [] and len(every) == 1
    a, _, b = every[0]
    at = len(inner[:inner.index("token")].encode())
    assert text[:a].replace("\n  ", "") == f"漢 x/{run[:at * 4 // 3]}"
    assert text[a:b].startswith(run[at * 4 // 3:][:4])


@pytest.mark.parametrize("common, most", [(2, 1 << 18), (2, 4)])
def test_sets_that_common_shingles_join_meet_by_their_rare_ones(spark, monkeypatch, common, most):
    rng = random.Random(common)
    stock = [words(f"s{i}", 12) for i in range(6)]  # phrases that many texts have
    texts = [f"{rng.choice(stock)} {words(f't{i // 6}x', 60)} {rng.choice(stock)} e{i}" for i in range(60)]
    texts += [f"{t} more words" for t in texts[::3]] + [" ".join(rng.sample(stock, 4)) for _ in range(20)]
    docs = list(enumerate(texts))
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "COMMON", common)
    monkeypatch.setattr(ngram_join, "MOST", most)
    found = ngram_join.joined(frame(spark, docs))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == components(docs)


def test_common_shingles_end_the_prefix(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON", 2)
    row = lambda i, grams: (i, 40, bytearray(b"".join(g.to_bytes(8, "little") for g in grams)), 3)
    held = spark.createDataFrame([row(1, [1, 2, 7, 8]), row(2, [1, 2, 7, 9]), row(3, [1, 2, 9, 11]), row(4, [1, 12])], "doc_id bigint, n bigint, grams binary, lead bigint")
    known = ngram_join.common_shingles(held)
    assert [x.tolist() for x in known] == [[1, 2], [1, 0]]
    rows = held.mapInArrow(ngram_join._leads(spark.sparkContext.broadcast(known), 85), "doc_id bigint, n bigint, gram bigint, near boolean, common boolean, first boolean").collect()
    assert [r.gram for r in rows if r.doc_id == 1] == [7, 8, 2, 1] and [r.gram for r in rows if r.doc_id == 4] == [12, 1]
    assert [(r.near, r.common, r.first) for r in rows if r.doc_id == 1] == [(True, False, True), (True, False, False), (True, True, False), (False, True, False)]
