import itertools

import pytest
from pyspark.sql import functions as F

from orderloom.functions import algebra as A
from orderloom.functions import composition as C
from orderloom.functions import constraints as K
from orderloom.functions import discovery as D
from orderloom.functions import graphs as G
from orderloom.functions import outbound
from orderloom.operators import discover, simulate, succession


def tally(words):
    rows = []
    for w in words:
        rows += [("first", w[0], None, 1), ("last", w[-1], None, 1)] + [("next", a, b, 1) for a, b in zip(w, w[1:])]
    return D.Follows.of(rows)


@pytest.mark.parametrize(("words", "tree"), [
    (["abc"], ("seq", "a", "b", "c")), (["ab", "ac"], ("seq", "a", ("xor", "b", "c"))), (["abc", "acb"], ("seq", "a", ("and", "b", "c"))),
    (["abd", "abcbd", "abcbcbd"], ("seq", "a", ("loop", "b", "c"), "d")), (["aab"], ("seq", ("loop", "a", None), "b")), (["abc", "ac"], ("seq", "a", ("xor", "b", None), "c")),
])
def test_trees_by_cuts(words, tree):
    assert D.tree(tally(words)) == tree


def test_trees_hold_their_logs():
    from orderloom.functions.distances import replay

    for words in (["abcd", "acbd", "aed"], ["ab", "ba", "cab"], ["xyz", "yxz", "zx"]):
        found = D.tree(tally(words))
        net, first, last = outbound.net(found)
        assert all(replay(net, w, first, last)[2] == 0 for w in words), found


def test_heuristics_nets_group_what_goes_together():
    f = tally(["abcd", "acbd"] * 10 + ["aed"] * 10)
    arcs = {("a", "b"), ("a", "c"), ("a", "e"), ("b", "d"), ("c", "d"), ("e", "d")}
    h = D.heuristics(f, arcs)
    assert h.together_out == {("a", "b", "c")} and h.together_in == {("d", "b", "c")}
    sig = G.extract(D.from_heuristics({"t": h}))
    assert {frozenset(p[2] for p in g.right) for g in sig if g.label == "a"} == {frozenset("bc"), frozenset("e")}
    assert C.language(sig) == {tuple("abcd"), tuple("acbd"), tuple("aed")}


def test_cliques_are_maximal():
    pairs = {("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")}
    every = [frozenset(s) for n in range(1, 5) for s in itertools.combinations("abcd", n) if all(p in pairs for p in itertools.combinations(s, 2))]
    assert set(D._cliques(list("abcd"), pairs)) == {s for s in every if not any(s < t for t in every)}


def test_discovery_from_a_log(spark):
    rows, eid = [], 0
    for case in range(12):
        for a in ("pack", "weigh", "send") if case % 2 else ("weigh", "pack", "send"):
            rows.append((eid, a, 1000 * case + eid, f"o{case}", "order"))
            if a != "weigh":
                rows.append((eid, a, 1000 * case + eid, f"b{case}", "box"))
            eid += 1
    rel = spark.createDataFrame(rows, "eid bigint, activity string, ts bigint, oid string, otype string").withColumn("ts", F.timestamp_seconds("ts"))
    raw = discover.raw_models(rel)
    assert raw["tree"] == {"box": ("seq", "pack", "send"), "order": ("seq", ("and", "pack", "weigh"), "send")}
    found = discover.signatures(rel)
    assert set(found) == set(discover.NOTATIONS) and all(found.values())
    for notation in discover.NOTATIONS:
        assert discover.model(rel, notation)[1] == found[notation]
    assert {p[1] for g in found["ocpn"] if g.label == "send" for p in g.left} == {"order", "box"}
    assert discover.spliced(G.extract(G.from_tree(raw["tree"]["order"], "order")), "order", forget=False).families
    with pytest.raises(ValueError):
        discover.model(rel, "odd")
    # the one-pass tallies are the three tables
    log = rel.select("otype", F.col("oid").alias("case_id"), "activity", "ts", "eid")
    t = succession.tallies(log, "otype")
    assert {tuple(r) for r in t.filter("kind = 'next'").select("otype", "a", "b", "n").collect()} == {tuple(r) for r in succession.direct(log, "otype").collect()}


def test_bindings_and_neutral_ports():
    g = G.Generator("a", frozenset({("s", "o", "a")}), frozenset({("a", "o", "b"), ("a", "o", "c")}), frozenset(K.linear("2 <= `s|o|a` <= 5", "`a|o|b` + `a|o|c` == `s|o|a`")))
    legs, wide = A.bindings(g)
    assert legs == {("left", "o"): [(2, 5)]} and len(wide) == 1 and "left o 2..5" in A.bindings_text(g)
    n = next(iter(A.neutral([g])))
    assert n.left == {("*", "o", "a")} and A.constrained_ports(n) == {("*", "o", "a"), ("*", "o", "b"), ("*", "o", "c")}
    assert A.bindings_text(G.Generator("b", frozenset({("a", "o", "b")}), frozenset())) == "one of each"


def test_faithful_runs_keep_objects(spark):
    p = lambda *x: frozenset([tuple(x)])
    split = frozenset({("a", "o", "b"), ("a", "o", "c")})
    sig = {
        G.Generator("a", frozenset(), split, frozenset(K.linear("1 <= `a|o|b` <= 2", "1 <= `a|o|c` <= 2"))),
        G.Generator("b", p("a", "o", "b"), frozenset()), G.Generator("c", p("a", "o", "c"), frozenset()),
    }
    assert A.several_objects(sig)
    rows = simulate.faithful_relations(spark, sig, 30, seed=2).toPandas()
    assert set(rows.run) == set(range(30))
    for _, run in rows.groupby("run"):
        made = run[run.activity == "a"]
        assert 2 <= len(made) <= 4 and sorted(made.oid) == sorted(run[run.activity != "a"].oid)
    again = simulate.faithful_relations(spark, sig, 30, seed=2).toPandas()
    assert again.equals(rows)
