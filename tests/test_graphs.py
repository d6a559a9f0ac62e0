from itertools import product

import pytest

from orderloom.functions import algebra as A
from orderloom.functions import composition as C
from orderloom.functions import constraints as K
from orderloom.functions import factored as FA
from orderloom.functions import graphs as G
from orderloom.functions import morphisms as M
from orderloom.functions import splices as S


def clinic():
    """A visit: a patient registers with a sample or without, is seen once or over again,
    and leaves with a bill when the lab has answered."""
    g = G.Graph({n: n for n in ("register", "draw", "analyse", "see", "repeat", "bill")})
    g.routers = {"start": "XOR", "lab": "XOR", "sample": "XOR", "answer": "XOR", "room": "XOR", "seen": "XOR", "skip": "SEQ", "end": "XOR"}
    flow = lambda typ, *path: g.edges.extend((s, t, typ) for s, t in zip(path, path[1:]))
    flow("patient", "start", "register", "room", "see", "seen", "bill", "end")
    flow("patient", "seen", "repeat", "room")
    flow("tube", "register", "lab", "draw", "sample", "analyse", "answer", "bill")
    flow("tube", "lab", "skip", "answer")
    return g.check()


def chosen_contexts(g, activity, forward):
    """Sets of ends over all ways to fix every choosing router's arc."""
    nexts = {n: [(t if forward else s, k) for s, t, k in g.edges if (s if forward else t) == n] for n in [*g.labels, *g.routers]}
    choosing = [r for r in g.routers if g.routers[r] == "XOR" and nexts[r]]
    found = set()
    for picks in product(*(nexts[r] for r in choosing)):
        pick, ends, todo = dict(zip(choosing, picks)), set(), [(n, k, ()) for n, k in nexts[activity]]
        while todo:
            n, typ, seen = todo.pop()
            if n in g.labels:
                ends.add((g.labels[n], typ))
            elif n not in seen:
                step = [pick[n]] if n in pick else nexts[n]
                todo += [(m, k if k is not None else typ, (*seen, n)) for m, k in step]
        found.add(frozenset(ends))
    return found


def test_extraction_is_all_choices_of_routers():
    for g in (clinic(), G.from_tree(("seq", "a", ("and", ("xor", "b", None), ("or", "c")), ("loop", "e", "f"), "g"), "t")):
        found = G.extract(g, drop_silent=False)
        assert found
        for n in g.labels:
            for forward in (False, True):
                side = {frozenset((p[2] if forward else p[0], p[1]) for p in (x.right if forward else x.left)) for x in found if x.label == g.labels[n]}
                assert side == {frozenset(x for x in b if x[0] != G.TERMINUS) for b in chosen_contexts(g, n, forward)}


def test_sequence_routers_take_all_their_arcs():
    g = G.Graph({"a": "a", "b": "b", "c": "c"}, {"m": "SEQ"}, [("a", "m", "t"), ("m", "b", "t"), ("m", "c", "t")])
    assert [x.right for x in G.extract(g) if x.label == "a"] == [frozenset({("a", "t", "b"), ("a", "t", "c")})]
    with pytest.raises(ValueError):
        G.extract(G.Graph({"a": "a", "b": "b"}, {"m": "MAYBE"}, [("a", "m", "t"), ("m", "b", "t")]))


def signature_of_clinic():
    """The clinic's generators with patients and tubes consumed at the end."""
    return G.extract(clinic())


def test_closings_are_the_composites():
    for sig in (signature_of_clinic(), G.extract(G.from_tree(("seq", "a", ("and", "b", ("xor", "c", "d"), ("seq", "e", "f")), "g"), "t"))):
        c = M.fragments(sig)
        orders = C.composites(sig)
        assert len(c.closings()) == len(orders) > 0 and not c.truncated
        assert sorted(sorted(g.label for g in c.run(x)) for x in c.closings()) == sorted(sorted(o.labels) for o in orders)
        assert c.generators() <= sig


def test_concurrent_branches_are_one_closing():
    sig = G.extract(G.from_tree(("seq", "s", ("and", *(("seq", f"x{i}", f"y{i}") for i in range(5))), "t"), "o"))
    c = M.fragments(sig)
    assert [len(c.run(x)) for x in c.closings()] == [12] and not c.loops()
    assert any(isinstance(step, frozenset) and len(step) == 5 for step in c.closings()[0].body)


def test_loops_anchor_where_they_are_entered():
    c = M.fragments(signature_of_clinic())
    assert {frozenset(g.label for g in c.run(x)) for x in c.loops()} == {frozenset({"see", "repeat"})}
    x = c.loops()[0]
    assert M.anchor(x) == (("patient", 1),) and S.skeleton(c, x) in (("see", "repeat"), ("repeat", "see"))
    keys = {c.graph(y, closed=True).key() for y in c.loops()}
    assert len(keys) == 1  # the cuts of one cycle look the same when closed
    assert "L1" in str(c) and M.has_placeholders({G.Generator("a", frozenset(), frozenset({("a", "t", "·0:t")}))})


def test_splices_give_the_traces():
    sig = signature_of_clinic()
    r = S.splices(M.fragments(sig), "clinic")
    assert len({f.term for f in r.families}) == len(r.families)
    c = M.fragments(sig)
    assert S.traces(c, 0) == C.language(sig)
    spliced = S.traces(c, 1)
    assert {w for w in C.language(sig, max_visits=2) if w.count("repeat") < 2} <= spliced
    assert all(w.count("see") == w.count("repeat") + 1 and w[0] == "register" and w[-1] == "bill" for w in spliced)
    assert {at for f in r.families for at, _ in f.splices}
    assert r.as_dict()["loops"][0]["cycle"] == "C1"


def test_schemas_forget_the_neighbours():
    p = lambda *x: frozenset([tuple(x)])
    sig = {G.Generator("go", frozenset(), p("go", "t", w)) for w in "ab"} | {G.Generator("work", p("go", "t", "work"), p("work", "t", "end"))}
    sig |= {G.Generator(w, p("go", "t", w), frozenset()) for w in "ab"}
    c = M.fragments(sig)
    assert sorted(S.skeleton(c, x) for x in c.closings()) == [("go", "a"), ("go", "b")]
    assert M.families_of_schemas(c) == {}
    twin = {G.Generator("run", p("in", "t", "run"), p("run", "t", "run")), G.Generator("run", p("run", "t", "run"), p("run", "t", "run"))}
    d = M.Catalogue({f"L{i}": M.Fragment(f"L{i}", tuple((q, 1) for q in g.left), (g,)) for i, g in enumerate(sorted(twin, key=str), 1)})
    assert [len(v) for v in M.families_of_schemas(d).values()] == [2]


def test_catalogue_differences():
    a = M.fragments(G.extract(G.from_tree(("seq", "a", ("loop", "b", "c"), "d"), "t")))
    b = M.fragments(G.extract(G.from_tree(("seq", "a", "b", "d"), "t")))
    found = S.difference(a, b)
    assert not found.equal and S.difference(a, a).equal
    assert found.paths[2] == {("a", "b", "d")} and len(found.loops[0]) >= 1 and not found.loops[1]
    same = S.spines({"a": a, "b": b})
    assert same.shared_by_all() == [("a", "b", "d")] and "a+b: 1" in same.summary()
    assert S.text(("a", "a", ("c", "b"), M.Ref("L1"))) == "a^2;(c x b);L1"
    assert S.loops_by_loops({("b", "c"): "L1", ("b", "c", "b", "c", "x"): "L2"})["L2"] == (M.Ref("L1"), M.Ref("L1"), "x")
    assert S.codes([("b", ("a", "c"))]) == {"a": "a", "b": "b", "c": "c"} and "closings" in S.catalogue_text("a", a) and "in both" in str(found)


def test_factored_signatures_multiply_late():
    for g in (clinic(), G.from_tree(("seq", "a", ("and", ("xor", "b", None), ("or", "c", "d")), ("loop", "e", "f"), "g"), "t")):
        f = FA.skeleton(g)
        assert f.materialise() == G.extract(g) and f.labels() == A.labels(G.extract(g))
        pool = {p: 1 for x in G.extract(g) for p in x.left}
        assert f.ready(pool) == {x for x in G.extract(g) if x.left}
    hub = G.Graph({"hub": "hub"})
    for i in range(20):
        hub.routers[f"m{i}"] = "XOR"
        hub.labels |= {f"x{i}": f"x{i}", f"y{i}": f"y{i}"}
        hub.edges += [(f"x{i}", f"m{i}", f"t{i}"), (f"y{i}", f"m{i}", f"t{i}"), (f"m{i}", "hub", f"t{i}")]
    f = next(x for x in FA.skeleton(hub).activities if x.label == "hub")
    assert len(f.ready({(f"x{i}", f"t{i}", "hub"): 1 for i in range(20)})) == 1 and not f.origin()


def test_signatures_up_to_renaming():
    sig = signature_of_clinic()
    other = {A._moved(g, lambda x: f"new {x}") for g in sig}
    assert A.isomorphic(sig, other) and not A.isomorphic(sig, {g for g in other if "bill" not in g.label})
    assert A.by_label(sig, "see") == {g for g in sig if g.label == "see"} and A.object_types(sig)["see"] == {"patient"}
    assert len(A.ports(sig)) == len({p for g in sig for p in g.left | g.right})


def test_common_boundary():
    p = lambda *x: frozenset([tuple(x)])
    marked = {G.Generator("START_o", frozenset(), p("START_o", "o", "a")), G.Generator("a", p("START_o", "o", "a"), p("a", "o", "END_o")), G.Generator("END_o", p("a", "o", "END_o"), frozenset())}
    opened = {G.Generator("a", frozenset(), p("a", "o", "b")), G.Generator("b", p("a", "o", "b"), frozenset())}
    assert A.common_boundary(marked) == {
        G.Generator("gamma1", frozenset(), p("gamma1", "o", "a")), G.Generator("a", p("gamma1", "o", "a"), p("a", "o", "gamma2")), G.Generator("gamma2", p("a", "o", "gamma2"), frozenset())}
    assert len(A.common_boundary(opened)) == 4 and A.common_boundary(A.common_boundary(opened)) == A.common_boundary(opened)


def test_grounding_keeps_objects():
    groups = {"a": ([[("START_o", "o", 1, 2)]], [[("b", "o", 0, 2), ("c", "o", 0, 2)]])}
    arcs, starts, ends = [("START_o", "o", "a"), ("a", "o", "b"), ("b", "o", "END_o"), ("a", "o", "c"), ("c", "o", "END_o")], {"o": "START_o"}, {"o": "END_o"}
    found = A.grounded_markers(groups, arcs, starts, ends)
    inner = [g for g in found if g.label == "a"]
    assert len(inner) == 2 + 3 and all(sum(g.weight(p) for p in g.left) == sum(g.weight(p) for p in g.right) for g in inner)
    assert {g.label for g in found} == {"a", "START_o", "END_o"}
    run = A.grounded_run(groups, arcs, starts, ends, {"o": 2})
    assert [g.weights for g in run if g.label == "gamma1"] == [frozenset({(("START_o", "o", "a"), 2)})]
    assert A.several_objects([G.Generator("a", frozenset(), frozenset(), A.firing_rules("a", *groups["a"][0], *groups["a"][1]))])


def test_profiles_are_the_keys_of_the_extraction():
    g = clinic()
    assert G.canonical(g) == {G.canonical_key(x) for x in G.extract(g)}
    tree = G.from_tree(("seq", "a", ("and", ("xor", "b", None), ("or", "c", "d")), ("loop", "e", "f"), "g"), "t")
    assert G.canonical(tree) == {G.canonical_key(x) for x in G.extract(tree)}


def test_many_optional_types_stay_small():
    g = G.Graph({"hub": "hub"})
    for i in range(14):
        g.routers[f"p{i}"] = "XOR"
        g.routers[f"skip{i}"] = "SEQ"
        for j in range(4):
            g.labels[f"x{i}{j}"] = f"x{i}{j}"
            g.edges.append((f"p{i}", f"x{i}{j}", f"t{i}"))
        g.edges += [("hub", f"p{i}", f"t{i}"), (f"p{i}", f"skip{i}", f"t{i}")]
    assert len(G.profiles(g, "hub", True)) == 2 ** 14  # not 5 ** 14


def test_rules_of_graphs():
    with pytest.raises(ValueError):
        G.Graph({"a": "a", "b": "b"}, {}, [("a", "b", None)]).check()
    with pytest.raises(ValueError):
        G.Graph({"a": "a", "b": "b"}, {"m": "XOR"}, [("a", "m", "t"), ("m", "b", "u")]).check()
    assert G.admissible("a", frozenset(), frozenset({("b", "t")}), {"a": ({"t"}, set())})
    assert not G.admissible("a", frozenset(), frozenset({("b", "t")}), {"a": (set(), set())})
    assert G.admissible("z", frozenset(), frozenset({("b", "t")}), {"a": (set(), set())})


def test_petri_nets_synchronise_and_drop_silent_steps():
    net = {"places": ["i", "m", "k", "o"], "transitions": {"1": "a", "2": None, "3": "b"}, "arcs": [("i", "1"), ("1", "m"), ("m", "2"), ("2", "k"), ("k", "3"), ("3", "o")]}
    found = G.extract(G.from_petri({"x": net, "y": net}))
    assert {(x.label, len(x.left), len(x.right)) for x in found} == {("a", 0, 2), ("b", 2, 0)}
    surfaced = G.extract(G.from_petri({"x": net}), surface=True)
    assert {x.label: len(x.right) for x in surfaced} == {"a": 1, "b": 0}


def test_bpmn_and_many_graphs(spark):
    g = G.from_bpmn({"t1": "A", "t2": "B"}, {"g": "XOR"}, ["s", "e"], [("s", "t1"), ("t1", "g"), ("g", "t2"), ("g", "e"), ("t2", "e")])
    # both arcs into the end event are needed: arcs of one activity combine by AND
    assert len(G.extract(g)) == 1 + 2 + 1 + 1
    rows = lambda i: [(i, n, "ACTIVITY", v, False) for n, v in g.labels.items()] + [(i, n, k, None, False) for n, k in g.routers.items()]
    nodes = spark.createDataFrame(rows(1) + rows(2), "graph_id int, node string, kind string, label string, silent boolean")
    edges = spark.createDataFrame([(i, *e) for i in (1, 2) for e in g.edges], "graph_id int, src string, tgt string, typ string")
    found = G.extract_table(nodes, edges)
    assert {r["graph_id"]: r["count"] for r in found.groupBy("graph_id").count().collect()} == {1: 5, 2: 5}


def test_loops_and_languages():
    tree = G.from_tree(("seq", "a", ("loop", "b", "c"), "d"), "t")
    sig = G.extract(tree)
    assert C.loops(sig) == [{"b", "c"}]
    assert C.language(sig) == {("a", "b", "d"), ("a", "b", "c", "b", "d")} or C.language(sig) == {("a", "b", "d")}
    assert ("a", "b", "c", "b", "d") in C.language(sig, max_visits=2)


def test_isomorphism_and_histories():
    from orderloom.functions.posets import Order

    a = Order.of("abab", [(0, 1), (2, 3)])
    b = Order.of("baba", [(1, 0), (3, 2)])
    assert C.isomorphic(a, b) and not C.isomorphic(a, Order.of("abab", [(0, 1), (2, 1)]))
    keys = C.history_keys(a)
    assert keys[0] == keys[2] and keys[1] == keys[3] and keys[0] != keys[1]


def test_constraints(spark):
    cs = K.linear("1 <= i <= 2", "0 <= n <= 2", "s == i + n")
    assert K.solve(cs) is None  # every variable is 1 by default
    found = list(K.solutions(cs, bound=4))
    assert {(x["i"], x["n"], x["s"]) for x in found} == {(i, n, i + n) for i in (1, 2) for n in (0, 1, 2)}
    assert K.ranges(cs, bound=4, lo=0) == {"i": (1, 2), "n": (0, 2), "s": (1, 4)}
    assert {(r.i, r.n, r.s) for r in K.solution_table(spark, cs, bound=4).collect()} == {(x["i"], x["n"], x["s"]) for x in found}
    assert K.feasible(cs, bound=2) and not K.feasible(K.linear("x == 3"), bound=2)
    with pytest.raises(K.TooLarge):
        list(K.solutions(K.linear(*(f"x{i} >= 0" for i in range(20))), bound=3))
    assert K.renamed(K.constraint({"a": 1, "b": -1, "c": 0}, "<=", 0), lambda _: "z").terms == ()


def test_constraints_from_text():
    assert K.linear("2 x - y >= 3") == [K.constraint({"x": 2, "y": -1}, ">=", 3)]
    assert K.linear("1 <= `a|t|b` <= 2") == [K.constraint({"a|t|b": 1}, ">=", 1), K.constraint({"a|t|b": 1}, "<=", 2)]
    assert K.linear("x + 1 == 4 - y") == [K.constraint({"x": 1, "y": 1}, "==", 3)]
    one = G.Generator("a", frozenset(), frozenset(), frozenset(K.linear("x >= 1")))
    assert K.system(K.linear("x >= 1"), K.linear("y >= 1")[0]) == K.system_of([one]) | set(K.linear("y >= 1"))
    for bad in ("x", "x >= ?", ""):
        with pytest.raises(ValueError):
            K.linear(bad)
