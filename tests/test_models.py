import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.functions import distances, graphs, morphisms, outbound, splices
from orderloom.functions import posets as P
from orderloom.functions import relations as R
from orderloom.operators import blocks, estimation, simulate
from orderloom.sources import drawings

ABC = ["a", "b", "c"]


def test_samples_of_trees_are_uniform_extensions():
    order = P.then(P.leaf("a"), P.par(P.then(P.leaf("b"), P.leaf("c")), P.leaf("d")))
    tree, rng = P.decompose(order), random.Random(1)
    found = [P.sample_tree_extension(tree, rng) for _ in range(3000)]
    words = sorted(P.words(order))
    assert sorted(set(found)) == words and P.tree_relation(tree) == order.relation()
    assert all(abs(found.count(w) / 3000 - 1 / len(words)) < 0.05 for w in words)


def test_ideal_bound_is_an_upper_bound():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 7)
        order = P.Order.of([str(i) for i in range(n)], [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.3])
        below = order.below
        ideals = sum(all(not below[e] & ~m for e in P.bits(m)) for m in range(1 << n))
        assert ideals <= P.ideal_bound(order) <= 2 ** n
    assert P.labels_of(P.leaf("a")) == {"a"}
    with pytest.raises(ValueError):
        P.labels_of(P.par(P.leaf("a"), P.leaf("a")))


def test_partition():
    p = P.Partition()
    for a, b in ((3, 4), (1, 2), (4, 5)):
        p.join(a, b)
    p.find(9)
    assert [sorted(x) for x in p.classes()] == [[3, 4, 5], [1, 2], [9]]


def test_loop_limit_and_observed_loops():
    rows = P.loop_limit(P.then(P.leaf("b"), P.leaf("c")), 0.25, (P.leaf("a"),), (P.leaf("d"),))
    assert sorted(rows) == sorted([("START", "a", 1.0), ("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 0.75), ("c", "b", 0.25), ("d", "END", 1.0)])
    with pytest.raises(ValueError):
        P.loop_limit(P.leaf("a"), 0.5, (P.leaf("a"),))
    assert [(len(o), w) for o, w in P.observed_loop_model(P.leaf("b"), [1, 1, 3, 2])] == [(1, 0.5), (2, 0.25), (3, 0.25)]


def test_alignments_and_distances():
    order = P.then(P.leaf("a"), P.par(P.leaf("b"), P.leaf("c")))
    assert [outbound.alignment_cost(t, order) for t in ("abc", "acb", "ab", "bac", "xabc", "")] == [0, 0, 1, 2, 1, 3]
    words = list(P.words(order))
    for t in itertools.product("abc", repeat=3):
        best = min(len(t) + len(w) - 2 * max(k for k in range(4) if any(_in(s, w) for s in itertools.combinations(t, k))) for w in words)
        assert outbound.alignment_cost(t, order) == best
    assert outbound.alignment_fitness([("abc", 1), ("ab", 1)], [(order, 1.0)]) == pytest.approx((1 + 1 - 1 / 5) / 2)
    laws = [P.law([(order, 1.0)]), {("a", "b", "c"): 1.0}, {("x",): 1.0}]
    found = outbound.pairwise_emd(laws)
    assert found[0][1] == found[1][0] == pytest.approx(distances.emd(laws[0], laws[1])) and found[2][2] == 0


def _in(short, long):
    rest = iter(long)
    return all(x in rest for x in short)


def _language(net, first, last, longest=9):
    """Words of a net by search over its markings."""
    found, seen, todo = set(), set(), [(tuple(sorted(first.items())), ())]
    while todo:
        marking, word = todo.pop()
        if (marking, word) in seen or len(word) > longest:
            continue
        seen.add((marking, word))
        held = dict(marking)
        if {p: n for p, n in held.items() if n} == last:
            found.add(word)
        for t, label in net["transitions"].items():
            into, onto = [s for s, x in net["arcs"] if x == t], [x for s, x in net["arcs"] if s == t]
            if all(held.get(p, 0) for p in into):
                new = dict(held)
                for p in into:
                    new[p] -= 1
                for p in onto:
                    new[p] = new.get(p, 0) + 1
                todo.append((tuple(sorted((p, n) for p, n in new.items() if n)), word + ((label,) if label else ())))
    return {w for w in found if len(w) <= longest}


def test_models_as_trees_and_nets():
    model = [(P.then(P.leaf("a"), P.par(P.leaf("b"), P.leaf("c"))), 0.5), (P.then(P.leaf("a"), P.leaf("d")), 0.5)]
    net, first, last = outbound.net(outbound.process_tree(model))
    assert _language(net, first, last) == set(P.law(model))
    loop = _language(*outbound.net(("seq", "a", ("loop", "b", None), "c")), longest=6)
    assert {("a", *"b" * k, "c") for k in range(1, 5)} == loop
    single, first, last = outbound.net(outbound.process_tree(model[:1]))
    assert distances.replay(single, ("a", "c", "b"), first, last)[2:] == (0, 0) != distances.replay(single, ("a", "b"), first, last)[2:]
    with pytest.raises(ValueError):
        outbound.process_tree([(P.n_order(), 1.0)])


def _log(spark, model, groups=60, per=4):
    log = simulate.grouped_log(spark, model, groups, per, seed=3)
    return log.select("group_id", R.from_trace(F.col("trace"), ABC).alias("chain"))


@pytest.fixture(scope="module")
def mixture(spark):
    model = [(P.Order.of(ABC, [(0, 1)]), 0.6), (P.Order.of(ABC, [(1, 0), (1, 2)]), 0.4)]
    log = _log(spark, model).cache()
    table = estimation.counts(log)
    orders, kind = estimation.candidates(spark, log, ABC)
    assert kind == "enumeration" and orders.count() == 19
    atom = estimation.atoms(orders, spark, ABC, (0.05,), (0.0,)).cache()
    return model, log, table, atom, estimation.group_loglik(table, estimation.pooled(table), atom, 3)


def test_fit_finds_the_mixture(spark, mixture):
    model, log, table, atom, logf = mixture
    w, gap, path = estimation.fit_mixture(logf)
    assert gap <= 1e-4 and sum(w.values()) == pytest.approx(1) and path == sorted(path)
    orders = {r.atom_id: r.order for r in atom.collect()}
    true = {estimation.to_mask(o, ABC): p for o, p in model}
    found = {orders[a]: x for a, x in w.items() if x > 0.05}
    assert set(true) <= set(found) and all(abs(found[o] - p) < 0.2 for o, p in true.items())
    # the same optimum from the moments' start, and by a dense solver
    ranking = estimation.moment_ranking(estimation.order_moments(atom, spark, ABC), estimation.pair_moments(log, ABC))
    first = estimation.moment_start(logf, atom, ranking)
    again, _, path2 = estimation.fit_mixture(logf, first=first)
    assert path2[-1] == pytest.approx(path[-1], abs=0.02)
    dense = logf.toPandas().pivot(index="atom_id", columns="group_id", values="logf").to_numpy()
    whole = estimation.corrected(dense, np.full(len(dense), 1 / len(dense)), 20000)
    top = dense.max(axis=0)
    assert float((np.log(whole @ np.exp(dense - top)) + top).sum()) == pytest.approx(path[-1], abs=0.02)


def test_refit_on_leftovers(spark, mixture):
    model, log, table, atom, logf = mixture
    w, _, _ = estimation.fit_mixture(logf)
    only = [o for o, _ in model][1]
    more = _log(spark, [(only, 1.0)], 30, 1).select((F.col("group_id") + 1000).alias("group_id"), "chain")
    new, loglik, gap = estimation.refitted(table, estimation.counts(more), atom, w, 3)
    mask = estimation.to_mask(only, ABC)
    place = {r.atom_id: r.order for r in atom.collect()}
    assert gap < 1e-3 and sum(x for a, x in new.items() if place[a] == mask) > sum(x for a, x in w.items() if place[a] == mask)


def test_candidates_by_class(spark, mixture):
    _, log, *_ = mixture
    closure, kind = estimation.candidates(spark, log, ABC, exact_up_to=2)
    chains = {r.chain for r in log.distinct().collect()}
    every = {0} | set(chains)
    while True:
        more = {a & b for a in every for b in every} - every
        if not more:
            break
        every |= more
    assert kind == "meet closure" and {r.order for r in closure.collect()} == every
    found, kind = estimation.candidates(spark, log, ABC, "sp", exact_up_to=2)
    assert kind == "heuristic" and chains <= {r.order for r in found.collect()}
    assert estimation.order_class("sp").extensions(P.par(P.leaf("a"), P.leaf("b"))) == 2
    assert not estimation.order_class("sp").holds(P.n_order()) and estimation.order_class("general").holds(P.n_order())
    for bad, error in (("odd", ValueError), (object(), TypeError)):
        with pytest.raises(error):
            estimation.order_class(bad)


def test_counting_limit(spark):
    orders = spark.createDataFrame([(estimation.to_mask(P.Order.of(ABC, p), ABC),) for p in ([(0, 1)], [(1, 2)])], "order bigint")
    law = estimation.laws(orders, spark, ABC)
    rows = orders.collect()
    rho = spark.createDataFrame([(rows[0].order, 0.7), (rows[1].order, 0.3)], "order bigint, rho double")
    found = {r.order: r.rho for r in estimation.counting_limit(law, rho).collect()}
    # each order has three words; they share one, whose mass is split in halves
    shared = (0.7 + 0.3) / 3
    assert found[rows[0].order] == pytest.approx(0.7 * 2 / 3 + shared / 2) and sum(found.values()) == pytest.approx(1)
    new = estimation.reweighted(spark.createDataFrame([(1, "x", 0.5)], "variant_id int, o string, weight double"), spark.createDataFrame([(1, 0.9)], "variant_id int, rho double"))
    assert [(r.o, r.weight) for r in new.collect()] == [("x", 0.9)]


def test_reports(spark):
    marginal = spark.createDataFrame([(0, 0.7, 0.0, 0.0), (R.bit(0, 1), 0.3, 0.1, 0.0)], "order bigint, w double, eps double, eta double")
    truth = spark.createDataFrame([(0, 0.6), (R.bit(0, 1) | R.bit(0, 2), 0.4)], "order bigint, w double")
    found = {(r.order, r.true_w, r.w, r.off) for r in estimation.recovery(marginal, truth).collect()}
    assert found == {(0, 0.6, 0.7, 0), (R.bit(0, 1) | R.bit(0, 2), 0.4, None, None), (R.bit(0, 1), None, 0.3, 1)}
    assert estimation.marginal_text(marginal, ABC).startswith("0.7000  (a || b || c)")
    assert "not converged" in estimation.fit_text([("x", 1.0, 0.0, 0.0)], -3.0, 0.1, "restricted")
    assert "told something" in estimation.against_chains(-1.0, -2.0, 4)


def test_keyed_logs(spark):
    model = [(P.then(*map(P.leaf, "abc")), 0.5), (P.then(*map(P.leaf, "cba")), 0.5)]
    rows = simulate.keyed_log(spark, model, 40, (1, 4), 0.0, seed=1).collect()
    per = {}
    for r in rows:
        per.setdefault(r.key, []).append("".join(r.trace))
    assert len(per) == 40 and all(1 <= len(v) <= 4 and len(set(v)) == 1 for v in per.values()) and {v[0] for v in per.values()} == {"abc", "cba"}
    assert rows == simulate.keyed_log(spark, model, 40, (1, 4), 0.0, seed=1).collect()


def test_refined_distance(spark):
    two = [(1, P.n_order()), (2, P.Order.of("abcd", [(0, 2), (1, 2), (0, 3)]))]
    rows = [(m, {"labels": list(o.labels), "less": [{"u": u, "v": v} for u, v in o.pairs()]}, 1.0) for m, o in two]
    from orderloom.functions.poset_columns import ORDER

    model = spark.createDataFrame(rows, f"model_id int, order {ORDER}, weight double")
    a, b = (set(P.chain_atoms(o)) for _, o in two)
    # one prime block each: the closed form over the shared atoms, in rows START and each atom
    d = blocks.refined_distance(model).first().d
    row = math.acos(len(a & b) / math.sqrt(len(a) * len(b)))
    assert d >= 2 * row - 1e-9 and blocks.refined_distance(model, normalize=True).first().d == pytest.approx(d / math.sqrt(len(a | b) + 2))
    assert blocks.refined_distance(model.withColumn("order", model.order).limit(2).filter("model_id = 1").unionByName(model.filter("model_id = 1").withColumn("model_id", F.lit(2)))).first().d == pytest.approx(0, abs=1e-6)


def test_drawings():
    a = morphisms.fragments(graphs.extract(graphs.from_tree(("seq", "a", ("loop", "b", "c"), "d"), "t")))
    b = morphisms.fragments(graphs.extract(graphs.from_tree(("seq", "a", "b", "d"), "t")))
    rep = splices.splices(a, "a")
    for dot in (
        drawings.overlay({"a": a, "b": b}), drawings.overlay({"a": a}, loops=True), drawings.merged_overlay({"a": a, "b": b}), drawings.splice_catalogue(rep),
        drawings.loop_gallery(rep), drawings.catalogue_graphs(a, 'the "a"'), drawings.markers_dot({"a": ([], [[("b", "t", 1, None)]])}),
        drawings.nets_dot({"t": outbound.net(("seq", "a", None))[0]}),
    ):
        assert dot.startswith("digraph") and dot.count("{") == dot.count("}") and dot.count("[") == dot.count("]")
    assert "a+b" in drawings.overlay({"a": a, "b": b, "c": b}).replace("b+c", "a+b") and "dashed" in drawings.splice_catalogue(rep)
    sig = graphs.extract(graphs.from_tree(("seq", "a", ("xor", "b", "c")), "t"))
    term = drawings.box(sig, "b") >> drawings.box(sig, "c") @ drawings.box(sig, "b")
    for svg in (drawings.matrix_map([("START", "a", 1.0), ("a", "END", 0.5)]), drawings.distance_map([("m", "n", 2.0)], {"m": "z"}), drawings.status_map([("x", "match", "novel")], ["p", "q"]), drawings.string_diagram(term, "t"), drawings.string_diagram(sig)):
        assert svg.startswith("<svg") and svg.endswith("</svg>") and len(re.findall("<rect", svg)) >= 2
    with pytest.raises(ValueError):
        drawings.pick(sig, "a")
    with pytest.raises(ValueError):
        drawings.status_map([("x", "match")] * 5, ["p"], limit=4)
    assert len(drawings.order_generators([(P.n_order(), 1.0)])) == 4 and set(drawings.listed(sig)) == {"a", "b", "c"}
    assert drawings.colours("ba") == {"a": drawings.PALETTE[0], "b": drawings.PALETTE[1]} and drawings.has_dot() in (True, False)


def test_likelihoods_are_made_where_the_groups_lie(spark, mixture):
    _, _, table, atom, logf = mixture
    text = logf._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and "Exchange" not in text[:text.index("MapInArrow")]  # nothing of atoms x groups moves
    pbar = estimation.pooled(table)
    k = estimation.kernel(pbar, atom, 3)
    rows = estimation.profiles(table)
    assert rows.agg(F.sum("n")).first()[0] == table.select("group_id").distinct().count() >= rows.count()
    weights = {int(a): (i + 1) / sum(range(len(k.ids) + 1)) for i, a in enumerate(k.ids)}
    frame = spark.createDataFrame(list(weights.items()), "atom_id int, w double")
    old = {r.atom_id: r.score for r in estimation.price(logf, estimation.log_mixture(logf, frame)).collect()}
    new = {r.atom_id: r.score for r in estimation.scores(rows, k, weights).collect()}
    assert new == pytest.approx(old, rel=1e-9)


def test_fit_from_counts_agrees_with_the_fit_from_likelihoods(spark, mixture):
    _, _, table, atom, logf = mixture
    w, gap, path = estimation.fit_mixture(logf)
    w2, gap2, path2 = estimation.fit_counts(table, estimation.pooled(table), atom, 3)
    assert gap <= 1e-4 and gap2 <= 1e-4 and path2[-1] == pytest.approx(path[-1], abs=1e-2)
    assert path2[0] == pytest.approx(path[0], rel=1e-9)


def test_traces_without_density(spark):
    table = spark.createDataFrame([(1, 7, 2), (1, 9, 1), (2, 9, 1), (None, 7, 1), (3, 8, 1)], "group_id bigint, chain bigint, cnt bigint")
    pbar = spark.createDataFrame([(7, 0.5), (9, 0.5)], "chain bigint, pbar double")
    atom = spark.createDataFrame([(0, 2, 2, 0.0, 0.0), (1, 0, 6, 0.0, 0.0)], "atom_id int, order bigint, e bigint, eps double, eta double")
    got = {(r.atom_id, r.group_id): r.logf for r in estimation.group_loglik(table, pbar, atom, 3).collect()}
    inf, ln = float("-inf"), math.log
    assert got == pytest.approx({(0, 1): inf, (0, 2): inf, (0, None): ln(1 / 2), (1, 1): 3 * ln(1 / 6), (1, 2): ln(1 / 6), (1, None): ln(1 / 6)})


def test_timed_likelihoods_of_groups(spark):
    rng = random.Random(5)
    rows = [(g if g else None, rng.sample(ABC, 3), [rng.random() * 4 for _ in ABC]) for g in range(5) for _ in range(6)]
    timed = spark.createDataFrame(rows, "group_id int, trace array<string>, gaps array<double>")
    model = [P.Order.of(ABC, pairs) for pairs in ([], [(0, 1)], [(2, 0), (2, 1)], [(0, 1), (1, 2)])]
    orders = spark.createDataFrame([(estimation.to_mask(o, ABC),) for o in model], "order bigint")
    lam, eps, eta, m = 0.5, 0.1, 0.05, 3
    rate, want = 3 * len(rows) / sum(sum(r[2]) for r in rows), {}
    for o in model:
        for g, trace, gaps in rows:
            done, load = [], 0.0
            fits = all(trace.index(a) < trace.index(b) for a, b in o.relation())
            for x, gap in zip(trace, gaps):
                load += gap * sum(y not in done and all(a in done for a, b in o.relation() if b == y) for y in ABC)
                done.append(x)
            clock = rate ** m * math.exp(-rate * sum(gaps))
            share = sum(r[1] == trace for r in rows) / len(rows)
            p = fits * (1 - eta) * (1 - eps) * lam ** m * math.exp(-lam * load) + (1 - eta) * eps / 6 * clock + eta * share * clock
            key = (estimation.to_mask(o, ABC), g)
            want[key] = want.get(key, 0.0) + math.log(p)
    found = estimation.timed_loglik(timed, orders, ABC, lam, eps, eta)
    assert {(r.order, r.group_id): r.logf for r in found.collect()} == pytest.approx(want)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and "Exchange" not in text[:text.index("MapInArrow")]
