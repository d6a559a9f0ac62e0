import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.functions import distances as D
from orderloom.functions import graphs as G
from orderloom.functions import posets as P
from orderloom.functions import relations as R
from orderloom.operators import blocks, estimation, signatures, simulate, succession
from orderloom.sources import event_log, sinks

ABC = ("a", "b", "c")


def masks(spark, *orders):
    rows = [(sum(R.bit(ABC.index(x), ABC.index(y)) for x, y in o),) for o in orders]
    return spark.createDataFrame(rows, "order bigint")


def test_emd():
    p = {("a", "b"): 0.5, ("b", "a"): 0.5}
    assert D.emd(p, p) == pytest.approx(0)
    assert D.emd(p, {("a", "b"): 1.0}) == pytest.approx(0.5 * 1.0)
    assert D.emd({("a",): 1.0}, {("a", "b"): 0.5, ("c",): 0.5}) == pytest.approx(0.25 + 0.5)
    assert D.edit_distance("kitten", "sitting") == 3


def test_replay():
    net = {"places": ["i", "m", "o"], "transitions": {"1": "a", "2": "b", "t": None}, "arcs": [("i", "1"), ("1", "m"), ("m", "2"), ("2", "o"), ("m", "t"), ("t", "o")]}
    assert D.replay(net, ["a", "b"], {"i": 1}, {"o": 1}) == (3, 3, 0, 0)
    assert D.replay(net, ["a"], {"i": 1}, {"o": 1}) == (3, 3, 0, 0)
    assert D.replay(net, ["b"], {"i": 1}, {"o": 1}) == (2, 2, 1, 1)
    assert D.replay_fitness([(2, 2, 1, 1, 1)]) == pytest.approx(0.5)


def test_simulated_groups_are_refitted(spark):
    chain, free = P.from_trace("abc"), P.par(*map(P.leaf, "abc"))
    log = simulate.grouped_log(spark, [(chain, 0.6), (free, 0.4)], 120, 5, seed=3).withColumn("chain", R.from_trace(F.col("trace"), ABC)).cache()
    again = simulate.grouped_log(spark, [(chain, 0.6), (free, 0.4)], 120, 5, seed=3)
    assert sorted(map(tuple, log.select("group_id", "trace_no").collect())) == sorted(map(tuple, again.select("group_id", "trace_no").collect()))
    every = masks(spark, [], [("a", "b")], [("a", "b"), ("a", "c"), ("b", "c")], [("c", "a"), ("c", "b"), ("b", "a")])
    table = estimation.counts(log)
    atom = estimation.atoms(every, spark, ABC, (0.05,), (0.0,))
    weights, gap, path = estimation.fit_mixture(estimation.group_loglik(table, estimation.pooled(table), atom, 3))
    assert sum(weights.values()) == pytest.approx(1) and gap < 0.01 and all(b >= a - 1e-9 for a, b in zip(path, path[1:]))
    by_order = {r.order: weights.get(r.atom_id, 0.0) for r in atom.collect()}
    true = {r.component: r["count"] / 600 for r in log.groupBy("component").count().collect()}
    assert by_order[sum(R.bit(i, j) for i, j in ((0, 1), (0, 2), (1, 2)))] == pytest.approx(true[0], abs=0.08)
    law = estimation.laws(every.limit(4), spark, ABC)
    rho = estimation.fit_weights(table, law)
    assert sum(rho.values()) == pytest.approx(1)


def test_off_support_is_an_error(spark):
    log = spark.createDataFrame([(1, ["b", "a", "c"])], "group_id int, trace array<string>").withColumn("chain", R.from_trace(F.col("trace"), ABC))
    law = estimation.laws(masks(spark, [("a", "b")]), spark, ABC)
    with pytest.raises(ValueError):
        estimation.counting_weights(estimation.counts(log), law)
    out = estimation.log_likelihood(estimation.counts(log), law, law.select("order").distinct().withColumn("rho", F.lit(1.0))).first().loglik
    assert out == -math.inf


def test_enabled_counts_and_timed_density(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "c"], [1.0, 2.0, 3.0])], "group_id int, trace array<string>, gaps array<double>")
    orders = masks(spark, [], [("a", "b"), ("b", "c"), ("a", "c")], [("b", "a")])
    k = rows.crossJoin(orders).select("order", estimation.enabled_counts("order", "trace", ABC).alias("k")).collect()
    chain = R.bit(0, 1) + R.bit(1, 2) + R.bit(0, 2)
    assert {r.order: r.k for r in k}[0] == [3, 2, 1] and {r.order: r.k for r in k}[chain] == [1, 1, 1]
    got = {r.order: r.logf for r in estimation.timed_loglik(rows, orders, ABC, 0.5).collect()}
    assert got[0] == pytest.approx(3 * math.log(0.5) - 0.5 * (3 + 4 + 3)) and got[chain] == pytest.approx(3 * math.log(0.5) - 3.0)
    assert got[R.bit(1, 0)] == -math.inf


def test_corrected_weights_and_bootstrap():
    r = np.random.default_rng(0)
    f = np.log(r.random((3, 200)))
    w = estimation.corrected(f, np.full(3, 1 / 3))
    assert w.sum() == pytest.approx(1) and (w >= 0).all()
    assert estimation.bootstrap(f, w, 5).shape == (5, 3)


def test_closure_and_orders(spark):
    chain = masks(spark, [("a", "b"), ("b", "c")])
    row = chain.select(R.closed(F.col("order"), 3).alias("c"), R.is_order(F.col("order"), 3).alias("o")).first()
    assert row.c == R.bit(0, 1) + R.bit(1, 2) + R.bit(0, 2) and row.o is False


def test_matrix_modes(spark):
    model = spark.createDataFrame([(1, ["a", "b"], 1.0), (2, ["a", "c"], 1.0)], "model_id int, blocks array<string>, weight double")
    d = {m: blocks.matrix_distance(model, mode=m).first().d for m in ("sink", "selfloop")}
    # a differs fully; b and c are unused in the other model
    assert d["sink"] == pytest.approx(2 * math.sqrt((math.pi / 2) ** 2))
    assert d["selfloop"] == pytest.approx(2 * math.sqrt(3 * (math.pi / 2) ** 2))
    with pytest.raises(ValueError):
        blocks.matrix_distance(model, mode="none").collect()


def test_signature_algebra(spark):
    sig = spark.createDataFrame([("x", ["s|t|x"], ["x|t|gamma2"]), ("y", ["x|t|y"], ["y|t|x"])], "label string, left array<string>, right array<string>")
    assert signatures.close_termini(sig).filter("label = 'gamma2'").count() == 1
    assert signatures.degenerate_filtered(sig).select("label").collect()[0][0] == "x" and signatures.degenerate_filtered(sig).count() == 1
    kappa = spark.createDataFrame([("x", [], []), ("y", [], [])], "label string, creates array<string>, consumes array<string>")
    assert signatures.violations(sig, kappa).count() == 0
    assert signatures.drop_boundary(sig).filter("label = 'x'").first().right == []


def test_runs_become_logs(spark):
    from orderloom.functions import composition as C

    sig = G.extract(G.from_tree(("seq", "a", ("and", "b", "c"), "d"), "t"))
    rel = simulate.relations_of_runs(spark, list(C.runs(sig)))
    assert rel.select("activity").distinct().count() == 4
    assert event_log.objects_of(rel).count() >= 2
    assert succession.dependency_graph(rel).filter("src = 'START_t'").count() >= 1


def test_grouping_needs_an_assumption(spark):
    log = spark.createDataFrame([("k", 1)], "key string, x int")
    with pytest.raises(ValueError):
        event_log.grouped(log, "key")
    kept, rest = event_log.grouped(log, "key", 1, "one key, one habit")
    assert (kept.count(), rest.count()) == (1, 0)


def test_sinks(spark, tmp_path):
    arcs = spark.createDataFrame([("a", "t", "b")], "src string, otype string, tgt string")
    assert '"a" -> "b" [label="t"];' in sinks.arcs_dot(arcs).first().dot
    assert sinks.order_dot(P.n_order()).count("->") == 3
    assert sinks.as_json(arcs).first().json == '{"otype":"t","src":"a","tgt":"b"}'
    sinks.write(arcs, f"{tmp_path}/x", "json")
    assert event_log.read_log(spark, f"{tmp_path}/x", "json", "src string, otype string, tgt string").count() == 1
    assert sinks.report_text(arcs, ["src", "tgt"]) == "src  tgt\na    b"
    sig = spark.createDataFrame([("x", ["a|t|x"], [])], "label string, left array<string>, right array<string>")
    assert sinks.signature_text(sig).first().line == "x {a|t|x} -> {}"


def test_marginals_and_identifiability(spark):
    every = masks(spark, [], [("a", "b")], [("b", "a")])
    law = estimation.laws(every, spark, ABC)
    # the free law is the mean of the other two
    assert estimation.identifiability(law) == pytest.approx(0, abs=1e-9)
    assert estimation.identifiability(law.filter("order != 0")) > 0.5
    assert estimation.margin_equivalences(every, spark, ABC).count() == 0
    atom = estimation.atoms(every, spark, ABC, (0.0, 0.2), (0.0,))
    w = spark.createDataFrame([(0, 0.25), (1, 0.75)], "atom_id int, w double")
    row = estimation.order_marginal(w, atom).first()
    assert (row.order, row.w, row.eps) == (0, pytest.approx(1.0), pytest.approx(0.15))


def test_trivial_loglik_is_the_entropy_of_single_traces(spark):
    log = spark.createDataFrame([(i, ["a", "b", "c"] if i % 2 else ["c", "b", "a"]) for i in range(10)], "group_id int, trace array<string>")
    table = estimation.counts(log.withColumn("chain", R.from_trace(F.col("trace"), ABC)))
    assert estimation.trivial_loglik(table, spark, ABC, 0.0) == pytest.approx(10 * math.log(0.5))


def test_polish_never_loses():
    r = np.random.default_rng(2)
    cnt = r.multinomial(5, [0.7, 0.1, 0.1, 0.04, 0.03, 0.03], 80).astype(float)
    inside = np.array([[1, 0, 0, 0, 0, 0], [1, 1, 1, 1, 1, 1]], float)
    pbar = cnt.sum(axis=0) / cnt.sum()
    w, eps, eta, path = estimation.polished(cnt, inside, inside.sum(axis=1), pbar, 3, np.array([0.5, 0.5]), np.array([0.1, 0.0]), np.zeros(2))
    assert all(b >= a - 1e-9 for a, b in zip(path, path[1:])) and w.sum() == pytest.approx(1)
    assert estimation.golden_max(lambda x: -((x - 0.3) ** 2), 0, 1)[0] == pytest.approx(0.3, abs=1e-6)


def test_catalogues(spark):
    from orderloom.functions import catalogues as Q

    a, b = P.then(P.leaf("s"), P.leaf("x"), P.leaf("e")), P.par(P.leaf("x"), P.leaf("y"))
    got = Q.membership(Q.forms(spark, {"m1": [a, b], "m2": [b]}))
    assert {r.form: r.models for r in got.collect()} == {"(s ; x ; e)": ["m1"], "(x * y)": ["m1", "m2"]}
    assert Q.shared_by_all(got, 2).count() == 1 and Q.summary(got).count() == 2
    assert P.tiling(Q.without(a, ["s", "e"])) == "x" and Q.legend(got).count() == 2
