"""Registered queries over model-sized objects: orders, boxes, graphs, loops."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import algebra as A
from ..functions import constraints as K
from ..functions import discovery as D
from ..functions import factored as FA
from ..functions import graphs as G
from ..functions import poset_columns as PC
from ..functions import posets as P
from ..operators import blocks, estimation, succession
from ..operators.settle import settled
from ..sources import event_log
from .catalogue import DAYS, LABELS, PERM, PERMS, SEQ, _with_empty, day, events, joined, meets, nine, orders, query


@query("extension_count_udf", f'WITH {PERMS} SELECT DISTINCT "order", e FROM law')
def extension_count_udf(s, d):
    return _with_empty(s, d).select("order", PC.extensions(PC.from_mask(F.col("order"), LABELS)).alias("e"))


@query("linear_extensions", f"""WITH {PERMS} SELECT l."order", array_to_string(p.trace, '>') AS word FROM law l JOIN perms p USING (chain)""")
def linear_extensions(s, d):
    rows = _with_empty(s, d).select("order", F.explode(PC.words(PC.from_mask(F.col("order"), LABELS))).alias("word"))
    return rows.select("order", joined("word", ">").alias("word"))


@query("tilings")
def tilings(s, d):
    """Canonical form, blocks and series-parallel text of each distinct group meet."""
    rows = _with_empty(s, d).withColumn("x", PC.from_mask(F.col("order"), LABELS))
    return rows.select("order", PC.tiling("x").alias("tiling"), joined(PC.blocks("x"), ";").alias("blocks"), PC.describe("x").alias("text"))


@query("enumerate_posets", "SELECT * FROM (VALUES (1, 1::BIGINT, 1::BIGINT), (2, 3, 3), (3, 19, 19), (4, 219, 195)) t(m, n_orders, n_series_parallel)")
def enumerate_posets(s, d):
    rows = [(m, len(P.enumerate_orders(LABELS[:m])), len(P.enumerate_series_parallel(LABELS[:m]))) for m in range(1, 5)]
    return s.createDataFrame(rows, "m int, n_orders bigint, n_series_parallel bigint")


@query("feasible_box", "SELECT i, n, i + n AS s FROM (SELECT unnest([1, 2, 3])::INT AS i), (SELECT unnest([0, 1, 2])::INT AS n) WHERE i + n <= 4 AND i >= n")
def feasible_box(s, d):
    return K.solution_table(s, K.linear("1 <= i <= 3", "0 <= n <= 2", "s <= 4", "s == i + n", "i >= n"), bound=8)


@query("trace_bhattacharyya", f"""WITH {PERMS}, md AS (SELECT group_id % 3 AS model_id, "order", count(*) AS w FROM gm GROUP BY ALL),
 lw AS (SELECT model_id, chain, sum(w * p) / any_value(t) AS p FROM md JOIN law USING ("order") JOIN (SELECT model_id, sum(w) AS t FROM md GROUP BY ALL) USING (model_id) GROUP BY ALL)
 SELECT a.model_id AS m1, b.model_id AS m2, round(2 * acos(least(1.0, sum(sqrt(a.p * b.p)))), 9) AS angle FROM lw a JOIN lw b USING (chain) WHERE a.model_id < b.model_id GROUP BY ALL""")
def trace_bhattacharyya(s, d):
    model = meets(s, d).groupBy((F.col("group_id") % 3).alias("model_id"), "order").agg(F.count(F.lit(1)).alias("w"))
    total = model.groupBy("model_id").agg(F.sum("w").alias("t"))
    law = estimation.laws(model, s, LABELS)
    rows = model.join(total, "model_id").join(law, "order").groupBy("model_id", "chain").agg(F.sum(F.col("w") * F.col("p") / F.col("t")).alias("p"))
    return blocks.law_angle(rows, "chain").select("m1", "m2", nine("angle").alias("angle"))


@query("refined_matrix")
def refined_matrix(s, d):
    """Block matrices of the group meets with primes and parallels fanned out."""
    model = meets(s, d).select((F.col("group_id") % 3).alias("model_id"), PC.from_mask(F.col("order"), LABELS).alias("order"), F.lit(1.0).alias("weight"))
    return PC.refined_matrix(model, strict=False).select("model_id", "src", "dst", nine("p").alias("p"))


@query("timed_group_loglik")
def timed_group_loglik(s, d):
    timed = event_log.first_orders(events(s, d), DAYS, LABELS)
    timed = estimation.gaps(timed, F.col("block") * DAYS * 86400).select("group_id", "trace", "gaps")
    return estimation.timed_loglik(timed, _with_empty(s, d), LABELS, 1e-5, 0.1, 0.05).select("order", "group_id", F.round("logf", 6).alias("logf"))


@query("swap_kernel", f"""WITH {PERMS}, ad AS (SELECT a.chain AS chain, b.chain AS near FROM perms a JOIN perms b ON bit_count(xor(a.chain, b.chain)) = 2)
 SELECT o."order", count(DISTINCT ad.chain) AS n FROM os o JOIN ad ON (ad.near & o."order") = o."order" AND (ad.chain & o."order") <> o."order" GROUP BY ALL""")
def swap_kernel(s, d):
    """Words one adjacent swap outside each order's language."""
    return estimation.swap_neighbours(_with_empty(s, d), s, LABELS).groupBy("order").agg(F.count(F.lit(1)).alias("n"))


@query("process_tree_generators", """SELECT * FROM (VALUES ('a', '', 'a|t|b,a|t|c'), ('a', '', 'a|t|c,a|t|d'), ('b', 'a|t|b', 'b|t|d'), ('c', 'a|t|c', 'c|t|d'),
 ('d', 'b|t|d,c|t|d', ''), ('d', 'a|t|d,c|t|d', '')) t(label, left_ports, right_ports)""")
def process_tree_generators(s, d):
    """Generators of a; ((b or nothing) and c); d, through the table extractor."""
    g = G.from_tree(("seq", "a", ("and", ("xor", "b", None), "c"), "d"), "t")
    rows = [(1, n, "ACTIVITY", x, False) for n, x in g.labels.items()] + [(1, n, k, None, False) for n, k in g.routers.items()]
    nodes = s.createDataFrame(rows, "graph_id int, node string, kind string, label string, silent boolean")
    edges = s.createDataFrame([(1, *e) for e in g.edges], "graph_id int, src string, tgt string, typ string")
    return G.extract_table(nodes, edges).select("label", joined("left").alias("left_ports"), joined("right").alias("right_ports"))


@query("meets_of_labels", f'WITH {PERMS} SELECT count(*) AS traces, count(DISTINCT chain) AS chains, CAST(bit_and(chain) AS BIGINT) AS "order" FROM po')
def meets_of_labels(s, d):
    return orders(s, d).agg(F.count(F.lit(1)).alias("traces"), F.count_distinct("chain").alias("chains"), F.bit_and("chain").alias("order"))




def _bind_sql() -> str:
    from .catalogue import BOTH

    card = lambda side: f"cd_{side} AS (SELECT act, st, m, min(c) AS lo, max(c) AS hi FROM (SELECT s.act, s.st, k.m, k.c FROM st_{side} s JOIN mk_{side} k USING (eid)) GROUP BY ALL), cl_{side} AS (SELECT act, st, list({{'m': m, 'lo': lo, 'hi': hi}}) AS cards FROM cd_{side} GROUP BY ALL)"
    inp = "split_part(c.m, ':', 2) || '|' || split_part(c.m, ':', 1) || '|' || act"
    out = "act || '|' || split_part(c.m, ':', 1) || '|' || split_part(c.m, ':', 2)"
    box = lambda cards, port: f"list_concat(list_transform({cards}, lambda c: {port} || '>=' || c.lo), list_transform({cards}, lambda c: {port} || '<=' || c.hi))"
    legs = lambda cards, port: f"list_sort(list_transform(list_filter({cards}, lambda c: split_part(c.m, ':', 1) = t), lambda c: {port}))"
    types = "list_filter(list_distinct(list_transform(co, lambda c: split_part(c.m, ':', 1))), lambda t: len(list_filter(co, lambda c: split_part(c.m, ':', 1) = t)) > 1 AND len(list_filter(ci, lambda c: split_part(c.m, ':', 1) = t)) > 0)"
    return f"""WITH {BOTH}, {card('in')}, {card('out')}, pr AS (SELECT coalesce(i.act, o.act) AS act, coalesce(i.cards, []) AS ci, coalesce(o.cards, []) AS co FROM cl_in i FULL JOIN cl_out o ON i.act = o.act
 WHERE i.st IS NULL OR o.st IS NULL OR list_sort(list_distinct(list_transform(i.st, lambda m: split_part(m, ':', 1)))) = list_sort(list_distinct(list_transform(o.st, lambda m: split_part(m, ':', 1)))))
 SELECT act AS label, array_to_string(list_sort(list_concat(list_concat({box('ci', inp)}, {box('co', out)}),
  list_transform({types}, lambda t: array_to_string({legs('co', out)}, '+') || '==' || array_to_string({legs('ci', inp)}, '+')))), ',') AS constraints FROM pr"""


@query("occn_bindings", _bind_sql())
def occn_bindings(s, d):
    from ..operators import objectcentric, succession
    from .catalogue import ocel

    rel = ocel(s, d)
    arcs = succession.dependency_graph(rel)
    groups = [objectcentric.marker_groups(objectcentric.neighbours(rel, arcs, side)) for side in ("in", "out")]
    return objectcentric.bound_generators(*groups).select("label", joined("constraints").alias("constraints"))


@query("compare_summary")
def compare_summary(s, d):
    from ..operators import signatures
    from .catalogue import compare_status

    return signatures.per_name(compare_status(s, d), "even")


# --- mined and composed models -----------------------------------------------------------------

@query("tallies", f"""WITH {SEQ} SELECT 'next' AS kind, act AS a, nxt AS b, count(*) AS n FROM seq WHERE nxt IS NOT NULL GROUP BY ALL
 UNION ALL SELECT 'loop', act, nxt, count(*) FROM seq WHERE nxt2 = act AND nxt <> act GROUP BY ALL
 UNION ALL SELECT 'first', act, NULL, count(*) FROM seq WHERE pos = 1 GROUP BY ALL UNION ALL SELECT 'last', act, NULL, count(*) FROM seq WHERE nxt IS NULL GROUP BY ALL""")
def tallies(s, d):
    return succession.tallies(day(s, d))


@query("candidate_orders", f'WITH {PERM} SELECT chain AS "order" FROM po UNION SELECT "order" FROM gm UNION SELECT 0')
def candidate_orders(s, d):
    return estimation.candidates(s, orders(s, d).select("group_id", "chain"), LABELS, heuristic=True)[0]


@query("candidate_closure", f'WITH RECURSIVE {PERM}, c(o) AS (SELECT DISTINCT chain FROM po UNION SELECT c.o & p.chain FROM c, (SELECT DISTINCT chain FROM po) p) SELECT o AS "order" FROM c UNION SELECT 0')
def candidate_closure(s, d):
    return estimation.candidates(s, orders(s, d).select("group_id", "chain"), LABELS)[0]


@query("counting_limit", f"""WITH {PERMS}, k AS (SELECT count(DISTINCT "order") AS k FROM law), mix AS (SELECT chain, sum(p / k) AS p FROM law, k GROUP BY chain),
 sup AS (SELECT chain, count(*) AS n FROM law GROUP BY chain) SELECT "order", round(sum(mix.p / n), 9) AS rho FROM law JOIN mix USING (chain) JOIN sup USING (chain) GROUP BY ALL""")
def counting_limit(s, d):
    """Where the counting weights go if every order has the same weight."""
    o = _with_empty(s, d)
    rho = o.select("order", (F.lit(1.0) / o.count()).alias("rho"))
    return estimation.counting_limit(estimation.laws(o, s, LABELS), rho).select("order", nine("rho").alias("rho"))


@query("recovery", f"""WITH {PERMS}, t AS (SELECT "order", count(*) / (SELECT count(*) FROM gm) AS w FROM gm WHERE group_id % 2 = 0 GROUP BY ALL),
 f AS (SELECT "order", count(*) / (SELECT count(*) FROM gm) AS w FROM gm WHERE group_id % 2 = 1 GROUP BY ALL)
 SELECT t."order", round(t.w, 9) AS true_w, round(f.w, 9) AS w, CASE WHEN f.w IS NULL THEN NULL ELSE 0 END AS off FROM t LEFT JOIN f USING ("order")
 UNION ALL SELECT f."order", NULL, round(f.w, 9), min(bit_count(xor(f."order", t."order"))) FROM f, t WHERE f."order" NOT IN (SELECT "order" FROM t) GROUP BY f."order", f.w""")
def recovery(s, d):
    """The orders of odd users as a fit of those of even users."""
    m = meets(s, d)
    n = m.count()
    half = lambda k: m.filter(F.col("group_id") % 2 == k).groupBy("order").agg((F.count(F.lit(1)) / F.lit(n)).alias("w"))
    rows = estimation.recovery(half(1), half(0), least=0.0)
    return rows.select("order", nine("true_w").alias("true_w"), nine("w").alias("w"), F.col("off").cast("int").alias("off"))


@query("event_nets", f"""WITH {SEQ}, pair AS (SELECT DISTINCT act AS a, nxt AS b FROM seq WHERE nxt IS NOT NULL)
 SELECT 'START' AS src, act AS tgt FROM seq WHERE pos = 1 GROUP BY ALL UNION SELECT a, b FROM pair UNION SELECT act, 'END' FROM seq WHERE nxt IS NULL GROUP BY ALL""")
def event_nets(s, d):
    """The succession net of the daily log as a typed graph, and back from its generators' ports."""
    rows = settled(succession.tallies(day(s, d))).collect()
    f = D.Follows.of(tuple(r) for r in rows)
    g = G.Graph({x: x for x in [*f.activities, "START", "END"]})
    for a, b in [*f.arcs, *(("START", x) for x in f.first), *((x, "END") for x in f.last)]:
        for hub, side in ((f"out {a}", "out"), (f"in {b}", "in")):
            if hub not in g.routers:
                g.routers[hub] = "XOR"
                g.edges.append((a, hub, "case") if side == "out" else (hub, b, "case"))
        g.edges.append((f"out {a}", f"in {b}", "case"))
    ports = A.ports(G.extract(g.check()))
    return s.createDataFrame(sorted((p[0], p[2]) for p in ports), "src string, tgt string")


@query("hub_profiles", "SELECT CAST(k AS INT) AS arcs, CAST(1 << k AS BIGINT) AS profiles FROM range(1, 16) t(k)")
def hub_profiles(s, d):
    """Type counts that a hub with k optional typed arcs of four alternatives can reach: the
    count follows the arcs and not the 5 ** k contexts."""

    def hub(k: int) -> G.Graph:
        g = G.Graph({"hub": "hub"})
        for i in range(k):
            g.routers |= {f"p{i}": "XOR", f"skip{i}": "SEQ"}
            g.labels |= {f"x{i}.{j}": f"x{i}.{j}" for j in range(4)}
            g.edges += [("hub", f"p{i}", f"t{i}"), (f"p{i}", f"skip{i}", f"t{i}"), *((f"p{i}", f"x{i}.{j}", f"t{i}") for j in range(4))]
        return g

    return s.createDataFrame([(k, len(G.profiles(hub(k), "hub", True))) for k in range(1, 16)], "arcs int, profiles bigint")


@query("chain_hub", "SELECT CAST(k AS INT) AS arcs, CAST(1 AS BIGINT) AS ready, CAST(1 << k AS BIGINT) AS contexts FROM range(1, 21) t(k)")
def chain_hub(s, d):
    """A hub with k arcs of two sources each: what a pool of one object an arc makes ready is
    found without its 2 ** k contexts."""
    rows = []
    for k in range(1, 21):
        g = G.Graph({"hub": "hub"} | {f"{x}{i}": f"{x}{i}" for x in "ab" for i in range(k)}, {f"m{i}": "XOR" for i in range(k)})
        g.edges = [e for i in range(k) for e in ((f"a{i}", f"m{i}", f"t{i}"), (f"b{i}", f"m{i}", f"t{i}"), (f"m{i}", "hub", f"t{i}"))]
        f = next(x for x in FA.skeleton(g).activities if x.label == "hub")
        contexts = 1
        for family in f.left:
            contexts *= len(family)
        rows.append((k, len(f.ready({(f"a{i}", f"t{i}", "hub"): 1 for i in range(k)})), contexts))
    return s.createDataFrame(rows, "arcs int, ready bigint, contexts bigint")
