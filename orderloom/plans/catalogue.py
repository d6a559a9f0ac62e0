"""Registered queries of the library, each beside the SQL that states its result.

Queries run over whole tables.  Doubles are rounded to nine digits and nested values
rendered as text on both sides, so that two engines can be compared row by row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import relations as R
from ..operators import blocks, estimation, objectcentric, signatures, succession
from ..operators.settle import settled
from ..sources import event_log

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

#: The event types of the event table, in label order.
LABELS = ("click", "error", "purchase", "signup", "view")
DAYS = 5


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return add


def nine(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 9)


def joined(c, sep: str = ",") -> Column:
    return F.array_join(c, sep)


def events(s: SparkSession, d: str) -> DataFrame:
    return event_log.read_table(s, d, "events")


def day(s: SparkSession, d: str) -> DataFrame:
    return event_log.daily_log(events(s, d))


def cohorts(s: SparkSession, d: str, k: int = 4) -> DataFrame:
    """Chain models of users by user_id modulo k."""
    return blocks.chain_models(day(s, d), (F.split_part("case_id", F.lit("@"), F.lit(1)).cast("bigint") % k).cast("int"))


def orders(s: SparkSession, d: str) -> DataFrame:
    """(group_id, chain): complete first-occurrence orders of the five labels."""
    rows = event_log.first_orders(events(s, d), DAYS, LABELS)
    return rows.select("group_id", "block", "trace", R.from_trace(F.col("trace"), LABELS).alias("chain"))


def meets(s: SparkSession, d: str) -> DataFrame:
    return orders(s, d).groupBy("group_id").agg(F.bit_and("chain").alias("order"))


def ocel(s: SparkSession, d: str) -> DataFrame:
    return event_log.relations(events(s, d))


# --- shared SQL ---------------------------------------------------------------------

EV = """ev AS (SELECT event_id, ts, user_id, event_type AS act, user_id % 4 AS model_id,
 CAST(user_id AS VARCHAR) || '@' || CAST(CAST(ts AS DATE) AS VARCHAR) AS case_id FROM events)"""
SEQ = EV + """, seq AS (SELECT *, lead(act) OVER w AS nxt, lead(act, 2) OVER w AS nxt2, row_number() OVER w AS pos
 FROM ev WINDOW w AS (PARTITION BY case_id ORDER BY ts, event_id))"""
TRACES = EV + """, tr AS (SELECT model_id, case_id, list(act ORDER BY ts, event_id) AS trace FROM ev GROUP BY ALL)"""
DFG = SEQ + """, dfg AS (SELECT act AS a, nxt AS b, count(*) AS n FROM seq WHERE nxt IS NOT NULL GROUP BY ALL),
 l2 AS (SELECT act AS a, nxt AS b, count(*) AS n FROM seq WHERE nxt2 = act AND nxt <> act GROUP BY ALL),
 dep AS (SELECT d.a, d.b, d.n, CASE WHEN d.a = d.b THEN d.n / (d.n + 1.0) ELSE (d.n - coalesce(e.n, 0)) / (d.n + coalesce(e.n, 0) + 1.0) END AS dep,
  (coalesce(x.n, 0) + coalesce(y.n, 0)) / (coalesce(x.n, 0) + coalesce(y.n, 0) + 1.0) AS dep2
  FROM dfg d LEFT JOIN dfg e ON e.a = d.b AND e.b = d.a LEFT JOIN l2 x ON x.a = d.a AND x.b = d.b LEFT JOIN l2 y ON y.a = d.b AND y.b = d.a)"""
STEPS = SEQ + """, path AS (SELECT model_id, case_id, pos, act AS s FROM seq
  UNION ALL SELECT DISTINCT model_id, case_id, 0, 'START' FROM seq UNION ALL SELECT model_id, case_id, max(pos) + 1, 'END' FROM seq GROUP BY ALL),
 step AS (SELECT model_id, s AS src, lead(s) OVER (PARTITION BY case_id ORDER BY pos) AS dst FROM path),
 raw AS (SELECT model_id, src, dst, count(*) AS w FROM step WHERE dst IS NOT NULL GROUP BY ALL),
 mat AS (SELECT model_id, src, dst, w / sum(w) OVER (PARTITION BY model_id, src) AS p FROM raw),
 space AS (SELECT src AS s FROM mat UNION SELECT dst FROM mat), models AS (SELECT DISTINCT model_id FROM mat)"""


def _closed(end: str, other: str) -> str:
    return STEPS + f""", aug AS (SELECT model_id, src, dst, p FROM mat UNION ALL
  SELECT m.model_id, s.s, CASE WHEN s.s = 'END' THEN {end} ELSE {other} END, 1.0 FROM models m, space s
  WHERE NOT EXISTS (SELECT 1 FROM mat x WHERE x.model_id = m.model_id AND x.src = s.s)),
 bc AS (SELECT a.model_id AS m1, b.model_id AS m2, a.src, sum(sqrt(a.p * b.p)) AS bc FROM aug a JOIN aug b USING (src, dst) WHERE a.model_id < b.model_id GROUP BY ALL),
 ang AS (SELECT x.model_id AS m1, y.model_id AS m2, s.s AS src, acos(least(1.0, greatest(0.0, coalesce(bc, 0.0)))) AS angle
  FROM models x, models y, space s LEFT JOIN bc ON bc.m1 = x.model_id AND bc.m2 = y.model_id AND bc.src = s.s WHERE x.model_id < y.model_id)"""


SINK, SELF = _closed("'START'", "'END'"), _closed("s.s", "s.s")
BITS = " + ".join(f"CASE WHEN list_position(trace, '{a}') < list_position(trace, '{b}') THEN {R.bit(i, j)} ELSE 0 END" for i, a in enumerate(LABELS) for j, b in enumerate(LABELS) if i != j)
PERM = f"""fo AS (SELECT user_id AS group_id, (CAST(ts AS DATE) - DATE '1970-01-01') // {DAYS} AS block, event_type, min(ts) AS ft FROM events GROUP BY ALL),
 pt AS (SELECT group_id, block, list(event_type ORDER BY ft) AS trace, list(ft ORDER BY ft) AS times FROM fo GROUP BY ALL HAVING count(*) = {len(LABELS)}),
 po AS (SELECT group_id, block, trace, times, CAST({BITS} AS BIGINT) AS chain FROM pt),
 gm AS (SELECT group_id, bit_and(chain) AS "order" FROM po GROUP BY ALL)"""
_FROM = ", ".join(f"(SELECT unnest({list(LABELS)!r}) AS x{i}) t{i}" for i in range(len(LABELS)))
_APART = " AND ".join(f"x{i} <> x{j}" for i in range(len(LABELS)) for j in range(i))
PERMS = PERM + f""", al AS (SELECT [{', '.join(f'x{i}' for i in range(len(LABELS)))}] AS trace FROM {_FROM} WHERE {_APART}),
 perms AS (SELECT trace, CAST({BITS} AS BIGINT) AS chain FROM al),
 os AS (SELECT DISTINCT "order" FROM gm UNION SELECT 0),
 law AS (SELECT "order", chain, 1.0 / count(*) OVER (PARTITION BY "order") AS p, count(*) OVER (PARTITION BY "order") AS e FROM os JOIN perms ON (chain & "order") = "order"),
 cnt AS (SELECT group_id, chain, count(*) AS cnt FROM po GROUP BY ALL), tot AS (SELECT chain, sum(cnt) AS cnt FROM cnt GROUP BY ALL),
 pb AS (SELECT chain, cnt / sum(cnt) OVER () AS pbar FROM tot)"""


# --- traces and dependency graphs ----------------------------------------------------

@query("variants", f"WITH {TRACES}, n AS (SELECT array_to_string(trace, '>') AS trace, count(*) AS n FROM tr GROUP BY ALL) SELECT trace, n, round(n / sum(n) OVER (), 9) AS p FROM n")
def variants(s, d):
    return succession.variants(day(s, d)).select(joined("trace", ">").alias("trace"), "n", nine("p").alias("p"))


@query("dfg", f"WITH {DFG} SELECT a, b, n FROM dfg")
def dfg(s, d):
    return succession.direct(day(s, d))


@query("start_end_counts", f"WITH {SEQ} SELECT act AS activity, CAST(sum((pos = 1)::INT) AS BIGINT) AS starts, CAST(sum((nxt IS NULL)::INT) AS BIGINT) AS stops FROM seq GROUP BY ALL")
def start_end_counts(s, d):
    return succession.ends(day(s, d))


@query("l2_loops", f"WITH {DFG} SELECT a, b, n FROM l2")
def l2_loops(s, d):
    return succession.short_loops(day(s, d))


@query("fhm_dependency", f"WITH {DFG} SELECT a, b, n, round(dep, 9) AS dep, round(dep2, 9) AS dep2 FROM dep")
def fhm_dependency(s, d):
    return succession.dependencies(day(s, d)).select("a", "b", "n", nine("dep").alias("dep"), nine("dep2").alias("dep2"))


ARCS = """ best AS (SELECT *, max(CASE WHEN a <> b THEN dep END) OVER (PARTITION BY a) AS o, max(CASE WHEN a <> b THEN dep END) OVER (PARTITION BY b) AS i FROM dep)
 SELECT a, b FROM best WHERE CASE WHEN a = b THEN dep >= 0.5 ELSE dep >= 0.5 OR dep2 >= 0.5 OR (o > 0 AND dep >= o - 0.05) OR (i > 0 AND dep >= i - 0.05) END"""


@query("fhm_arcs", f"WITH {DFG}, {ARCS}")
def fhm_arcs(s, d):
    return succession.accepted(succession.dependencies(day(s, d)))


@query("log_to_rows", "SELECT conv_id AS case_id, role AS activity, turn, epoch(TIMESTAMP '2020-01-01' + to_seconds(1000 * conv_id + row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1))::BIGINT AS at FROM conversations")
def log_to_rows(s, d):
    """Conversations as traces, written back as an event table with synthetic times."""
    c = event_log.read_table(s, d, "conversations")
    traces = c.groupBy(F.col("conv_id").alias("case_no")).agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    rows = event_log.to_rows(traces.select("case_no", F.transform("x", lambda e: F.concat_ws("/", e["turn"].cast("string"), e["role"])).alias("trace")))
    return rows.select(
        F.col("case_id").cast("bigint").alias("case_id"), F.substring_index("activity", "/", -1).alias("activity"),
        F.substring_index("activity", "/", 1).cast("bigint").alias("turn"), F.unix_seconds("ts").alias("at"),
    )


@query("group_by_key", f"""WITH {TRACES}, g AS (SELECT model_id, split_part(case_id, '@', 1) AS key, count(*) AS n FROM tr GROUP BY ALL)
 SELECT CASE WHEN n >= 25 THEN 'group' ELSE 'leftover' END AS kind, count(*) AS keys, CAST(sum(n) AS BIGINT) AS traces FROM g GROUP BY ALL""")
def group_by_key(s, d):
    rows = succession.traces(day(s, d)).withColumn("key", F.split_part("case_id", F.lit("@"), F.lit(1)))
    kept, rest = event_log.grouped(rows, "key", 25, "days of one user follow one habit")
    both = kept.withColumn("kind", F.lit("group")).unionByName(rest.withColumn("kind", F.lit("leftover")))
    return both.groupBy("kind").agg(F.count_distinct("key").alias("keys"), F.count(F.lit(1)).alias("traces"))


# --- block matrices and distances ----------------------------------------------------

@query("block_matrix_k1", f"WITH {STEPS} SELECT model_id, src, dst, round(p, 9) AS p FROM mat")
def block_matrix_k1(s, d):
    return blocks.matrix(cohorts(s, d)).select("model_id", "src", "dst", nine("p").alias("p"))


K2 = SEQ + """, st AS (SELECT model_id, case_id, pos, CASE WHEN pos = 1 THEN act ELSE lag(act) OVER (PARTITION BY case_id ORDER BY pos) || '|' || act END AS s FROM seq),
 path AS (SELECT * FROM st UNION ALL SELECT DISTINCT model_id, case_id, 0, 'START' FROM st UNION ALL SELECT model_id, case_id, max(pos) + 1, 'END' FROM st GROUP BY ALL),
 step AS (SELECT model_id, s AS src, lead(s) OVER (PARTITION BY case_id ORDER BY pos) AS dst FROM path),
 raw AS (SELECT model_id, src, dst, count(*) AS w FROM step WHERE dst IS NOT NULL GROUP BY ALL)
 SELECT model_id, src, dst, round(w / sum(w) OVER (PARTITION BY model_id, src), 9) AS p FROM raw"""


@query("block_matrix_k2", f"WITH {K2}")
def block_matrix_k2(s, d):
    return blocks.matrix(cohorts(s, d), 2).select("model_id", "src", "dst", nine("p").alias("p"))


_D = "round(2 * sqrt(sum(angle * angle)), 9) AS d"


@query("smd_pair", f"WITH {SINK.replace('user_id % 4', 'user_id % 2')} SELECT m1, m2, {_D} FROM ang GROUP BY ALL")
def smd_pair(s, d):
    return blocks.matrix_distance(cohorts(s, d, 2)).select(F.col("m1").cast("bigint").alias("m1"), F.col("m2").cast("bigint").alias("m2"), nine("d").alias("d"))


@query("smd_fleet", f"WITH {SINK} SELECT m1, m2, round(2 * sqrt(sum(angle * angle)) / sqrt((SELECT count(*) FROM space)), 9) AS d FROM ang GROUP BY ALL")
def smd_fleet(s, d):
    return blocks.matrix_distance(cohorts(s, d), normalize=True).select(F.col("m1").cast("bigint").alias("m1"), F.col("m2").cast("bigint").alias("m2"), nine("d").alias("d"))


@query("smd_selfloop", f"WITH {SELF} SELECT m1, m2, {_D} FROM ang GROUP BY ALL")
def smd_selfloop(s, d):
    return blocks.matrix_distance(cohorts(s, d), mode="selfloop").select(F.col("m1").cast("bigint").alias("m1"), F.col("m2").cast("bigint").alias("m2"), nine("d").alias("d"))


@query("smd_state_angles", f"WITH {SINK} SELECT m1, m2, src, round(angle, 9) AS angle FROM ang")
def smd_state_angles(s, d):
    rows = blocks.matrix(cohorts(s, d))
    out = blocks.row_angles(blocks.closed(rows, blocks.state_space(rows)))
    return out.select(F.col("m1").cast("bigint").alias("m1"), F.col("m2").cast("bigint").alias("m2"), "src", nine("angle").alias("angle"))


SUPPORT = SINK.replace("bc AS (", "uni AS (SELECT model_id, src, dst, 1.0 / count(*) OVER (PARTITION BY model_id, src) AS p FROM aug), bc AS (").replace("FROM aug a JOIN aug b", "FROM uni a JOIN uni b")


@query("block_angle_support", f"WITH {SUPPORT} SELECT m1, m2, {_D} FROM ang GROUP BY ALL")
def block_angle_support(s, d):
    return blocks.block_angle(cohorts(s, d), "support").select(F.col("m1").cast("bigint").alias("m1"), F.col("m2").cast("bigint").alias("m2"), nine("d").alias("d"))


FORMS = TRACES + """, f AS (SELECT model_id, array_to_string(trace, ';') AS form, count(*) AS w FROM tr GROUP BY ALL), fl AS (SELECT model_id, form, w / sum(w) OVER (PARTITION BY model_id) AS p FROM f)"""


@query("normal_form_law", f"WITH {FORMS} SELECT model_id, form, round(p, 9) AS p FROM fl")
def normal_form_law(s, d):
    return blocks.normal_form_law(cohorts(s, d)).select(F.col("model_id").cast("bigint").alias("model_id"), "form", nine("p").alias("p"))


@query("normal_form_angle", f"WITH {FORMS} SELECT a.model_id AS m1, b.model_id AS m2, round(2 * acos(least(1.0, sum(sqrt(a.p * b.p)))), 9) AS angle FROM fl a JOIN fl b USING (form) WHERE a.model_id < b.model_id GROUP BY ALL")
def normal_form_angle(s, d):
    out = blocks.law_angle(blocks.normal_form_law(cohorts(s, d)), "form")
    return out.select(F.col("m1").cast("bigint").alias("m1"), F.col("m2").cast("bigint").alias("m2"), nine("angle").alias("angle"))


_X = ", ".join(f"('{a}', '{b}', {R.bit(i, j)}, {R.bit(j, i)})" for i, a in enumerate(LABELS) for j, b in enumerate(LABELS) if i < j)
PREC = PERM + f""", k(x, y, f, g) AS (VALUES {_X}), pr AS (SELECT group_id % 3 AS model_id, x, y, avg(((chain & f) <> 0)::INT) AS lt, avg(((chain & g) <> 0)::INT) AS gt FROM po, k GROUP BY ALL)"""


def _precedence(s, d):
    rows = orders(s, d).select((F.col("group_id") % 3).alias("model_id"), F.array(*map(F.lit, LABELS)).alias("labels"), "trace").withColumn("weight", F.lit(1.0))
    chain = F.flatten(F.transform("trace", lambda a, i: F.transform(F.slice("trace", i + 2, 8), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return blocks.precedence(rows.withColumn("pairs", chain))


@query("precedence", f"WITH {PREC} SELECT model_id, x, y, round(lt, 9) AS lt, round(gt, 9) AS gt, 0.0::DOUBLE AS par FROM pr")
def precedence(s, d):
    return _precedence(s, d).select("model_id", "x", "y", nine("lt").alias("lt"), nine("gt").alias("gt"), nine("par").alias("par"))


@query("order_angle", f"WITH {PREC}, an AS (SELECT a.model_id AS m1, b.model_id AS m2, acos(least(1.0, sqrt(a.lt * b.lt) + sqrt(a.gt * b.gt))) AS angle FROM pr a JOIN pr b USING (x, y) WHERE a.model_id < b.model_id) SELECT m1, m2, round(2 * sqrt(sum(angle * angle)), 9) AS angle FROM an GROUP BY ALL")
def order_angle(s, d):
    return blocks.order_angle(_precedence(s, d)).select("m1", "m2", nine("angle").alias("angle"))


# --- orders as masks -----------------------------------------------------------------

@query("rel_from_trace", f"WITH {PERM} SELECT group_id, block, array_to_string(trace, '>') AS trace, chain FROM po")
def rel_from_trace(s, d):
    return orders(s, d).select("group_id", "block", joined("trace", ">").alias("trace"), "chain")


@query("group_meet", f'WITH {PERM} SELECT group_id, "order", bit_count("order")::INT AS size FROM gm')
def group_meet(s, d):
    return meets(s, d).select("group_id", "order", R.size(F.col("order")).cast("int").alias("size"))


@query("meet_closure", f'WITH RECURSIVE {PERM}, c(o) AS (SELECT DISTINCT "order" FROM gm UNION SELECT c.o & g."order" FROM c, gm g) SELECT o AS "order", bit_count(o)::INT AS size FROM c')
def meet_closure(s, d):
    found, _ = R.meet_closure(meets(s, d))
    return found.select("order", R.size(F.col("order")).cast("int").alias("size"))


@query("respects_matrix", f'WITH {PERM}, o AS (SELECT DISTINCT "order" FROM gm) SELECT "order", count(*) AS traces FROM o JOIN po ON (chain & "order") = "order" GROUP BY ALL')
def respects_matrix(s, d):
    o = meets(s, d).select("order").distinct()
    return orders(s, d).join(F.broadcast(o), R.respects(F.col("chain"), F.col("order"))).groupBy("order").agg(F.count(F.lit(1)).alias("traces"))


@query("refines_pairs", f'WITH {PERM}, o AS (SELECT DISTINCT "order" FROM gm) SELECT a."order" AS p, count(*) AS refined_by FROM o a JOIN o b ON (a."order" & b."order") = a."order" GROUP BY ALL')
def refines_pairs(s, d):
    o = meets(s, d).select("order").distinct()
    return o.toDF("p").join(F.broadcast(o.toDF("q")), R.refines(F.col("p"), F.col("q"))).groupBy("p").agg(F.count(F.lit(1)).alias("refined_by"))


@query("kemeny_pairs", f'WITH {PERM} SELECT a.group_id AS g1, b.group_id AS g2, bit_count(xor(a."order", b."order"))::INT AS d FROM gm a JOIN gm b ON a.group_id < b.group_id')
def kemeny_pairs(s, d):
    g = meets(s, d)
    return g.toDF("g1", "p").join(g.toDF("g2", "q"), F.expr("g1 < g2")).select("g1", "g2", R.kemeny(F.col("p"), F.col("q")).cast("int").alias("d"))


_PV = ", ".join(f"('{LABELS[i]}', '{LABELS[j]}', {b})" for i, j, b in R.pairs(LABELS))


@query("hasse_edges", f"""WITH {PERM}, k(x, y, b) AS (VALUES {_PV}), o AS (SELECT DISTINCT "order" FROM gm),
 r AS (SELECT "order", x, y FROM o, k WHERE ("order" & b) <> 0)
 SELECT "order", x, y FROM r WHERE NOT EXISTS (SELECT 1 FROM r p JOIN r q ON p."order" = q."order" AND p.y = q.x WHERE p."order" = r."order" AND p.x = r.x AND q.y = r.y)""")
def hasse_edges(s, d):
    o = meets(s, d).select("order").distinct().withColumn("cover", R.covers(F.col("order"), len(LABELS)))
    every = F.array(*(F.when(R.holds(F.col("cover"), b), F.struct(F.lit(LABELS[i]).alias("x"), F.lit(LABELS[j]).alias("y"))) for i, j, b in R.pairs(LABELS)))
    return o.select("order", F.explode(F.array_compact(every)).alias("e")).select("order", "e.x", "e.y")


@query("closure_of_covers", f'WITH {PERM} SELECT DISTINCT "order", "order" AS closed, true AS is_order FROM gm')
def closure_of_covers(s, d):
    """Closing the covers gives the order back."""
    n, o = len(LABELS), meets(s, d).select("order").distinct()
    return o.select("order", R.closed(R.covers(F.col("order"), n), n).alias("closed"), R.is_order(F.col("order"), n).alias("is_order"))


@query("extension_count", f'WITH {PERMS} SELECT DISTINCT "order", e FROM law')
def extension_count(s, d):
    return R.extension_counts(_with_empty(s, d), s, LABELS)


def _with_empty(s, d) -> DataFrame:
    """Distinct group meets and the empty order, whose law supports every trace."""
    return meets(s, d).select("order").union(s.range(1).select(F.lit(0).cast("bigint"))).distinct()


@query("meet_rendered", f"""WITH {PERM}, k(x, y, b) AS (VALUES {_PV}) SELECT group_id, coalesce(string_agg(CASE WHEN ("order" & b) <> 0 THEN x || '<' || y END, ', ' ORDER BY x, y), '') AS rel FROM gm, k GROUP BY ALL""")
def meet_rendered(s, d):
    return meets(s, d).select("group_id", R.render(F.col("order"), LABELS).alias("rel"))


# --- estimation ----------------------------------------------------------------------

@query("group_counts_pbar", f"WITH {PERMS} SELECT group_id, chain, cnt, round(pbar, 9) AS pbar FROM cnt JOIN pb USING (chain)")
def group_counts_pbar(s, d):
    c = estimation.counts(orders(s, d))
    return c.join(estimation.pooled(c), "chain").select("group_id", "chain", "cnt", nine("pbar").alias("pbar"))


@query("trace_law", f'WITH {PERMS} SELECT "order", chain, round(p, 9) AS p FROM law')
def trace_law(s, d):
    return estimation.laws(_with_empty(s, d), s, LABELS).select("order", "chain", nine("p").alias("p"))


@query("rho_counting", f"""WITH {PERMS}, sp AS (SELECT "order", cnt / count(*) OVER (PARTITION BY chain) AS part FROM tot JOIN law USING (chain))
 SELECT "order", round(sum(part) / (SELECT sum(cnt) FROM tot), 9) AS rho FROM sp GROUP BY ALL""")
def rho_counting(s, d):
    return estimation.counting_weights(estimation.counts(orders(s, d)), estimation.laws(_with_empty(s, d), s, LABELS)).select("order", nine("rho").alias("rho"))


EM = PERMS + """, r0 AS (SELECT "order", 1.0 / (SELECT count(*) FROM os) AS rho FROM os),
 j1 AS (SELECT "order", cnt * p * rho / sum(p * rho) OVER (PARTITION BY chain) AS part FROM tot JOIN law USING (chain) JOIN r0 USING ("order")),
 r1 AS (SELECT "order", sum(part) / (SELECT sum(cnt) FROM tot) AS rho FROM j1 GROUP BY ALL),
 j2 AS (SELECT "order", cnt * p * rho / sum(p * rho) OVER (PARTITION BY chain) AS part FROM tot JOIN law USING (chain) JOIN r1 USING ("order")),
 r2 AS (SELECT "order", sum(part) / (SELECT sum(cnt) FROM tot) AS rho FROM j2 GROUP BY ALL)"""


def _two_steps(s, d):
    c, law = estimation.counts(orders(s, d)), estimation.laws(_with_empty(s, d), s, LABELS)
    o = _with_empty(s, d)
    rho = o.join(F.broadcast(o.agg(F.count(F.lit(1)).alias("k")))).select("order", (1 / F.col("k")).alias("rho"))
    for _ in range(2):
        rho = estimation.em_step(c, law, rho)
    return c, law, rho


@query("em_two_steps", f'WITH {EM} SELECT "order", round(rho, 9) AS rho FROM r2')
def em_two_steps(s, d):
    return _two_steps(s, d)[2].select("order", nine("rho").alias("rho"))


@query("log_likelihood", f'WITH {EM}, mx AS (SELECT chain, sum(p * rho) AS p FROM law JOIN r2 USING ("order") GROUP BY ALL) SELECT round(sum(cnt * ln(p)), 6) AS loglik FROM tot JOIN mx USING (chain)')
def log_likelihood(s, d):
    return estimation.log_likelihood(*_two_steps(s, d)).select(F.round("loglik", 6).alias("loglik"))


LOGF = PERMS + """, dn AS (SELECT "order", po2.chain, ln(0.95 * (0.9 * CASE WHEN (po2.chain & "order") = "order" THEN 1.0 / e ELSE 0 END + 0.1 / 120) + 0.05 * pbar) AS lnp
  FROM (SELECT DISTINCT "order", e FROM law) a, pb po2),
 lf AS (SELECT "order", group_id, sum(cnt * lnp) AS logf FROM cnt JOIN dn USING (chain) GROUP BY ALL)"""


def _mixture(s, d):
    """Counts, marginal, atoms and the number of labels; the model-sized two are settled."""
    c = estimation.counts(orders(s, d))
    return c, settled(estimation.pooled(c)), settled(estimation.atoms(_with_empty(s, d), s, LABELS, (0.1,), (0.05,))), len(LABELS)


@query("group_logf", f'WITH {LOGF} SELECT "order", group_id, round(logf, 6) AS logf FROM lf')
def group_logf(s, d):
    c, pbar, atom, m = _mixture(s, d)
    return estimation.group_loglik(c, pbar, atom, m).join(F.broadcast(atom), "atom_id").select("order", "group_id", F.round("logf", 6).alias("logf"))


@query("price_atoms", f"""WITH {LOGF}, ld AS (SELECT group_id, max(logf) + ln(sum(exp(logf - mx)) / count(*)) AS logd FROM (SELECT *, max(logf) OVER (PARTITION BY group_id) AS mx FROM lf) GROUP BY ALL)
 SELECT "order", round(avg(exp(logf - logd)), 6) AS score FROM lf JOIN ld USING (group_id) GROUP BY ALL""")
def price_atoms(s, d):
    c, pbar, atom, m = _mixture(s, d)
    k = estimation.kernel(pbar, atom, m)
    scores = estimation.scores(estimation.profiles(c), k, dict.fromkeys(k.ids.tolist(), 1 / max(1, len(k.ids))))
    return scores.join(F.broadcast(atom), "atom_id").select("order", F.round("score", 6).alias("score"))


@query("npmle_fit")
def npmle_fit(s, d):
    """Weights of the fitted mixture by order, and the certified gap."""
    c, pbar, atom, m = _mixture(s, d)
    weights, gap, _ = estimation.fit_counts(c, pbar, atom, m)
    rows = s.createDataFrame([(int(a), float(w)) for a, w in weights.items()], "atom_id int, w double")
    return rows.join(atom, "atom_id").select("order", "e", nine("w").alias("w"), F.lit(round(gap, 6)).alias("gap"))


@query("moment_phi2", f"WITH {PERM}, k(x, y, b) AS (VALUES {_PV}) SELECT x, y, round(avg(((chain & b) <> 0)::INT), 9) AS phi FROM po, k GROUP BY ALL")
def moment_phi2(s, d):
    return estimation.pair_moments(orders(s, d), LABELS).select("x", "y", nine("phi").alias("phi"))


@query("moment_ranking", f"""WITH {PERMS}, k(x, y, b) AS (VALUES {_PV}), dm AS (SELECT x, y, avg(((chain & b) <> 0)::INT) AS q FROM po, k GROUP BY ALL),
 om AS (SELECT "order", x, y, avg(((chain & b) <> 0)::INT) AS phi FROM law, k GROUP BY ALL) SELECT "order", round(sqrt(sum((phi - q) * (phi - q))), 9) AS dist FROM om JOIN dm USING (x, y) GROUP BY ALL""")
def moment_ranking(s, d):
    model = estimation.order_moments(_with_empty(s, d), s, LABELS)
    return estimation.moment_ranking(model, estimation.pair_moments(orders(s, d), LABELS)).select("order", nine("dist").alias("dist"))


@query("timed_rate", f"""WITH {PERM}, tm AS (SELECT block * {DAYS} * 86400.0 AS t0, epoch(times[{len(LABELS)}]) AS t1 FROM po)
 SELECT {len(LABELS)} * count(*) AS n, round(sum(t1 - t0), 3) AS total, round({len(LABELS)} * count(*) / sum(t1 - t0), 12) AS rate FROM tm""")
def timed_rate(s, d):
    rows = estimation.gaps(event_log.first_orders(events(s, d), DAYS, LABELS), F.col("block") * DAYS * 86400)
    return estimation.pooled_rate(rows).select("n", F.round("total", 3).alias("total"), F.round("rate", 12).alias("rate"))


@query("loop_weights", """SELECT n::INT AS n, tail, round(CASE WHEN tail = 'renorm' THEN 0.6 * pow(0.4, n - 1) / (1 - pow(0.4, 6)) WHEN n = 6 THEN pow(0.4, 5) ELSE 0.6 * pow(0.4, n - 1) END, 9) AS w
 FROM range(1, 7) r(n), (VALUES ('renorm'), ('lump')) t(tail)""")
def loop_weights(s, d):
    parts = [estimation.loop_weights(s, 0.4, 6, t).withColumn("tail", F.lit(t)) for t in ("renorm", "lump")]
    return parts[0].unionByName(parts[1]).select("n", "tail", nine("w").alias("w"))


# --- object-centric ------------------------------------------------------------------

REL = """rel AS (SELECT event_id AS eid, event_type AS act, ts, user_id, 'u' || user_id AS oid, 'user' AS otype FROM events
 UNION ALL SELECT event_id, event_type, ts, user_id, 'i' || json_extract_string(props, '$.k'), 'item' FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL)"""
OSEQ = REL + """, seq AS (SELECT otype, oid, act, lead(act) OVER w AS nxt, lead(act, 2) OVER w AS nxt2, row_number() OVER w AS pos FROM rel WINDOW w AS (PARTITION BY otype, oid ORDER BY ts, eid)),
 dfg AS (SELECT otype, act AS a, nxt AS b, count(*) AS n FROM seq WHERE nxt IS NOT NULL GROUP BY ALL),
 l2 AS (SELECT otype, act AS a, nxt AS b, count(*) AS n FROM seq WHERE nxt2 = act AND nxt <> act GROUP BY ALL),
 dep AS (SELECT d.otype, d.a, d.b, CASE WHEN d.a = d.b THEN d.n / (d.n + 1.0) ELSE (d.n - coalesce(e.n, 0)) / (d.n + coalesce(e.n, 0) + 1.0) END AS dep,
  (coalesce(x.n, 0) + coalesce(y.n, 0)) / (coalesce(x.n, 0) + coalesce(y.n, 0) + 1.0) AS dep2
  FROM dfg d LEFT JOIN dfg e ON e.otype = d.otype AND e.a = d.b AND e.b = d.a LEFT JOIN l2 x ON x.otype = d.otype AND x.a = d.a AND x.b = d.b LEFT JOIN l2 y ON y.otype = d.otype AND y.a = d.b AND y.b = d.a),
 best AS (SELECT *, max(CASE WHEN a <> b THEN dep END) OVER (PARTITION BY otype, a) AS o, max(CASE WHEN a <> b THEN dep END) OVER (PARTITION BY otype, b) AS i FROM dep),
 arcs AS (SELECT a AS src, otype, b AS tgt FROM best WHERE CASE WHEN a = b THEN dep >= 0.5 ELSE dep >= 0.5 OR dep2 >= 0.5 OR (o > 0 AND dep >= o - 0.05) OR (i > 0 AND dep >= i - 0.05) END
  UNION SELECT 'START_' || otype, otype, act FROM seq WHERE pos = 1 UNION SELECT act, otype, 'END_' || otype FROM seq WHERE nxt IS NULL)"""


def _near_sql(side: str) -> str:
    prev = side == "in"
    cmp, pick = ("<", "max") if prev else (">", "min")
    arc = "(c.act, e.otype, e.act)" if prev else "(e.act, e.otype, c.act)"
    bound = "('START_' || e.otype, e.otype, e.act)" if prev else "(e.act, e.otype, 'END_' || e.otype)"
    node = "START_" if prev else "END_"
    return f"""near_{side} AS (SELECT * FROM (SELECT e.eid, e.act, e.otype, e.oid, coalesce((SELECT arg_{pick}(c.act, (c.ts, c.eid)) FROM rel c
  WHERE c.oid = e.oid AND c.otype = e.otype AND (c.ts, c.eid) {cmp} (e.ts, e.eid) AND {arc} IN (SELECT (src, otype, tgt) FROM arcs)),
  CASE WHEN {bound} IN (SELECT (src, otype, tgt) FROM arcs) THEN '{node}' || e.otype END) AS other FROM rel e) WHERE other IS NOT NULL),
 mk_{side} AS (SELECT eid, act, otype || ':' || other AS m, count(DISTINCT oid) AS c FROM near_{side} GROUP BY ALL),
 st_{side} AS (SELECT eid, act, list(m ORDER BY m) AS st FROM mk_{side} GROUP BY ALL)"""


BOTH = OSEQ + ", " + _near_sql("in") + ", " + _near_sql("out")


@query("ocel_flatten", f"WITH {REL} SELECT otype, oid, string_agg(act, '>' ORDER BY ts, eid) AS trace FROM rel GROUP BY ALL")
def ocel_flatten(s, d):
    return event_log.flatten(ocel(s, d)).select("otype", "oid", joined("trace", ">").alias("trace"))


@query("ocel_objects", f"WITH {REL} SELECT otype, count(DISTINCT oid) AS objects, count(DISTINCT eid) AS events FROM rel GROUP BY ALL")
def ocel_objects(s, d):
    rel = ocel(s, d)
    return event_log.objects_of(rel).groupBy("otype").agg(F.count(F.lit(1)).alias("objects")).join(rel.groupBy("otype").agg(F.count_distinct("eid").alias("events")), "otype")


@query("ocel_kappa", f"""WITH {REL}, b AS (SELECT oid, any_value(otype) AS otype, arg_min(act, (ts, eid)) AS f, arg_max(act, (ts, eid)) AS l FROM rel GROUP BY ALL)
 SELECT a.act AS label, coalesce((SELECT string_agg(DISTINCT otype, ',' ORDER BY otype) FROM b WHERE f = a.act), '') AS creates,
 coalesce((SELECT string_agg(DISTINCT otype, ',' ORDER BY otype) FROM b WHERE l = a.act), '') AS consumes FROM (SELECT DISTINCT act FROM rel) a""")
def ocel_kappa(s, d):
    return objectcentric.licences(ocel(s, d)).select("label", joined("creates").alias("creates"), joined("consumes").alias("consumes"))


@query("ocdg_arcs", f"WITH {OSEQ} SELECT src, otype, tgt FROM arcs")
def ocdg_arcs(s, d):
    return succession.dependency_graph(ocel(s, d))


@query("occn_neighbours", f"WITH {BOTH} SELECT 'in' AS side, act AS activity, otype, other, count(*) AS n FROM near_in GROUP BY ALL UNION ALL SELECT 'out', act, otype, other, count(*) FROM near_out GROUP BY ALL")
def occn_neighbours(s, d):
    rel = ocel(s, d)
    arcs = settled(succession.dependency_graph(rel))
    parts = [objectcentric.neighbours(rel, arcs, side).groupBy("activity", "otype", "other").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(side)) for side in ("in", "out")]
    return parts[0].unionByName(parts[1]).select("side", "activity", "otype", "other", "n")


def _markers_sql(side: str) -> str:
    return f"""SELECT '{side}' AS side, x.act AS activity, array_to_string(x.st, ',') AS structure, x.m AS marker, min(x.c) AS lo, max(x.c) AS hi, count(*) AS n
 FROM (SELECT s.act, s.st, k.m, k.c FROM st_{side} s JOIN mk_{side} k USING (eid)) x GROUP BY ALL"""


@query("occn_markers", f"WITH {BOTH} {_markers_sql('in')} UNION ALL {_markers_sql('out')}")
def occn_markers(s, d):
    rel = ocel(s, d)
    arcs = settled(succession.dependency_graph(rel))
    parts = [objectcentric.marker_groups(objectcentric.neighbours(rel, arcs, side)).withColumn("side", F.lit(side)) for side in ("in", "out")]
    rows = parts[0].unionByName(parts[1]).select("side", "activity", joined("structure").alias("structure"), "n", F.explode("cards").alias("c"))
    return rows.select("side", "activity", "structure", F.col("c.m").alias("marker"), F.col("c.lo").alias("lo"), F.col("c.hi").alias("hi"), "n")


GENS = BOTH + """, si AS (SELECT DISTINCT act, st FROM st_in), so AS (SELECT DISTINCT act, st FROM st_out),
 gen AS (SELECT coalesce(i.act, o.act) AS label, coalesce(list_sort(list_transform(i.st, lambda m: split_part(m, ':', 2) || '|' || split_part(m, ':', 1) || '|' || i.act)), []) AS l,
  coalesce(list_sort(list_transform(o.st, lambda m: o.act || '|' || split_part(m, ':', 1) || '|' || split_part(m, ':', 2))), []) AS r
  FROM si i FULL JOIN so o ON i.act = o.act WHERE i.st IS NULL OR o.st IS NULL OR
  list_sort(list_distinct(list_transform(i.st, lambda m: split_part(m, ':', 1)))) = list_sort(list_distinct(list_transform(o.st, lambda m: split_part(m, ':', 1))))
  UNION SELECT src, [], [src || '|' || otype || '|' || tgt] FROM arcs WHERE src = 'START_' || otype
  UNION SELECT tgt, [src || '|' || otype || '|' || tgt], [] FROM arcs WHERE tgt = 'END_' || otype)"""


@query("occn_generators", f"WITH {GENS} SELECT label, array_to_string(l, ',') AS left_ports, array_to_string(r, ',') AS right_ports FROM gen")
def occn_generators(s, d):
    return objectcentric.signature(ocel(s, d)).select("label", joined("left").alias("left_ports"), joined("right").alias("right_ports"))


_TYPES = lambda c: f"list_transform({c}, lambda p: split_part(p, '|', 2))"
_COUNTS = lambda c: f"array_to_string(list_transform(list_sort(list_distinct({_TYPES(c)})), lambda t: t || 'x' || len(list_filter({_TYPES(c)}, lambda u: u = t))), ',')"


@query("canon_keys", f"WITH {GENS} SELECT label, {_COUNTS('l')} AS ins, {_COUNTS('r')} AS outs, count(*) AS n FROM gen GROUP BY ALL")
def canon_keys(s, d):
    return signatures.canonical_keys(objectcentric.signature(ocel(s, d))).select("label", joined("ins").alias("ins"), joined("outs").alias("outs"), "n")


_FACTS = lambda gen: f"""sd AS (SELECT label, 'in' AS side, {_TYPES('l')} AS types FROM {gen} UNION SELECT label, 'out', {_TYPES('r')} FROM {gen}),
 dom AS (SELECT DISTINCT label, side, unnest(types) AS typ FROM sd), ids AS (SELECT DISTINCT label, side FROM sd),
 fact AS (SELECT i.label, i.side, d.typ, string_agg(DISTINCT c, ',' ORDER BY c) AS arities FROM ids i LEFT JOIN dom d USING (label, side),
  LATERAL (SELECT CASE WHEN d.typ IS NULL THEN 0 ELSE len(list_filter(s.types, lambda u: u = d.typ)) END AS c FROM sd s WHERE s.label = i.label AND s.side = i.side) GROUP BY ALL)"""  # noqa: E731


def _facts(sig: DataFrame) -> DataFrame:
    return signatures.marginal_facts(sig).select("label", "side", "typ", F.array_join(F.transform("arities", lambda a: a.cast("string")), ",").alias("arities"))


@query("marginal_facts", f"WITH {GENS}, {_FACTS('gen')} SELECT label, side, typ, arities FROM fact")
def marginal_facts(s, d):
    return _facts(objectcentric.signature(ocel(s, d)))


KAPPA = """b AS (SELECT oid, any_value(otype) AS otype, arg_min(act, (ts, eid)) AS f, arg_max(act, (ts, eid)) AS l FROM rel GROUP BY ALL),
 kap AS (SELECT a.act AS label, coalesce((SELECT list(DISTINCT otype) FROM b WHERE f = a.act), []) AS cr, coalesce((SELECT list(DISTINCT otype) FROM b WHERE l = a.act), []) AS co FROM (SELECT DISTINCT act FROM rel) a),
 vi AS (SELECT g.label, l, r, list_filter(list_distinct(tr), lambda t: NOT list_contains(tl, t) AND NOT list_contains(cr, t)) AS made, list_filter(list_distinct(tl), lambda t: NOT list_contains(tr, t) AND NOT list_contains(co, t)) AS lost
  FROM (SELECT *, list_transform(l, lambda p: split_part(p, '|', 2)) AS tl, list_transform(r, lambda p: split_part(p, '|', 2)) AS tr FROM gen) g JOIN kap k ON g.label = k.label)"""


@query("type_balance_violations", f"WITH {GENS}, {KAPPA} SELECT label, count(*) AS n FROM vi WHERE len(made) > 0 OR len(lost) > 0 GROUP BY ALL")
def type_balance_violations(s, d):
    rel = ocel(s, d)
    return signatures.violations(objectcentric.signature(rel), objectcentric.licences(rel)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("forget_provenance", f"""WITH {GENS} SELECT DISTINCT label, array_to_string(list_sort(list_distinct(list_transform(l, lambda p: '*|' || split_part(p, '|', 2) || '|' || split_part(p, '|', 3)))), ',') AS left_ports,
 array_to_string(list_sort(list_distinct(list_transform(r, lambda p: '*|' || split_part(p, '|', 2) || '|' || split_part(p, '|', 3)))), ',') AS right_ports FROM gen""")
def forget_provenance(s, d):
    return signatures.forget_provenance(objectcentric.signature(ocel(s, d))).select("label", joined("left").alias("left_ports"), joined("right").alias("right_ports"))


def _sides(s, d):
    """The signatures of both halves of the users, mined together."""
    rel = ocel(s, d).join(events(s, d).select(F.col("event_id").alias("eid"), (F.col("user_id") % 2).alias("h")), "eid")
    sig = settled(objectcentric.signature(rel, "h"))
    return [sig.filter(f"h = {i}").drop("h") for i in (0, 1)]


def _half(i: int) -> str:
    """GENS over one half of the users, every relation renamed."""
    import re

    text = GENS.replace("FROM events", f"FROM (SELECT * FROM events WHERE user_id % 2 = {i})")
    names = set(re.findall(r"(\w+) AS \(SELECT", text))
    return re.sub(r"\b(" + "|".join(names) + r")\b(?!')", lambda m: f"{m[1]}_{i}", text)


@query("signature_jaccard", f"""WITH {_half(0)}, {_half(1)} , x AS (SELECT count(*) AS common FROM (SELECT * FROM gen_0 INTERSECT SELECT * FROM gen_1)), y AS (SELECT count(*) AS total FROM (SELECT * FROM gen_0 UNION SELECT * FROM gen_1))
 SELECT common, total, round(common / total, 9) AS jaccard FROM x, y""")
def signature_jaccard(s, d):
    return signatures.jaccard(*_sides(s, d)).select("common", "total", nine("jaccard").alias("jaccard"))


_F0, _F1 = (_FACTS(f"gen_{i}").replace("sd", f"sd_{i}").replace("dom", f"dom_{i}").replace("ids", f"ids_{i}").replace("fact", f"fact_{i}") for i in (0, 1))


@query("compare_status", f"""WITH {_half(0)}, {_half(1)}, {_F0}, {_F1}, al AS (SELECT coalesce(a.label, b.label) AS label, coalesce(a.side, b.side) AS side, coalesce(a.typ, b.typ) AS typ, a.arities AS x, b.arities AS y
  FROM fact_0 a FULL JOIN fact_1 b ON a.label = b.label AND a.side = b.side AND a.typ IS NOT DISTINCT FROM b.typ)
 SELECT label, side, typ, CASE WHEN x IS NULL THEN 'absent' ELSE 'ref' END AS status_even, CASE WHEN y IS NULL THEN 'absent' WHEN x IS NULL THEN 'novel' WHEN x = y THEN 'match' ELSE 'diff' END AS status_odd,
 CASE WHEN x <> y THEN 'param-diff' WHEN x IS NULL OR y IS NULL THEN 'partial' ELSE 'match' END AS verdict FROM al""")
def compare_status(s, d):
    even, odd = map(_facts, _sides(s, d))
    return signatures.compare({"even": even, "odd": odd}, ["label", "side", "typ"], "arities", "even")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of the block-transition matrices of user cohorts."""
    return smd_fleet(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
