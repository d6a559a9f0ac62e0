"""Seeded synthetic logs: every row's randomness comes from the seed and its number,
so any task can be recomputed and gives the same rows."""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import algebra, composition
from ..functions.posets import Order, sample_extension


def _pick(r: random.Random, weights: Sequence[float]) -> int:
    return r.choices(range(len(weights)), weights)[0]


def _swapped(r: random.Random, trace: list[str], eps: float) -> list[str]:
    if len(trace) > 1 and r.random() < eps:
        i = r.randrange(len(trace) - 1)
        trace[i], trace[i + 1] = trace[i + 1], trace[i]
    return trace


def grouped_log(spark: SparkSession, model: Sequence[tuple[Order, float]], groups: int, per_group: int, seed: int = 0, eps: float = 0.0, eta: float = 0.0) -> DataFrame:
    """(group_id, trace_no, component, trace): each group draws a component; its traces
    are uniform extensions, with adjacent swaps (eps) and traces of others (eta)."""
    model = list(model)
    weights = [w for _, w in model]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for g in pdf.id:
                r = random.Random(f"{seed}/{g}")
                own = _pick(r, weights)
                for i in range(per_group):
                    k = _pick(r, weights) if r.random() < eta else own
                    order = model[k][0]
                    trace = [order.labels[e] for e in sample_extension(order, r)]
                    out.append((g, i, own, _swapped(r, trace, eps)))
            yield pd.DataFrame(out, columns=["group_id", "trace_no", "component", "trace"])

    return spark.range(groups).mapInPandas(run, "group_id bigint, trace_no int, component int, trace array<string>")


def timed_log(spark: SparkSession, model: Sequence[tuple[Order, float, float]], groups: int, per_group: int, seed: int = 0) -> DataFrame:
    """(group_id, trace_no, component, trace, gaps): racing clocks: the next gap is
    exponential at rate lam times the number of enabled labels, the finisher uniform."""
    model = list(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for g in pdf.id:
                r = random.Random(f"{seed}/{g}")
                own = _pick(r, [w for _, w, _ in model])
                order, _, lam = model[own]
                below = order.below
                for i in range(per_group):
                    done, trace, gaps = 0, [], []
                    while len(trace) < len(order):
                        ready = [e for e in range(len(order)) if not done >> e & 1 and not below[e] & ~done]
                        gaps.append(r.expovariate(lam * len(ready)))
                        e = r.choice(ready)
                        done |= 1 << e
                        trace.append(order.labels[e])
                    out.append((g, i, own, trace, gaps))
            yield pd.DataFrame(out, columns=["group_id", "trace_no", "component", "trace", "gaps"])

    return spark.range(groups).mapInPandas(run, "group_id bigint, trace_no int, component int, trace array<string>, gaps array<double>")


def keyed_log(spark: SparkSession, model: Sequence[tuple[Order, float]], blocks: int, traces: int | tuple[int, int], defect: float, seed: int = 0, eps: float = 0.0) -> DataFrame:
    """(key, trace): blocks without case ids.  A block has a main component, from which each
    trace defects with probability ``defect``; ``traces`` is how many a block has, or a range."""
    model = list(model)
    weights = [w for _, w in model]
    low, high = (traces, traces) if isinstance(traces, int) else traces

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for b in pdf.id:
                r = random.Random(f"{seed}/{b}")
                own = _pick(r, weights)
                for _ in range(r.randint(low, high)):
                    order = model[_pick(r, weights) if r.random() < defect else own][0]
                    out.append((f"block{b:03d}", _swapped(r, [order.labels[e] for e in sample_extension(order, r)], eps)))
            yield pd.DataFrame(out, columns=["key", "trace"])

    return spark.range(blocks).mapInPandas(run, "key string, trace array<string>")


def repeats(spark: SparkSession, q: float, n: int, seed: int = 0) -> DataFrame:
    """(id, k): geometric repeat counts by inversion."""
    u = F.greatest(F.rand(seed), F.lit(1e-300))
    return spark.range(n).select("id", F.when(F.lit(q) <= 0, 1).otherwise(F.floor(F.ln(u) / F.ln(F.lit(max(q, 1e-300)))) + 1).cast("int").alias("k"))


def relations_of_runs(spark: SparkSession, runs: Sequence[Sequence], start: str = "2020-01-01") -> DataFrame:
    """(eid, activity, ts, oid, otype) of runs of generators (functions.composition):
    a token is an object; it keeps its identity along ports of its type."""
    rows, eid = [], 0
    for n, run in enumerate(runs):
        held: dict = {}
        made = 0
        for g in run:
            came: dict[str, list[str]] = {}
            for p in sorted(g.left, key=str):
                came.setdefault(str(p[1]), []).append(held[p].pop(0))
            for p in sorted(g.right, key=str):
                pool = came.get(str(p[1]), [])
                if pool:
                    oid = pool[0] if len(pool) == 1 else pool.pop(0)
                else:
                    oid, made = f"{n}-{p[1]}-{made}", made + 1
                held.setdefault(p, []).append(oid)
                rows.append((eid, g.label, n, oid, str(p[1])))
            rows += [(eid, g.label, n, oid, t) for t, ids in came.items() for oid in ids]
            eid += 1
    df = spark.createDataFrame(rows, "eid bigint, activity string, run int, oid string, otype string").distinct()
    base = F.unix_seconds(F.lit(start).cast("timestamp"))
    return df.select("eid", "activity", F.timestamp_seconds(base + F.col("eid")).alias("ts"), "oid", "otype")


def faithful_relations(spark: SparkSession, signature: Sequence, runs: int = 100, seed: int = 7, order: int = 4, longest: int = 10_000) -> DataFrame:
    """(run, eid, activity, oid, otype): random runs of a signature's groundings that end with
    nothing left.  A leg carries as many objects as its weight says; an object keeps its
    identity along ports of its type and each run is recomputed from the seed and its number."""
    grounded = sorted(algebra.ground(signature, order), key=str)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = composition.explore(grounded)
        good = composition.closing_states(graph)
        for pdf in batches:
            out = []
            for n in pdf.id:
                r, state, held, made, eid = random.Random(f"{seed}/{n}"), ((), frozenset()), {}, 0, 0
                while (state[0] or not state[1]) and eid < longest:
                    moves = [(g, t) for g, t in graph[state] if t in good]
                    if not moves:
                        break
                    g, state = r.choice(moves)
                    came: dict[str, list[str]] = {}
                    for p in sorted(g.left, key=str):
                        for _ in range(g.weight(p)):
                            came.setdefault(str(p[1]), []).append(held[p].pop(0))
                    seen = {(oid, t) for t, ids in came.items() for oid in ids}
                    for p in sorted(g.right, key=str):
                        for _ in range(g.weight(p)):
                            pool = came.get(str(p[1]), [])
                            oid = pool.pop(0) if pool else f"{n}-{p[1]}-{made}"
                            made += oid.endswith(f"-{made}")
                            held.setdefault(p, []).append(oid)
                            seen.add((oid, str(p[1])))
                    out += [(n, eid, g.label, oid, t) for oid, t in sorted(seen)]
                    eid += 1
            yield pd.DataFrame(out, columns=["run", "eid", "activity", "oid", "otype"])

    return spark.range(runs).mapInPandas(run, "run bigint, eid bigint, activity string, oid string, otype string")
