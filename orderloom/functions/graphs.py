"""Typed activity graphs with routing nodes, and the generators they induce.

Nodes are activities (with labels) or routers: XOR, AND, OR, SEQ.  A generator is a
label with sets of typed left and right ports; its contexts are the ways to route
from and to other activities.  Graphs are model-sized; many of them go through
``extract_table``, one group a graph.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame

KINDS = ("XOR", "AND", "OR", "SEQ")
TERMINUS = "gamma2"

Bundle = frozenset  # of (label, type or None)


@dataclass(frozen=True)
class Generator:
    label: str
    left: frozenset
    right: frozenset
    constraints: frozenset = frozenset()
    weights: frozenset = frozenset()

    def weight(self, port) -> int:
        return dict(self.weights).get(port, 1)


@dataclass
class Graph:
    """label of each activity, kind of each router, edges (src, tgt, type), silent routers."""

    labels: dict[str, str] = field(default_factory=dict)
    routers: dict[str, str] = field(default_factory=dict)
    edges: list[tuple[str, str, str | None]] = field(default_factory=list)
    silent: frozenset[str] = frozenset()

    def check(self) -> Graph:
        """No edge joins two activities; a router's edges have one type."""
        for s, t, _ in self.edges:
            if s in self.labels and t in self.labels:
                raise ValueError(f"{s} -> {t} needs a router between")
        for r in self.routers:
            if len({k for s, t, k in self.edges if r in (s, t) and k is not None}) > 1:
                raise ValueError(f"router {r} has edges of several types")
        return self

    def without_silent(self) -> Graph:
        """Silent routers contracted: every way in joins every way out."""
        edges = list(dict.fromkeys(self.edges))
        for gone in sorted(self.silent):
            into = [e for e in edges if e[1] == gone]
            out = [e for e in edges if e[0] == gone]
            rest = [e for e in edges if gone not in e[:2]]
            through = [(a[0], b[1], a[2] if a[2] is not None else b[2]) for a in into for b in out if a[0] != b[1]]
            edges = list(dict.fromkeys(rest + through))
        return replace(self, edges=edges, routers={r: k for r, k in self.routers.items() if r not in self.silent}, silent=frozenset())

    def arcs(self, node: str, forward: bool) -> list[tuple[str, str | None]]:
        return [(t if forward else s, k) for s, t, k in self.edges if (s if forward else t) == node]


def _all(families: Iterable[set[Bundle]]) -> set[Bundle]:
    """One bundle of each family, joined; duplicates go after every family."""
    out = {frozenset()}
    for family in families:
        out = {a | b for a in out for b in family}
    return out


def _route(kind: str, families: list[set[Bundle]]) -> set[Bundle]:
    if kind in ("AND", "SEQ"):  # a sequence router with several arcs takes them all
        return _all(families)
    if kind == "OR":
        return set().union(*(_all(some) for n in range(1, len(families) + 1) for some in itertools.combinations(families, n)))
    if kind == "XOR":
        return set().union(*families) or {frozenset()}
    raise ValueError(f"unknown router {kind!r}")


def _type(path: tuple) -> str | None:
    """The path's type: the last one named."""
    named = [k for k in path if k is not None]
    return named[-1] if named else None


def reach(g: Graph, node: str, path: tuple, seen: frozenset, forward: bool) -> set[Bundle]:
    """Bundles of activities that routing from a node can end in."""
    if node in g.labels:
        return {frozenset({(g.labels[node], _type(path))})}
    if node in seen:
        return {frozenset()}
    arcs = g.arcs(node, forward)
    if not arcs:
        return {frozenset({(TERMINUS, _type(path))})} if forward else {frozenset()}
    return _route(g.routers[node], [reach(g, n, (*path, k), seen | {node}, forward) for n, k in arcs])


def families(g: Graph, activity: str, forward: bool) -> list[set[Bundle]]:
    """One family of bundles an arc of the activity: the factored form."""
    return [reach(g, n, (k,), frozenset(), forward) for n, k in g.arcs(activity, forward)]


def contexts(g: Graph, activity: str, forward: bool, surface: bool = False) -> set[Bundle]:
    found = _all(families(g, activity, forward))
    if not forward:
        return found
    if surface:  # a bundle of nothing but termini is an end, not a leg
        return {frozenset() if b and all(x[0] == TERMINUS for x in b) else b for b in found}
    return {frozenset(x for x in b if x[0] != TERMINUS) for b in found}


def admissible(label: str, left: Bundle, right: Bundle, licences: dict[str, tuple[set, set]] | None) -> bool:
    """Types that only leave are licensed creations, types that only come are licensed ends."""
    if licences is None or label not in licences:
        return True
    creates, consumes = licences[label]
    a, b = {k for _, k in left if k is not None}, {k for _, k in right if k is not None}
    return b - a <= set(creates) and a - b <= set(consumes)


def _prepared(g: Graph, drop_silent: bool, surface: bool) -> tuple[Graph, bool]:
    if drop_silent and g.silent:
        g = g.without_silent()
    ends = any(x == TERMINUS or x.startswith("END_") for x in g.labels.values())
    return g, surface and not ends


def extract(g: Graph, licences=None, drop_silent: bool = True, surface: bool = False) -> set[Generator]:
    """All admissible generators."""
    g, surface = _prepared(g, drop_silent, surface)
    out = set()
    for node in g.labels:
        label = g.labels[node]
        into, onto = contexts(g, node, False), contexts(g, node, True, surface)
        for a in into:
            for b in onto:
                if admissible(label, a, b, licences):
                    out.add(Generator(label, frozenset((p, k, label) for p, k in a), frozenset((label, k, s) for s, k in b)))
    return out


def _profile(bundle: Bundle) -> tuple:
    return tuple(sorted(Counter(str(k) for _, k in bundle).items()))


def profiles(g: Graph, activity: str, forward: bool, surface: bool = False) -> set[tuple]:
    """Achievable type counts of a side.  Arcs whose endpoints can't meet fold by
    their counts, deduplicated after each, so independent optional types cost the
    number of distinct profiles and not the product of contexts; arcs that share an
    endpoint are joined as sets first."""
    arcs = families(g, activity, forward)
    if forward and not surface:
        arcs = [{frozenset(x for x in b if x[0] != TERMINUS) for b in f} for f in arcs]
    groups: list[tuple[set, set[Bundle]]] = []
    for family in arcs:
        ends, merged = set().union(*family) if family else set(), family
        apart = []
        for other, held in groups:
            if other & ends:
                ends, merged = ends | other, _all([held, merged])
            else:
                apart.append((other, held))
        groups = [*apart, (ends, merged)]
    out = {((), False)}
    for _, family in groups:
        options = {(_profile(b), any(x[0] != TERMINUS for x in b)) for b in family}
        out = {(tuple(sorted((Counter(dict(p)) + Counter(dict(q))).items())), r or s) for p, r in out for q, s in options}
    return {p if real or not (forward and surface) else () for p, real in out}


def canonical(g: Graph, drop_silent: bool = True, surface: bool = False) -> set[tuple]:
    """(label, in counts, out counts) of all generators, without making them."""
    g, surface = _prepared(g, drop_silent, surface)
    return {(g.labels[n], a, b) for n in g.labels for a in profiles(g, n, False) for b in profiles(g, n, True, surface)}


def canonical_key(x: Generator) -> tuple:
    return x.label, _profile(frozenset((p[0], p[1]) for p in x.left)), _profile(frozenset((p[2], p[1]) for p in x.right))


# --- adapters ------------------------------------------------------------------------

def from_petri(nets: dict[str | None, dict]) -> Graph:
    """Typed nets {places, transitions {id: label or None}, arcs} as one graph: places
    choose, unlabelled transitions are silent, labels shared by types synchronise."""
    g, silent = Graph(), set()
    for otype, net in nets.items():
        name = lambda x, o=otype: f"{o}__{x}" if o is not None else x
        for p in net["places"]:
            g.routers[name(p)] = "XOR"
        for t, label in net["transitions"].items():
            if label is None:
                g.routers[name(t)] = "SEQ"
                silent.add(name(t))
            else:
                g.labels[label] = label
        node = lambda x, n=net, f=name: n["transitions"].get(x) or f(x)
        g.edges += [(node(s), node(t), otype) for s, t in net["arcs"]]
    g.silent = frozenset(silent)
    return g.check()


def from_tree(tree, otype: str | None = None) -> Graph:
    """A process tree: a label, None (silent), or (operator, children) with operators
    seq, xor, and, or, loop (do, redo)."""
    g, count = Graph(), itertools.count()

    def router(kind: str) -> str:
        node = f"{kind.lower()}{next(count)}"
        g.routers[node] = kind
        return node

    def build(t) -> tuple[str, str]:
        if t is None or isinstance(t, str):
            a, b = router("SEQ"), router("SEQ")
            if t is None:
                g.edges.append((a, b, otype))
            else:
                node = t if t not in g.labels else f"{t}#{next(count)}"
                g.labels[node] = t
                g.edges += [(a, node, otype), (node, b, otype)]
            return a, b
        op, parts = t[0], [build(x) for x in t[1:]]
        if op == "seq":
            g.edges += [(x[1], y[0], otype) for x, y in zip(parts, parts[1:])]
            return parts[0][0], parts[-1][1]
        if op == "loop":
            a, b = router("XOR"), router("XOR")
            g.edges += [(a, parts[0][0], otype), (parts[0][1], b, otype)]
            for redo in parts[1:]:
                g.edges += [(b, redo[0], otype), (redo[1], a, otype)]
            return a, b
        if op not in ("xor", "and", "or"):
            raise ValueError(f"unknown operator {op!r}")
        a, b = router(op.upper()), router(op.upper())
        g.edges += [e for x in parts for e in ((a, x[0], otype), (x[1], b, otype))]
        return a, b

    build(tree)
    return g.check()


def from_bpmn(tasks: dict[str, str], gateways: dict[str, str], events: Iterable[str], flows: Iterable[tuple[str, str]], otype: str | None = None) -> Graph:
    """Tasks and events are activities (events as ``__Event_<id>__``); a flow between
    two activities gets a sequence router."""
    g = Graph({**tasks, **{e: f"__Event_{e}__" for e in events}}, dict(gateways))
    for i, (s, t) in enumerate(flows):
        if s in g.labels and t in g.labels:
            g.routers[f"flow{i}"] = "SEQ"
            g.edges += [(s, f"flow{i}", otype), (f"flow{i}", t, otype)]
        else:
            g.edges.append((s, t, otype))
    return g.check()


def extract_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, label, left, right) of many graphs: nodes (graph_id, node, kind,
    label, silent), kind ACTIVITY or a router's; edges (graph_id, src, tgt, typ)."""

    def one(key, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        act = n[n.kind == "ACTIVITY"]
        rest = n[n.kind != "ACTIVITY"]
        g = Graph(
            dict(zip(act.node, act.label.where(act.label.notna(), act.node))), dict(zip(rest.node, rest.kind)),
            [(s, t, None if pd.isna(k) else k) for s, t, k in zip(e.src, e.tgt, e.typ)], frozenset(rest.node[rest.silent.fillna(False).astype(bool)]),
        )
        port = lambda ps: sorted("|".join(str(x) for x in p) for p in ps)
        rows = sorted((x.label, port(x.left), port(x.right)) for x in extract(g.check()))
        return pd.DataFrame({"graph_id": [key[0]] * len(rows), "label": [r[0] for r in rows], "left": [r[1] for r in rows], "right": [r[2] for r in rows]})

    kind = nodes.schema["graph_id"].dataType.simpleString()
    return nodes.groupBy("graph_id").cogroup(edges.groupBy("graph_id")).applyInPandas(one, f"graph_id {kind}, label string, left array<string>, right array<string>")


def unroll(g: Generator, order: int = 8) -> set[Generator]:
    """One weighted generator a solution of its constraints (on port texts); without
    constraints the generator itself."""
    from .constraints import solutions

    if not g.constraints:
        return {g}
    text = {"|".join(map(str, p)): p for p in g.left | g.right}
    return {Generator(g.label, g.left, g.right, frozenset(), frozenset((text[v], n) for v, n in s.items())) for s in solutions(g.constraints, bound=order)}
