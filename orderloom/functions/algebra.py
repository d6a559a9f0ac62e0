"""Sets of generators: views, boundary conventions, structure up to renaming, grounding."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import replace
from itertools import product

from .constraints import Constraint, linear, renamed
from .graphs import Generator, unroll

Port = tuple


def name_of(port: Port) -> str:
    """The port's name in constraints."""
    return "|".join(map(str, port))


def labels(sig: Iterable[Generator]) -> set[str]:
    return {g.label for g in sig}


def by_label(sig: Iterable[Generator], label: str) -> set[Generator]:
    return {g for g in sig if g.label == label}


def ports(sig: Iterable[Generator]) -> set[Port]:
    return {p for g in sig for p in (*g.left, *g.right)}


def constrained_ports(g: Generator) -> set[Port]:
    """The legs that a constraint speaks of."""
    told = {p for c in g.constraints for p, _ in c.terms}
    return {p for p in (*g.left, *g.right) if name_of(p) in told}


def object_types(sig: Iterable[Generator]) -> dict[str, set[str]]:
    """Types that each label touches."""
    out: dict[str, set[str]] = defaultdict(set)
    for g in sig:
        out[g.label] |= {p[1] for p in (*g.left, *g.right) if p[1] is not None}
    return dict(out)


def several_objects(sig: Iterable[Generator]) -> bool:
    """Some leg may carry more than one object, or some rule deals objects over several legs."""
    rules = [c for g in sig for c in g.constraints]
    wide = any(len(c.terms) == 1 and c.rel != ">=" and c.rhs > 1 for c in rules)
    return wide or any(sum(k > 0 for _, k in c.terms) > 1 or sum(k < 0 for _, k in c.terms) > 1 for c in rules)


def ground(sig: Iterable[Generator], order: int = 8) -> set[Generator]:
    """Every generator once a solution of its constraints, with the objects of each leg as weights."""
    return {x for g in sig for x in unroll(g, order)}


def _moved(g: Generator, end) -> Generator:
    port = lambda p: (end(p[0]), p[1], end(p[2]))
    names = {name_of(p): name_of(port(p)) for p in (*g.left, *g.right)}
    return Generator(
        end(g.label), frozenset(map(port, g.left)), frozenset(map(port, g.right)),
        frozenset(renamed(c, lambda x: names.get(x, x)) for c in g.constraints), frozenset((port(p), n) for p, n in g.weights),
    )


def common_boundary(sig: Iterable[Generator], first: str = "gamma1", last: str = "gamma2") -> set[Generator]:
    """Boundaries in one convention: START_ and END_ labels become ``first`` and ``last``
    wherever they stand, and activities that are open to one side get a leg from ``first`` or
    to ``last`` for every type of the other side, with the generators that feed or drain it."""
    end = lambda x: first if x.startswith("START_") else last if x.startswith("END_") else x
    out: set[Generator] = set()
    for g in (_moved(g, end) for g in sig):
        if g.label not in (first, last) and bool(g.left) != bool(g.right):
            types = {p[1] for p in g.left | g.right}
            legs = {(first, k, g.label) for k in types} if g.right else {(g.label, k, last) for k in types}
            out |= {Generator(first, frozenset(), frozenset([p])) if g.right else Generator(last, frozenset([p]), frozenset()) for p in legs}
            g = replace(g, left=frozenset(legs)) if g.right else replace(g, right=frozenset(legs))
        out.add(g)
    return out


def neutral(sig: Iterable[Generator]) -> set[Generator]:
    """Ports without where their objects come from: what is left tells type and goal."""
    port = lambda p: ("*", p[1], p[2])
    return {
        Generator(g.label, frozenset(map(port, g.left)), frozenset(map(port, g.right)), frozenset(
            renamed(c, lambda x, names={name_of(p): name_of(port(p)) for p in g.left | g.right}: names.get(x, x)) for c in g.constraints
        )) for g in sig
    }


def bindings(g: Generator) -> tuple[dict[tuple[str, str], list[tuple[int, int | None]]], list[str]]:
    """(side, type) -> the intervals of its legs, those of exactly one left out; and the rules over
    several legs as text."""
    told: dict = defaultdict(list)
    for side, legs in (("left", g.left), ("right", g.right)):
        for p in sorted(legs, key=str):
            own = [c for c in g.constraints if c.terms == ((name_of(p), 1),)]
            low = max([c.rhs for c in own if c.rel != "<="], default=1)
            high = min([c.rhs for c in own if c.rel != ">="], default=None if own else 1)
            if (low, high) != (1, 1):
                told[side, str(p[1])].append((low, high))
    wide = sorted(f"{' + '.join(f'{k} {p}' if k != 1 else p for p, k in c.terms)} {c.rel} {c.rhs}" for c in g.constraints if len(c.terms) > 1)
    return {k: sorted(v, key=str) for k, v in told.items()}, wide


def bindings_text(g: Generator) -> str:
    legs, wide = bindings(g)
    parts = [f"{side} {typ} " + ", ".join(f"{a}..{'*' if b is None else b}" for a, b in spans) for (side, typ), spans in sorted(legs.items())]
    return "; ".join(parts + wide) or "one of each"


# --- structure up to renaming ------------------------------------------------------------

def _incidence(sig: Iterable[Generator]) -> tuple[dict, dict]:
    """Nodes with what names may not change, and neighbours by side."""
    kind, near = {}, defaultdict(set)
    for i, g in enumerate(sorted(sig, key=str)):
        kind["g", i] = (len(g.left), len(g.right))
        for side, legs in (("l", g.left), ("r", g.right)):
            for p in legs:
                kind["p", p] = str(p[1])
                near["g", i].add((side, ("p", p)))
                near["p", p].add((side, ("g", i)))
    return kind, near


def _refined(kind: dict, near: dict) -> dict:
    name = {n: repr((n[0], k)) for n, k in kind.items()}
    while True:
        told = {n: hashlib.blake2b(repr((name[n], sorted((s, name[m]) for s, m in near[n]))).encode(), digest_size=8).hexdigest() for n in kind}
        if len(set(told.values())) == len(set(name.values())):
            return told
        name = told


def isomorphic(a: Iterable[Generator], b: Iterable[Generator]) -> bool:
    """The signatures are one up to the names of activities; types and arities stay."""
    (ka, na), (kb, nb) = _incidence(a), _incidence(b)
    ca, cb = _refined(ka, na), _refined(kb, nb)
    if Counter(ca.values()) != Counter(cb.values()):
        return False
    rare = Counter(ca.values())
    todo, rivals = sorted(ka, key=lambda n: (rare[ca[n]], ca[n], str(n))), defaultdict(list)
    for n in kb:
        rivals[cb[n]].append(n)

    def extend(match: dict) -> bool:
        if len(match) == len(todo):
            return True
        n, used = todo[len(match)], set(match.values())
        for m in rivals[ca[n]]:
            if m not in used and {(s, match[x]) for s, x in na[n] if x in match} == {(s, y) for s, y in nb[m] if y in used}:
                if extend({**match, n: m}):
                    return True
        return False

    return extend({})


# --- grounding of mined markers ------------------------------------------------------------

Marker = tuple  # (activity at the other end, type, least, greatest or None)


def firing_rules(activity: str, into: Iterable[Marker], out: Iterable[Marker]) -> frozenset[Constraint]:
    """Bounds of each leg, and as many objects of a type out as in where both sides have it."""
    rules, total = [], defaultdict(lambda: ([], []))
    for side, markers in enumerate((into, out)):
        for other, typ, low, high in markers:
            leg = f"`{name_of((other, typ, activity) if side == 0 else (activity, typ, other))}`"
            total[typ][side].append(leg)
            rules += linear(f"{low} <= {leg}" + (f" <= {high}" if high is not None else ""))
    for given, taken in total.values():
        if given and taken:
            rules += linear(f"{' + '.join(sorted(taken))} == {' + '.join(sorted(given))}")
    return frozenset(rules)


def grounded_markers(groups: dict[str, tuple[list, list]], arcs: Iterable[tuple], starts: dict[str, str], ends: dict[str, str], order: int = 8) -> set[Generator]:
    """Weighted generators of marker groups {activity: (groups in, groups out)}, each pair of
    groups with the same types (or one side without groups) grounded by its firing rules, and
    one START_ or END_ generator an arc (src, type, tgt) at the boundary."""
    return _interior(groups, order) | {
        Generator(node, frozenset() if first else frozenset([a]), frozenset([a]) if first else frozenset())
        for nodes, first in ((starts, True), (ends, False)) for typ, node in nodes.items() for a in arcs if a[1] == typ and a[0 if first else 2] == node
    }


def _interior(groups: dict, order: int) -> set[Generator]:
    out: set[Generator] = set()
    for activity, (into, onto) in groups.items():
        for a, b in product(into or [()], onto or [()]):
            if into and onto and {m[1] for m in a} != {m[1] for m in b}:
                continue
            left, right = frozenset((m[0], m[1], activity) for m in a), frozenset((activity, m[1], m[0]) for m in b)
            out |= unroll(Generator(activity, left, right, firing_rules(activity, a, b)), order)
    return out


def run_boundary(arcs: Iterable[tuple], starts: dict[str, str], ends: dict[str, str], counts: dict[str, int], order: int = 8) -> set[Generator]:
    """The boundary of one run with ``counts`` objects of each type: one ``gamma1`` a way to
    deal them over the activities that can begin, and sinks of single objects."""
    arcs = list(arcs)
    first = {typ: [a for a in arcs if a[0] == node and a[1] == typ] for typ, node in starts.items()}
    rules = [c for typ, legs in first.items() if legs for c in linear(" + ".join(f"`{name_of(p)}`" for p in legs) + f" == {counts.get(typ, 0)}")]
    source = Generator("gamma1", frozenset(), frozenset(p for legs in first.values() for p in legs), frozenset(rules))
    sinks = {Generator(node, frozenset([a]), frozenset()) for typ, node in ends.items() for a in arcs if a[1] == typ and a[2] == node}
    return unroll(source, max(order, *counts.values(), 1)) | sinks


def grounded_run(groups: dict, arcs: Iterable[tuple], starts: dict[str, str], ends: dict[str, str], counts: dict[str, int], order: int = 8) -> set[Generator]:
    arcs = list(arcs)
    return _interior(groups, order) | run_boundary(arcs, starts, ends, counts, order)
