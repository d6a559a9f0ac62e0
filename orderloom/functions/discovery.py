"""Models from tallies of a log (``succession.tallies``): process trees by cuts of the
directly-follows graph, heuristics nets by dependency and concurrency measures.

Tallies are counted in Spark; what is mined here is as large as the alphabet.
Successions don't tell how often an activity occurs in a case, so a tree by cuts may
lack a repeat that the log has.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

from .graphs import Graph


@dataclass
class Follows:
    """Counts of direct successions, first and last activities."""

    arcs: Counter = field(default_factory=Counter)
    first: Counter = field(default_factory=Counter)
    last: Counter = field(default_factory=Counter)

    @staticmethod
    def of(rows: Iterable[tuple[str, str, str | None, int]]) -> Follows:
        """From (kind, a, b, n) rows."""
        out = Follows()
        for kind, a, b, n in rows:
            if kind == "next":
                out.arcs[a, b] += n
            elif kind in ("first", "last"):
                getattr(out, kind)[a] += n
        return out

    @property
    def activities(self) -> set[str]:
        return {x for arc in self.arcs for x in arc} | set(self.first) | set(self.last)

    def part(self, some: set[str]) -> Follows:
        """The graph of some activities; who comes from outside begins, who leaves ends."""
        out = Follows(Counter({(a, b): n for (a, b), n in self.arcs.items() if a in some and b in some}))
        out.first.update({a: n for a, n in self.first.items() if a in some})
        out.last.update({a: n for a, n in self.last.items() if a in some})
        for (a, b), n in self.arcs.items():
            if a in some and b not in some:
                out.last[a] += n
            if b in some and a not in some:
                out.first[b] += n
        return out


def _connected(nodes: set[str], pairs: Iterable[tuple[str, str]]) -> list[set[str]]:
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    out, left = [], set(nodes)
    while left:
        part, todo = set(), [min(left)]
        while todo:
            x = todo.pop()
            if x not in part:
                part.add(x)
                todo += near[x] - part
        out.append(part & nodes)
        left -= part
    return sorted(out, key=min)


def _reach(nodes: set[str], arcs: Iterable[tuple[str, str]]) -> dict[str, set[str]]:
    nexts = defaultdict(set)
    for a, b in arcs:
        nexts[a].add(b)
    out = {}
    for x in nodes:
        seen, todo = set(), list(nexts[x])
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += nexts[y] - seen
        out[x] = seen
    return out


def _in_sequence(f: Follows, nodes: set[str]) -> list[set[str]]:
    """Parts that only lead onwards: what reaches each other, or neither way, stays together."""
    reach = _reach(nodes, f.arcs)
    together = [(a, b) for a in nodes for b in nodes if a < b and (b in reach[a]) == (a in reach[b])]
    parts = _connected(nodes, together)
    return sorted(parts, key=lambda p: sum(bool(reach[min(q)] & p) for q in parts))


def _side_by_side(f: Follows, nodes: set[str]) -> list[set[str]]:
    """Parts whose activities all follow each other both ways; each must begin and end."""
    apart = [(a, b) for a in nodes for b in nodes if a < b and not ((a, b) in f.arcs and (b, a) in f.arcs)]
    parts = _connected(nodes, apart)
    return parts if all(p & set(f.first) and p & set(f.last) for p in parts) else [nodes]


def _loop(f: Follows, nodes: set[str]) -> list[set[str]]:
    """A body with all begins and ends, and parts that lead from its ends back to its begins."""
    body, first, last = set(f.first) | set(f.last), set(f.first), set(f.last)
    rest = _connected(nodes - body, [(a, b) for a, b in f.arcs if a not in body and b not in body])
    redo = []
    for part in rest:
        enters, leaves = {a for a, b in f.arcs if b in part and a in body}, {b for a, b in f.arcs if a in part and b in body}
        if enters and leaves and enters <= last and leaves <= first:
            redo.append(part)
        else:
            body |= part
    return [body, *redo]


def tree(f: Follows):
    """A process tree (as ``graphs.from_tree`` reads it); what no cut parts may do anything."""
    nodes = f.activities
    if len(nodes) == 1:
        one = next(iter(nodes))
        return ("loop", one, None) if (one, one) in f.arcs else one
    if not nodes:
        return None
    for kind, cut in (("xor", lambda: _connected(nodes, f.arcs)), ("seq", lambda: _in_sequence(f, nodes)), ("and", lambda: _side_by_side(f, nodes)), ("loop", lambda: _loop(f, nodes))):
        parts = cut()
        if len(parts) > 1:
            return (kind, *(_optional(f, p, kind) for p in parts))
    return ("loop", ("xor", *sorted(nodes)), None)


def _optional(f: Follows, part: set[str], kind: str):
    inner = tree(f.part(part))
    if kind != "seq":
        return inner
    # a step of a sequence that some path leads past may be left out
    reach = _reach(f.activities, f.arcs)
    before, after = {a for a in f.activities - part if reach[a] & part}, {b for b in f.activities - part if any(b in reach[a] for a in part)}
    past = any(a in before and b in after for a, b in f.arcs) or (set(f.first) & after) or (set(f.last) & before)
    return ("xor", inner, None) if past else inner


# --- heuristics nets ---------------------------------------------------------------------------

@dataclass(frozen=True)
class Heuristics:
    """Arcs that were accepted; pairs of successors (predecessors) of an activity that go together."""

    arcs: frozenset[tuple[str, str]]
    together_out: frozenset[tuple[str, str, str]]
    together_in: frozenset[tuple[str, str, str]]
    first: frozenset[str] = frozenset()
    last: frozenset[str] = frozenset()


def heuristics(f: Follows, arcs: Iterable[tuple[str, str]], threshold: float = 0.65) -> Heuristics:
    """Successors b, c of a go together if (b>c + c>b) / (a>b + a>c + 1) reaches the threshold;
    predecessors likewise."""
    arcs, n = frozenset(arcs), f.arcs
    out, into = set(), set()
    for a in f.activities:
        for near, far, arc in ((out, sorted(y for x, y in arcs if x == a and y != a), lambda x: (a, x)), (into, sorted(x for x, y in arcs if y == a and x != a), lambda x: (x, a))):  # noqa: B023
            near |= {(a, b, c) for b in far for c in far if b < c and (n[b, c] + n[c, b]) / (n[arc(b)] + n[arc(c)] + 1) >= threshold}
    return Heuristics(arcs, frozenset(out), frozenset(into), frozenset(f.first), frozenset(f.last))


def _cliques(nodes: list[str], pairs: set[tuple[str, str]]) -> list[frozenset[str]]:
    """Maximal sets of nodes that all go together, in order."""
    near = {x: {y for y in nodes if (min(x, y), max(x, y)) in pairs} for x in nodes}
    found: list[frozenset[str]] = []

    def grow(have: frozenset, may: set, done: set) -> None:
        if not may and not done:
            found.append(have)
        for x in sorted(may):
            grow(have | {x}, may & near[x], done & near[x])
            may, done = may - {x}, done | {x}

    if nodes:
        grow(frozenset(), set(nodes), set())
    return sorted(found, key=sorted)


def from_heuristics(nets: dict[str | None, Heuristics]) -> Graph:
    """Heuristics nets by type as one graph: at each side of an activity a choice of groups that
    go together; a neighbour in several groups counts to the last."""
    g = Graph()
    for otype, h in nets.items():
        name = lambda *x, o=otype: "|".join(str(y) for y in (o, *x))
        for a in sorted({x for arc in h.arcs for x in arc} | h.first | h.last):
            g.labels[a] = a
        for s, t in sorted(h.arcs):
            g.routers[name("arc", s, t)] = "SEQ"
        for a in sorted(g.labels):
            for side, together in (("out", h.together_out), ("in", h.together_in)):
                far = sorted((t if side == "out" else s) for s, t in h.arcs if (s if side == "out" else t) == a)
                groups = _cliques(far, {(b, c) for x, b, c in together if x == a})
                last = {x: i for i, group in enumerate(groups) for x in group}
                hub = name(side, a)
                if far:
                    g.routers[hub] = "XOR"
                    g.edges.append((a, hub, otype) if side == "out" else (hub, a, otype))
                for i, group in enumerate(groups):
                    members = [x for x in sorted(group) if last[x] == i]
                    at = hub
                    if len(members) > 1:
                        at = name(side, a, i)
                        g.routers[at] = "AND"
                        g.edges.append((hub, at, otype) if side == "out" else (at, hub, otype))
                    for x in members:
                        arc = name("arc", a, x) if side == "out" else name("arc", x, a)
                        g.edges.append((at, arc, otype) if side == "out" else (arc, at, otype))
    return g.check()
