"""Runs of a signature: frontier states, composites, loops, bounded trace languages.

A state is the multiset of open ports and the labels of origins that fired.  An
origin (no left ports) fires at most once a label.  A generator fires where the
frontier covers its left ports.  A composite is a run whose frontier ends empty.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

from .graphs import Generator
from .posets import Order

MAX_STATES = 200_000


class TooManyStates(ValueError):
    """The state space is over its limit."""


State = tuple[tuple, frozenset]


def _key(frontier: Counter) -> tuple:
    return tuple(sorted(((p, n) for p, n in frontier.items() if n), key=str))


def enabled(frontier: Counter, g: Generator) -> bool:
    return all(frontier[p] >= g.weight(p) for p in g.left)


def fire(frontier: Counter, g: Generator) -> Counter:
    out = Counter(frontier)
    for p in g.left:
        out[p] -= g.weight(p)
    for p in g.right:
        out[p] += g.weight(p)
    return +out


def _moves(sig: list[Generator], state: State) -> Iterator[tuple[Generator, State]]:
    frontier, fired = Counter(dict(state[0])), state[1]
    for g in sig:
        if g.left and enabled(frontier, g):
            yield g, (_key(fire(frontier, g)), fired)
        elif not g.left and g.label not in fired:
            yield g, (_key(fire(frontier, g)), fired | {g.label})


def explore(signature: Iterable[Generator], limit: int = MAX_STATES) -> dict[State, list[tuple[Generator, State]]]:
    """The reachable state graph from nothing."""
    sig = sorted(signature, key=str)
    graph: dict[State, list] = {}
    todo: list[State] = [((), frozenset())]
    while todo:
        state = todo.pop()
        if state in graph:
            continue
        graph[state] = list(_moves(sig, state))
        if len(graph) > limit:
            raise TooManyStates(f"more than {limit} states")
        todo += [s for _, s in graph[state] if s not in graph]
    return graph


def components(graph: dict[State, list]) -> list[set[State]]:
    """Strongly connected components by two depth-first passes."""
    order, seen = [], set()
    for root in graph:
        stack = [(root, iter(graph[root]))] if root not in seen else []
        seen.add(root)
        while stack:
            node, nexts = stack[-1]
            for _, t in nexts:
                if t not in seen:
                    seen.add(t)
                    stack.append((t, iter(graph[t])))
                    break
            else:
                order.append(node)
                stack.pop()
    back: dict[State, list[State]] = {s: [] for s in graph}
    for s, out in graph.items():
        for _, t in out:
            back[t].append(s)
    found, seen = [], set()
    for root in reversed(order):
        if root in seen:
            continue
        part, todo = set(), [root]
        seen.add(root)
        while todo:
            s = todo.pop()
            part.add(s)
            for t in back[s]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        found.append(part)
    return found


def closing_states(graph: dict[State, list]) -> set[State]:
    """States from which an empty frontier can be reached after a first move."""
    good = {s for s in graph if not s[0] and s[1]}
    back: dict[State, list[State]] = {s: [] for s in graph}
    for s, out in graph.items():
        for _, t in out:
            back[t].append(s)
    todo = list(good)
    while todo:
        for s in back[todo.pop()]:
            if s not in good:
                good.add(s)
                todo.append(s)
    return good


def runs(signature: Iterable[Generator], max_visits: int = 1, limit: int = 20_000) -> Iterator[tuple[Generator, ...]]:
    """Runs from nothing to the empty frontier that pass a state at most ``max_visits`` times."""
    graph = explore(signature)
    good, made = closing_states(graph), 0
    stack: list[tuple[State, tuple, Counter]] = [(((), frozenset()), (), Counter())]
    while stack:
        state, run, visits = stack.pop()
        if run and not state[0]:
            made += 1
            if made > limit:
                raise TooManyStates(f"more than {limit} runs")
            yield run
        for g, t in graph[state]:
            if t in good and visits[t] < max_visits:
                stack.append((t, (*run, g), visits + Counter([t])))


def occurrence(run: Iterable[Generator]) -> Order:
    """The causal order of a run: tokens are taken first in, first out."""
    labels, edges, queue = [], [], {}
    for i, g in enumerate(run):
        labels.append(g.label)
        for p in sorted(g.left, key=str):
            for _ in range(g.weight(p)):
                edges.append((queue[p].pop(0), i))
        for p in g.right:
            queue.setdefault(p, []).extend([i] * g.weight(p))
    return Order.of(labels, edges)


def shape(order: Order, rounds: int = 4) -> str:
    """Colour-refinement name: equal for isomorphic labelled orders."""
    import hashlib

    digest = lambda x: hashlib.sha1(repr(x).encode()).hexdigest()
    cover = order.covers()
    colour = list(order.labels)
    for _ in range(rounds):
        colour = [
            digest((colour[e], sorted(colour[v] for u, v in cover if u == e), sorted(colour[u] for u, v in cover if v == e))) for e in range(len(order))
        ]
    return digest(sorted(colour))


def isomorphic(a: Order, b: Order) -> bool:
    """Backtracking over label-preserving matches, after the shapes agree."""
    if len(a) != len(b) or shape(a) != shape(b):
        return False
    n, match = len(a), []

    def extend() -> bool:
        i = len(match)
        if i == n:
            return True
        for j in range(n):
            if j not in match and a.labels[i] == b.labels[j] and all(a.less(k, i) == b.less(m, j) and a.less(i, k) == b.less(j, m) for k, m in enumerate(match)):
                match.append(j)
                if extend():
                    return True
                match.pop()
        return False

    return extend()


def composites(signature: Iterable[Generator], max_visits: int = 1, limit: int = 20_000) -> list[Order]:
    """Distinct causal orders of the runs, up to isomorphism."""
    found: dict[str, list[Order]] = {}
    for run in runs(signature, max_visits, limit):
        order = occurrence(run)
        held = found.setdefault(shape(order), [])
        if not any(isomorphic(order, x) for x in held):
            held.append(order)
    return [x for k in sorted(found) for x in found[k]]


def loops(signature: Iterable[Generator]) -> list[set[str]]:
    """Labels of the cyclic components of the state graph."""
    graph = explore(signature)
    out = []
    for part in components(graph):
        labels = {g.label for s in part for g, t in graph[s] if t in part}
        if labels:
            out.append(labels)
    return sorted(out, key=sorted)


def language(signature: Iterable[Generator], max_visits: int = 1, limit: int = 20_000) -> set[tuple[str, ...]]:
    """Label words of all linear extensions of the composites."""
    from .posets import words

    return {w for order in composites(signature, max_visits, limit) for w in words(order)}


def history_keys(order: Order) -> list[str]:
    """Per element a digest of its label and the keys of what it covers: equal causal histories agree."""
    import hashlib

    out: dict[int, str] = {}
    into: dict[int, list[int]] = {}
    for u, v in order.covers():
        into.setdefault(v, []).append(u)
    for e in sorted(range(len(order)), key=lambda x: order.below[x].bit_count()):
        out[e] = hashlib.sha1(repr((order.labels[e], sorted(out[u] for u in into.get(e, ())))).encode()).hexdigest()
    return [out[e] for e in range(len(order))]
