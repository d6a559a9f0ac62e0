"""Models of orders as process trees and nets; alignments and distances to them."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Sequence

from .distances import emd
from .posets import Order, Tree, bits, decompose

Net = dict


def process_tree(model: Iterable[tuple[Order, float]]):
    """A choice over the orders' series-parallel trees (as ``graphs.from_tree`` reads them);
    an order with a prime inside is an error."""

    def tree(t: Tree):
        if t.kind == "leaf":
            return t.order.labels[0]
        if t.kind == "prime":
            raise ValueError(f"{t.canonical} is no series-parallel order")
        return ("seq" if t.kind == "series" else "and", *map(tree, t.parts))

    variants = [tree(decompose(o)) for o, _ in model]
    return variants[0] if len(variants) == 1 else ("xor", *variants)


def net(tree) -> tuple[Net, dict[str, int], dict[str, int]]:
    """(net, first marking, last marking) of a process tree."""
    out: Net = {"places": [], "transitions": {}, "arcs": []}

    def place() -> str:
        out["places"].append(f"p{len(out['places'])}")
        return out["places"][-1]

    def step(label: str | None, into: Sequence[str], onto: Sequence[str]) -> None:
        t = f"t{len(out['transitions'])}"
        out["transitions"][t] = label
        out["arcs"] += [(p, t) for p in into] + [(t, p) for p in onto]

    def build(x, a: str, b: str) -> None:
        if x is None or isinstance(x, str):
            return step(x, [a], [b])
        kind, parts = x[0], x[1:]
        if kind == "seq":
            cuts = [a, *(place() for _ in parts[1:]), b]
            for part, u, v in zip(parts, cuts, cuts[1:]):
                build(part, u, v)
        elif kind == "xor":
            for part in parts:
                build(part, a, b)
        elif kind == "and":
            ends = [(place(), place()) for _ in parts]
            step(None, [a], [u for u, _ in ends])
            step(None, [v for _, v in ends], [b])
            for part, (u, v) in zip(parts, ends):
                build(part, u, v)
        elif kind == "loop":
            u, v = place(), place()
            step(None, [a], [u])
            step(None, [v], [b])
            build(parts[0], u, v)
            for redo in parts[1:]:
                build(redo, v, u)
        else:
            raise ValueError(f"unknown operator {kind!r}")

    a, b = place(), place()
    build(tree, a, b)
    return out, {a: 1}, {b: 1}


def alignment_cost(trace: Sequence[str], order: Order) -> int:
    """Least number of steps that only the trace or only the order makes: shortest path over
    (events read, elements done)."""
    below, full = order.below, (1 << len(order)) - 1
    todo, best = [(0, 0, 0)], {(0, 0): 0}
    while todo:
        cost, i, done = heapq.heappop(todo)
        if cost > best[i, done]:
            continue
        if i == len(trace) and done == full:
            return cost
        ready = [e for e in bits(full & ~done) if not below[e] & ~done]
        moves = [(cost, i + 1, done | 1 << e) for e in ready if i < len(trace) and order.labels[e] == trace[i]]
        moves += [(cost + 1, i, done | 1 << e) for e in ready] + ([(cost + 1, i + 1, done)] if i < len(trace) else [])
        for m in moves:
            if m[0] < best.get(m[1:], 1 << 60):
                best[m[1:]] = m[0]
                heapq.heappush(todo, m)
    raise AssertionError("every order can be done")


def alignment_fitness(traces: Iterable[tuple[Sequence[str], float]], model: Iterable[tuple[Order, float]]) -> float:
    """Mean over weighted traces of 1 - cost of the best order over the worst cost there is."""
    orders = [o for o, _ in model]
    short, total, value = min(map(len, orders)), 0.0, 0.0
    for trace, w in traces:
        cost = min(alignment_cost(trace, o) for o in orders)
        worst = len(trace) + short
        value += w * (1 - cost / worst if worst else 1.0)
        total += w
    return value / total if total else 1.0


def pairwise_emd(laws: Sequence[dict]) -> list[list[float]]:
    """Symmetric matrix of earth mover's distances."""
    out = [[0.0] * len(laws) for _ in laws]
    for i, p in enumerate(laws):
        for j in range(i):
            out[i][j] = out[j][i] = emd(p, laws[j])
    return out
