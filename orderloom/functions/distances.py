"""Earth mover's distance of small trace laws, and token replay on nets."""

from __future__ import annotations

from collections.abc import Sequence


def edit_distance(a: Sequence[str], b: Sequence[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def ground_cost(a: Sequence[str], b: Sequence[str]) -> float:
    """Edit distance over the longer length."""
    return edit_distance(a, b) / max(len(a), len(b), 1)


def emd(p: dict, q: dict, cost=ground_cost) -> float:
    """Least cost of moving law p to law q: shortest augmenting paths on the transport
    graph; supports are model-sized."""
    left, right = sorted(p), sorted(q)
    n, m = len(left), len(right)
    c = [[cost(a, b) for b in right] for a in left]
    supply, demand = [p[a] for a in left], [q[b] for b in right]
    flow = [[0.0] * m for _ in range(n)]
    total, tiny = 0.0, 1e-12
    while True:
        far = [0.0 if s > tiny else float("inf") for s in supply] + [float("inf")] * m
        via = [-1] * (n + m)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    if far[i] + c[i][j] < far[n + j] - tiny:
                        far[n + j], via[n + j], changed = far[i] + c[i][j], i, True
                    if flow[i][j] > tiny and far[n + j] - c[i][j] < far[i] - tiny:
                        far[i], via[i], changed = far[n + j] - c[i][j], n + j, True
        ends = [j for j in range(m) if demand[j] > tiny and far[n + j] < float("inf")]
        if not ends:
            return total
        j = min(ends, key=lambda x: far[n + x])
        path, at = [], n + j
        while via[at] >= 0:
            path.append((via[at], at))
            at = via[at]
        amount = min([supply[at], demand[j], *(flow[b][a - n] for a, b in path if a >= n)])
        for a, b in path:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        supply[at] -= amount
        demand[j] -= amount
        total += amount * far[n + j]


def replay(net: dict, trace: Sequence[str], start: dict[str, int], final: dict[str, int]) -> tuple[int, int, int, int]:
    """(produced, consumed, missing, remaining) of token replay; silent transitions
    fire where they enable the next label (breadth first over markings)."""
    pre: dict[str, list[str]] = {t: [] for t in net["transitions"]}
    post: dict[str, list[str]] = {t: [] for t in net["transitions"]}
    for s, t in net["arcs"]:
        (post[s] if s in post else pre[t]).append(t if s in post else s)
    marking = dict(start)
    produced = sum(start.values())
    consumed = missing = 0

    def on(m, t):
        return all(m.get(p, 0) >= pre[t].count(p) for p in pre[t])

    def fired(m, t):
        out = dict(m)
        for p in pre[t]:
            out[p] -= 1
        for p in post[t]:
            out[p] = out.get(p, 0) + 1
        return out

    def silently(m, goal):
        """A shortest run of silent transitions after which goal holds."""
        todo, seen = [(m, ())], {tuple(sorted(m.items()))}
        while todo:
            now, run = todo.pop(0)
            if goal(now):
                return run
            for t, label in net["transitions"].items():
                if label is None and on(now, t):
                    new = fired(now, t)
                    key = tuple(sorted(new.items()))
                    if key not in seen and len(seen) < 5000:
                        seen.add(key)
                        todo.append((new, (*run, t)))
        return None

    def step(t):
        nonlocal marking, produced, consumed
        consumed += len(pre[t])
        produced += len(post[t])
        marking = fired(marking, t)

    for label in trace:
        named = [t for t, x in net["transitions"].items() if x == label]
        if not named:
            continue
        run = silently(marking, lambda m: any(on(m, t) for t in named))
        for t in run or ():
            step(t)
        t = next((t for t in named if on(marking, t)), named[0])
        for p in set(pre[t]):
            short = pre[t].count(p) - marking.get(p, 0)
            if short > 0:
                missing += short
                marking[p] = marking.get(p, 0) + short
        step(t)
    for t in silently(marking, lambda m: all(m.get(p, 0) >= n for p, n in final.items())) or ():
        step(t)
    for p, n in final.items():
        short = max(0, n - marking.get(p, 0))
        missing += short
        consumed += n
        marking[p] = marking.get(p, 0) + short - n
    return produced, consumed, missing, sum(marking.values())


def replay_fitness(counts: Sequence[tuple[int, int, int, int, int]]) -> float:
    """Fitness of (produced, consumed, missing, remaining, how often) rows."""
    p, c, m, r = (sum(x[i] * x[4] for x in counts) for i in range(4))
    return 0.5 * (1 - m / c) + 0.5 * (1 - r / p) if p and c else 1.0
