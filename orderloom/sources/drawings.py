"""Drawings as text: DOT graphs, SVG heat maps and string diagrams.  All inputs are
model-sized; tables that are not must be cut by the caller, too large ones are refused."""

from __future__ import annotations

import shutil
from collections import defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from html import escape

from ..functions import splices as S
from ..functions.event_graphs import SINK, SOURCE, EventGraph
from ..functions.graphs import Generator
from ..functions.morphisms import Catalogue
from ..functions.posets import Order

PALETTE = ("#2a6f97", "#c8553d", "#588157", "#8e6c8a", "#b08900", "#3d5a80", "#9c6644", "#6d6875")
MAX_ROWS = 1000


def has_dot() -> bool:
    """Graphviz is there to draw what these functions write."""
    return shutil.which("dot") is not None


def colours(names: Iterable[str]) -> dict[str, str]:
    return {n: PALETTE[i % len(PALETTE)] for i, n in enumerate(sorted(set(names)))}


def _quoted(x) -> str:
    return '"' + str(x).replace("\\", "\\\\").replace('"', '\\"') + '"'


def _node(name: str, label: str, **style: str) -> str:
    return f"  {name} [" + ", ".join([f"label={_quoted(label)}", *(f"{k}={_quoted(v)}" for k, v in style.items())]) + "];"


def _digraph(name: str, lines: Iterable[str], title: str = "", direction: str = "LR") -> str:
    head = [f"digraph {_quoted(name)} {{", f"  rankdir={direction};"] + ([f"  label={_quoted(title)};"] if title else [])
    return "\n".join([*head, *lines, "}"])


def _events(graph: EventGraph, prefix: str, **style: str) -> list[str]:
    name = lambda n: f"{prefix}in" if n == SOURCE else f"{prefix}out" if n == SINK else f"{prefix}{n}"
    ends = sorted({n for a in graph.arcs for n in a[:2] if n < 0})
    lines = [_node(name(n), "", shape="point") for n in ends] + [_node(name(i), x, **style) for i, x in enumerate(graph.labels)]
    return lines + [f"  {name(u)} -> {name(v)} [label={_quoted(t)}];" for u, v, t in graph.arcs]


def overlay(catalogues: dict[str, Catalogue], loops: bool = False) -> str:
    """The event graphs of several catalogues' closings (or loops), equal ones once, coloured by
    the models that have them."""
    classes: list[tuple[EventGraph, set[str]]] = []
    held: dict[str, int] = {}
    for model, c in catalogues.items():
        for x in c.loops() if loops else c.closings():
            graph = c.graph(x)
            i = held.setdefault(graph.key(), len(classes))
            if i == len(classes):
                classes.append((graph, set()))
            classes[i][1].add(model)
    colour = colours("+".join(sorted(m)) for _, m in classes)
    lines = []
    for i, (graph, models) in enumerate(classes):
        name = "+".join(sorted(models))
        lines += [f"  subgraph cluster_{i} {{", f"  label={_quoted(name)};", *_events(graph, f"c{i}_", color=colour[name]), "  }"]
    return _digraph("overlay", lines, direction="TB")


def merged_overlay(catalogues: dict[str, Catalogue]) -> str:
    """All closings in one graph: events with equal causal pasts fall together."""
    models, label, arcs = defaultdict(set), {}, set()
    for model, c in catalogues.items():
        for x in c.closings():
            graph = c.graph(x)
            names = graph.histories()
            for i, n in enumerate(names):
                models[n].add(model)
                label[n] = graph.labels[i]
            arcs |= {(names[u], names[v], t) for u, v, t in graph.arcs if u >= 0 and v >= 0}
    colour = colours("+".join(sorted(m)) for m in models.values())
    lines = [_node(f"e{n}", label[n], color=colour["+".join(sorted(models[n]))]) for n in sorted(models)]
    return _digraph("merged", [*lines, *(f"  e{u} -> e{v} [label={_quoted(t)}];" for u, v, t in sorted(arcs))], direction="TB")


def splice_catalogue(rep: S.Splices, title: str = "") -> str:
    """Families as chains of steps, loops beside them, dashed arcs where they splice in."""
    lines = []
    for f in rep.families:
        names = [f"{f.spine_id}_{i}" for i in range(len(f.term) + 1)]
        lines += [_node(_quoted(n), S.text((s,))) for n, s in zip(names[1:], f.term)] + [_node(_quoted(names[0]), f.spine_id, shape="plaintext")]
        lines += [f"  {_quoted(a)} -> {_quoted(b)};" for a, b in zip(names, names[1:])]
        lines += [f"  {_quoted(names[min(at, len(f.term))])} -> {_quoted(i)} [style=dashed, dir=both];" for at, ids in f.splices for i in ids]
    lines += [_node(_quoted(x.loop_id), f"{x.loop_id} ({x.cycle}): {S.text(x.term)}", shape="box", style="rounded") for x in rep.loops]
    return _digraph(rep.name, lines, title or rep.name)


def loop_gallery(rep: S.Splices, title: str = "") -> str:
    lines = []
    for i, x in enumerate(rep.loops):
        lines += [f"  subgraph cluster_{i} {{", f"  label={_quoted(f'{x.loop_id} {x.cycle}')};"]
        lines += _events(EventGraph(tuple(name for _, name in x.events), x.arcs), f"l{i}_") + ["  }"]
    return _digraph("loops", lines, title)


def catalogue_graphs(c: Catalogue, title: str = "") -> str:
    lines = []
    for i, x in enumerate(c.fragments.values()):
        lines += [f"  subgraph cluster_{i} {{", f"  label={_quoted(x.name)};", *_events(c.graph(x), f"f{i}_"), "  }"]
    return _digraph("catalogue", lines, title)


def markers_dot(groups: dict[str, tuple[list, list]], title: str = "") -> str:
    """Marker groups {activity: (groups in, groups out)} of (other, type, least, greatest): one
    dot a group, arcs by type and count."""
    types = colours(m[1] for sides in groups.values() for side in sides for g in side for m in g)
    lines = [_node(_quoted(a), a, shape="box") for a in sorted(groups)]
    for a, sides in sorted(groups.items()):
        for side, some in zip("io", sides):
            for k, markers in enumerate(some):
                dot = _quoted(f"{a}/{side}{k}")
                lines += [_node(dot, "", shape="point"), f"  {dot} -> {_quoted(a)};" if side == "i" else f"  {_quoted(a)} -> {dot};"]
                for other, typ, low, high in markers:
                    ends = (_quoted(other), dot) if side == "i" else (dot, _quoted(other))
                    lines.append(f"  {ends[0]} -> {ends[1]} [color={_quoted(types[typ])}, label={_quoted(f'{typ} {low}..{high if high is not None else chr(42)}')}];")
    return _digraph("markers", lines, title)


def nets_dot(nets: dict[str | None, dict], title: str = "") -> str:
    """Typed nets (as ``graphs.from_petri`` takes them) as one graph, coloured by type."""
    types, lines = colours(map(str, nets)), []
    for otype, net in nets.items():
        name = lambda x, o=otype, n=net: _quoted(n["transitions"].get(x) or f"{o}.{x}")
        colour = types[str(otype)]
        lines += [_node(name(p), "", shape="circle", color=colour) for p in net["places"]]
        lines += [_node(name(t), label or "", shape="box", **({} if label else {"style": "filled", "fillcolor": "black"})) for t, label in net["transitions"].items()]
        lines += [f"  {name(s)} -> {name(t)} [color={_quoted(colour)}];" for s, t in net["arcs"]]
    return _digraph("nets", list(dict.fromkeys(lines)), title)


# --- SVG -----------------------------------------------------------------------------------

def _svg(width: float, height: float, parts: Iterable[str]) -> str:
    return "\n".join([f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:g}" height="{height:g}" font-family="sans-serif" font-size="11">', *parts, "</svg>"])


def _text(x: float, y: float, s, anchor: str = "start") -> str:
    return f'<text x="{x:g}" y="{y:g}" text-anchor="{anchor}">{escape(str(s))}</text>'


def heat_map(rows: Sequence[str], columns: Sequence[str], values: dict[tuple[str, str], float], title: str = "", cell: int = 22) -> str:
    """Values between 0 and their largest as shades; missing ones stay white."""
    top = max([*values.values(), 1e-12])
    left = 8 + 7 * max([len(str(r)) for r in rows], default=0)
    parts = [_text(left, 14, title)] if title else []
    for i, r in enumerate(rows):
        parts.append(_text(left - 4, 40 + cell * i + cell / 2, r, "end"))
        for j, c in enumerate(columns):
            v = values.get((r, c))
            if v is not None:
                shade = round(255 - 200 * v / top)
                parts.append(f'<rect x="{left + cell * j}" y="{26 + cell * i}" width="{cell}" height="{cell}" fill="rgb({shade},{shade},255)"><title>{escape(f"{r}, {c}: {v:.4g}")}</title></rect>')
    parts += [_text(left + cell * j + cell / 2, 40 + cell * len(rows), c, "middle") for j, c in enumerate(columns)]
    return _svg(left + cell * len(columns) + 8, 50 + cell * len(rows), parts)


def matrix_map(rows: Iterable[tuple[str, str, float]], title: str = "") -> str:
    """A block matrix (src, dst, p)."""
    values = {(a, b): p for a, b, p in rows}
    states = sorted({x for k in values for x in k}, key=lambda x: (x == "END", x != "START", x))
    return heat_map(states, states, values, title)


def distance_map(pairs: Iterable[tuple[str, str, float]], group: dict[str, str], title: str = "") -> str:
    """Pairwise distances, models in the order of their groups."""
    values = {}
    for a, b, d in pairs:
        values[a, b] = values[b, a] = d
    names = sorted({x for k in values for x in k}, key=lambda x: (group.get(x, ""), x))
    return heat_map(names, names, values | {(n, n): 0.0 for n in names}, title)


STATUS = {"ref": "#d9d9d9", "match": "#a6d5a0", "diff": "#f2c879", "novel": "#e58f86", "absent": "#ffffff"}


def status_map(rows: Sequence[tuple], columns: Sequence[str], title: str = "", limit: int = MAX_ROWS) -> str:
    """A comparison (name, status, status, ...) as coloured cells; more than ``limit`` rows are refused."""
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    left, parts = 8 + 7 * max([len(str(r[0])) for r in rows], default=0), [_text(8, 14, title)] if title else []
    for i, (name, *told) in enumerate(rows):
        parts.append(_text(left - 4, 42 + 18 * i, name, "end"))
        parts += [f'<rect x="{left + 60 * j}" y="{30 + 18 * i}" width="58" height="16" fill="{STATUS[s]}" stroke="#999"><title>{escape(s)}</title></rect>' for j, s in enumerate(told)]
    parts += [_text(left + 60 * j + 29, 26, c, "middle") for j, c in enumerate(columns)]
    return _svg(left + 60 * len(columns) + 8, 40 + 18 * len(rows), parts)


def order_generators(model: Iterable[tuple[Order, float]], first: str = "g1", last: str = "g2") -> set[Generator]:
    """The generators of a model's orders: each element with what it covers and what covers it."""
    out = set()
    for order, _ in model:
        into, onto = defaultdict(set), defaultdict(set)
        for u, v in order.covers():
            into[v].add(order.labels[u])
            onto[u].add(order.labels[v])
        for e, x in enumerate(order.labels):
            out.add(Generator(x, frozenset((y, None, x) for y in into[e] or {first}), frozenset((x, None, y) for y in onto[e] or {last})))
    return out


# --- terms -----------------------------------------------------------------------------------

@dataclass(frozen=True)
class Term:
    """Columns of generators: ``a >> b`` one after the other, ``a @ b`` side by side."""

    columns: tuple[tuple[Generator, ...], ...]

    def __rshift__(self, other: Term) -> Term:
        return Term(self.columns + other.columns)

    def __matmul__(self, other: Term) -> Term:
        n = max(len(self.columns), len(other.columns))
        pad = lambda t: t.columns + ((),) * (n - len(t.columns))
        return Term(tuple(a + b for a, b in zip(pad(self), pad(other))))


def listed(sig: Iterable[Generator]) -> dict[str, list[Generator]]:
    out = defaultdict(list)
    for g in sorted(sig, key=lambda g: (g.label, sorted(map(str, g.left)), sorted(map(str, g.right)))):
        out[g.label].append(g)
    return dict(out)


def pick(sig: Iterable[Generator], label: str, i: int | None = None) -> Generator:
    """The i-th generator of a label; without i there must be one only."""
    found = listed(sig).get(label, [])
    if not found or (i is None and len(found) > 1):
        raise ValueError(f"{len(found)} generators of {label!r}")
    return found[i or 0]


def box(sig: Iterable[Generator], label: str, i: int | None = None) -> Term:
    return Term(((pick(sig, label, i),),))


def string_diagram(term: Term | Iterable[Generator], title: str = "", columns: int = 4, limit: int = 24) -> str:
    """A term with wires between equal ports of neighbouring columns; a signature as a grid of
    its first ``limit`` generators."""
    grid = term.columns if isinstance(term, Term) else tuple(_rows(sorted(term, key=str)[:limit], columns))
    types = colours(str(p[1]) for col in grid for g in col for p in (*g.left, *g.right))
    parts, open_ends = [_text(8, 14, title)] if title else [], []
    for i, col in enumerate(grid):
        ends = []
        for j, g in enumerate(col):
            x, y = 60 + 150 * i, 30 + 70 * j
            parts += [f'<rect x="{x}" y="{y}" width="70" height="40" rx="5" fill="white" stroke="black"/>', _text(x + 35, y + 24, g.label, "middle")]
            for side, legs in ((0, sorted(g.left, key=str)), (1, sorted(g.right, key=str))):
                for k, p in enumerate(legs):
                    py, px = y + 40 * (k + 1) / (len(legs) + 1), x + 70 * side
                    mate = next((e for e in open_ends if e[0] == p), None) if not side else None
                    if mate:
                        open_ends.remove(mate)
                    a, b = (mate[1:] if mate else (px - 30, py)), (px, py)
                    if side:
                        a, b = (px, py), (px + 30, py)
                        ends.append((p, px, py))
                    parts.append(f'<line x1="{a[0]:g}" y1="{a[1]:g}" x2="{b[0]:g}" y2="{b[1]:g}" stroke="{types[str(p[1])]}"><title>{escape(" ".join(map(str, p)))}</title></line>')
        open_ends += ends
    return _svg(80 + 150 * len(grid), 50 + 70 * max([len(c) for c in grid], default=0), parts)


def _rows(items: Sequence, n: int) -> Iterable[tuple]:
    return (tuple(items[i::n]) for i in range(min(n, len(items))))
