"""From an object-centric log to models and signatures in several notations.

``tree`` and ``heuristics`` are mined per object type from tallies, ``ocpn`` joins the
nets of all types' trees on their labels, ``occn`` mines marker groups
(``objectcentric.signature``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import algebra, discovery, graphs, morphisms, outbound, splices
from ..functions.graphs import Generator
from .objectcentric import signature
from .settle import settled
from .succession import _measured, accepted, tallies

NOTATIONS = ("tree", "heuristics", "ocpn", "occn")


def _tallies(rel: DataFrame) -> DataFrame:
    return settled(tallies(rel.select("otype", F.col("oid").alias("case_id"), "activity", "ts", "eid"), "otype"))


def raw_models(rel: DataFrame) -> dict[str, dict[str, object]]:
    """notation -> type -> process tree or heuristics net.  Tallies and accepted arcs are as
    large as the alphabet."""
    tally = _tallies(rel)
    rows = tally.collect()
    arcs = accepted(_measured(tally, "otype"), "otype").collect()
    out: dict[str, dict[str, object]] = {"tree": {}, "heuristics": {}}
    for otype in sorted({r.otype for r in rows}):
        follows = discovery.Follows.of((r.kind, r.a, r.b, r.n) for r in rows if r.otype == otype)
        out["tree"][otype] = discovery.tree(follows)
        out["heuristics"][otype] = discovery.heuristics(follows, ((r.a, r.b) for r in arcs if r.otype == otype))
    return out


def signature_of(notation: str, models: dict[str, object]) -> set[Generator]:
    """The generators of one notation's models by type."""
    if notation == "heuristics":
        return graphs.extract(discovery.from_heuristics(models))
    if notation == "tree":
        return {g for otype, tree in models.items() if tree is not None for g in graphs.extract(graphs.from_tree(tree, otype))}
    if notation == "ocpn":
        nets = {otype: outbound.net(tree)[0] for otype, tree in models.items()}
        return graphs.extract(graphs.from_petri(nets), surface=True)
    raise ValueError(f"unknown notation {notation!r}")


def generators_of(sig: DataFrame) -> set[Generator]:
    """Signature rows (label, left, right) as generators; model-sized."""
    port = lambda p: tuple(p.split("|", 2))
    return {Generator(r.label, frozenset(map(port, r.left)), frozenset(map(port, r.right))) for r in sig.collect()}


def model(rel: DataFrame, notation: str) -> tuple[object, set[Generator]]:
    """(models by type, or signature rows for ``occn``; generators)."""
    if notation not in NOTATIONS:
        raise ValueError(f"unknown notation {notation!r}; there are {NOTATIONS}")
    if notation == "occn":
        rows = settled(signature(rel))
        return rows, generators_of(rows)
    raw = raw_models(rel)["heuristics" if notation == "heuristics" else "tree"]
    return raw, signature_of(notation, raw)


def signatures(rel: DataFrame, object_centric: bool = True) -> dict[str, set[Generator]]:
    """All notations' generators; an object-centric one that can't be mined is empty."""
    raw = raw_models(rel)
    out = {k: signature_of(k, raw[k]) for k in ("tree", "heuristics")}
    for notation in ("ocpn", "occn") if object_centric else ():
        try:
            out[notation] = signature_of("ocpn", raw["tree"]) if notation == "ocpn" else generators_of(signature(rel))
        except ValueError:
            out[notation] = set()
    return out


def spliced(sig: set[Generator], name: str, forget: bool = True, bound: int | None = None) -> splices.Splices:
    """The splice representation of a signature, by default without the provenance of its ports."""
    return splices.splices(morphisms.fragments(algebra.neutral(sig) if forget else sig), name, bound)
