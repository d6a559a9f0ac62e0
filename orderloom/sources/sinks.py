"""Results as files and text: tables, JSON reports, DOT graphs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.posets import Order


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: Iterable[str] = ()) -> None:
    df.write.format(fmt).mode(mode).partitionBy(*partition_by).save(path)


def as_json(df: DataFrame) -> DataFrame:
    """(json): one canonical JSON object a row, fields in name order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("json"))


def order_dot(order: Order, name: str = "order") -> str:
    """The cover relation as DOT text."""
    lines = [f'  n{i} [label="{label}"];' for i, label in enumerate(order.labels)]
    lines += [f"  n{u} -> n{v};" for u, v in sorted(order.covers())]
    return "\n".join([f"digraph {name} {{", "  rankdir=LR;", *lines, "}"])


def arcs_dot(arcs: DataFrame, name: str = "graph") -> DataFrame:
    """(dot): typed arcs (src, otype, tgt) as one DOT text; the graph is model-sized."""
    line = F.format_string('  "%s" -> "%s" [label="%s"];', "src", "tgt", "otype")
    body = F.array_join(F.array_sort(F.collect_set(line)), "\n")
    return arcs.agg(F.concat(F.lit(f"digraph {name} {{\n"), body, F.lit("\n}")).alias("dot"))


def signature_text(sig: DataFrame) -> DataFrame:
    """(line): one generator a line, in order."""
    show = lambda c: F.concat(F.lit("{"), F.array_join(c, ", "), F.lit("}"))
    return sig.select(F.concat_ws(" ", F.col("label"), show("left"), F.lit("->"), show("right")).alias("line")).orderBy("line")


def report_text(rows: DataFrame, columns: list[str]) -> str:
    """A small report as a fixed-width table."""
    data = [columns, *([str(v) for v in r] for r in rows.select(*columns).orderBy(*columns).collect())]
    width = [max(len(r[i]) for r in data) for i in range(len(columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, width, strict=True)).rstrip() for r in data)
