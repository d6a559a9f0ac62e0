"""Signatures as tables: keys, set algebra, quotients, type balance, comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NONE = "array<string>"


def port_types(ports: Column) -> Column:
    return F.transform(ports, lambda p: F.split_part(p, F.lit("|"), F.lit(2)))


def type_counts(ports: Column) -> Column:
    """Sorted ``type x count`` of a side."""
    types = port_types(ports)
    return F.transform(F.array_sort(F.array_distinct(types)), lambda t: F.concat(t, F.lit("x"), F.size(F.filter(types, lambda u: u == t)).cast("string")))


def is_boundary(label: Column) -> Column:
    """gamma1, gamma2, START_... or END_..."""
    return label.rlike("^(gamma[12]$|START_|END_)")


def canonical_keys(sig: DataFrame) -> DataFrame:
    """(label, ins, outs, n): generators that agree in label and typed arity."""
    return sig.groupBy("label", type_counts(F.col("left")).alias("ins"), type_counts(F.col("right")).alias("outs")).agg(F.count(F.lit(1)).alias("n"))


def marginal_facts(sig: DataFrame) -> DataFrame:
    """(label, side, typ, arities): achievable leg counts of each type on each side,
    0 among them where a context lacks the type; an always empty side is (null, [0])."""
    keys = sig.select("label", port_types(F.col("left")).alias("in"), port_types(F.col("right")).alias("out")).distinct()
    sides = keys.select("label", F.explode(F.array(
        F.struct(F.lit("in").alias("side"), F.col("in").alias("types")), F.struct(F.lit("out").alias("side"), F.col("out").alias("types"))
    )).alias("s")).select("label", "s.side", "s.types").distinct()
    domain = sides.groupBy("label", "side").agg(F.array_distinct(F.flatten(F.collect_set("types"))).alias("domain"))
    rows = sides.join(domain, ["label", "side"]).select("label", "side", "types", F.explode_outer("domain").alias("typ"))
    count = F.when(F.col("typ").isNull(), 0).otherwise(F.size(F.filter("types", lambda t: t == F.col("typ"))))
    return rows.groupBy("label", "side", "typ").agg(F.array_sort(F.collect_set(count)).alias("arities"))


def difference(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Generators only in a, only in b."""
    return a.select("label", "left", "right").subtract(b.select("label", "left", "right")), b.select("label", "left", "right").subtract(a.select("label", "left", "right"))


def jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """(common, total, jaccard); two empty signatures agree."""
    tag = lambda df, i: df.select("label", "left", "right").distinct().withColumn("side", F.lit(i))
    rows = tag(a, 1).unionByName(tag(b, 2)).groupBy("label", "left", "right").agg(F.count(F.lit(1)).alias("n"))
    return rows.agg(F.coalesce(F.sum((F.col("n") == 2).cast("bigint")), F.lit(0)).alias("common"), F.count(F.lit(1)).alias("total")).withColumn(
        "jaccard", F.when(F.col("total") == 0, 1.0).otherwise(F.col("common") / F.greatest("total", F.lit(1)))
    )


def drop_boundary(sig: DataFrame, boundary=is_boundary) -> DataFrame:
    """Without boundary labels and without ports to them."""
    keep = lambda ports: F.filter(ports, lambda p: ~boundary(F.split_part(p, F.lit("|"), F.lit(1))) & ~boundary(F.split_part(p, F.lit("|"), F.lit(3))))
    return sig.filter(~boundary(F.col("label"))).select("label", keep("left").alias("left"), keep("right").alias("right")).distinct()


def forget_provenance(sig: DataFrame) -> DataFrame:
    """Input ports keep type and label only; generators that become equal merge."""
    star = lambda ports: F.array_sort(F.array_distinct(F.transform(ports, lambda p: F.concat(F.lit("*|"), F.split_part(p, F.lit("|"), F.lit(2)), F.lit("|"), F.split_part(p, F.lit("|"), F.lit(3))))))
    return sig.select("label", star("left").alias("left"), star("right").alias("right")).distinct()


def close_termini(sig: DataFrame, label: str = "gamma2") -> DataFrame:
    """Adds a drain for every leg to the terminus that no generator consumes."""
    made = sig.select(F.explode("right").alias("p")).filter(F.split_part("p", F.lit("|"), F.lit(3)) == label).distinct()
    used = sig.select(F.explode("left").alias("p")).distinct()
    drains = made.join(used, "p", "left_anti").select(F.lit(label).alias("label"), F.array("p").alias("left"), F.array().cast(_NONE).alias("right"))
    return sig.select("label", "left", "right").unionByName(drains).distinct()


def violations(sig: DataFrame, kappa: DataFrame) -> DataFrame:
    """(label, left, right, created, consumed): contexts whose types appear or vanish
    without a licence; labels without one are unconstrained."""
    rows = sig.join(F.broadcast(kappa), "label").select(
        "label", "left", "right", "creates", "consumes", F.array_distinct(port_types(F.col("left"))).alias("l"), F.array_distinct(port_types(F.col("right"))).alias("r")
    )
    rows = rows.select("label", "left", "right", F.array_sort(F.array_except(F.array_except("r", "l"), "creates")).alias("created"), F.array_sort(F.array_except(F.array_except("l", "r"), "consumes")).alias("consumed"))
    return rows.filter((F.size("created") > 0) | (F.size("consumed") > 0))


def compare(named: dict[str, DataFrame], keys: list[str], payload: str, reference: str | None = None) -> DataFrame:
    """Full alignment of several tables on ``keys``: one status column a name (ref,
    match, diff, absent, novel) against the reference, and a verdict a row."""
    names = list(named)
    reference = reference or ("master" if "master" in named else names[0])
    order = [reference, *(n for n in names if n != reference)]
    tables = [named[n].select(*keys, F.col(payload).alias(f"_{n}")) for n in order]
    same = lambda a, b: reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in keys))
    rows = tables[0]
    for t in tables[1:]:
        both = rows.alias("x").join(t.alias("y"), reduce(lambda p, q: p & q, (F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys)), "full")
        rest = [c for c in rows.columns if c not in keys] + [c for c in t.columns if c not in keys]
        rows = both.select(*(F.coalesce(f"x.{k}", f"y.{k}").alias(k) for k in keys), *rest)
    ref = F.col(f"_{reference}")

    def status(n: str) -> Column:
        own = F.col(f"_{n}")
        if n == reference:
            return F.when(own.isNotNull(), "ref").otherwise("absent")
        return F.when(own.isNull(), "absent").when(ref.isNull(), "novel").when(own == ref, "match").otherwise("diff")

    every = F.array(*(status(n) for n in order))
    verdict = F.when(F.array_contains(every, "diff"), "param-diff").when(F.exists(every, lambda s: s.isin("absent", "novel")), "partial").otherwise("match")
    return rows.select(*keys, *(status(n).alias(f"status_{n}") for n in order), verdict.alias("verdict"))


def per_name(compared: DataFrame, reference: str) -> DataFrame:
    """(name, status, n): each table's cells against the reference; rows that neither
    has are left out."""
    names = [c.removeprefix("status_") for c in compared.columns if c.startswith("status_") and c != f"status_{reference}"]
    cells = compared.select(F.col(f"status_{reference}").alias("ref"), F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"status_{n}").alias("status")) for n in names))).alias("c"))
    return cells.select("ref", "c.*").filter((F.col("status") != "absent") | (F.col("ref") == "ref")).groupBy("name", "status").agg(F.count(F.lit(1)).alias("n"))


def degenerate_filtered(sig: DataFrame) -> DataFrame:
    """Without generators that go straight back where they came from, for labels all of
    whose generators have one leg on each side."""
    from pyspark.sql import Window

    w = Window.partitionBy("label")
    rows = sig.withColumn("_wide", F.max(F.greatest(F.size("left"), F.size("right"))).over(w)).withColumn("_thin", F.min(F.least(F.size("left"), F.size("right"))).over(w))
    part = lambda c, i: F.split_part(F.get(c, F.lit(0)), F.lit("|"), F.lit(i))
    bounce = (F.col("_wide") == 1) & (F.col("_thin") == 1) & (part("left", 1) == part("right", 3))
    return rows.filter(~bounce).drop("_wide", "_thin")
