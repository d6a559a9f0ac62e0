"""Object-centric discovery: licences, causal neighbours, marker groups, generators.

A signature is rows (label, left, right); ports are strings ``src|type|tgt`` in
sorted arrays, so set semantics are ``distinct`` and array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def licences(rel: DataFrame) -> DataFrame:
    """(label, creates, consumes): types whose objects begin or end at an activity."""
    bounds = rel.groupBy("oid").agg(
        F.min_by(F.struct("activity", "otype"), F.struct("ts", "eid")).alias("f"), F.max_by(F.struct("activity", "otype"), F.struct("ts", "eid")).alias("l")
    )
    # an object's first row fixes its type
    side = bounds.select(F.explode(F.array(
        F.struct(F.col("f.activity").alias("label"), F.col("f.otype").alias("c"), F.lit(None).cast("string").alias("d")),
        F.struct(F.col("l.activity").alias("label"), F.lit(None).cast("string").alias("c"), F.col("f.otype").alias("d")),
    )).alias("x")).select("x.*")
    found = side.groupBy("label").agg(F.array_sort(F.collect_set("c")).alias("creates"), F.array_sort(F.collect_set("d")).alias("consumes"))
    none = F.array().cast("array<string>")
    return rel.select(F.col("activity").alias("label")).distinct().join(found, "label", "left").select(
        "label", F.coalesce("creates", none).alias("creates"), F.coalesce("consumes", none).alias("consumes")
    )


def neighbours(rel: DataFrame, arcs: DataFrame, side: str, *keys: str) -> DataFrame:
    """(keys, eid, activity, other, otype, oid): per event and object the nearest earlier
    (``in``) or later (``out``) event whose activity has an arc with this one, else the
    type's START_ or END_ node if it has; else no row.

    An as-of join as a window: each event offers itself to every activity an arc links
    it to, and the last offer before an event of that activity is its neighbour.
    """
    own, far = ("tgt", "src") if side == "in" else ("src", "tgt")
    log = rel.select(*keys, "eid", "activity", "ts", "oid", "otype")
    links = F.broadcast(arcs.select(*keys, "otype", F.col(far).alias("activity"), F.col(own).alias("seeks")))
    offers = log.join(links, [*keys, "otype", "activity"]).select(*keys, "oid", "otype", "ts", "eid", "seeks", F.col("activity").alias("other"), F.lit(1).alias("offer"))
    asks = log.select(*keys, "oid", "otype", "ts", "eid", F.col("activity").alias("seeks"), F.lit(None).cast("string").alias("other"), F.lit(0).alias("offer"))
    order = ["ts", "eid"] if side == "in" else [F.desc("ts"), F.desc("eid")]
    w = Window.partitionBy(*keys, "oid", "otype", "seeks").orderBy(*order, "offer").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = offers.unionByName(asks).withColumn("other", F.last("other", ignorenulls=True).over(w)).filter("offer = 0")
    node = F.concat(F.lit("START_" if side == "in" else "END_"), F.col("otype"))
    bounds = arcs.filter(F.col(far) == node).select(*keys, F.col(own).alias("seeks"), "otype", F.col(far).alias("bound"))
    return found.join(F.broadcast(bounds), [*keys, "seeks", "otype"], "left").select(
        *keys, "eid", F.col("seeks").alias("activity"), F.coalesce("other", "bound").alias("other"), "otype", "oid"
    ).filter("other is not null")


def marker_groups(near: DataFrame, *keys: str) -> DataFrame:
    """(keys, activity, structure, n, cards): per activity the distinct sets of (other, type)
    of its events, how often each occurs, and each marker's least and greatest count.

    Markers of one type share a key (its objects are dealt between them), so the
    structure is the sorted set of ``type:other`` and needs no key numbers.
    """
    marker = near.groupBy(*keys, "eid", "activity", "other", "otype").agg(F.count_distinct("oid").alias("c"))
    event = marker.groupBy(*keys, "eid", "activity").agg(F.array_sort(F.collect_list(F.struct(F.concat_ws(":", "otype", "other").alias("m"), "c"))).alias("x"))
    # events of one kind are one row before the structures are taken apart
    event = event.groupBy(*keys, "activity", "x").agg(F.count(F.lit(1)).alias("one"))
    event = event.select(*keys, "activity", F.transform("x", lambda e: e["m"]).alias("structure"), F.explode("x").alias("x"), "one")
    card = event.groupBy(*keys, "activity", "structure", "x.m").agg(F.min("x.c").alias("lo"), F.max("x.c").alias("hi"), F.sum("one").alias("n"))
    return card.groupBy(*keys, "activity", "structure").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("m", "lo", "hi"))).alias("cards"))


def _types(structure: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(structure, lambda m: F.substring_index(m, ":", 1))))


def _balanced(into: DataFrame, out: DataFrame, *keys: str) -> DataFrame:
    """Input and output groups of an activity with the same types, the types being part of the
    join's key; groups of an activity that has none on the other side stay alone."""
    at = [*keys, "activity"]
    into, out = into.withColumn("types", _types(F.col("i"))), out.withColumn("types", _types(F.col("o")))
    pairs = into.join(out, [*at, "types"])
    alone = [a.join(b.select(*at).distinct(), at, "left_anti") for a, b in ((into, out), (out, into))]
    return pairs.unionByName(alone[0], allowMissingColumns=True).unionByName(alone[1], allowMissingColumns=True).drop("types")


def generators(into: DataFrame, out: DataFrame, arcs: DataFrame, *keys: str) -> DataFrame:
    """(keys, label, left, right): type-balanced pairs of input and output groups, and a
    generator for every START_ and END_ arc."""
    none = F.array().cast("array<string>")
    both = _balanced(into.select(*keys, "activity", F.col("structure").alias("i")), out.select(*keys, "activity", F.col("structure").alias("o")), *keys)
    part = lambda m, k: F.substring_index(m, ":", 1) if k == 0 else F.substring_index(m, ":", -1)
    port = lambda src, typ, tgt: F.concat_ws("|", src, typ, tgt)
    inner = both.select(
        *keys, F.col("activity").alias("label"),
        F.array_sort(F.transform(F.coalesce("i", none), lambda m: port(part(m, 1), part(m, 0), F.col("activity")))).alias("left"),
        F.array_sort(F.transform(F.coalesce("o", none), lambda m: port(F.col("activity"), part(m, 0), part(m, 1)))).alias("right"),
    )
    arc = F.array(port(F.col("src"), F.col("otype"), F.col("tgt")))
    first = arcs.filter(F.col("src") == F.concat(F.lit("START_"), "otype")).select(*keys, F.col("src").alias("label"), none.alias("left"), arc.alias("right"))
    last = arcs.filter(F.col("tgt") == F.concat(F.lit("END_"), "otype")).select(*keys, F.col("tgt").alias("label"), arc.alias("left"), none.alias("right"))
    return inner.unionByName(first).unionByName(last).distinct()


def signature(rel: DataFrame, *keys: str, **thresholds: float) -> DataFrame:
    """Mined generators of an object-centric log, or of several that ``keys`` tell apart."""
    from .settle import settled
    from .succession import dependency_graph

    arcs = settled(dependency_graph(rel, *keys, **thresholds))
    sides = [marker_groups(neighbours(rel, arcs, side, *keys), *keys) for side in ("in", "out")]
    return generators(*map(settled, sides), arcs, *keys)


def bound_generators(into: DataFrame, out: DataFrame) -> DataFrame:
    """(label, left, right, constraints): interior generators with what their markers
    say of object counts, as text: ``port>=lo`` and ``port<=hi`` for every leg, and for a
    type dealt over several output legs ``their sum==the sum of its input legs``."""
    none = F.array().cast(_card_type())
    a = into.select("activity", F.col("structure").alias("i"), F.col("cards").cast(_card_type()).alias("ci"))
    b = out.select("activity", F.col("structure").alias("o"), F.col("cards").cast(_card_type()).alias("co"))
    both = _balanced(a, b).select("activity", F.coalesce("ci", none).alias("ci"), F.coalesce("co", none).alias("co"))
    typ, other = (lambda m: F.substring_index(m, ":", 1)), (lambda m: F.substring_index(m, ":", -1))
    inp = lambda m: F.concat_ws("|", other(m), typ(m), F.col("activity"))
    outp = lambda m: F.concat_ws("|", F.col("activity"), typ(m), other(m))
    box = lambda cards, port: F.flatten(F.transform(cards, lambda c: F.array(F.concat(port(c["m"]), F.lit(">="), c["lo"].cast("string")), F.concat(port(c["m"]), F.lit("<="), c["hi"].cast("string")))))
    legs = lambda cards, port, t: F.array_sort(F.transform(F.filter(cards, lambda c: typ(c["m"]) == t), lambda c: port(c["m"])))
    dealt = F.transform(
        F.filter(_types(F.transform("co", lambda c: c["m"])), lambda t: (F.size(legs(F.col("co"), outp, t)) > 1) & (F.size(legs(F.col("ci"), inp, t)) > 0)),
        lambda t: F.concat(F.array_join(legs(F.col("co"), outp, t), "+"), F.lit("=="), F.array_join(legs(F.col("ci"), inp, t), "+")),
    )
    return both.select(
        F.col("activity").alias("label"), F.array_sort(F.transform("ci", lambda c: inp(c["m"]))).alias("left"), F.array_sort(F.transform("co", lambda c: outp(c["m"]))).alias("right"),
        F.array_sort(F.concat(box(F.col("ci"), inp), box(F.col("co"), outp), dealt)).alias("constraints"),
    ).distinct()


def _card_type() -> str:
    return "array<struct<m:string,lo:bigint,hi:bigint>>"
