"""Traces, variants, succession counts and dependency graphs, all by windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def traces(log: DataFrame, *keys: str) -> DataFrame:
    """(keys, case_id, trace)."""
    return log.groupBy(*keys, "case_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ts", "eid", "activity"))), lambda x: x["activity"]).alias("trace")
    )


def variants(log: DataFrame, *keys: str) -> DataFrame:
    """(keys, trace, n, p): distinct traces, how often, and their share: the log's language."""
    counted = traces(log, *keys).groupBy(*keys, "trace").agg(F.count(F.lit(1)).alias("n"))
    total = counted.groupBy(*keys).agg(F.sum("n").alias("_t")) if keys else counted.agg(F.sum("n").alias("_t"))
    joined = counted.join(total, list(keys)) if keys else counted.join(F.broadcast(total))
    return joined.withColumn("p", F.col("n") / F.col("_t")).drop("_t")


def successions(log: DataFrame, *keys: str) -> DataFrame:
    """Every event with its next two activities and its place in the case."""
    w = Window.partitionBy(*keys, "case_id").orderBy("ts", "eid")
    return log.withColumns({
        "next": F.lead("activity", 1).over(w), "next2": F.lead("activity", 2).over(w), "pos": F.row_number().over(w),
    })


def direct(log: DataFrame, *keys: str) -> DataFrame:
    """(keys, a, b, n): b directly follows a."""
    return successions(log, *keys).filter("next is not null").groupBy(*keys, F.col("activity").alias("a"), F.col("next").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def short_loops(log: DataFrame, *keys: str) -> DataFrame:
    """(keys, a, b, n): a b a with a != b."""
    rows = successions(log, *keys).filter("next2 = activity and next != activity")
    return rows.groupBy(*keys, F.col("activity").alias("a"), F.col("next").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def ends(log: DataFrame, *keys: str) -> DataFrame:
    """(keys, activity, starts, stops): cases that begin and end with an activity."""
    rows = successions(log, *keys)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return rows.groupBy(*keys, "activity").agg(count(F.col("pos") == 1).alias("starts"), count(F.col("next").isNull()).alias("stops"))


def dependency(ab: Column, ba: Column, same: Column) -> Column:
    """(ab - ba) / (ab + ba + 1); a loop on itself: n / (n + 1)."""
    return F.when(same, ab / (ab + 1)).otherwise((ab - ba) / (ab + ba + 1))


def tallies(log: DataFrame, *keys: str) -> DataFrame:
    """(keys, kind, a, b, n): direct successions (``next``), two-step loops (``loop``), first and
    last activities (``first``, ``last``; b is null) from one window and one aggregation."""
    rows = successions(log, *keys)
    none = F.lit(None).cast("string")
    told = lambda kind, b: F.struct(F.lit(kind).alias("kind"), F.col("activity").alias("a"), b.alias("b"))
    every = F.array_compact(F.array(
        F.when(F.col("next").isNotNull(), told("next", F.col("next"))).otherwise(told("last", none)),
        F.when((F.col("next2") == F.col("activity")) & (F.col("next") != F.col("activity")), told("loop", F.col("next"))),
        F.when(F.col("pos") == 1, told("first", none)),
    ))
    return rows.select(*keys, F.explode(every).alias("x")).groupBy(*keys, "x.kind", "x.a", "x.b").agg(F.count(F.lit(1)).alias("n"))


def dependencies(log: DataFrame, *keys: str) -> DataFrame:
    """(keys, a, b, n, dep, dep2) of the pairs that occur, with the measure of two-step loops."""
    return _measured(tallies(log, *keys), *keys)


def _measured(tally: DataFrame, *keys: str) -> DataFrame:
    """Both directions of a pair meet under its smaller label: one aggregation, no join."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    count = lambda kind, ahead: F.sum(F.when((F.col("kind") == kind) & ((F.col("a") <= F.col("b")) == ahead), F.col("n")).otherwise(0))
    pair = tally.filter(F.col("kind").isin("next", "loop")).groupBy(*keys, low.alias("x"), high.alias("y")).agg(
        count("next", True).alias("xy"), count("next", False).alias("yx"), F.sum(F.when(F.col("kind") == "loop", F.col("n")).otherwise(0)).alias("l2")
    )
    way = lambda a, b, n, back: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col(n).alias("n"), F.col(back).alias("ba"))
    both = F.when(F.col("x") == F.col("y"), F.array(way("x", "y", "xy", "xy"))).otherwise(F.array(way("x", "y", "xy", "yx"), way("y", "x", "yx", "xy")))
    rows = pair.select(*keys, "l2", F.explode(both).alias("w")).select(*keys, "w.*", "l2").filter("n > 0")
    return rows.select(
        *keys, "a", "b", "n", dependency(F.col("n"), F.col("ba"), F.col("a") == F.col("b")).alias("dep"), (F.col("l2") / (F.col("l2") + 1)).alias("dep2")
    )


def accepted(deps: DataFrame, *keys: str, threshold: float = 0.5, loop1: float = 0.5, loop2: float = 0.5, near_best: float = 0.05) -> DataFrame:
    """(keys, a, b): arcs by threshold, self loop, two-step loop, or near the best of either end."""
    other = F.when(F.col("a") != F.col("b"), F.col("dep"))
    rows = deps.withColumns({
        "out": F.max(other).over(Window.partitionBy(*keys, "a")), "in": F.max(other).over(Window.partitionBy(*keys, "b")),
    })
    best = lambda c: (F.col(c) > 0) & (F.col("dep") >= F.col(c) - near_best)
    apart = (F.col("dep") >= threshold) | (F.col("dep2") >= loop2) | best("out") | best("in")
    return rows.filter(F.when(F.col("a") == F.col("b"), F.col("dep") >= loop1).otherwise(apart)).select(*keys, "a", "b")


def dependency_graph(rel: DataFrame, *keys: str, **thresholds: float) -> DataFrame:
    """Typed arcs (keys, src, otype, tgt) of an object-centric log, with START_ and END_ nodes."""
    from .settle import settled

    log = rel.select(*keys, "otype", F.col("oid").alias("case_id"), "activity", "ts", "eid")
    tally = settled(tallies(log, *keys, "otype"))
    arcs = accepted(_measured(tally, *keys, "otype"), *keys, "otype", **thresholds).select(*keys, F.col("a").alias("src"), "otype", F.col("b").alias("tgt"))
    first = tally.filter("kind = 'first'").select(*keys, F.concat(F.lit("START_"), "otype").alias("src"), "otype", F.col("a").alias("tgt"))
    last = tally.filter("kind = 'last'").select(*keys, F.col("a").alias("src"), "otype", F.concat(F.lit("END_"), "otype").alias("tgt"))
    return arcs.unionByName(first).unionByName(last)
