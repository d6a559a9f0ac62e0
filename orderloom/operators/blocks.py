"""Block-transition matrices of weighted variants, and distances between models.

A model is rows (model_id, blocks ARRAY<STRING>, weight): one normal form a row.
Matrices are long and sparse (model_id, src, dst, p); a dense one never exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "START", "END"


def chain_models(log: DataFrame, model: Column) -> DataFrame:
    """Frequency-weighted chain variants of each cohort of cases."""
    from .succession import traces

    return traces(log.withColumn("model_id", model), "model_id").groupBy("model_id", F.col("trace").alias("blocks")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def states(blocks: Column, depth: int) -> Column:
    """START, the last at most ``depth`` blocks at each step, END."""
    inner = F.transform(blocks, lambda _, i: F.array_join(F.slice(blocks, F.greatest(i - depth + 2, F.lit(1)), F.least(i + 1, F.lit(depth))), "|"))
    return F.concat(F.array(F.lit(START)), inner, F.array(F.lit(END)))


def matrix(model: DataFrame, depth: int = 1) -> DataFrame:
    """(model_id, src, dst, p), rows normalised; END has no row."""
    path = model.select("model_id", "weight", states(F.col("blocks"), depth).alias("path"))
    steps = path.select("model_id", "weight", F.explode(F.transform(F.slice("path", 2, F.size("path")), lambda dst, i: F.struct(F.get("path", i).alias("src"), dst.alias("dst")))).alias("s"))
    raw = steps.groupBy("model_id", "s.src", "s.dst").agg(F.sum("weight").alias("w"))
    return raw.select("model_id", "src", "dst", (F.col("w") / F.sum("w").over(Window.partitionBy("model_id", "src"))).alias("p"))


def state_space(rows: DataFrame) -> DataFrame:
    """The states that any of the models has."""
    return rows.select("src").union(rows.select("dst")).distinct().toDF("state")


def closed(rows: DataFrame, space: DataFrame, mode: str = "sink") -> DataFrame:
    """Rows for every model and state of the space.  sink: END goes to START and an
    unused state to END; selfloop: a state without a row goes to itself."""
    if mode not in ("sink", "selfloop"):
        raise ValueError(f"unknown mode {mode!r}")
    models = rows.select("model_id").distinct()
    empty = models.crossJoin(F.broadcast(space)).join(rows.select("model_id", F.col("src").alias("state")).distinct(), ["model_id", "state"], "left_anti")
    goes = F.col("state") if mode == "selfloop" else F.when(F.col("state") == END, F.lit(START)).otherwise(F.lit(END))
    return rows.select("model_id", "src", "dst", "p").unionByName(empty.select("model_id", F.col("state").alias("src"), goes.alias("dst"), F.lit(1.0).alias("p")))


def row_angles(rows: DataFrame) -> DataFrame:
    """(m1, m2, src, angle) for m1 < m2 from closed rows."""
    left = rows.select(F.col("model_id").alias("m1"), "src", "dst", F.col("p").alias("p1"))
    right = rows.select(F.col("model_id").alias("m2"), "src", "dst", F.col("p").alias("p2"))
    common = left.join(right, ["src", "dst"]).filter("m1 < m2").groupBy("m1", "m2", "src").agg(F.sum(F.sqrt(F.col("p1") * F.col("p2"))).alias("bc"))
    pairs = rows.select(F.col("model_id").alias("m1"), "src").distinct().join(rows.select(F.col("model_id").alias("m2"), "src").distinct(), "src").filter("m1 < m2")
    bc = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("bc", F.lit(0.0))))
    return pairs.join(common, ["m1", "m2", "src"], "left").select("m1", "m2", "src", F.acos(bc).alias("angle"))


def matrix_distance(model: DataFrame, depth: int = 1, mode: str = "sink", normalize: bool = False, fleet: bool = True) -> DataFrame:
    """(m1, m2, d): 2 sqrt(sum of squared row angles).

    fleet: one state space of all models (needed to compare the numbers of several
    pairs); else give just two models.  normalize divides by the root of its size.
    """
    rows = matrix(model, depth)
    space = state_space(rows)
    out = row_angles(closed(rows, space, mode)).groupBy("m1", "m2").agg((2 * F.sqrt(F.sum(F.col("angle") * F.col("angle")))).alias("d"))
    if normalize:
        out = out.join(F.broadcast(space.agg(F.count(F.lit(1)).alias("_x")))).withColumn("d", F.col("d") / F.sqrt("_x")).drop("_x")
    return out


def refined_distance(model: DataFrame, normalize: bool = False, mode: str = "sink", **options) -> DataFrame:
    """(m1, m2, d) as ``matrix_distance``, with the blocks of (model_id, order, weight) fanned
    out; ``options`` are those of ``posets.refined_steps``."""
    from ..functions.poset_columns import refined_matrix

    rows = refined_matrix(model, **options)
    space = state_space(rows)
    out = row_angles(closed(rows, space, mode)).groupBy("m1", "m2").agg((2 * F.sqrt(F.sum(F.col("angle") * F.col("angle")))).alias("d"))
    size = F.broadcast(space.agg(F.count(F.lit(1)).alias("_x")))
    return out.join(size).withColumn("d", F.col("d") / F.sqrt("_x")).drop("_x") if normalize else out


def law_angle(laws: DataFrame, key: str) -> DataFrame:
    """(m1, m2, angle): 2 acos of the Bhattacharyya coefficient of laws (model_id, key, p)."""
    a = laws.select(F.col("model_id").alias("m1"), key, F.col("p").alias("p1"))
    b = laws.select(F.col("model_id").alias("m2"), key, F.col("p").alias("p2"))
    bc = a.join(b, key).filter("m1 < m2").groupBy("m1", "m2").agg(F.sum(F.sqrt(F.col("p1") * F.col("p2"))).alias("bc"))
    ids = laws.select("model_id").distinct()
    pairs = ids.toDF("m1").join(ids.toDF("m2"), F.expr("m1 < m2"))
    clamp = F.least(F.lit(1.0), F.coalesce("bc", F.lit(0.0)))
    return pairs.join(bc, ["m1", "m2"], "left").select("m1", "m2", (2 * F.acos(clamp)).alias("angle"))


def normal_form_law(model: DataFrame) -> DataFrame:
    """(model_id, form, p): weight share of each normal form."""
    raw = model.groupBy("model_id", F.array_join("blocks", ";").alias("form")).agg(F.sum("weight").alias("w"))
    return raw.select("model_id", "form", (F.col("w") / F.sum("w").over(Window.partitionBy("model_id"))).alias("p"))


def precedence(orders: DataFrame) -> DataFrame:
    """(model_id, x, y, lt, gt, par) for x < y from (model_id, labels, pairs, weight):
    weight shares of x before y, y before x, unordered."""
    labels = orders.select("model_id", F.explode("labels").alias("l")).distinct()
    pairs = labels.toDF("model_id", "x").join(labels.toDF("model_id", "y"), "model_id").filter("x < y")
    has = lambda a, b: F.exists("pairs", lambda p: (p["a"] == F.col(a)) & (p["b"] == F.col(b)))
    rows = orders.join(F.broadcast(pairs), "model_id").select("model_id", "x", "y", "weight", has("x", "y").alias("f"), has("y", "x").alias("g"))
    share = lambda c: F.sum(F.when(c, F.col("weight")).otherwise(0.0)) / F.sum("weight")
    return rows.groupBy("model_id", "x", "y").agg(
        share(F.col("f")).alias("lt"), share(F.col("g") & ~F.col("f")).alias("gt"), share(~F.col("f") & ~F.col("g")).alias("par")
    )


def order_angle(table: DataFrame) -> DataFrame:
    """(m1, m2, angle) from precedence tables over one alphabet."""
    a = table.select(F.col("model_id").alias("m1"), "x", "y", *(F.col(c).alias(f"{c}1") for c in ("lt", "gt", "par")))
    b = table.select(F.col("model_id").alias("m2"), "x", "y", *(F.col(c).alias(f"{c}2") for c in ("lt", "gt", "par")))
    bc = sum((F.sqrt(F.col(f"{c}1") * F.col(f"{c}2")) for c in ("gt", "par")), F.sqrt(F.col("lt1") * F.col("lt2")))
    ang = F.acos(F.least(F.lit(1.0), bc))
    return a.join(b, ["x", "y"]).filter("m1 < m2").groupBy("m1", "m2").agg((2 * F.sqrt(F.sum(ang * ang))).alias("angle"))


def support_uniform(rows: DataFrame) -> DataFrame:
    """Closed rows with every positive entry of a row made equal."""
    return rows.filter("p > 0").select("model_id", "src", "dst", (1 / F.count(F.lit(1)).over(Window.partitionBy("model_id", "src"))).alias("p"))


def block_angle(model: DataFrame, weighting: str = "uniform_variant", depth: int = 1) -> DataFrame:
    """(m1, m2, d) after reweighting: uniform_variant, lincount (column ``extensions``) or support."""
    if weighting == "uniform_variant":
        model = model.withColumn("weight", F.lit(1.0))
    elif weighting == "lincount":
        model = model.withColumn("weight", F.col("extensions").cast("double"))
    elif weighting != "support":
        raise ValueError(f"unknown weighting {weighting!r}")
    rows = matrix(model, depth)
    rows = closed(rows, state_space(rows))
    if weighting == "support":
        rows = support_uniform(rows)
    return row_angles(rows).groupBy("m1", "m2").agg((2 * F.sqrt(F.sum(F.col("angle") * F.col("angle")))).alias("d"))
