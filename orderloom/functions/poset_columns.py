"""Spark columns over orders: struct<labels: array<string>, less: array<struct<u, v>>>.

Each is an Arrow-batched function; call it on distinct orders and join back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import posets

ORDER = "struct<labels:array<string>,less:array<struct<u:int,v:int>>>"


def _read(x) -> posets.Order:
    return posets.Order.of(x["labels"], [(p["u"], p["v"]) for p in x["less"]])


def column(f, kind: str):
    """A column function from a function of an Order, built when first used in a session."""

    def apply(order) -> Column:
        return F.udf(lambda x: None if x is None else f(_read(x)), kind, useArrow=True)(order)

    return apply


tiling = column(posets.tiling, "string")
blocks = column(lambda o: posets.decompose(o).blocks, "array<string>")
extensions = column(posets.extensions, "bigint")
describe = column(posets.describe, "string")
series_parallel = column(posets.series_parallel, "string")
words = column(lambda o: [list(w) for w in posets.words(o)], "array<array<string>>")
prime_free = column(lambda o: posets.series_parallel(o) is not None, "boolean")


def from_mask(order: Column, alphabet) -> Column:
    """The struct of a relation mask (functions.relations)."""
    from . import relations as R

    less = F.array_compact(F.array(*(F.when(R.holds(order, b), F.struct(F.lit(i).alias("u"), F.lit(j).alias("v"))) for i, j, b in R.pairs(alphabet))))
    return F.struct(F.array(*map(F.lit, alphabet)).alias("labels"), less.alias("less")).cast(ORDER)


def distinct_apply(df: DataFrame, key: str, name: str, f) -> DataFrame:
    """df with ``name`` = f(key), computed once a distinct key."""
    return df.join(df.select(key).distinct().withColumn(name, f(F.col(key))), key)


def refined_matrix(model: DataFrame, **options) -> DataFrame:
    """(model_id, src, dst, p) of (model_id, order, weight) with blocks fanned out."""
    from pyspark.sql import Window

    steps = F.udf(lambda x, w: [(a, b, float(m)) for a, b, m in posets.refined_steps(_read(x), w, **options)], "array<struct<src:string,dst:string,m:double>>", useArrow=True)
    rows = model.groupBy("model_id", "order").agg(F.sum("weight").alias("w")).select("model_id", F.explode(steps("order", "w")).alias("s"))
    raw = rows.groupBy("model_id", "s.src", "s.dst").agg(F.sum("s.m").alias("w"))
    return raw.select("model_id", "src", "dst", (F.col("w") / F.sum("w").over(Window.partitionBy("model_id", "src"))).alias("p"))
