"""Catalogues of causal orders: canonical forms, differences between models, families."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .posets import Order, tiling


def forms(spark: SparkSession, models: dict[str, Iterable[Order]]) -> DataFrame:
    """(model, form, size): the canonical form of every order of every model."""
    rows = [(name, tiling(o), len(o)) for name, orders in models.items() for o in orders]
    return spark.createDataFrame(rows, "model string, form string, size int")


def membership(catalogue: DataFrame) -> DataFrame:
    """(form, models): which models have a form."""
    return catalogue.groupBy("form").agg(F.array_sort(F.collect_set("model")).alias("models"))


def summary(members: DataFrame) -> DataFrame:
    """(models, n): forms by the set of models that have them."""
    return members.groupBy("models").agg(F.count(F.lit(1)).alias("n"))


def shared_by_all(members: DataFrame, n: int) -> DataFrame:
    return members.filter(F.size("models") == n)


def without(order: Order, boundary: Iterable[str]) -> Order:
    """The order without boundary labels."""
    drop = set(boundary)
    return order.restrict(sum(1 << i for i, label in enumerate(order.labels) if label not in drop))


def legend(catalogue: DataFrame, prefix: str = "P") -> DataFrame:
    """(id, form): short names in the order of the forms."""
    from pyspark.sql import Window

    rows = catalogue.select("form").distinct()
    return rows.select(F.concat(F.lit(prefix), F.row_number().over(Window.orderBy("form")).cast("string")).alias("id"), "form")
