"""Strict orders on at most eight labels as one BIGINT: bit ``8 i + j`` says i before j.

Meet, refinement, respect and Kemeny distance are then single bit operations in
generated code, and the meet of a group is an aggregate (``bit_and``).
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_LABELS = 8


def bit(i: int, j: int) -> int:
    return 1 << (8 * i + j)


def pairs(alphabet: Sequence[str]) -> list[tuple[int, int, int]]:
    """(i, j, bit) of all ordered pairs."""
    if len(alphabet) > MAX_LABELS:
        raise ValueError(f"a mask holds {MAX_LABELS} labels at most")
    return [(i, j, bit(i, j)) for i, j in itertools.permutations(range(len(alphabet)), 2)]


def from_trace(trace: Column, alphabet: Sequence[str]) -> Column:
    """Mask of the chain that a permutation of the alphabet is."""
    at = [F.array_position(trace, a) for a in alphabet]
    return sum((F.when(at[i] < at[j], F.lit(b)).otherwise(F.lit(0)) for i, j, b in pairs(alphabet)), F.lit(0).cast("bigint"))


def meet(p: Column, q: Column) -> Column:
    return p.bitwiseAND(q)


def refines(p: Column, q: Column) -> Column:
    """Every pair of p is one of q."""
    return p.bitwiseAND(q) == p


def respects(chain: Column, order: Column) -> Column:
    """The trace with this chain mask is a linear extension of the order."""
    return refines(order, chain)


def size(p: Column) -> Column:
    return F.bit_count(p)


def kemeny(p: Column, q: Column) -> Column:
    return F.bit_count(p.bitwiseXOR(q))


def holds(p: Column, b: int) -> Column:
    return p.bitwiseAND(F.lit(b)) != 0


def covers(p: Column, n: int) -> Column:
    """Mask of the pairs with nothing between."""
    out = F.lit(0).cast("bigint")
    for i, j in itertools.permutations(range(n), 2):
        between = [holds(p, bit(i, k)) & holds(p, bit(k, j)) for k in range(n) if k not in (i, j)]
        broken = between[0] if between else F.lit(False)
        for x in between[1:]:
            broken = broken | x
        out = out + F.when(holds(p, bit(i, j)) & ~broken, F.lit(bit(i, j))).otherwise(F.lit(0))
    return out


def closed(p: Column, n: int) -> Column:
    """Transitive closure: Warshall, a label at a time.  Each round binds its input in
    a lambda, so the expression stays linear in the rounds."""

    def through(k: int, x: Column) -> Column:
        add = x
        for i, j in itertools.permutations([y for y in range(n) if y != k], 2):
            add = add.bitwiseOR(F.when(holds(x, bit(i, k)) & holds(x, bit(k, j)), F.lit(bit(i, j)).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        return add

    bound = F.array(p)
    for k in range(n):
        bound = _each(bound, through, k)
    return F.get(bound, F.lit(0))


def _each(bound: Column, through, k: int) -> Column:
    return F.transform(bound, lambda x: through(k, x))


def is_order(p: Column, n: int) -> Column:
    """Irreflexive, antisymmetric and transitive on n labels."""
    inside = sum(bit(i, j) for i, j in itertools.permutations(range(n), 2))
    twice = F.lit(False)
    for i, j in itertools.combinations(range(n), 2):
        twice = twice | (holds(p, bit(i, j)) & holds(p, bit(j, i)))
    return (p.bitwiseAND(F.lit(inside)) == p) & ~twice & (closed(p, n) == p)


def render(p: Column, alphabet: Sequence[str]) -> Column:
    """The pairs as ``a<b, ...`` in label order."""
    return F.concat_ws(", ", *(F.when(holds(p, b), F.lit(f"{alphabet[i]}<{alphabet[j]}")) for i, j, b in pairs(alphabet)))


def permutations(spark: SparkSession, alphabet: Sequence[str]) -> DataFrame:
    """(trace, chain): the dimension table of all m! permutations (m at most 8)."""
    rows = [(list(p), sum(bit(alphabet.index(p[x]), alphabet.index(p[y])) for x in range(len(p)) for y in range(x + 1, len(p)))) for p in itertools.permutations(alphabet)]
    return spark.createDataFrame(rows, "trace array<string>, chain bigint")


def extension_counts(orders: DataFrame, spark: SparkSession, alphabet: Sequence[str]) -> DataFrame:
    """(order, e): linear extensions of each distinct order, against the permutation table."""
    table = F.broadcast(permutations(spark, alphabet).select("chain"))
    return orders.select("order").distinct().join(table, respects(F.col("chain"), F.col("order"))).groupBy("order").agg(F.count(F.lit(1)).alias("e"))


def meet_closure(orders: DataFrame, cap: int = 200_000) -> tuple[DataFrame, bool]:
    """All meets of members, by semi-naive rounds; stops with True beyond ``cap``.

    Sets are distinct orders on at most eight labels: model-sized, whatever the log.
    """
    from ..operators.settle import settled

    base = settled(orders.select("order").distinct())
    known, fresh = base, base
    while True:
        new = fresh.join(base.withColumnRenamed("order", "other"), F.expr("`order` != other")).select(meet(F.col("order"), F.col("other")).alias("order")).distinct()
        fresh = settled(new.join(known, "order", "left_anti"))
        n = fresh.count()
        if not n:
            return known, False
        known = settled(known.unionByName(fresh))
        if known.count() > cap:
            return known.orderBy(size(F.col("order")), "order").limit(cap), True
