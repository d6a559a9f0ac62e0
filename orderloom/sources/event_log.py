"""Event tables as process data: cases, object relations, label permutations.

Everything here is a projection or one aggregation of the fact table; nothing is
collected.  Ties in time are broken by the event id, so every order is total.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_log(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """A log from parquet, orc, csv or json; give text formats a schema."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def case_log(events: DataFrame, case: Column, activity: str = "event_type", ts: str = "ts", eid: str = "event_id") -> DataFrame:
    """(case_id, activity, ts, eid): the long form of a classical log."""
    return events.select(case.cast("string").alias("case_id"), F.col(activity).alias("activity"), F.col(ts).alias("ts"), F.col(eid).alias("eid"))


def daily_log(events: DataFrame) -> DataFrame:
    """One case a user and day."""
    return case_log(events, F.concat_ws("@", F.col("user_id").cast("string"), F.col("ts").cast("date").cast("string")))


def relations(events: DataFrame) -> DataFrame:
    """Object-centric relations (eid, activity, ts, oid, otype) of the event table:
    the user and the item (``props.k``) of every event."""
    base = events.select(F.col("event_id").alias("eid"), F.col("event_type").alias("activity"), "ts", "user_id", F.get_json_object("props", "$.k").alias("k"))
    both = F.array(
        F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("oid"), F.lit("user").alias("otype")),
        F.struct(F.concat(F.lit("i"), F.col("k")).alias("oid"), F.lit("item").alias("otype")),
    )
    return base.select("eid", "activity", "ts", F.explode(both).alias("o")).select("eid", "activity", "ts", "o.oid", "o.otype").filter("oid is not null")


def events_of(rel: DataFrame) -> DataFrame:
    return rel.select("eid", "activity", "ts").distinct()


def objects_of(rel: DataFrame) -> DataFrame:
    """(oid, otype); the first row in time fixes an object's type."""
    return rel.groupBy("oid").agg(F.min_by("otype", F.struct("ts", "eid")).alias("otype"))


def flatten(rel: DataFrame) -> DataFrame:
    """(otype, oid, trace): each object's activities in time order."""
    return rel.groupBy("otype", "oid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ts", "eid", "activity"))), lambda x: x["activity"]).alias("trace")
    )


def first_orders(events: DataFrame, days: int, alphabet: Sequence[str]) -> DataFrame:
    """(group_id, block, trace, times): per user and window of ``days`` days the order in
    which all labels first occur; windows that miss a label are left out."""
    block = F.floor(F.unix_date(F.col("ts").cast("date")) / days)
    first = events.filter(F.col("event_type").isin(*alphabet)).groupBy(F.col("user_id").alias("group_id"), block.alias("block"), "event_type").agg(F.min("ts").alias("at"))
    row = first.groupBy("group_id", "block").agg(F.array_sort(F.collect_list(F.struct("at", "event_type"))).alias("x")).filter(F.size("x") == len(alphabet))
    return row.select("group_id", "block", F.transform("x", lambda e: e["event_type"]).alias("trace"), F.transform("x", lambda e: e["at"]).alias("times"))


def grouped(log: DataFrame, key: str, min_size: int = 3, assumption: str = "") -> tuple[DataFrame, DataFrame]:
    """(groups, leftovers): rows whose key occurs at least ``min_size`` times, and the
    rest.  Grouping asserts something about the data, so the caller must say what."""
    if not assumption.strip():
        raise ValueError("say what grouping by this key assumes")
    sized = log.join(log.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), key)
    return sized.filter(F.col("_n") >= min_size).drop("_n"), sized.filter(F.col("_n") < min_size).drop("_n")


def to_rows(traces: DataFrame, start: str = "2020-01-01") -> DataFrame:
    """Traces (case_no, trace) as rows (case_id, activity, ts): a case every 1000 s, an event every second."""
    base = F.unix_seconds(F.lit(start).cast("timestamp"))
    return traces.select(F.col("case_no").cast("string").alias("case_id"), "case_no", F.posexplode("trace").alias("pos", "activity")).select(
        "case_id", "activity", F.timestamp_seconds(base + 1000 * F.col("case_no") + F.col("pos")).alias("ts")
    )
