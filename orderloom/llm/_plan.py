"""Spark plumbing of the operators: table access, size checks, bucket exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.settle import checkpoint_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size_in_bytes(df: DataFrame) -> int:
    """Catalyst's estimate for the optimised plan: file sizes for a scan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bucket_count(df: DataFrame, per_bucket: int = 8 << 20) -> int:
    """Hash buckets such that one holds about ``per_bucket`` bytes of the scanned
    files, so what meets in a task stays the same size as the corpus grows."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-size_in_bytes(df) // per_bucket))


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """At most so many texts in an Arrow batch from now on: it is held twice, by the JVM and by Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; below one of the session's own where that is
    unset and all runs on one machine."""
    return f"{str(checkpoint_folder(spark)).rstrip('/')}/orderloom-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there and
    a lost executor costs nothing that was done before."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made, once what was read from them is written itself."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(conf).delete(path, True)


def _measured(field) -> Column:
    """Bytes of a column's values in memory, a little more than there are."""
    name, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.sum(F.coalesce(F.octet_length(name), F.lit(0)) + 16)
    if isinstance(kind, T.ArrayType):
        return F.sum(F.greatest(F.size(name), F.lit(0)) * (48 if isinstance(kind.elementType, T.StringType) else 16) + 16)
    return F.sum(F.lit(16))


def broadcastable(df: DataFrame, limit: int = 32 << 20) -> DataFrame:
    """Broadcast hint only if the rows take less than ``limit`` in memory.  A plan whose files
    alone are larger is not looked at; else its values are measured, since Parquet's size
    says little of them."""
    if size_in_bytes(df) > limit:
        return df
    measured = df.agg(*(_measured(f).alias(str(i)) for i, f in enumerate(df.schema))).first()
    return F.broadcast(df) if sum(x or 0 for x in measured) <= limit else df


def texts(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id, text and the named columns only: clashing extras never reach an operator."""
    return docs.select("doc_id", "text", *columns)
