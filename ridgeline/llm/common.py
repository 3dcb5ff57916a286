"""Small helpers that the text operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where the session names none and all
    tasks run in this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}")
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/ridgeline/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, partition_by: str | None = None) -> DataFrame:
    """`df` as a Parquet table in the shared folder, reread: lineage ends there and
    columns can be pruned. A lost executor costs a reread only."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def ascii_lower(text: Column) -> Column:
    """A-Z only. `lower` has a fast path for ASCII and is the same there."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def hashable(df: DataFrame) -> list[str]:
    """Columns that can enter a hash or an order (no maps, variants or nested maps)."""
    return [f"`{f.name}`" for f in df.schema if "map<" not in f.dataType.simpleString() and not isinstance(f.dataType, T.VariantType)]


def in_hash_sample(key: Column, bound: int, salt: int, count: int) -> Column:
    """Whether a row is among about `bound` of `count`, by a hash of `key`."""
    if count <= bound:
        return F.lit(True)
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 20)) < F.lit(int(bound / count * (1 << 20)) + 1)


def hash_sample(df: DataFrame, key: Column, bound: int, salt: int, count: int | None = None) -> DataFrame:
    """About `bound` rows, at most twice as many, chosen by a hash of `key`: repeatable and
    without a sort. Only for fitting models."""
    n = df.count() if count is None else count
    return df.where(in_hash_sample(key, bound, salt, n)).limit(2 * bound)


def held_out(key: Column, n: int, rest: int) -> Column:
    """Whether crc32 of the key as text leaves `rest` modulo n; never for a null key."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(n)) == rest, F.lit(False))

