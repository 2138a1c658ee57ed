"""Shard arithmetic: key ``k`` of ``n`` shards lives in shard ``k mod n`` at local index ``k div n``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstate.session import cut


def shard_of(key: Column, n: int) -> Column:
    return F.pmod(key, F.lit(n).cast("bigint")).cast("int")


def local_of(key: Column, n: int) -> Column:
    return F.call_function("div", key, F.lit(n).cast("bigint"))


def key_of(local: Column, shard: Column, n: int) -> Column:
    return local * F.lit(n).cast("bigint") + shard.cast("bigint")


def route(df: DataFrame, key: str, n: int) -> DataFrame:
    """``df`` with ``shard`` and ``local`` columns."""
    return df.withColumn("shard", shard_of(F.col(key), n)).withColumn("local", local_of(F.col(key), n))


def by_shard(df: DataFrame, n: int, shard: str = "shard") -> DataFrame:
    """One partition per shard, partition number = shard number."""
    return df.repartitionById(n, F.col(shard))


def local_shards(df: DataFrame, shards: list[int], shard: str = "shard") -> DataFrame:
    """Rows of the given shards; prunes directories of a layout partitioned by ``shard``."""
    return df.where(F.col(shard).isin(shards))


def worker_rows(df: DataFrame, rank: int, size: int, order: list[str], contiguous: bool = False) -> DataFrame:
    """The rows a worker reads: every ``size``-th row, or its contiguous part; a remainder is left out.

    Row numbers come from a range-partitioned count, not from one global window.
    """
    numbered = row_numbers(df, order, "__rn")
    n = df.count() // size * size
    kept = numbered.where(F.col("__rn") < n)
    if contiguous:
        per = n // size
        kept = kept.where(F.col("__rn").between(rank * per, (rank + 1) * per - 1))
    else:
        kept = kept.where(F.pmod("__rn", F.lit(size)) == rank)
    return kept.drop("__rn")


def row_numbers(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """0-based row numbers in the given order, without pulling all rows into one partition.

    Rows are range partitioned on the order columns; each partition's size is counted and
    the running total is joined back, so only one row per partition meets in one place.
    Range bounds come from a sample, so the partitioned rows are written once and both
    passes read what was written. Rows that tie in all order columns are numbered in any order.
    """
    cols = [F.col(c) for c in order]
    parts = cut(df.repartitionByRange(*cols).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = parts.withColumn("__i", F.row_number().over(Window.partitionBy("__part").orderBy(*cols)))
    return inside.join(F.broadcast(base), F.col("__part") == F.col("__p")).withColumn(name, F.col("__base") + F.col("__i") - 1).drop("__part", "__p", "__base", "__i")
