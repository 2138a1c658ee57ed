"""Locality of key streams, trace and log roll-ups, commit metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def batch_locality(rows: DataFrame, column: str, batch: str, key: str) -> DataFrame:
    """Per column: rows, distinct keys per batch, and those that were in the batch before.

    Works on distinct (column, batch, key) counts; the previous batch is an equi-join on
    ``batch - 1``, so no pair of rows is ever formed within a batch.
    """
    per = rows.groupBy(column, batch, key).agg(F.count(F.lit(1)).alias("__n"))
    before = per.select(F.col(column).alias("__c"), (F.col(batch) + 1).alias("__b"), F.col(key).alias("__k"), F.lit(1).alias("__hit"))
    j = per.join(before, (F.col(column) == F.col("__c")) & (F.col(batch) == F.col("__b")) & (F.col(key) == F.col("__k")), "left")
    hit = F.col("__hit").isNotNull()
    out = j.groupBy(column).agg(
        F.sum("__n").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"),
        F.coalesce(F.sum(F.when(hit, F.col("__n"))), F.lit(0).cast("bigint")).alias("hit_rows"), F.count(F.when(hit, 1)).alias("hit_distinct"),
    )
    return out.withColumn("row_ratio", F.col("hit_rows") / F.col("n_rows")).withColumn("distinct_ratio", F.col("hit_distinct") / F.col("n_distinct"))


def cumulative_hit(rows: DataFrame, column: str, batch: str, key: str, at: int) -> DataFrame:
    """Distinct keys of batch ``at`` and those seen in any earlier batch, per column."""
    first = rows.where(F.col(batch) <= at).groupBy(column, key).agg(F.min(batch).alias("__first"), F.max(batch).alias("__last"))
    here = first.where(F.col("__last") == at)
    return here.groupBy(column).agg(F.count(F.lit(1)).alias("n_distinct"), F.count(F.when(F.col("__first") < at, 1)).alias("n_seen"))


def cumulative_hits(rows: DataFrame, column: str, batch: str, key: str) -> DataFrame:
    """Per column and batch: distinct keys, and those seen in any earlier batch.

    A key is new in its first batch only, so the seen ones are the distinct keys less the
    keys that begin there; two aggregates, joined on (column, batch).
    """
    per = rows.select(column, batch, key).distinct()
    distinct = per.groupBy(column, batch).agg(F.count(F.lit(1)).alias("n_distinct"))
    first = rows.groupBy(column, key).agg(F.min(batch).alias(batch)).groupBy(column, batch).agg(F.count(F.lit(1)).alias("__new"))
    j = distinct.join(first, [column, batch], "left")
    return j.select(column, batch, "n_distinct", (F.col("n_distinct") - F.coalesce("__new", F.lit(0))).alias("n_seen"))


def trace_rollup(events: DataFrame) -> DataFrame:
    """Per operation (the name's part after the last colon): first start, last end, total and count, in thousandths cut to whole numbers."""
    op = F.substring_index("name", ":", -1)
    usable = events.where("name is not null and ts is not null and dur is not null")
    whole = lambda c: (c / 1000).cast("bigint")
    return usable.groupBy(op.alias("op")).agg(whole(F.min("ts")).alias("start_ms"), whole(F.max(F.col("ts") + F.col("dur"))).alias("end_ms"), whole(F.sum("dur")).alias("total_ms"), F.count(F.lit(1)).alias("n"))


def log_pivot(epochs: DataFrame, workers: list[int] = [1, 2, 4, 8]) -> DataFrame:  # noqa: B006
    """Fastest epoch per case and number of workers, one column per number."""
    return epochs.groupBy("case").pivot("np", workers).agg(F.min("seconds"))


def commit_metrics(before: DataFrame, after: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """Rows added, changed and unchanged between two versions of a state, per ``on``."""
    b = before.select(*on, "key", F.xxhash64("weights").alias("h0"))
    a = after.select(*on, "key", F.xxhash64("weights").alias("h1"))
    j = a.join(b, [*on, "key"], "left")
    return j.groupBy(*on).agg(F.count(F.when(F.col("h0").isNull(), 1)).alias("added"), F.count(F.when(F.col("h0") != F.col("h1"), 1)).alias("changed"), F.count(F.when(F.col("h0") == F.col("h1"), 1)).alias("unchanged"))
