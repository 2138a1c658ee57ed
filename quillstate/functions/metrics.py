"""Model metrics and closed-form forward passes as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstate.operators.gradients import push_reduce
from quillstate.session import cut


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def log_loss(df: DataFrame, label: str, p: str, eps: float = 1e-15) -> DataFrame:
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    y = F.col(label)
    return df.agg(F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("log_loss"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve by rank sums; tied scores share their average rank.

    Rows are reduced to (score, positives, negatives) first; ranks are running totals over
    distinct scores, in two levels, so no window holds all rows.
    """
    y = F.col(label).cast("bigint")
    per = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("__s")).agg(F.sum(y).alias("__p"), F.sum(1 - y).alias("__n"))
    # the bounds of the ranges are sampled: both passes have to read the same ranges
    parts = cut(per.repartitionByRange(F.col("__s")).withColumn("__c", F.spark_partition_id()))
    before = Window.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.groupBy("__c").agg(F.sum("__n").alias("__t")).select("__c", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__c").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("__base") + F.coalesce(F.sum("__n").over(inside), F.lit(0))
    # one row per partition on the small side
    won = parts.join(F.broadcast(base), "__c").withColumn("__w", F.col("__p") * (below + F.col("__n") / 2))
    return won.agg(F.try_divide(F.sum("__w"), F.sum("__p").cast("double") * F.sum("__n")).alias("auc"))


def error_rate(df: DataFrame, label: str, p: str) -> DataFrame:
    """Share of rows whose rounded-half-up prediction is not the label."""
    predicted = F.floor(F.col(p) + 0.5)
    return df.agg(F.avg(F.when(predicted != F.col(label), 1.0).otherwise(0.0)).alias("error_rate"))


def fm_second_order(vectors: DataFrame, row: str, vector: str, dim: int | None = None) -> DataFrame:
    """``0.5 * sum((sum v)^2 - sum v^2)`` per row over its vectors; NULL vectors are none.

    Values and squares lie side by side in one vector, whose sums are taken element by element
    without multiplying rows (``push_reduce``).
    """
    pairs = F.flatten(F.transform(F.col(vector).cast("array<double>"), lambda v: F.array(v, v * v)))
    sums = push_reduce(vectors.where(F.col(vector).isNotNull()).select(row, pairs.alias("__v")), [row], "__v", dim and 2 * dim)
    parts = F.transform("grad", lambda x, i: F.when(i % 2 == 0, x * x).otherwise(-x))
    return sums.select(row, (F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) * 0.5).alias("fm"))


def worker_average(values: DataFrame, worker: str, columns: list[str]) -> DataFrame:
    """One row: the mean over workers of each worker's mean, as workers that report once each give it."""
    per = values.groupBy(worker).agg(*[F.avg(c).alias(c) for c in columns])
    return per.agg(*[F.avg(c).alias(c) for c in columns])


def lr_forward(embedded: DataFrame, row: str, weight: str, dense: Column, bias: float = 0.0) -> DataFrame:
    """Logistic regression over pulled weights of one dimension and a dense term per row."""
    z = F.sum(weight) + F.first(dense) + F.lit(float(bias))
    return embedded.groupBy(row).agg(sigmoid(z).alias("p"))
