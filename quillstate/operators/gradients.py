"""Push: two-level sums of gradient vectors and counts per key; unique and inverse of index lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstate.operators.sharding import row_numbers

#: Elements that one aggregate sums side by side, for vectors of known and unknown length; longer ones are summed slice by slice.
WIDTH, UNKNOWN_WIDTH = 128, 32


def push_reduce(df: DataFrame, keys: list[str], grad: str, dim: int | None = None, count: str | None = None) -> DataFrame:
    """``*keys, grad ARRAY<DOUBLE>, cnt``: summed vectors and counts, combined map-side, in one pass over the rows.

    Every element is a sum of its own, so a vector of up to ``WIDTH`` elements is one row
    of sums; a longer one is cut into slices that are put together again per key. ``count`` names
    a column of counts; every row counts 1 without it. NULL gradients add zeros and still count;
    NULL keys are keys of their own, alike for every dimension. Without ``dim`` a sum is as long
    as the longest vector of its key, which may be none.
    """
    one = F.coalesce(F.col(count), F.lit(0)).cast("bigint") if count else F.lit(1).cast("bigint")
    if dim is not None and dim <= WIDTH:
        sums = [F.coalesce(F.sum(F.get(grad, F.lit(i)).cast("double")), F.lit(0.0)).alias(f"__g{i}") for i in range(dim)]
        out = df.groupBy(*keys).agg(*sums, F.sum(one).alias("cnt"))
        return out.select(*keys, F.array(*[f"__g{i}" for i in range(dim)]).alias("grad"), "cnt")
    width = WIDTH if dim is not None else UNKNOWN_WIDTH
    size = F.lit(dim) if dim is not None else F.greatest(F.size(grad), F.lit(0))
    slices = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((size - 1) / width).cast("int"))), lambda c: F.struct(c.alias("c"), F.slice(F.col(grad), c * width + 1, F.lit(width)).alias("v")))
    rows = df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], one.alias("__one"), size.alias("__size"), F.explode(slices).alias("__s"))
    first = F.col("__s.c") == 0
    names = [f"__k{i}" for i in range(len(keys))]
    summed = rows.groupBy(*names, F.col("__s.c").alias("__c")).agg(
        *[F.coalesce(F.sum(F.get("__s.v", F.lit(i)).cast("double")), F.lit(0.0)).alias(f"__g{i}") for i in range(width)],
        F.sum(F.when(first, F.col("__one"))).alias("__n"), F.max(F.when(first, F.col("__size"))).alias("__size"),
    )
    part = F.struct("__c", F.array(*[f"__g{i}" for i in range(width)]).alias("v"))
    whole = summed.groupBy(*names).agg(F.array_sort(F.collect_list(part)).alias("__p"), F.sum("__n").alias("cnt"), F.max("__size").alias("__size"))  # one entry per slice
    vector = F.slice(F.flatten(F.transform("__p", lambda p: p["v"])), F.lit(1), F.col("__size"))
    return whole.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], vector.alias("grad"), "cnt")


def push_two_level(df: DataFrame, worker: str, keys: list[str], grad: str, dim: int) -> DataFrame:
    """The same sums with the workers' partial blocks made explicit: (worker, keys), then keys."""
    return push_reduce(push_reduce(df, [worker, *keys], grad, dim), keys, "grad", dim, "cnt")


def mean_gradient(reduced: DataFrame) -> DataFrame:
    """``grad`` divided by ``cnt``; a count of 0 gives NULL elements."""
    return reduced.withColumn("grad", F.transform("grad", lambda g: F.try_divide(g, F.col("cnt"))))


def unique_inverse(df: DataFrame, pos: str, key: str, groups: list[str] | None = None) -> DataFrame:
    """Every position with the number of its key in first-seen order (``inverse``, from 0).

    First positions are reduced per key before they are numbered, and distinct keys are
    numbered by ranges. Rows with a NULL key or group have no number and are not returned.
    """
    groups = groups or []
    first = df.groupBy(*groups, key).agg(F.min(pos).alias("__first"))
    numbered = row_numbers(first, [*groups, "__first"], "inverse").drop("__first")
    if groups:
        base = numbered.groupBy(*groups).agg(F.min("inverse").alias("__base"))
        numbered = numbered.join(base, groups).withColumn("inverse", F.col("inverse") - F.col("__base")).drop("__base")
    return df.join(numbered.withColumn("inverse", F.col("inverse").cast("bigint")), [*groups, key])


def pull_totals(df: DataFrame, variable: str, key: str) -> DataFrame:
    """Pulled and distinct keys per variable: ``pull_indices, pull_unique``."""
    per_key = df.groupBy(variable, key).agg(F.count(F.lit(1)).alias("__n"))
    return per_key.groupBy(variable).agg(F.sum("__n").alias("pull_indices"), F.count(key).alias("pull_unique"))


def dense_gradient(reduced: DataFrame, vocabulary_size: int, dim: int) -> DataFrame:
    """A row for every key of a small vocabulary, zeros where nothing was pushed."""
    every = reduced.sparkSession.range(vocabulary_size).withColumnRenamed("id", "key")
    return every.join(reduced, "key", "left").select("key", F.coalesce("grad", F.array_repeat(F.lit(0.0), dim)).alias("grad"), F.coalesce("cnt", F.lit(0).cast("bigint")).alias("cnt"))
