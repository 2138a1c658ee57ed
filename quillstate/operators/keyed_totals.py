"""Per-key totals when a few keys hold most rows.

Every total here is algebraic (count, sum), so Spark's partial hash aggregate keeps one
bounded table of key states per map task, spills it when memory is short, and shuffles
one compact state per key and map task instead of the rows. A key that holds a third of
all rows therefore reaches its reducer as one row per map task. Vectors are summed
element by element as (key, element) states, never as collected lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def present(item: Column) -> Column:
    """An id that is neither NULL nor -1."""
    return item.isNotNull() & (item != F.lit(-1))


def keyed_totals(df: DataFrame, keys: list[str], sums: dict[str, Column] | None = None, rows: str = "n_rows") -> DataFrame:
    """Row count and sums per key: one map-side combine, one shuffle of partial states.

    NULL is a key value of its own; a sum over no non-NULL value is NULL; an empty table
    gives no rows. Columns not named are ignored, whatever they are called.
    """
    sums = sums or {}
    aggs = [F.sum(c).alias(name) for name, c in sums.items()]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(rows), *aggs)


def vector_totals(df: DataFrame, keys: list[str], vector: str, dim: str, out: str = "vec_sum") -> DataFrame:
    """Element-wise vector sum per key as (keys, ``dim``, ``out``) rows.

    ``vector`` is an ARRAY column; the element number comes out as ``dim``. NULL vectors
    and NULL elements add nothing; vectors of different length add to the elements they have.
    """
    exploded = df.select(*keys, F.posexplode(F.col(vector)).alias(dim, "__v"))
    return exploded.groupBy(*keys, dim).agg(F.sum(F.col("__v").cast("double")).alias(out))


def share_of_group(df: DataFrame, groups: list[str], keys: list[str], min_share: str, rows: str = "n_rows") -> DataFrame:
    """Keys holding at least ``min_share`` (a decimal string) of the rows of their group.

    The group totals are summed from the per-key totals, not from the rows, and joined
    back on the group columns; Spark broadcasts them only while they are small.
    """
    per_key = keyed_totals(df, [*groups, *keys], rows=rows)
    totals = per_key.groupBy(*groups).agg(F.sum(rows).alias("__total"))
    on = [F.col(f"k.{g}").eqNullSafe(F.col(f"t.{g}")) for g in groups]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    wide = "decimal(38,8)"
    return (
        per_key.alias("k")
        .join(totals.alias("t"), cond)
        .where(F.col(rows).cast(wide) >= F.lit(min_share).cast("decimal(18,8)") * F.col("__total").cast("decimal(20,0)"))
        .select(*[F.col(f"k.{c}").alias(c) for c in [*groups, *keys]], rows, F.col("__total").alias("group_rows"))
    )
