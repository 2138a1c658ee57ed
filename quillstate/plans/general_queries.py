"""Queries of the general data problem: per-key results although few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstate.operators.keyed_totals import keyed_totals, present, share_of_group, vector_totals
from quillstate.session import table

HOT_SHARE = "0.025"


def _click_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "train100").select(
        F.lit("C2").alias("field"), "day_n", F.lit(-1).alias("variable_id"), F.col("C2").alias("item"), "label"
    ).where(present(F.col("item")))


def _push_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embedding_push_request_data").select(
        F.lit("indices").alias("field"), "day_n", "variable_id", F.explode("indices").alias("item")
    ).where(present(F.col("item")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    items = _click_items(spark, d).drop("label").unionByName(_push_items(spark, d))
    return share_of_group(items, ["field", "day_n"], ["variable_id", "item"], HOT_SHARE).select("field", "day_n", "variable_id", "item")


def p5_click_totals(spark: SparkSession, d: str) -> DataFrame:
    return keyed_totals(_click_items(spark, d), ["item"], {"clicks": F.col("label").cast("bigint")}).select(
        "item", "n_rows", F.coalesce("clicks", F.lit(0).cast("bigint")).alias("clicks")
    )


def _push_blocks(spark: SparkSession, d: str) -> DataFrame:
    """One row per list element with its count and its slice of the gradient block."""
    src = table(spark, d, "embedding_push_request_data").select("variable_id", "embedding_dim", "indices", "counts", "gradients")
    dim = F.col("embedding_dim")
    return (
        src.select("variable_id", "embedding_dim", "counts", "gradients", F.posexplode("indices").alias("pos", "item"))
        .where(present(F.col("item")))
        .select(
            "variable_id",
            "item",
            F.get("counts", F.col("pos")).alias("cnt"),
            F.slice("gradients", F.col("pos") * dim + 1, dim).alias("grad"),
        )
    )


def p5_push_counts(spark: SparkSession, d: str) -> DataFrame:
    return keyed_totals(_push_blocks(spark, d), ["variable_id", "item"], {"sum_count": F.col("cnt")}).select(
        "variable_id", "item", "n_rows", F.coalesce("sum_count", F.lit(0).cast("bigint")).alias("sum_count")
    )


def p5_push_gradients(spark: SparkSession, d: str) -> DataFrame:
    return vector_totals(_push_blocks(spark, d), ["variable_id", "item"], "grad", "dim", "grad_sum").select("variable_id", "item", "dim", "grad_sum")


QUERIES = {
    "p5_found": p5_found,
    "p5_click_totals": p5_click_totals,
    "p5_push_counts": p5_push_counts,
    "p5_push_gradients": p5_push_gradients,
}

ORACLE = {
    "p5_found": """
WITH v AS (
  SELECT 'C2' AS field, day_n, -1 AS variable_id, C2 AS item FROM train100
  UNION ALL
  SELECT 'indices', day_n, variable_id, unnest(indices) FROM embedding_push_request_data),
u AS (SELECT * FROM v WHERE item IS NOT NULL AND item <> -1),
t AS (SELECT field, day_n, COUNT(*) AS total FROM u GROUP BY field, day_n),
k AS (SELECT field, day_n, variable_id, item, COUNT(*) AS n FROM u GROUP BY field, day_n, variable_id, item)
SELECT k.field, k.day_n, k.variable_id, k.item
FROM k JOIN t ON k.field = t.field AND k.day_n IS NOT DISTINCT FROM t.day_n
WHERE k.n * 1000 >= 25 * t.total""",
    "p5_click_totals": """
SELECT C2 AS item, COUNT(*) AS n_rows, CAST(COALESCE(SUM(label), 0) AS BIGINT) AS clicks
FROM train100 WHERE C2 IS NOT NULL AND C2 <> -1 GROUP BY C2""",
    "p5_push_counts": """
WITH e AS (
  SELECT variable_id, UNNEST(indices) AS item, UNNEST(counts) AS cnt FROM embedding_push_request_data)
SELECT variable_id, item, COUNT(*) AS n_rows, CAST(COALESCE(SUM(cnt), 0) AS BIGINT) AS sum_count
FROM e WHERE item IS NOT NULL AND item <> -1 GROUP BY variable_id, item""",
    "p5_push_gradients": """
WITH e AS (
  SELECT variable_id, embedding_dim, gradients, UNNEST(indices) AS item, UNNEST(range(len(indices))) AS pos
  FROM embedding_push_request_data),
g AS (
  SELECT variable_id, item, gradients, pos * embedding_dim AS base, UNNEST(range(embedding_dim)) AS dim
  FROM e WHERE item IS NOT NULL AND item <> -1 AND gradients IS NOT NULL)
SELECT variable_id, item, CAST(dim AS INT) AS dim, SUM(CAST(gradients[base + dim + 1] AS DOUBLE)) AS grad_sum
FROM g GROUP BY variable_id, item, dim""",
}
