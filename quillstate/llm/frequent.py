"""Most frequent values among billions, exactly and in bounded memory.

Exact prefix refinement. Every value is hashed to 64 bits. A pass counts hash prefixes of
a few bits with a plain SQL aggregate; a prefix count bounds the count of every value
below it, so prefixes whose count cannot reach the current lower bound are dropped. The
next pass reads the rows again, keeps those below surviving prefixes, and counts longer
prefixes; the last pass counts full values. No pass holds more than
``survivors * 2**step_bits`` counters, and counts of surviving values are exact.

* By share: the lower bound is ``min_share`` of the rows of the field, so at most
  ``1 / min_share`` prefixes of a field survive any pass.
* By rank: the lower bound is the k-th largest exact count among the values below the
  currently largest prefixes (a pilot count), which can only rise.

Defined results: NULL and -1 ids are no values (the caller filters them with
a predicate); a NULL field is a field of its own, and NULL in another key column is a
value of its own; a value counts once for every stored row;
ties at rank k are broken by the key columns in ascending order; an empty table gives no
rows. Only the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstate.session import cut

#: Largest number of surviving prefixes that are shipped to all tasks; beyond it both sides shuffle, salted.
MAX_BROADCAST = 200_000
#: Parts that the rows below one prefix are dealt out to where both sides shuffle.
SALTS = 32


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned(F.col("__h"), 64 - bits)


def _hashed(df: DataFrame, field: str, keys: list[str]) -> DataFrame:
    return df.select(field, *keys, F.xxhash64(*keys).alias("__h"))


def _survivors(df: DataFrame) -> tuple[DataFrame, bool]:
    """Survivors as a local broadcast table when they are few, else written down, so that no later pass computes them again; and which of both."""
    rows = df.limit(MAX_BROADCAST + 1).collect()
    if len(rows) > MAX_BROADCAST:
        return cut(df), False
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema).coalesce(1)), True


def _small(df: DataFrame) -> DataFrame:
    return _survivors(df)[0]


def _below(rows: DataFrame, survivors: tuple[DataFrame, bool], field: str, bits: int) -> DataFrame:
    """The rows below surviving prefixes.

    Surviving prefixes are the frequent ones: where they have to be shuffled, the rows of a prefix are dealt out
    by the task that reads them, and the survivors are repeated for every part.
    """
    kept, few = survivors
    s = kept.select(F.col(field).alias("__f"), F.col("__p").alias("__sp"))
    same = F.col(field).eqNullSafe(F.col("__f")) & (_prefix(bits) == F.col("__sp"))
    if few:
        return rows.join(s, same, "left_semi")
    dealt = rows.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    every = s.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(every, same & (F.col("__salt") == F.col("__part")), "left_semi").drop("__salt")


def _with(left: DataFrame, right: DataFrame, field: str) -> DataFrame:
    """Columns of a one-row-per-field table beside the rows of that field, a NULL field included."""
    return left.join(right.withColumnRenamed(field, "__f"), F.col(field).eqNullSafe(F.col("__f"))).drop("__f")


def _counts(rows: DataFrame, field: str, bits: int) -> DataFrame:
    return rows.groupBy(field, _prefix(bits).alias("__p")).agg(F.count(F.lit(1)).alias("__n"))


def frequent_by_share(df: DataFrame, field: str, keys: list[str], min_share: str, step_bits: int = 14, prefix_bits: int = 28) -> DataFrame:
    """All values with at least ``min_share`` (decimal string) of the rows of their field.

    Returns ``field, *keys, n_rows, field_rows``; the counts are exact.
    """
    share = Fraction(min_share)
    rows = _hashed(df, field, keys)
    bits, survivors, totals = step_bits, None, None
    while bits <= prefix_bits:
        counted = _counts(rows if survivors is None else _below(rows, survivors, field, bits - step_bits), field, bits)
        if totals is None:
            w = Window.partitionBy(field)  # at most 2**step_bits counters per field
            counted = counted.withColumn("__total", F.sum("__n").over(w))
        else:
            counted = _with(counted, totals, field)
        kept = counted.where(F.col("__n") * F.lit(share.denominator) >= F.col("__total") * F.lit(share.numerator))
        survivors = _survivors(kept.select(field, "__p", "__total"))
        totals = _small(survivors[0].select(field, "__total").distinct())  # one row a field
        bits += step_bits
    full = _below(rows, survivors, field, bits - step_bits).groupBy(field, *keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return (
        _with(full, totals, field)
        .where(F.col("n_rows") * F.lit(share.denominator) >= F.col("__total") * F.lit(share.numerator))
        .withColumnRenamed("__total", "field_rows")
    )


def frequent_by_rank(df: DataFrame, field: str, keys: list[str], k: int, step_bits: int = 14, prefix_bits: int = 28) -> DataFrame:
    """The ``k`` most frequent values of each field with exact counts: ``field, *keys, n_rows, rank``."""
    rows = _hashed(df, field, keys)
    bits, survivors, bound = step_bits, None, None
    top = Window.partitionBy(field).orderBy(F.col("__n").desc(), F.col("__p"))
    while bits <= prefix_bits:
        # counted once, used for the pilot and for the survivors
        counted = cut(_counts(rows if survivors is None else _below(rows, survivors, field, bits - step_bits), field, bits))
        # pilot: exact counts of the values below the k largest prefixes give a lower bound on the k-th count
        pilot = _survivors(counted.withColumn("__r", F.row_number().over(top)).where(F.col("__r") <= k).select(field, "__p"))
        exact = _below(rows, pilot, field, bits).groupBy(field, *keys).agg(F.count(F.lit(1)).alias("__n"))
        kth = Window.partitionBy(field).orderBy(F.col("__n").desc(), *keys)
        lower = _small(
            exact.withColumn("__r", F.row_number().over(kth)).where(F.col("__r") <= k).groupBy(field)
            .agg(F.when(F.count(F.lit(1)) == k, F.min("__n")).otherwise(F.lit(1)).alias("__lower"))
        )
        bound = lower if bound is None else _small(bound.unionByName(lower).groupBy(field).agg(F.max("__lower").alias("__lower")))
        survivors = _survivors(_with(counted, bound, field).where(F.col("__n") >= F.col("__lower")).select(field, "__p"))
        bits += step_bits
    full = _below(rows, survivors, field, bits - step_bits).groupBy(field, *keys).agg(F.count(F.lit(1)).alias("n_rows"))
    w = Window.partitionBy(field).orderBy(F.col("n_rows").desc(), *keys)
    return _with(full, bound, field).where(F.col("n_rows") >= F.col("__lower")).drop("__lower").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
