"""Click-log preprocessing: filling, scaling, encoding, splitting, bucketing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstate.operators.sharding import row_numbers


def by_prefix(df: DataFrame, prefixes: str) -> list[str]:
    """Names of the columns that start with one of the letters and go on with a number."""
    return [c for c in df.columns if c[:1] in prefixes and c[1:].isdigit()]


def fill_missing(df: DataFrame, sparse: list[str], dense: list[str]) -> DataFrame:
    """Missing sparse values become -1 (or '-1'), missing dense values (NULL, NaN) 0."""
    kinds = dict(df.dtypes)
    made = {c: F.coalesce(F.col(c), F.lit("-1" if kinds[c] == "string" else -1).cast(kinds[c])) for c in sparse}
    made |= {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in dense}
    return df.withColumns(made)


def min_max_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to [0, 1] over the whole table; a constant column becomes 0, NULL stays NULL."""
    stats = df.agg(*[F.min(c).cast("double").alias(f"a_{c}") for c in columns], *[F.max(c).cast("double").alias(f"b_{c}") for c in columns]).first()
    made = {}
    for c in columns:
        a, b = stats[f"a_{c}"], stats[f"b_{c}"]
        x = F.col(c).cast("double")
        made[c] = F.when(x.isNotNull(), F.lit(0.0)) if a is None or a == b else (x - F.lit(a)) / F.lit(b - a)
    return df.withColumns(made)


def standardise(df: DataFrame, constants: dict[str, tuple[float, float]]) -> DataFrame:
    """``(x - b) / k`` with fixed ``(b, k)`` per column."""
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(float(b))) / F.lit(float(k)) for c, (b, k) in constants.items()})


def _codes(distinct: DataFrame, order: str, name: str) -> DataFrame:
    return row_numbers(distinct, [order], name).withColumn(name, F.col(name).cast("bigint"))


def label_encode_sorted(df: DataFrame, column: str, out: str) -> DataFrame:
    """Codes of distinct values in sorted order; NULL gets none.

    Values are numbered by ranges, so hundreds of millions of them never meet in one task.
    """
    codes = _codes(df.select(column).where(F.col(column).isNotNull()).distinct(), column, out)
    return df.join(codes, column, "left")


def label_encode_first_seen(df: DataFrame, column: str, order: str, out: str) -> DataFrame:
    """Codes of distinct values in the order of their first row; -1 counts as the largest id."""
    value = F.when(F.col(column) == -1, F.lit((1 << 63) - 1)).otherwise(F.col(column)) if dict(df.dtypes)[column] != "string" else F.col(column)
    first = df.where(F.col(column).isNotNull()).groupBy(value.alias("__v")).agg(F.min(order).alias("__first"))
    codes = _codes(first, "__first", out).drop("__first")
    return df.withColumn("__x", value).join(codes, F.col("__x") == F.col("__v"), "left").drop("__x", "__v")


def hex_parse(token: Column, collide: bool = False) -> Column:
    """The number of a hexadecimal token; empty and NULL are -1, other text NULL.

    ``collide`` reads the digits a to f as 0 to 5, as data encoded by an older tool needs it.
    """
    t = F.lower(F.trim(token))
    if collide:
        t = F.translate(t, "abcdef", "012345")
    number = F.when(t.rlike("^[0-9a-f]{1,16}$"), F.conv(t, 16, 10).cast("decimal(20,0)"))
    small = F.when(number < F.lit(str(1 << 63)).cast("decimal(20,0)"), number.cast("bigint"))
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit(-1).cast("bigint")).otherwise(small)


def replicate(df: DataFrame, times: int, label: str, out: str) -> DataFrame:
    """Every row ``times`` times with ``out = label * times + r``."""
    return df.withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn(out, F.col(label) * times + F.col("__r")).drop("__r")


def mod_bucket(value: Column, buckets: int = 65536) -> Column:
    return F.pmod(value, F.lit(buckets).cast("bigint"))


def string_bucket(value: Column) -> Column:
    """A string's bucket in ``[0, 2**62)``; NULL hashes as the empty string."""
    return F.pmod(F.xxhash64(F.coalesce(value, F.lit(""))), F.lit(1 << 62))


def request_hash(indices: Column) -> Column:
    """One hash of an ordered index list, to match a prefetched request with its pull."""
    return F.xxhash64(indices)


def batches(df: DataFrame, order: list[str], size: int, out: str = "batch", full_only: bool = False) -> DataFrame:
    """Fixed-size count windows: ``out = row number div size``; an incomplete last batch can be left out."""
    numbered = row_numbers(df, order, "__rn").withColumn(out, F.floor(F.col("__rn") / size).cast("bigint"))
    if full_only:
        numbered = numbered.where(F.col("__rn") < df.count() // size * size)
    return numbered.drop("__rn")


def train_test_split(df: DataFrame, order: list[str], share: float = 0.8, batch: int = 1) -> DataFrame:
    """``is_test`` for an unshuffled split; both parts are cut to whole batches."""
    n = df.count()
    cut = int(n * share) // batch * batch
    rest = (n - int(n * share)) // batch * batch
    start = int(n * share)
    numbered = row_numbers(df, order, "__rn")
    kept = numbered.where((F.col("__rn") < cut) | ((F.col("__rn") >= start) & (F.col("__rn") < start + rest)))
    return kept.withColumn("is_test", F.col("__rn") >= start).drop("__rn")


def cardinalities(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, min, max, cardinality`` with cardinality ``max + 1``, one scan."""
    row = df.agg(*[F.min(c).cast("bigint").alias(f"a_{c}") for c in columns], *[F.max(c).cast("bigint").alias(f"b_{c}") for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").alias("min"), F.col(f"b_{c}").alias("max")) for c in columns])
    return row.select(F.explode(pairs).alias("x")).select("x.*").withColumn("cardinality", F.col("max") + 1)


def first_rows(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
