"""Pull: order- and duplicate-preserving lookup of keyed vectors with default rows.

A pull is one left join of the key stream with the state, so Catalyst and AQE choose
between broadcast and shuffle and split hot keys of the stream at run time. The position
column travels with the key; nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstate.operators.initializers import initializer
from quillstate.session import broadcast_if_small
from quillstate.types import StateError, VariableMeta

#: Tables of at most this many rows count as dense and are broadcast.
DENSE_ROWS = 64


def in_range(key: Column, meta: VariableMeta) -> Column:
    ok = key.isNotNull() & (key >= 0)
    return ok & (key < F.lit(meta.vocabulary_size).cast("bigint")) if meta.bounded else ok


def check_keys(df: DataFrame, key: str, meta: VariableMeta) -> DataFrame:
    """``df``; reading a row whose key is out of range raises, which fails the whole request."""
    k = F.col(key)
    return df.withColumn(key, F.when(in_range(k, meta), k).otherwise(F.raise_error(F.concat(F.lit("embedding index out of range: "), F.coalesce(k.cast("string"), F.lit("NULL"))))))


def invalid_keys(df: DataFrame, key: str, meta: VariableMeta) -> DataFrame:
    """The rows ``check_keys`` would reject."""
    return df.where(~in_range(F.col(key), meta))


def pull(
    keys: DataFrame, state: DataFrame, key: str = "key", *, init: dict | None = None, dim: int | None = None, meta: VariableMeta | None = None,
    broadcast_rows: int | None = None, columns: tuple[str, ...] = ("weights",), on: tuple[str, ...] = (),
) -> DataFrame:
    """``keys`` with the state's ``weights`` (default: the initializer's row) and ``is_new``.

    ``on`` names further key columns (such as ``variable_id``); ``columns`` the state
    columns to bring (``slots`` for a lookup with optimizer state). Keys of another type are cast to
    64-bit integers. Reading never writes:
    a missing key shows its initial row and stays missing.
    """
    if dict(keys.dtypes)[key] != "bigint":
        keys = keys.withColumn(key, F.col(key).cast("bigint"))
    if meta is not None:
        keys, dim = check_keys(keys, key, meta), meta.embedding_dim
    if init is not None and dim is None:
        raise StateError("a default row needs its dimension")
    names = [*on, key]
    right = state.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate([*on, "key"])], *[F.col(c).alias(f"__s_{c}") for c in columns], F.lit(True).alias("__hit"))
    if broadcast_rows is not None:
        right = broadcast_if_small(right, broadcast_rows)
    cond = F.lit(True)
    for i, c in enumerate(names):
        cond = cond & (F.col(c) == F.col(f"__k{i}"))
    joined = keys.join(right, cond, "left")
    out = []
    for c in columns:
        v = F.col(f"__s_{c}")
        if c == "weights" and init is not None:
            # a stored row wins, even where the default would do
            v = F.when(F.col("__hit"), v).otherwise(initializer(init).vector(F.col(key), dim).cast(state.schema[c].dataType))
        out.append(v.alias(c))
    return joined.select(*[F.col(c) for c in keys.columns], *out, F.col("__hit").isNull().alias("is_new"))


def new_rows(keys: DataFrame, state: DataFrame, init: dict, dim: int, key: str = "key") -> DataFrame:
    """Distinct pulled keys that have no row yet, with their initial weights; NULL keys give none."""
    fresh = keys.select(F.col(key).alias("key")).where("key is not null").distinct()
    return fresh.join(state.select("key"), "key", "left_anti").select("key", initializer(init).vector(F.col("key"), dim).alias("weights"))


def pull_ragged(rows: DataFrame, state: DataFrame, row_id: str, indices: str, *, init: dict, dim: int, on: tuple[str, ...] = ()) -> DataFrame:
    """``row_id, *on, vectors``: the vectors of each row's list in its order; empty and NULL lists give an empty list."""
    flat = rows.select(row_id, *on, F.posexplode_outer(indices).alias("pos", "key"))
    got = pull(flat, state, init=init, dim=dim, on=on)
    piece = F.when(F.col("pos").isNotNull(), F.struct("pos", "weights"))
    return got.groupBy(row_id, *on).agg(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["weights"]).alias("vectors"))  # as long as its own list


def is_dense(vocabulary_size: int, batch_size: int | None = None, dense_rows: int = DENSE_ROWS) -> bool:
    """Whether a variable is small enough to be replicated instead of looked up by shard."""
    return 0 <= vocabulary_size <= dense_rows or (batch_size is not None and 0 <= vocabulary_size < batch_size)


def hash_encode(df: DataFrame, columns: list[str], prime: int = 1_000_000_007) -> DataFrame:
    """Columns moved into one id space: ``(c + i * prime) mod 2**63``, ``i`` the column's ordinal."""
    low = F.lit((1 << 63) - 1)
    return df.withColumns({c: _wrap_add(F.col(c).cast("bigint"), i * prime, low) for i, c in enumerate(columns)})


def _wrap_add(c: Column, n: int, low: Column) -> Column:
    # beyond 2**63 - 1 the sum wraps to what is left over 2**63
    room = low - F.lit(n)
    return F.when(c > room, c - room - 1).otherwise(c + F.lit(n))


def offset_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns moved into one id space by running offsets of ``max + 1``; NULLs stay NULL."""
    tops = df.agg(*[F.coalesce(F.max(c) + 1, F.lit(0)).alias(c) for c in columns]).first()
    offset, moved = 0, {}
    for c in columns:
        moved[c] = F.col(c) + F.lit(offset).cast("bigint")
        offset += tops[c]
    return df.withColumns(moved)
