"""Percentiles per group with bounded rank error, mergeable over partitions and days.

Randomized compactor hierarchies. A sketch holds one buffer per level; an item of level h
stands for ``2**h`` values. A full buffer is sorted and every other item, starting at a
random one of the first two, moves up a level. Sketches merge levelwise: buffers of equal
level are joined and compacted again. One compaction at level h shifts any rank by at most
``2**h`` with mean zero, so with ``V`` the sum of ``4**h`` over all compactions a rank is
off by more than ``sqrt(V * ln(2 / delta) / 2) * 2`` with probability below ``delta``
(Hoeffding); every sketch carries its own ``V``. A group with at most ``k`` values is
never compacted, and its percentiles are exact.

Every map task keeps the sketches of its groups and emits them when they hold more than
``FLUSH`` items together; partial sketches are merged in two rounds, first in salted
subgroups, so neither a hot group nor a great number of tasks piles up in one reducer.

Defined results: percentiles interpolate linearly between the two neighbouring order
statistics. NULL and NaN values are not usable and count nowhere; a NULL group column is a
group of its own; groups without usable values give no row; infinities are ordered as
usual; empty tables give no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

K = 2048
DELTA = 1e-6
FLUSH = 2_000_000


class Compactors:
    """One mergeable sketch."""

    def __init__(self, k: int = K, n: int = 0, spread: float = 0.0, levels: list[np.ndarray] | None = None, seed: tuple[int, ...] = ()):
        self.k, self.n, self.spread, self.seed = k, n, spread, seed
        self.levels = levels or [np.zeros(0)]

    def size(self) -> int:
        return sum(map(len, self.levels))

    def add(self, values: np.ndarray) -> None:
        self.n += len(values)
        self.levels[0] = np.concatenate([self.levels[0], values])
        self._compact()

    def merge(self, other: Compactors) -> None:
        self.n += other.n
        self.spread += other.spread
        while len(self.levels) < len(other.levels):
            self.levels.append(np.zeros(0))
        for h, items in enumerate(other.levels):
            self.levels[h] = np.concatenate([self.levels[h], items])
        self._compact()

    def _compact(self) -> None:
        h = 0
        while h < len(self.levels):
            items = self.levels[h]
            if len(items) > self.k:
                items = np.sort(items)
                even = len(items) & ~1
                # fixed by the task, the group and what was seen: a retried task gives the same sketch,
                # and the coins of different tasks, groups, levels and times are independent
                start = np.random.default_rng([*self.seed, self.n, h, even]).integers(2)
                if h + 1 == len(self.levels):
                    self.levels.append(np.zeros(0))
                self.levels[h + 1] = np.concatenate([self.levels[h + 1], items[start:even:2]])
                self.levels[h] = items[even:]
                self.spread += 4.0**h
            h += 1

    def rank_error(self, delta: float = DELTA) -> float:
        return math.sqrt(2 * self.spread * math.log(2 / delta))

    def at_ranks(self, ranks: np.ndarray) -> np.ndarray:
        """Items at the given 0-based ranks, interpolated between neighbours where a rank is not whole."""
        items = np.concatenate(self.levels)
        weights = np.concatenate([np.full(len(x), 2**h, np.int64) for h, x in enumerate(self.levels)])
        order = np.argsort(items, kind="stable")
        items, upto = items[order], np.cumsum(weights[order])
        ranks = np.clip(ranks, 0, self.n - 1)
        low = np.floor(ranks).astype(np.int64)
        a = items[np.minimum(np.searchsorted(upto, low, side="right"), len(items) - 1)]
        b = items[np.minimum(np.searchsorted(upto, np.minimum(low + 1, self.n - 1), side="right"), len(items) - 1)]
        with np.errstate(invalid="ignore"):
            return np.where(ranks == low, a, a + (b - a) * (ranks - low))


def _pack(key_cols: list[str], keys: list[tuple], sketches: list[Compactors], salts: list[int] | None = None) -> pd.DataFrame:
    out = {c: pd.Series([k[i] for k in keys], dtype=object) for i, c in enumerate(key_cols)}
    if salts is not None:
        out["__salt"] = salts
    out["n"], out["spread"] = [s.n for s in sketches], [s.spread for s in sketches]
    out["sizes"] = [[len(x) for x in s.levels] for s in sketches]
    out["items"] = [np.concatenate(s.levels) for s in sketches]
    return pd.DataFrame(out)


def _unpack(k: int, n: int, spread: float, sizes: list[int], items: list[float]) -> Compactors:
    return Compactors(k, int(n), float(spread), np.split(np.asarray(items, float), np.cumsum(sizes)[:-1]))


def _null_to_none(key: tuple) -> tuple:
    return tuple(None if v is pd.NaT or (isinstance(v, float) and v != v) else v for v in key)


def _number(key: tuple) -> int:
    """A number that stands for a group, the same in every process."""
    return zlib.crc32(repr(key).encode())


def sketch(df: DataFrame, groups: list[str], value: str, k: int = K) -> DataFrame:
    """One sketch per group: ``*groups, n, spread, sizes, items``."""
    usable = df.select(*groups, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    group_fields = [usable.schema[g] for g in groups]
    state = [T.StructField("n", T.LongType()), T.StructField("spread", T.DoubleType()), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.DoubleType()))]
    salted = T.StructType([*group_fields, T.StructField("__salt", T.IntegerType()), *state])
    plain = T.StructType([*group_fields, *state])
    salts = max(1, math.isqrt(max(1, usable.rdd.getNumPartitions())))

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        salt, size, flushes = part % salts, 0, 0
        held: dict[tuple, Compactors] = {}
        for f in frames:
            values = f["__v"].to_numpy()
            for key, index in f.groupby(groups, dropna=False, sort=False).indices.items():
                key = _null_to_none(key if isinstance(key, tuple) else (key,))
                if key not in held:
                    held[key] = Compactors(k, seed=(part, flushes, _number(key)))
                held[key].add(values[index])
                size += len(index)
            if size > FLUSH:  # an upper bound of what is held since it was last counted
                size = sum(s.size() for s in held.values())
                if 2 * size > FLUSH:
                    yield _pack(groups, list(held), list(held.values()), [salt] * len(held))
                    held, size, flushes = {}, 0, flushes + 1
        if held:
            yield _pack(groups, list(held), list(held.values()), [salt] * len(held))

    def joined(pdf: pd.DataFrame, *seed: object) -> Compactors:
        total = Compactors(k, seed=(_number(seed),))
        for n, spread, sizes, items in zip(pdf["n"], pdf["spread"], pdf["sizes"], pdf["items"]):
            total.merge(_unpack(k, n, spread, sizes, items))
        return total

    def merge_salted(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _pack(groups, [_null_to_none(key[:-1])], [joined(pdf, "salted", *key)], [key[-1]])

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _pack(groups, [_null_to_none(key)], [joined(pdf, "all", *key)])

    partial = usable.mapInPandas(build, salted)
    if salts > 1:
        partial = partial.groupBy(*groups, "__salt").applyInPandas(merge_salted, salted)
    return partial.groupBy(*groups).applyInPandas(merge, plain)


def merge_sketches(sketches: DataFrame, groups: list[str], k: int = K) -> DataFrame:
    """Sketches of finer groups (say, days) merged into those of ``groups``."""
    schema = T.StructType([*[sketches.schema[g] for g in groups], *[sketches.schema[c] for c in ("n", "spread", "sizes", "items")]])

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = Compactors(k, seed=(_number(("merged", *key)),))
        for n, spread, sizes, items in zip(pdf["n"], pdf["spread"], pdf["sizes"], pdf["items"]):
            total.merge(_unpack(k, n, spread, sizes, items))
        return _pack(groups, [_null_to_none(key)], [total])

    return sketches.groupBy(*groups).applyInPandas(merge, schema)


def percentiles(sketches: DataFrame, groups: list[str], pcts: list[int], k: int = K, delta: float = DELTA) -> DataFrame:
    """``*groups, pct, n, value, low, high``: the true percentile lies in [low, high] but for chance ``delta``."""
    schema = T.StructType([
        *[sketches.schema[g] for g in groups],
        T.StructField("pct", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("value", T.DoubleType()), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType()),
    ])

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            parts = []
            for row in f.itertuples(index=False):
                s = _unpack(k, row.n, row.spread, row.sizes, row.items)
                rank, err = np.asarray(pcts) / 100 * (s.n - 1), s.rank_error(delta)
                if not err:
                    value = low = high = s.at_ranks(rank)
                else:
                    value, low, high = s.at_ranks(rank), s.at_ranks(np.floor(rank - err)), s.at_ranks(np.ceil(rank + 1 + err))
                parts.append(pd.DataFrame({**{g: pd.Series([getattr(row, g)] * len(pcts), dtype=object) for g in groups}, "pct": pcts, "n": s.n, "value": value, "low": low, "high": high}))
            if parts:
                yield pd.concat(parts)

    return sketches.mapInPandas(ask, schema)


def exact_beyond(df: DataFrame, asked: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Exact percentiles compared with two limits, by counting.

    ``asked`` has the groups, ``pct``, ``low_limit`` and ``high_limit``. For each limit the
    rows at or below it are counted and the nearest value on either side is kept, which is
    all it takes to place the interpolated percentile; nothing is collected per group.
    Returns ``*groups, pct, beyond BOOLEAN`` (below ``low_limit`` or above ``high_limit``).
    """
    v = F.col("__v")
    rows = df.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col(value).cast("double").alias("__v"))
    rows = rows.where(v.isNotNull() & ~F.isnan(v))
    cond = F.lit(True)
    for i, g in enumerate(groups):
        cond = cond & F.col(f"__g{i}").eqNullSafe(F.col(g))

    def side(limit: str) -> list:
        at_most = v < F.col(limit) if limit == "low_limit" else v <= F.col(limit)
        return [F.count(F.when(at_most, 1)).alias("le_" + limit), F.max(F.when(at_most, v)).alias("below_" + limit), F.min(F.when(~at_most, v)).alias("above_" + limit)]

    agg = rows.join(asked, cond).groupBy(*groups, "pct", "low_limit", "high_limit").agg(F.count(F.lit(1)).alias("n"), *side("low_limit"), *side("high_limit"))
    rank = F.col("pct") / F.lit(100.0) * (F.col("n") - 1)
    at, frac = F.floor(rank), rank - F.floor(rank)

    def exceeds(limit: str, below: bool):
        le, b, a = F.col("le_" + limit), F.col("below_" + limit), F.col("above_" + limit)
        x = F.when(frac == 0, F.when(le > at, b).otherwise(a)).otherwise(
            F.when(le >= at + 2, b).when(le <= at, a).otherwise(b + (a - b) * frac)
        )  # where both neighbours lie on one side, any value of that side decides alike
        return x < F.col(limit) if below else x > F.col(limit)

    return agg.select(*groups, "pct", (exceeds("low_limit", True) | exceeds("high_limit", False)).alias("beyond"))
