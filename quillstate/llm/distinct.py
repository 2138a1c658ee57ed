"""Distinct identifiers per day range and combination of groups, exactly.

Hash-range decomposition. Identifiers belong to ``BUCKETS`` disjoint hash buckets. The (identifier,
groups) pairs are deduplicated with the set of their days as bit words (a bitwise OR, combined
map-side, so a hot identifier is one row per map task and group), and the distinct pairs go on
to the task of their (field, identifier): two exchanges, the first of combined rows,
the second of distinct pairs. There every requested combination of groups is formed from
deduplicated pairs, which keeps it exact, and every identifier adds to small counters. Buckets
are disjoint in identifiers, so counters of buckets add up to exact totals: the error is 0.
``range_counters`` can be asked for some of the buckets; its results for disjoint ranges of
buckets, made apart, are combined by ``merge``, an addition.

The counters are kept by (previous day, day): an identifier seen on days d1 < d2 < ... adds
one to (none, d1), (d1, d2), ... The identifiers present anywhere in [a, b] are then
exactly those counted at a day in [a, b] whose previous day lies before a, so one counter
table answers every day range.

Later days change the counters of identifiers seen before, so what is kept for adding
days is the state of the buckets (``bucket_state``: pairs with their days, per bucket), to
which ``merge_states`` adds the state of other days bucket by bucket.

Defined results: NULL and -1 identifiers are missing and count nowhere. In a combination
a group column that is left out (NULL in the request) stands for all rows, those with a
NULL group included; a requested value never matches a NULL group. A range with no rows
counts 0; a range that begins before ``first`` counts from ``first`` on. Rows without an
event day belong to no range. An empty table counts 0 everywhere.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 62
#: Hash buckets; fixed, so that counters and states of separate runs fit together.
BUCKETS = 4096


def bucket_of(id_: Column) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(BUCKETS)).cast("int")


def _n_words(first: date, last: date) -> int:
    return max(0, (last - first).days) // WORD + 1


def _day_words(day: Column, first: date, n_words: int) -> list[Column]:
    at = F.datediff(day, F.lit(first))
    return [
        F.bit_or(F.when(F.floor(at / WORD) == w, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(at, F.lit(WORD)).cast("int"))).otherwise(F.lit(0).cast("bigint"))).alias(f"w{w}")
        for w in range(n_words)
    ]


def bucket_state(pairs: DataFrame, groups: list[str], first: date, last: date, buckets: range | None = None) -> DataFrame:
    """``field, id, *groups, w0.., bucket``: distinct pairs with the bits of their days from ``first`` to ``last``.

    ``pairs``: ``field, id, day DATE`` and the group columns; ``buckets`` limits the work to some of them.
    """
    inside = pairs.where(F.col("day").between(F.lit(first), F.lit(last)) & F.col("id").isNotNull() & (F.col("id") != -1))
    if buckets is not None:
        inside = inside.where(bucket_of(F.col("id")).between(buckets.start, buckets.stop - 1))
    words = _day_words(F.col("day"), first, _n_words(first, last))
    return _by_identifier(inside.groupBy("field", "id", *groups).agg(*words))


def _by_identifier(distinct: DataFrame) -> DataFrame:
    """All rows of an identifier in one place; the bucket is named by its identifiers and does not travel."""
    return distinct.repartition("field", "id").withColumn("bucket", bucket_of(F.col("id")))


def merge_states(states: Iterable[DataFrame], groups: list[str]) -> DataFrame:
    """The state of the rows of some states made with the same ``first`` and number of words."""
    every = reduce(DataFrame.unionByName, states)
    words = [c for c in every.columns if c not in ("field", "bucket", "id", *groups)]
    return _by_identifier(every.groupBy("field", "id", *groups).agg(*[F.bit_or(w).alias(w) for w in words]))


def state_counters(state: DataFrame, groups: list[str], patterns: list[tuple[bool, ...]]) -> DataFrame:
    """Counters ``field, pattern, *groups, prev, day, n_ids`` of every combination in ``patterns``.

    A pattern says of each group column whether it is kept; ``pattern`` is its number as bits.
    ``prev`` and ``day`` are day numbers from the state's first day; ``prev`` is -1 for a first day.
    """
    words, types = [c for c in state.columns if c not in ("field", "bucket", "id", *groups)], dict(state.dtypes)
    kinds = F.array(*[
        F.struct(
            F.lit(sum(1 << i for i, k in enumerate(p) if k)).alias("pattern"),
            *[(F.col(g) if k else F.lit(None).cast(types[g])).alias(g) for g, k in zip(groups, p)],
        )
        for p in patterns
    ])
    combos = state.select("field", "id", *words, F.explode(kinds).alias("__k")).select("field", "id", *words, "__k.*")
    per_id = combos.groupBy("field", "id", "pattern", *groups).agg(*[F.bit_or(w).alias(w) for w in words])
    # identifiers with one set of days count together before days are listed
    sets = per_id.groupBy("field", "pattern", *groups, *words).agg(F.count(F.lit(1)).alias("__n"))

    def days_of(i: int) -> Column:
        return F.filter(F.sequence(F.lit(i * WORD), F.lit(i * WORD + WORD - 1)), lambda d: F.getbit(F.col(words[i]), d - F.lit(i * WORD)) == 1)

    steps = sets.withColumn("__d", F.concat(*map(days_of, range(len(words))))).select(
        "field", "pattern", *groups, "__n",
        F.explode(F.transform("__d", lambda d, i: F.struct(d.alias("day"), F.when(i == 0, F.lit(-1)).otherwise(F.get(F.col("__d"), i - 1)).alias("prev")))).alias("s"),
    )
    return steps.groupBy("field", "pattern", *groups, F.col("s.prev").alias("prev"), F.col("s.day").alias("day")).agg(F.sum("__n").alias("n_ids"))


def merge(counters: Iterable[DataFrame]) -> DataFrame:
    """Counters of disjoint ranges of buckets, added up."""
    every = reduce(DataFrame.unionByName, counters)
    return every.groupBy(*[c for c in every.columns if c != "n_ids"]).agg(F.sum("n_ids").alias("n_ids"))


def range_counters(pairs: DataFrame, groups: list[str], patterns: list[tuple[bool, ...]], first: date, last: date, buckets: range | None = None) -> DataFrame:
    """Counters of all identifiers, or of those in a range of buckets."""
    return state_counters(bucket_state(pairs, groups, first, last, buckets), groups, patterns)


def answer_ranges(counters: DataFrame, requests: DataFrame, key: str, groups: list[str], first: date) -> DataFrame:
    """``requests`` (``key, field, day_from, day_to`` and group columns, NULL for all) with ``n_ids``."""
    pattern = sum((F.when(F.col(g).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, g in enumerate(groups)), F.lit(0))
    r = requests.select(
        F.col(key).alias("__key"), F.col("field").alias("__field"), pattern.alias("__pattern"),
        *[F.col(g).alias(f"__{g}") for g in groups],
        F.greatest(F.lit(0), F.datediff("day_from", F.lit(first))).alias("__a"), F.datediff("day_to", F.lit(first)).alias("__b"),
    )
    cond = (F.col("__field") == F.col("field")) & (F.col("__pattern") == F.col("pattern"))
    for g in groups:
        cond = cond & F.col(f"__{g}").eqNullSafe(F.col(g))
    cond = cond & F.col("day").between(F.col("__a"), F.col("__b")) & (F.col("prev") < F.col("__a"))
    counted = r.join(counters, cond, "left").groupBy("__key").agg(F.coalesce(F.sum("n_ids"), F.lit(0)).cast("bigint").alias("n_ids"))
    return counted.withColumnRenamed("__key", key)
