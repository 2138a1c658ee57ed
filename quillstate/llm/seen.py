"""Has this key been seen before? Elias-Fano coded hash partitions.

Keys are hashed to ``hash_bits`` bits. The leading bits name one of ``partitions`` disjoint
hash ranges; inside a range the rest of the hash is a sorted set kept in Elias-Fano form
(see ``eliasfano``). Records come in batches, ordered slices of the stream. Each batch is
first reduced by SQL to its distinct keys with the first place of each (map-side combined,
so a key that holds a third of all rows is one row per map task); the distinct keys of a
batch are sorted by hash and probed by successor search, those not found are the first
occurrences, and they are merged into the set before the next batch. Batches run
sequentially inside a range, ranges run in parallel, and a range never holds more than
its coded set and one batch.

A record was seen iff it is not a first occurrence, so the answer for every record is an
anti join on the record's place, which no hot key can skew.

Wrong answers come only from two keys with one hash: a new key is reported as seen with
probability at most ``n / 2**hash_bits`` after ``n`` distinct keys (``error_bound``); a
seen key is never reported as new. ``hash_bits=64`` makes that about 5e-11 per record at
1e9 keys.

Defined results: NULL and -1 ids are missing and give no row; NULL in other key columns is
a value of its own; records that tie in their place share one verdict; records with a
NULL place come before all others; an empty stream gives no rows, an empty start set is
allowed. Only named columns are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstate.llm.eliasfano import EliasFano
from quillstate.session import shuffle_partitions

#: Distinct keys a hash range should hold at most; sets the number of ranges.
KEYS_PER_RANGE = 2_000_000
#: Slices a stream is cut into; each costs one merge of every range's set.
BATCHES = 8


def error_bound(n_keys: int, hash_bits: int = 64) -> float:
    """Chance that one new key is wrongly reported as seen after ``n_keys`` distinct keys."""
    return n_keys / 2.0**hash_bits


def range_bits(rows: int, at_least: int) -> int:
    return max(1, max(at_least - 1, rows // KEYS_PER_RANGE).bit_length())


def _first_occurrences(universe_bits: int):
    """Pandas batches sorted by (part, batch, h) -> places of first occurrences."""

    def groups(frames: Iterator[pd.DataFrame]):
        held: list[pd.DataFrame] = []
        for f in frames:
            if not len(f):
                continue
            edges = np.flatnonzero((np.diff(f["part"]) != 0) | (np.diff(f["batch"]) != 0)) + 1
            for a, b in zip(np.r_[0, edges], np.r_[edges, len(f)]):
                piece = f.iloc[a:b]
                if held and (held[0]["part"].iat[0], held[0]["batch"].iat[0]) != (piece["part"].iat[0], piece["batch"].iat[0]):
                    yield pd.concat(held)
                    held = []
                held.append(piece)
        if held:
            yield pd.concat(held)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, known = None, None
        for g in groups(frames):
            if g["part"].iat[0] != part:
                part, known = g["part"].iat[0], EliasFano.encode(np.zeros(0, np.uint64), universe_bits)
            h = g["h"].to_numpy().astype(np.uint64)
            fresh = ~known.contains(h)
            distinct = fresh & np.r_[True, h[1:] != h[:-1]]  # two keys with one hash: the later one counts as seen
            known = known.merge(h[distinct])
            if g["batch"].iat[0] >= 0:
                yield g.loc[distinct, ["stream", "rec", "pos"]]

    return run


def first_occurrences(stream: DataFrame, known: DataFrame | None, keys: list[str], *, hash_bits: int = 64, batches: int = BATCHES) -> DataFrame:
    """Places (``stream, rec, pos``) at which a key occurs for the first time.

    ``stream`` has ``stream STRING, rec BIGINT, pos INT`` and the key columns, ids already
    non-missing; ``known`` has ``stream`` and the key columns of keys seen before.
    """
    spark = stream.sparkSession
    b = stream.agg(F.count(F.lit(1)).alias("n"), F.min("rec").alias("lo"), F.max("rec").alias("hi")).first()
    # a range holds the keys known before as well as those of the stream
    pbits = range_bits(b["n"] + (known.count() if known is not None else 0), shuffle_partitions(spark))
    universe = hash_bits - pbits
    lo, hi = (b["lo"] or 0), (b["hi"] or 0)
    span = max(1, -(-(hi - lo + 1) // batches))
    h = F.xxhash64("stream", *keys)
    part = F.shiftrightunsigned(h, 64 - pbits).cast("int")
    rest = F.shiftrightunsigned(h.bitwiseAND(F.lit((1 << (64 - pbits)) - 1)), 64 - hash_bits)
    coded = [part.alias("part"), rest.alias("h")]
    # the key with its first place per batch; min over a struct keeps the aggregate algebraic
    batch = F.greatest(F.lit(0), F.floor((F.col("rec") - F.lit(lo)) / F.lit(span)).cast("int"))
    rows = stream.select("stream", F.coalesce(batch, F.lit(0)).alias("batch"), *coded, "rec", "pos")
    firsts = rows.groupBy("part", "batch", "stream", "h").agg(F.min(F.struct(F.col("rec").isNotNull().alias("a"), "rec", "pos")).alias("f"))
    firsts = firsts.select("part", "batch", "h", "stream", "f.rec", "f.pos")
    if known is not None:
        seeds = known.select(*coded, "stream").distinct()
        firsts = firsts.unionByName(
            seeds.select("part", F.lit(-1).alias("batch"), "h", "stream", F.lit(None).cast("bigint").alias("rec"), F.lit(None).cast("int").alias("pos"))
        )
    placed = firsts.repartitionById(1 << pbits, F.col("part")).sortWithinPartitions("part", "batch", "h", "rec", "pos")
    return placed.mapInPandas(_first_occurrences(universe), "stream string, rec bigint, pos int")


def seen_before(stream: DataFrame, known: DataFrame | None, keys: list[str], *, hash_bits: int = 64, batches: int = BATCHES) -> DataFrame:
    """Records of ``stream`` whose key occurred earlier: ``stream, rec, pos``."""
    new = first_occurrences(stream, known, keys, hash_bits=hash_bits, batches=batches)
    s, n = stream.select("stream", "rec", "pos").alias("s"), new.alias("n")
    same = (F.col("s.stream") == F.col("n.stream")) & F.col("s.rec").eqNullSafe(F.col("n.rec")) & F.col("s.pos").eqNullSafe(F.col("n.pos"))
    return s.join(n, same, "left_anti")


STATE = "part int, universe_bits int, n bigint, low binary, high binary"


def build_state(keys_df: DataFrame, keys: list[str], *, part_bits: int, hash_bits: int = 64) -> DataFrame:
    """The coded sets of ``keys_df`` as one row per hash range, to be written and updated later."""
    return update_state(keys_df.sparkSession.createDataFrame([], STATE), keys_df, keys, part_bits=part_bits, hash_bits=hash_bits)


def update_state(state: DataFrame, keys_df: DataFrame, keys: list[str], *, part_bits: int, hash_bits: int = 64) -> DataFrame:
    """``state`` with the keys of one more batch merged in, range by range."""
    universe = hash_bits - part_bits
    h = F.xxhash64(*keys)
    coded = keys_df.select(
        F.shiftrightunsigned(h, 64 - part_bits).cast("int").alias("part"),
        F.shiftrightunsigned(h.bitwiseAND(F.lit((1 << (64 - part_bits)) - 1)), 64 - hash_bits).alias("h"),
    ).distinct()

    def merge(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        known = EliasFano.encode(np.zeros(0, np.uint64), universe)
        if len(old):
            known = EliasFano.from_bytes(int(old["n"].iat[0]), universe, old["low"].iat[0], old["high"].iat[0])
        fresh = np.unique(new["h"].to_numpy().astype(np.uint64))
        known = known.merge(fresh[~known.contains(fresh)])
        n, low, high = known.to_bytes()
        return pd.DataFrame({"part": [key[0]], "universe_bits": [universe], "n": [n], "low": [low], "high": [high]})

    return state.groupBy("part").cogroup(coded.groupBy("part")).applyInPandas(merge, STATE)
