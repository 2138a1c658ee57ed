"""Pulls made ahead of their batch, matched by the hash of the batch's ordered list of keys."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstate.session import cut
from quillstate.types import StateError


def batch_hash(keys: DataFrame, key: str, pos: str) -> int:
    """A hash of the ordered list of a batch's keys: the sum of hashed (position, key) pairs, one pass, in any row order."""
    one = F.xxhash64(pos, key).cast("decimal(20,0)")
    return int(keys.agg(F.coalesce(F.sum(one), F.lit(0))).first()[0])


class PrefetchQueue:
    """At most ``steps`` pulls that were made and not taken yet.

    A pull is taken by the batch with the same ordered keys, once; of equal batches the oldest is taken.
    A batch that nothing was prefetched for is pulled when it comes. Rows are those of the version
    that was committed when the pull was made.
    """

    def __init__(self, pull: Callable[[DataFrame], DataFrame], steps: int = 2, key: str = "key", pos: str = "pos"):
        self.pull, self.steps, self.key, self.pos = pull, steps, key, pos
        self.waiting: OrderedDict[int, list[DataFrame]] = OrderedDict()
        self.hits = self.misses = 0

    def __len__(self) -> int:
        return sum(map(len, self.waiting.values()))

    def prefetch(self, keys: DataFrame) -> None:
        if len(self) >= self.steps:
            raise StateError(f"{self.steps} pulls are waiting to be taken")
        self.waiting.setdefault(batch_hash(keys, self.key, self.pos), []).append(cut(self.pull(keys)))

    def take(self, keys: DataFrame) -> DataFrame:
        h = batch_hash(keys, self.key, self.pos)
        if h not in self.waiting:
            self.misses += 1
            return self.pull(keys)
        self.hits += 1
        got = self.waiting[h].pop(0)
        if not self.waiting[h]:
            del self.waiting[h]
        return got
