"""Per-key training inside the stream: every key carries its own weight and slots as state.

The state is kept by the stream's state store (RocksDB where the session names it), so
there is no table to rewrite per micro-batch; it fits gradients that depend on their own
key only. Each micro-batch applies one update per key with the summed gradient and emits
the new row. A replayed micro-batch starts from the state before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "key bigint, weight double, accum double, n_updates bigint"


def adagrad_stream(stream: DataFrame, learning_rate: float = 0.001, initial_accumulator: float = 0.1, epsilon: float = 1e-7, initial_weight: float = 0.0) -> DataFrame:
    """``key, weight, accum, n_updates`` of every key a micro-batch touched; ``stream`` has ``key, grad``.

    NULL gradients add nothing; rows with a NULL key form a key of their own.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        weight, accum, n = state.get if state.exists else (initial_weight, initial_accumulator, 0)
        g = sum(float(f["grad"].sum()) for f in frames)
        accum += g * g
        weight -= learning_rate * g / (accum**0.5 + epsilon)
        state.update((weight, accum, n + 1))
        yield pd.DataFrame({"key": [key[0]], "weight": [weight], "accum": [accum], "n_updates": [n + 1]})

    return stream.select("key", "grad").groupBy("key").applyInPandasWithState(update, OUTPUT, "weight double, accum double, n_updates bigint", "update", GroupStateTimeout.NoTimeout)
