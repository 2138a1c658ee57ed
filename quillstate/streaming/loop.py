"""Micro-batch training: each micro-batch pulls, reduces its gradients and commits one version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillstate.operators.gradients import push_reduce
from quillstate.operators.lookup import pull
from quillstate.plans.store import Store


def train_batch(store: Store, variable_id: int, batch: DataFrame, batch_id: int, gradient: Callable[[DataFrame], DataFrame], key: str = "key", stream: str = "steps") -> bool:
    """Pull, gradient, push, store for one batch; False if the batch of this stream was committed before.

    ``gradient`` turns the batch with its ``weights`` into rows ``key, grad``. The batch reads
    the committed version, and its commit is the only write.
    """
    if batch_id <= store.last_batch(stream):
        return False
    v = store.variables[variable_id]
    state = store.read(variable_id)
    keys = batch.withColumnRenamed(key, "key") if key != "key" else batch
    pulled = pull(keys, state.select("key", "weights"), init=v.initializer, meta=v.meta)
    reduced = push_reduce(gradient(pulled), ["key"], "grad", v.meta.embedding_dim)
    return store.store(batch_id, {variable_id: reduced}, {variable_id: keys.select("key")}, stream)


def train_stream(stream: DataFrame, store: Store, variable_id: int, gradient: Callable[[DataFrame], DataFrame], checkpoint: str, key: str = "key") -> StreamingQuery:
    """Runs ``train_batch`` for all data there is and stops; a replayed micro-batch changes nothing.

    Micro-batches are numbered by their checkpoint folder, which names the stream in the store: a new
    checkpoint starts a new stream, whatever the store has seen before.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        train_batch(store, variable_id, batch, batch_id, gradient, key, checkpoint)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
