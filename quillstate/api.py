"""A small front: storages, variables, and the pull, push, update cycle with its bookkeeping.

    context = Context(spark, "hdfs:///state")
    storage = context.create_storage()
    clicks = storage.create_variable(-1, 16, name="C1", optimizer={"category": "adagrad"})
    rows = clicks.pull(batch)            # remembers which keys were read
    clicks.push(gradients)               # key, grad[, cnt]; any number of times
    storage.update_weights()             # one step of every variable, one new version

Pulled keys without a row are inserted by the next update even if no gradient arrives;
gradients pushed late simply join the next update; read-only pulls leave no trace.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstate.operators import initializers, lookup, optimizers
from quillstate.operators.gradients import push_reduce
from quillstate.operators.sharding import shard_of
from quillstate.plans.catalog import Catalog, load_model, save_model
from quillstate.plans.store import Store
from quillstate.types import StateError, Variable, VariableMeta


class VariableHandle:
    def __init__(self, storage: Storage, variable: Variable):
        self.storage, self.variable = storage, variable
        self._grads: list[DataFrame] = []
        self._pulled: list[DataFrame] = []

    @property
    def variable_id(self) -> int:
        return self.variable.variable_id

    @property
    def meta(self) -> VariableMeta:
        return self.variable.meta

    def configure(self, *, initializer: dict | None = None, optimizer: dict | None = None) -> None:
        if initializer:
            initializers.initializer(initializer)
        if optimizer:
            optimizers.optimizer(optimizer)
        self.storage.store.configure(self.variable_id, initializer=initializer, optimizer_config=optimizer)

    def rows(self, version: int | None = None) -> DataFrame:
        return self.storage.store.read(self.variable_id, version)

    def pull(self, keys: DataFrame, key: str = "key", *, train: bool = True, batch_id: int | None = None, wait_seconds: float | None = None) -> DataFrame:
        """``keys`` with their weights at the committed version; a batch too far ahead is refused.

        With ``wait_seconds`` a pull for ``batch_id`` waits that long for the batches before it; late pulls
        read the committed version.
        """
        if batch_id is not None:
            self.storage.store.check_ahead(batch_id)
            if wait_seconds is not None:
                self.storage.store.wait_for(batch_id, seconds=wait_seconds)
        dense = self.meta.bounded and lookup.is_dense(self.meta.vocabulary_size)
        got = lookup.pull(keys, self.rows().select("key", "weights"), key, init=self.variable.initializer, meta=self.meta, broadcast_rows=lookup.DENSE_ROWS if dense else None)
        if train:
            self._pulled.append(lookup.check_keys(keys.select(F.col(key).alias("key")), "key", self.meta))
        return got

    def pull_with_state(self, keys: DataFrame, key: str = "key") -> DataFrame:
        return lookup.pull(keys, self.rows(), key, meta=self.meta, columns=("weights", "slots"))

    def push(self, gradients: DataFrame) -> None:
        """Queues rows ``key, grad`` (and ``cnt``); they are summed once, by the next update."""
        cnt = F.col("cnt") if "cnt" in gradients.columns else F.lit(1)
        rows = gradients.select("key", F.col("grad").cast("array<double>").alias("grad"), cnt.cast("bigint").alias("cnt"))
        self._grads.append(lookup.check_keys(rows, "key", self.meta))

    def _take(self) -> tuple[DataFrame | None, DataFrame | None]:
        grads, pulled = (reduce(DataFrame.unionByName, x) if x else None for x in (self._grads, self._pulled))
        self._grads, self._pulled = [], []
        return push_reduce(grads, ["key"], "grad", self.meta.embedding_dim, "cnt") if grads is not None else None, pulled

    def set_weights(self, rows: DataFrame) -> None:
        self.storage.store.upsert(self.variable_id, rows)

    def clear_weights(self) -> None:
        self.storage.store.clear(self.variable_id)

    def num_items(self) -> int:
        return self.rows().count()

    def shard_sizes(self) -> DataFrame:
        return self.rows().groupBy(shard_of(F.col("key"), self.storage.store.shard_num).alias("shard")).count()


class Storage:
    """Variables that share a shard layout and one batch counter."""

    def __init__(self, store: Store):
        self.store = store
        self.variables: list[VariableHandle] = []

    def create_variable(self, vocabulary_size: int, embedding_dim: int, datatype: str = "float32", *, name: str | None = None, initializer: dict | None = None, optimizer: dict | None = None) -> VariableHandle:
        """The next variable; a negative vocabulary size is unbounded."""
        i = len(self.variables)
        v = Variable(i, name or f"variable_{i}", VariableMeta(datatype, embedding_dim, vocabulary_size), self.store.storage)
        if initializer:
            initializers.initializer(initializer)
            v.initializer = initializer
        if optimizer:
            optimizers.optimizer(optimizer)
            v.optimizer = optimizer
        self.store.create_variable(v)
        self.variables.append(VariableHandle(self, v))
        return self.variables[-1]

    @property
    def batch_id(self) -> int:
        """The batch that the next update will be."""
        return self.store.last_batch() + 1

    def update_weights(self, batch_id: int | None = None) -> bool:
        """One optimizer step with everything pushed since the last one; False for a replayed batch."""
        batch_id = self.batch_id if batch_id is None else batch_id
        taken = {v.variable_id: v._take() for v in self.variables}
        return self.store.store(batch_id, {i: g for i, (g, _) in taken.items() if g is not None}, {i: p for i, (_, p) in taken.items() if p is not None})


class Context:
    """Storages and models below one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.storages: list[Storage] = []
        self.catalog = Catalog(spark, f"{self.root}/serving")

    def create_storage(self, shard_num: int = -1, retain: int = 2) -> Storage:
        """A storage; by default with as many shards as the session has cores."""
        n = shard_num if shard_num > 0 else max(1, self.spark.sparkContext.defaultParallelism)
        self.storages.append(Storage(Store(self.spark, f"{self.root}/state", f"storage_{len(self.storages)}", n, retain)))
        return self.storages[-1]

    def delete_storage(self, storage: Storage) -> None:
        storage.store.drop()
        self.storages.remove(storage)

    def _stores(self) -> list[Store]:
        if not self.storages:
            raise StateError("the context has no storage")
        return [s.store for s in self.storages]

    def save_model(self, uri: str, version: int = 0, include_optimizer: bool = True) -> str:
        return save_model(self._stores(), uri, version, include_optimizer)

    def load_model(self, uri: str) -> str:
        return load_model(self._stores(), uri)

    def create_model(self, uri: str, replica_num: int = 1, shard_num: int = -1) -> str:
        return self.catalog.create_model(uri, replica_num, shard_num)


def layer_variable(storage: Storage, input_dim: int, output_dim: int, *, embeddings_initializer: str = "RandomUniform", initializer_config: dict | None = None, optimizer: str | None = None, optimizer_config: dict | None = None, regularizer: object = None, constraint: object = None, explicit: bool = True) -> VariableHandle:
    """A variable from an embedding layer's settings; a sharded layer has no regularizer or constraint."""
    if explicit and (regularizer is not None or constraint is not None):
        raise StateError("regularizers and constraints do not apply to a sharded layer")
    made = storage.create_variable(input_dim, output_dim, initializer=initializers.from_layer_config(embeddings_initializer, initializer_config, explicit))
    if optimizer:
        made.configure(optimizer=optimizers.from_layer_config(optimizer, optimizer_config))
    return made
