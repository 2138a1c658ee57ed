"""Applying reduced gradients to keyed state, and ordered per-key training."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstate.operators.initializers import initializer
from quillstate.operators.optimizers import apply_to_arrays, fresh_slots, one_step, optimizer, start

def empty_state(spark, opt_config: dict, datatype: str = "double") -> DataFrame:
    from quillstate.operators.optimizers import slot_schema

    return spark.createDataFrame([], f"key bigint, weights array<{datatype}>, slots {slot_schema(optimizer(opt_config))}")


def apply_gradients(state: DataFrame, reduced: DataFrame, opt_config: dict, init_config: dict, dim: int, pulled: DataFrame | None = None, touched_only: bool = False, also: Column | None = None) -> DataFrame:
    """The next state: one update per key with a gradient, new rows for pulled keys without one.

    One outer join on the key; both sides hold a key once, so no key can be hot. Keys with
    neither gradient nor pull pass through, or are left out with ``touched_only``, but for those
    whose ``key`` meets ``also``. Weights are computed in double and cast to the state's element type once.
    """
    opt = optimizer(opt_config)
    touched = reduced.select("key", "grad", "cnt")
    if pulled is not None:
        keys = pulled.select("key").where("key is not null").distinct()
        touched = keys.join(touched, "key", "full_outer").select("key", "grad", "cnt")
    t = touched.select(F.col("key").alias("__key"), "grad", "cnt")
    joined = state.join(t, F.col("key") == F.col("__key"), "right_outer" if touched_only and also is None else "full_outer").withColumn("key", F.coalesce("key", "__key"))
    if touched_only and also is not None:
        joined = joined.where(F.col("__key").isNotNull() | also)
    w = F.coalesce(F.col("weights").cast("array<double>"), initializer(init_config).vector(F.col("key"), dim))
    s = F.coalesce("slots", fresh_slots(opt, dim))
    based = joined.select("key", w.alias("w"), s.alias("s"), "grad", "cnt")
    after = F.when(F.col("grad").isNotNull(), apply_to_arrays(opt, F.col("w"), F.col("s"), F.col("grad"), F.col("cnt"))).otherwise(F.struct(F.col("w").alias("weights"), F.col("s").alias("slots")))
    kind = state.schema["weights"].dataType
    return based.select("key", after.alias("n")).select("key", F.col("n.weights").cast(kind).alias("weights"), F.col("n.slots").alias("slots"))


def train_ordered(df: DataFrame, key: str, order: list[str], gradient: Column, opt_config: dict, w0: float = 0.0) -> DataFrame:
    """Per key, ``n_steps``, the weight and the slots after updating it by its gradients in order.

    Keys are independent, so rows are sorted by key and order inside hash partitions of the key
    (a sort that spills), and one pass over them carries the state of one key along: no
    history is collected, whatever its length, and no round reads a row twice. The steps of one
    key follow each other, as its order demands; ``streaming.loop`` is the way to spread a key's
    gradients. A NULL gradient makes the weight and slots of its key NULL from there on; NULL
    keys are one key.
    """
    opt = optimizer(opt_config)
    step, begin = one_step(opt), start(opt, w0)
    names = list(begin)
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], gradient.cast("double").alias("__g"))
    placed = rows.repartition("__key").sortWithinPartitions("__key", *[f"__o{i}" for i in range(len(order))]).select("__key", "__g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, n, state = None, 0, begin
        for b in batches:
            done: list[tuple] = []
            for k, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if n and k != current:
                    done.append((current, n, *[state and state[c] for c in names]))
                    n = 0
                if not n:
                    current, state = k, begin
                n += 1
                state = step(state, g) if state is not None and g is not None else None
            yield table(done, b.schema.field(0).type)
        if n:
            yield table([(current, n, *[state and state[c] for c in names])], b.schema.field(0).type)

    def table(done: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*done)) if done else [()] * (len(names) + 2)
        types = [key_type, pa.int64(), *[pa.float64()] * len(names)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["__key", "__n", *[f"__s{i}" for i in range(len(names))]])

    schema = ", ".join([f"__key {kind}", "__n bigint", *[f"__s{i} double" for i in range(len(names))]])
    out = placed.mapInArrow(run, schema)
    return out.select(F.col("__key").alias(key), F.col("__n").alias("n_steps"), *[F.col(f"__s{i}").alias(c) for i, c in enumerate(names)])
