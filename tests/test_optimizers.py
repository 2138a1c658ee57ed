"""The column expressions against a NumPy model, over many configurations and steps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstate.operators.optimizers import apply_to_arrays, fresh_slots, from_layer_config, optimizer
from quillstate.operators.training import apply_gradients, train_ordered
from quillstate.types import StateError

CONFIGS = [{"category": "default"}, {"category": "default", "learning_rate": 0.3}, {"category": "test"}, {"category": "test", "flip": 3, "learning_rate": 1}]
CONFIGS += [{"category": "sgd", "momentum": m, "nesterov": n, "learning_rate": lr} for m in (0.0, 0.9) for n in (False, True) for lr in (0.01, 0.5)]
CONFIGS += [{"category": "adagrad", "initial_accumulator_value": a, "epsilon": e} for a in (0.1, 1.0) for e in (1e-7, 1e-3)]
CONFIGS += [{"category": "adadelta", "rho": r, "learning_rate": lr} for r in (0.95, 0.5) for lr in (0.001, 1.0)]
CONFIGS += [{"category": c, "beta_1": b, "learning_rate": lr} for c in ("adam", "adamax") for b in (0.9, 0.5) for lr in (0.001, 0.1)]
CONFIGS += [{"category": "ftrl"}, {"category": "ftrl", "l1_regularization_strength": 0.1, "l2_regularization_strength": 0.2}, {"category": "ftrl", "learning_rate_power": -0.7, "beta": 0.3}, {"category": "ftrl", "l2_shrinkage_regularization_strength": 0.05}]
CONFIGS += [{"category": "rmsprop", "momentum": m, "rho": r} for m in (0.0, 0.9) for r in (0.9, 0.5)]


def shadow(c, w, grads):
    o = optimizer(c)
    s = {k: np.full_like(w, v) for k, v in o.slots().items()}
    r = dict(o.scalars())
    for g in grads:
        k = c["category"]
        if k == "default":
            w = w - o.learning_rate * g
        elif k == "test":
            r["state"] = o.flip - r["state"]
            w = w + o.learning_rate * g / 2 + r["state"]
        elif k == "sgd":
            s["moment"] = o.momentum * s["moment"] + o.learning_rate * g
            w = w - (o.momentum * s["moment"] + o.learning_rate * g if o.nesterov else s["moment"])
        elif k == "adagrad":
            s["accum"] = s["accum"] + g * g
            w = w - o.learning_rate * g / (np.sqrt(s["accum"]) + o.epsilon)
        elif k == "adadelta":
            s["accum"] = o.rho * s["accum"] + (1 - o.rho) * g * g
            u = g * np.sqrt(s["accum_update"] + o.epsilon) / np.sqrt(s["accum"] + o.epsilon)
            s["accum_update"] = o.rho * s["accum_update"] + (1 - o.rho) * u * u
            w = w - o.learning_rate * u
        elif k == "adam":
            r = {"beta_1_t": r["beta_1_t"] * o.beta_1, "beta_2_t": r["beta_2_t"] * o.beta_2}
            s["m"] = o.beta_1 * s["m"] + (1 - o.beta_1) * g
            s["v"] = o.beta_2 * s["v"] + (1 - o.beta_2) * g * g
            w = w - o.learning_rate * np.sqrt(1 - r["beta_2_t"]) / (1 - r["beta_1_t"]) * s["m"] / (np.sqrt(s["v"]) + o.epsilon)
        elif k == "adamax":
            r = {"beta_1_t": r["beta_1_t"] * o.beta_1}
            s["m"] = o.beta_1 * s["m"] + (1 - o.beta_1) * g
            s["v"] = np.maximum(abs(g), o.beta_2 * s["v"])
            w = w - o.learning_rate / (1 - r["beta_1_t"]) * s["m"] / (s["v"] + o.epsilon)
        elif k == "ftrl":
            p = -o.learning_rate_power
            l2 = o.l2_regularization_strength + o.beta / (2 * o.learning_rate)
            shrunk = g + 2 * o.l2_shrinkage_regularization_strength * w
            a = s["accum"] + g * g
            sigma = (a**p - s["accum"] ** p) / o.learning_rate
            s["linear"] = s["linear"] + shrunk - sigma * w
            s["accum"] = a
            z, l1 = s["linear"], o.l1_regularization_strength
            w = (np.clip(z, -l1, l1) - z) / (a**p / o.learning_rate + 2 * l2)
        elif k == "rmsprop":
            s["accum"] = o.rho * s["accum"] + (1 - o.rho) * g * g
            s["moment"] = o.momentum * s["moment"] + o.learning_rate * g / np.sqrt(s["accum"] + o.epsilon)
            w = w - s["moment"]
    return w


@pytest.mark.parametrize("config", CONFIGS, ids=lambda c: "-".join(map(str, c.values())))
def test_against_numpy(spark, config):
    rng = np.random.default_rng(3)
    grads, w0, o = rng.uniform(-1, 1, (6, 3)), np.array([1.0, -0.5, 0.0]), optimizer(config)
    row = spark.range(1).select(F.struct(F.array(*[F.lit(float(x)) for x in w0]).alias("weights"), fresh_slots(o, 3).alias("slots")).alias("s"))
    for g in grads:
        row = row.select(apply_to_arrays(o, F.col("s.weights"), F.col("s.slots"), F.array(*[F.lit(float(x)) for x in g]), F.lit(2)).alias("s"))
        row = spark.createDataFrame(row.collect(), row.schema)
    assert np.allclose(row.first().s.weights, shadow(config, w0, grads), rtol=1e-9, atol=1e-12)


def test_idle_rows_do_not_change(spark):
    c, i = {"category": "adam"}, {"category": "constant", "value": 2.0}
    state = spark.createDataFrame([(1, [1.0], ([0.3], [0.2], 0.9, 0.99)), (2, [4.0], ([0.0], [0.0], 1.0, 1.0))], "key bigint, weights array<double>, slots struct<m: array<double>, v: array<double>, beta_1_t: double, beta_2_t: double>")
    grads = spark.createDataFrame([(2, [1.0], 1), (9, [1.0], 3)], "key bigint, grad array<double>, cnt bigint")
    pulled = spark.createDataFrame([(7,), (7,), (None,)], "key bigint")
    got = {r.key: r for r in apply_gradients(state, grads, c, i, 1, pulled).collect()}
    assert set(got) == {1, 2, 7, 9}
    assert got[1].weights == [1.0] and got[1].slots.m == [0.3] and got[1].slots.beta_1_t == 0.9
    assert got[7].weights == [2.0] and got[7].slots.beta_1_t == 1.0
    assert got[9].weights[0] < 2.0 and got[2].weights[0] < 4.0


def test_float_state_is_cast_once(spark):
    state = spark.createDataFrame([(1, [0.1])], "key bigint, weights array<float>").withColumn("slots", fresh_slots(optimizer({"category": "default"}), 1))
    grads = spark.createDataFrame([(1, [1.0], 1)], "key bigint, grad array<double>, cnt bigint")
    new = apply_gradients(state, grads, {"category": "default", "learning_rate": 0.1}, {}, 1)
    assert dict(new.dtypes)["weights"] == "array<float>"
    assert abs(new.first().weights[0]) < 1e-7


def test_names_and_options():
    assert from_layer_config("Adam", {"learning_rate": 0.1, "name": "x", "amsgrad": False}) == {"category": "adam", "learning_rate": 0.1}
    for bad in ("Nadam", "Unknown"):
        with pytest.raises(StateError):
            from_layer_config(bad)
    with pytest.raises(StateError):
        from_layer_config("Adam", {"amsgrad": True})
    with pytest.raises(StateError):
        optimizer({"category": "nadam"})
    with pytest.warns(UserWarning):
        optimizer({"category": "sgd", "nonsense": 1})


@pytest.mark.parametrize("config", [{"category": "adam"}, {"category": "sgd", "momentum": 0.9}, {"category": "test"}], ids=lambda c: c["category"])
def test_long_histories_are_carried_from_batch_to_batch(spark, config):
    rng = np.random.default_rng(4)
    rows = [(k, i, float(g)) for k, n in ((1, 23), (2, 5), (None, 11), (3, 1)) for i, g in enumerate(rng.uniform(-1, 1, n))]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "key bigint, at int, g double").withColumn("w", F.lit("clash"))
    once = {r.key: (r.n_steps, r.w) for r in train_ordered(df, "key", ["at"], F.col("g"), config, 1.0).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        parts = {r.key: (r.n_steps, r.w) for r in train_ordered(df, "key", ["at"], F.col("g"), config, 1.0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert once == parts and {k: n for k, (n, _) in once.items()} == {1: 23, 2: 5, None: 11, 3: 1}
    assert train_ordered(df.limit(0), "key", ["at"], F.col("g"), config).count() == 0
    some = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("a", 3, 1.0), ("b", 1, 1.0)], "key string, at int, g double")
    got = {r.key: (r.n_steps, r.w) for r in train_ordered(some, "key", ["at"], F.col("g"), config, 1.0).collect()}
    assert got["a"] == (3, None) and got["b"][1] is not None
