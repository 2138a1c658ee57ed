import random

import pytest
from pyspark.sql import functions as F

from quillstate.api import Context, layer_variable
from quillstate.streaming.keyed import adagrad_stream
from quillstate.types import StateError


def test_cycle_against_a_shadow_model(spark, tmp_path):
    """Random windows of keys with duplicates, two pushes a step, compared exactly."""
    r = random.Random(8)
    c = Context(spark, f"file://{tmp_path}")
    s = c.create_storage(5)
    v = s.create_variable(-1, 1, "float64", optimizer={"category": "test", "learning_rate": 1.0}, initializer={"category": "constant", "value": 100.0})
    w, flip = {}, {}
    for step in range(3):
        keys = [r.randrange(30) for _ in range(12)] * 2
        df = spark.createDataFrame([(k,) for k in keys], "key bigint")
        got = v.pull(df).collect()
        assert [x.key for x in got] == keys or sorted(x.key for x in got) == sorted(keys)
        assert all(x.weights[0] == w.get(x.key, 100.0) for x in got)
        pushed = [(k, [float(r.randrange(10))]) for k in keys[:9]] + [(99, [4.0])]
        v.push(spark.createDataFrame(pushed[:4], "key bigint, grad array<double>"))
        v.push(spark.createDataFrame(pushed[4:], "key bigint, grad array<double>"))
        assert s.update_weights() and s.batch_id == step + 1
        for k in keys:
            w.setdefault(k, 100.0)
        for k in {k for k, _ in pushed}:
            g = [x[0] for q, x in pushed if q == k]
            flip[k] = 10000.0 - flip.get(k, 0.0)
            w[k] = w.get(k, 100.0) + sum(g) / len(g) + flip[k]
        assert {x.key: x.weights[0] for x in v.rows().collect()} == pytest.approx(w)
    assert v.num_items() == len(w) and v.shard_sizes().count() == 5
    assert not s.update_weights(0)
    assert v.pull_with_state(spark.createDataFrame([(99,)], "key bigint")).first().slots.state == flip[99]


def test_read_only_and_limits(spark, tmp_path):
    c = Context(spark, f"file://{tmp_path}")
    s = c.create_storage()
    v = s.create_variable(10, 2, initializer={"category": "constant", "value": 3.0})
    keys = spark.createDataFrame([(1,), (9,)], "key bigint")
    assert [r.weights for r in v.pull(keys, train=False).collect()] == [[3.0, 3.0]] * 2
    s.update_weights()
    assert v.num_items() == 0
    v.pull(keys)
    s.update_weights()
    assert v.num_items() == 2
    with pytest.raises(StateError, match="too large version"):
        v.pull(keys, batch_id=2000)
    v.push(spark.createDataFrame([(10, [1.0, 1.0])], "key bigint, grad array<double>"))
    with pytest.raises(Exception, match="out of range"):
        s.update_weights()
    v.set_weights(spark.createDataFrame([(4, [1.0, 2.0])], "key bigint, weights array<float>"))
    assert v.num_items() == 3
    v.clear_weights()
    assert v.num_items() == 0
    c.delete_storage(s)
    with pytest.raises(StateError):
        c.save_model(f"file://{tmp_path}/m")


def test_models_and_layers(spark, tmp_path):
    c = Context(spark, f"file://{tmp_path}")
    s = c.create_storage(3)
    v = layer_variable(s, -1, 2, embeddings_initializer="Ones", optimizer="Adam", optimizer_config={"learning_rate": 0.5})
    with pytest.raises(StateError):
        layer_variable(s, 5, 2, regularizer="l2")
    v.push(spark.createDataFrame([(7, [1.0, -1.0], 2)], "key bigint, grad array<double>, cnt bigint"))
    s.update_weights()
    sign = c.save_model(f"file://{tmp_path}/model", 4)
    c.create_model(f"file://{tmp_path}/model")
    served = c.catalog.read_only_pull(sign, 0, spark.createDataFrame([(7,), (8,)], "key bigint")).orderBy("key").collect()
    assert served[0].weights == pytest.approx([0.5, 1.5], abs=1e-5) and served[1].weights == [1.0, 1.0]
    v.clear_weights()
    assert c.load_model(f"file://{tmp_path}/model") == sign and v.num_items() == 1


def test_keyed_stream(spark, tmp_path):
    src = tmp_path / "in"
    batches = [[(1, 1.0), (1, 2.0), (2, -1.0)], [(1, 0.5), (3, None)]]
    for rows in batches:
        spark.createDataFrame(rows, "key bigint, grad double").coalesce(1).write.mode("append").json(f"file://{src}")
    stream = spark.readStream.schema("key bigint, grad double").option("maxFilesPerTrigger", 1).json(f"file://{src}")
    q = adagrad_stream(stream, 0.1).writeStream.format("memory").queryName("keyed").outputMode("update").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    last = {r.key: r for r in spark.table("keyed").groupBy("key").agg(F.max_by("weight", "n_updates").alias("w"), F.max("n_updates").alias("n")).collect()}
    assert last[1].n == 2 and last[2].n == 1
    orders = []
    for order in ([3.0, 0.5], [0.5, 3.0]):  # files come in any order
        w, a = 0.0, 0.1
        for g in order:
            a += g * g
            w -= 0.1 * g / (a**0.5 + 1e-7)
        orders.append(pytest.approx(w))
    assert last[1].w in orders and last[3].w == 0.0
