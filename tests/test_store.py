import pytest
from pyspark.sql import functions as F

from quillstate.operators.gradients import push_reduce
from quillstate.operators.lookup import pull
from quillstate.plans import store as st
from quillstate.plans.catalog import Catalog, load_beside, load_model, save_beside, save_model
from quillstate.streaming.loop import train_batch
from quillstate.types import StateError, Variable, VariableMeta, model_meta_json, parse_model_meta


def make(spark, path, dim=2, shards=3, **kw):
    s = st.Store(spark, f"file://{path}", "storage_0", shards)
    s.create_variable(Variable(0, "C0", VariableMeta("float64", dim), **kw))
    return s


def weights(df):
    return {r.key: list(r.weights) for r in df.collect()}


def test_golden_pull_push(spark, tmp_path):
    """Rows start at 100, gradients are the keys, the flipping optimizer moves by mean + 10000."""
    s = make(spark, tmp_path, optimizer={"category": "test", "learning_rate": 1.0}, initializer={"category": "constant", "value": 100.0})
    keys = [*range(20), *[107 * i % 20 for i in range(20)]]  # every key twice
    grads = spark.createDataFrame([(k, [float(k)] * 2) for k in keys], "key bigint, grad array<double>")
    assert s.store(0, {0: push_reduce(grads, ["key"], "grad", 2)})
    assert weights(s.read(0)) == {k: [k + 100.0 + 10000.0] * 2 for k in range(20)}
    assert s.store(1, {0: push_reduce(grads, ["key"], "grad", 2)})
    assert weights(s.read(0)) == {k: [2 * k + 100.0 + 10000.0] * 2 for k in range(20)}
    before = weights(s.read(0))
    assert not s.store(0, {0: push_reduce(grads, ["key"], "grad", 2)})
    assert weights(s.read(0)) == before and s.version == 2


def folders(s):
    return [n for n in s.files.names("storage_0") if n.startswith("v=")]


def rows_written(s, version):
    """Rows in the folders that one version wrote."""
    return sum(s.spark.read.parquet(f"{s.files.root}/storage_0/{n}").count() for n in folders(s) if st.version_of(n) == version)


def test_versions_and_limits(spark, tmp_path):
    s = make(spark, tmp_path)
    assert s.version is None and s.read(0).count() == 0
    with pytest.raises(StateError, match="too large version"):
        s.store(1025, {})
    for b in range(6):
        s.store(b, {}, {0: spark.range(b + 1).withColumnRenamed("id", "key")})
    assert s.version == 6 and s.last_batch() == 5
    assert s.read(0, 4).count() == 4 and s.read(0).count() == 6
    s.clear(0)
    assert s.read(0).count() == 0 and s.version == 7 and s.last_batch() == 5
    with pytest.raises(StateError):
        s.store(5000, {})
    s.drop()
    assert s.version is None


def test_old_versions_go_when_they_are_old(spark, tmp_path):
    s = make(spark, tmp_path)
    s.grace_seconds = 0
    for b in range(6):
        s.store(b, {}, {0: spark.range(b + 1).withColumnRenamed("id", "key")})
    assert s.files.names("storage_0", "_manifests") == ["4", "5", "6"] and s.read(0, 4).count() == 4 and s.read(0).count() == 6
    with pytest.raises(StateError, match="no version 3"):
        s.read(0, 3)
    used = {f for v in (4, 5, 6) for held in s._manifest(v)["variables"]["0"]["shards"].values() for f, _ in held}
    assert set(folders(s)) == used


def test_a_reader_keeps_its_version(spark, tmp_path):
    s = make(spark, tmp_path, dim=1)
    s.upsert(0, spark.createDataFrame([(1, [1.0])], "key bigint, weights array<double>"))
    old = s.read(0)
    for i in range(6):
        s.upsert(0, spark.createDataFrame([(1, [float(i)]), (i + 2, [9.0])], "key bigint, weights array<double>"))
    assert weights(old) == {1: [1.0]} and weights(s.read(0))[1] == [5.0]


def test_of_two_writers_one_is_refused(spark, tmp_path):
    a, b = make(spark, tmp_path, dim=1), make(spark, tmp_path, dim=1)
    row = lambda v: spark.createDataFrame([(1, [v])], "key bigint, weights array<double>")
    a.upsert(0, row(1.0))
    stale = b._manifest()
    a.upsert(0, row(2.0))
    written = b._put(stale, 0, b.read(0, 1))
    with pytest.raises(StateError, match="another writer"):
        b._commit(stale, written)
    assert weights(b.read(0)) == {1: [2.0]} and not set(written) & set(folders(a))
    b.upsert(0, row(3.0))
    assert weights(a.read(0)) == {1: [3.0]} and a.version == 3


def test_batches_are_counted_apart_from_versions(spark, tmp_path):
    s = make(spark, tmp_path, dim=1, optimizer={"category": "sgd", "learning_rate": 1.0})
    row = spark.createDataFrame([(1, [10.0])], "key bigint, weights array<double>")
    s.upsert(0, row)
    s.upsert(0, row)
    batch = spark.createDataFrame([(1,)], "key bigint")
    down = lambda p: p.select("key", F.array(F.lit(1.0)).alias("grad"))
    assert train_batch(s, 0, batch, 0, down) and weights(s.read(0)) == {1: [9.0]}
    assert not train_batch(s, 0, batch, 0, down)
    assert train_batch(s, 0, batch, 0, down, stream="another") and weights(s.read(0)) == {1: [8.0]}
    assert (s.last_batch(), s.last_batch("another"), s.last_batch("none")) == (0, 0, -1)
    s.wait_for(1)
    with pytest.raises(StateError, match="waits"):
        s.wait_for(2)


def test_a_step_writes_the_rows_it_touches(spark, tmp_path):
    s = make(spark, tmp_path, shards=4, initializer={"category": "constant", "value": 1.0}, optimizer={"category": "sgd", "learning_rate": 1.0})
    s.upsert(0, spark.createDataFrame([(k, [float(k), 0.0]) for k in range(400)], "key bigint, weights array<double>"))
    assert rows_written(s, 1) == 400
    step = lambda keys: spark.createDataFrame([(k, [1.0, 1.0], 1) for k in keys], "key bigint, grad array<double>, cnt bigint")
    for b in range(3):
        assert s.store(b, {0: step([5, 401, b])})
        assert rows_written(s, b + 2) == 3
    got = weights(s.read(0))
    assert got[5] == [2.0, -3.0] and got[401] == [-2.0, -2.0] and got[0] == [-1.0, -1.0] and got[6] == [6.0, 0.0] and len(got) == 401
    assert weights(s.read(0, 2))[5] == [4.0, -1.0] and len(weights(s.read(0, shards=[2]))) == 100
    # half a shard changes: the commit writes that shard anew, once, and no other
    s.store(3, {0: step(range(3, 400, 8))})
    held = s._manifest()["variables"]["0"]["shards"]
    assert len(held["3"]) == 1 and held["3"][0][1] == 100 and len(held["1"]) > 1 and rows_written(s, 5) == 100
    assert len(weights(s.read(0))) == 401 and weights(s.read(0))[3] == [2.0, -1.0]


def test_many_small_changes_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "MAX_CHANGES", 3)
    s = make(spark, tmp_path, dim=1, shards=1)
    s.upsert(0, spark.createDataFrame([(k, [0.0]) for k in range(100)], "key bigint, weights array<double>"))
    sizes = []
    for i in range(5):
        s.upsert(0, spark.createDataFrame([(i, [1.0 + i])], "key bigint, weights array<double>"))
        sizes.append(len(s._manifest()["variables"]["0"]["shards"]["0"]))
    assert sizes == [2, 3, 1, 2, 3] and [weights(s.read(0))[i] for i in range(5)] == [[1.0], [2.0], [3.0], [4.0], [5.0]]


def test_other_optimizer_without_rewriting(spark, tmp_path):
    s = make(spark, tmp_path, dim=1, optimizer={"category": "adagrad"})
    g = spark.createDataFrame([(1, [2.0], 1), (2, [2.0], 1)], "key bigint, grad array<double>, cnt bigint")
    s.store(0, {0: g})
    before = folders(s)
    s.configure(0, optimizer_config={"category": "adadelta"})
    assert folders(s) == before and s.read(0, 1).first().slots.accum == [4.1]
    assert all(r.slots.accum == [0.0] and r.slots.accum_update == [0.0] for r in s.read(0).collect())
    s.store(1, {0: g.where("key = 2")})
    got = {r.key: r for r in s.read(0).collect()}
    assert got[1].slots.accum == [0.0] and got[2].slots.accum[0] > 0 and got[1].weights == s.read(0, 1).where("key = 1").first().weights


def test_keys_out_of_range_are_refused_by_every_way_in(spark, tmp_path):
    s = st.Store(spark, f"file://{tmp_path}", "storage_0", 2)
    s.create_variable(Variable(0, "C0", VariableMeta("float64", 1, 10)))
    for bad in (10, -1):
        g = spark.createDataFrame([(bad, [1.0], 1)], "key bigint, grad array<double>, cnt bigint")
        for call in (lambda g=g: s.store(0, {0: g}), lambda g=g: s.store(0, {}, {0: g}), lambda g=g: s.upsert(0, g.select("key", F.col("grad").alias("weights")))):
            with pytest.raises(Exception, match="out of range"):
                call()
    assert s.version is None


def test_blocks_and_null_sink(spark, tmp_path):
    state = spark.createDataFrame([(k, [float(k)]) for k in range(25)], "key bigint, weights array<double>")
    blocks = list(st.read_blocks(state, 10))
    assert [b.num_rows for b in blocks] == [10, 10, 5] and blocks[1]["key"].to_pylist() == list(range(10, 20))
    assert [b["key"].to_pylist()[0] for b in st.read_blocks(state, 10, after=19)] == [20] and not list(st.read_blocks(state.limit(0), 4))
    assert {r.block: r["count"] for r in st.numbered_blocks(state, 10).groupBy("block").count().collect()} == {0: 10, 1: 10, 2: 5}
    st.dump(state, "null:///x", 0, 3)
    sink = st.Files(spark, "null:///x")
    assert sink.write("text", "a") and not sink.exists("a") and sink.names() == []
    with pytest.raises(StateError, match="bounded"):
        st.export_dense(state, 1 << 63, {"category": "constant"}, 1)


def test_meta_guard(spark, tmp_path):
    s = make(spark, tmp_path)
    with pytest.raises(StateError, match="does not match"):
        s.create_variable(Variable(0, "C0", VariableMeta("float64", 3)))
    for bad in ("int32", "int64", "text"):
        with pytest.raises(StateError):
            VariableMeta(bad, 1)
    text = model_meta_json("s-1", [Variable(0, "a", VariableMeta("float32", 4, 10))])
    assert parse_model_meta(text)[1][0].meta == VariableMeta("float32", 4, 10)
    with pytest.raises(StateError, match="version"):
        parse_model_meta(text.replace('"0.2"', '"0.1"'))


@pytest.mark.parametrize("shards", [1, 3, 7, 111, 256])
def test_reshard(spark, tmp_path, shards):
    keys = [0, 1, 2, 110, 111, 255, 256, (1 << 62) + 5, (1 << 63) - 2]
    state = spark.createDataFrame([(k, [float(i)]) for i, k in enumerate(keys)], "key bigint, weights array<double>")
    path = f"file://{tmp_path}/dump"
    st.dump(state, path, 4, shards)
    back = st.load(spark, path, 4)
    assert weights(back) == {k: [float(i)] for i, k in enumerate(keys)}
    placed = st.reshard(back, 5).select("key", "shard", F.spark_partition_id().alias("p")).collect()
    assert all(r.shard == r.key % 5 == r.p for r in placed)
    assert sorted(st.load(spark, path, 4, [0]).select("key").toPandas()["key"]) == [k for k in keys if k % shards == 0]


def test_load_without_slots_starts_fresh(spark, tmp_path):
    s = make(spark, tmp_path / "a", dim=1, optimizer={"category": "adagrad"})
    grads = spark.createDataFrame([(3, [2.0], 1)], "key bigint, grad array<double>, cnt bigint")
    s.store(0, {0: grads})
    assert s.read(0).first().slots.accum == [4.1]
    for include, accum in ((True, 4.1), (False, 0.1)):
        uri = f"file://{tmp_path}/model{include}"
        sign = save_model([s], uri, 7, include)
        assert sign.endswith("-7")
        other = make(spark, tmp_path / f"b{include}", dim=1, shards=5, optimizer={"category": "adagrad"})
        assert load_model([other], uri) == sign
        row = other.read(0).first()
        assert row.key == 3 and row.slots.accum == [accum] and row.weights == s.read(0).first().weights


def test_saved_beside_a_dense_model(spark, tmp_path):
    s = make(spark, tmp_path / "s")
    s.upsert(0, spark.createDataFrame([(1, [1.0, 2.0])], "key bigint, weights array<double>"))
    for file_style in (False, True):
        path = f"file://{tmp_path}/m{file_style}"
        save_beside([s], path, file_style)
        t = make(spark, tmp_path / f"t{file_style}")
        load_beside([t], path)
        assert weights(t.read(0)) == {1: [1.0, 2.0]}
    with pytest.raises(StateError):
        load_beside([s], f"file://{tmp_path}/none")


def test_upsert_replaces_and_keeps(spark, tmp_path):
    s = make(spark, tmp_path, dim=1)
    s.upsert(0, spark.createDataFrame([(1, [1.0]), (2, [2.0])], "key bigint, weights array<double>"))
    s.upsert(0, spark.createDataFrame([(2, [5.0]), (3, [3.0]), (3, [3.0])], "key bigint, weights array<double>"))
    assert weights(s.read(0)) == {1: [1.0], 2: [5.0], 3: [3.0]}


def test_snapshot_and_compaction(spark):
    d = spark.createDataFrame([(1, 1, "a"), (1, 5, "b"), (1, 9, "c"), (2, 5, "x"), (3, -1, "never")], "key int, work_id bigint, v string")
    at = lambda c: {r.key: r.v for r in st.snapshot(d, ["key"], c).collect()}
    assert at(None) == {1: "c", 2: "x"} and at(9) == {1: "b", 2: "x"} and at(5) == {1: "a"} and at(1) == {}
    small = st.compact(d, ["key"], 6)
    assert sorted((r.key, r.work_id) for r in small.collect()) == [(1, 5), (1, 9), (2, 5)]
    assert st.should_persist(60, 100, 0) and not st.should_persist(60, 100, 1) and not st.should_persist(10, 100, 0)


def test_catalog(spark, tmp_path):
    s = make(spark, tmp_path / "s", initializer={"category": "constant", "value": 7.0})
    s.upsert(0, spark.createDataFrame([(1, [1.0, 2.0])], "key bigint, weights array<double>"))
    uri = f"file://{tmp_path}/m"
    sign = save_model([s], uri, 1)
    c = Catalog(spark, f"file://{tmp_path}/serving")
    assert c.request("POST", "/models", {"model_uri": uri})[0] == 400
    assert c.request("POST", "/models", {"model_uri": uri, "replica_num": 3, "shard_num": -1}) == (201, {"model_sign": sign})
    assert c.request("POST", "/models", {"model_uri": uri, "replica_num": 3, "shard_num": -1})[0] == 403
    assert c.request("GET", "/models") == (200, {sign: "NORMAL"})
    assert c.request("GET", f"/models/{sign}")[1]["status"] == "NORMAL"
    got = c.read_only_pull(sign, 0, spark.createDataFrame([(1,), (5,)], "key bigint"))
    assert sorted((r.key, r.weights[0], r.is_new) for r in got.collect()) == [(1, 1.0, False), (5, 7.0, True)]
    c._put(c.show_model(sign) | {"status": "CREATING"})
    c.files.create_exclusive("models", sign, "lock")
    with pytest.raises(StateError, match="being created"):
        c.create_model(uri)
    c.stale_seconds = 0  # the lock's holder is gone
    with pytest.raises(StateError):
        c.find_variable(sign, 0)
    assert c.create_model(uri) == sign  # an interrupted creation is resumed
    assert c.request("DELETE", f"/models/{sign}") == (202, {})
    assert c.request("GET", f"/models/{sign}")[0] == 404 and c.request("PUT", "/x")[0] == 404


def test_catalog_after_a_crash(spark, tmp_path, monkeypatch):
    from quillstate.plans import catalog as module

    s = make(spark, tmp_path / "s")
    s.upsert(0, spark.createDataFrame([(1, [1.0, 2.0]), (5, [3.0, 4.0])], "key bigint, weights array<double>"))
    uri = f"file://{tmp_path}/m"
    sign = save_model([s], uri, 1)
    c = Catalog(spark, f"file://{tmp_path}/serving", stale_seconds=0)
    c.files.create_exclusive("models", sign, "lock")  # a crash before the entry was written
    c.delete_model(sign)
    c.files.create_exclusive("models", sign, "lock")
    with monkeypatch.context() as m:
        m.setattr(module, "load", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            c.create_model(uri)
    assert c.show_model(sign)["status"] == "CREATING" and "division" in c.show_model(sign)["error"] and not c.files.exists("models", sign, "lock")
    assert c.create_model(uri, 2, 3) == sign
    assert c.files.names("models", sign, "rows", "storage_0", "0", "variable_id=0") == ["shard=1", "shard=2"]
    assert {r.key: list(r.weights) for r in c.find_variable(sign, 0)[1].collect()} == {1: [1.0, 2.0], 5: [3.0, 4.0]}


def test_batch_training_follows_weights(spark, tmp_path):
    """Gradients that depend on the pulled weights equal a plain loop."""
    s = make(spark, tmp_path, dim=1, optimizer={"category": "sgd", "learning_rate": 0.5}, initializer={"category": "constant", "value": 1.0})
    batches = [[1, 1, 2], [2, 3], [1, 3, 3]]
    w = {}
    for i, b in enumerate(batches):
        df = spark.createDataFrame([(k,) for k in b], "key bigint")
        assert train_batch(s, 0, df, i, lambda p: p.select("key", F.transform("weights", lambda x: x * 0.5).alias("grad")))
        grad = {k: 0.5 * w.get(k, 1.0) * b.count(k) for k in b}
        for k, g in grad.items():
            w[k] = w.get(k, 1.0) - 0.5 * g
    assert not train_batch(s, 0, df, 1, lambda p: p)
    assert {k: v[0] for k, v in weights(s.read(0)).items()} == pytest.approx(w)
    assert pull(df, s.read(0)).where("is_new").count() == 0
