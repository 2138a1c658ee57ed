"""Edge cases of lookups, reductions, shards, features, and sources on small tables."""

import pytest
from pyspark.sql import functions as F

from quillstate.functions import features, metrics
from quillstate.operators import gradients, initializers, keyed_totals, lookup, sharding
from quillstate.plans import analysis
from quillstate.sources import clicklog, profiling, tfrecord
from quillstate.types import StateError, VariableMeta


@pytest.fixture
def state(spark):
    return spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0]), (4, None)], "key bigint, weights array<double>")


def test_pull_keeps_order_duplicates_and_nulls(spark, state):
    keys = spark.createDataFrame([(0, 2, "a"), (1, 2, "b"), (2, 9, "c"), (3, None, "d"), (4, 1, "e"), (5, 4, "f")], "pos int, key bigint, weights string")
    got = {r.pos: r for r in lookup.pull(keys.withColumnRenamed("weights", "is_old"), state, init={"category": "constant", "value": 5.0}, dim=2).collect()}
    assert [got[i].weights for i in range(6)] == [[3.0, 4.0], [3.0, 4.0], [5.0, 5.0], [5.0, 5.0], [1.0, 2.0], None]
    assert [got[i].is_new for i in range(6)] == [False, False, True, True, False, False]
    assert lookup.pull(keys.limit(0), state).count() == 0
    assert lookup.pull(keys, state.limit(0), init={"category": "constant"}, dim=2).where("is_new").count() == 6


def test_bounds(spark, state):
    meta = VariableMeta("float64", 2, 10)
    keys = spark.createDataFrame([(9,), (10,), (-1,), (None,), ((1 << 63) - 1,)], "key bigint")
    assert lookup.invalid_keys(keys, "key", meta).count() == 4
    assert lookup.invalid_keys(keys, "key", VariableMeta("float64", 2)).count() == 2
    assert lookup.pull(keys.where("key = 9"), state, meta=meta, init={"category": "constant"}).count() == 1
    with pytest.raises(Exception, match="out of range"):
        lookup.pull(keys, state, meta=meta, init={"category": "constant"}).collect()


def test_pull_ragged(spark, state):
    rows = spark.createDataFrame([(1, [2, 1, 2]), (2, []), (3, None), (4, [None, 7])], "id int, idx array<bigint>")
    got = {r.id: r.vectors for r in lookup.pull_ragged(rows, state, "id", "idx", init={"category": "constant", "value": 0.0}, dim=2).collect()}
    assert got == {1: [[3.0, 4.0], [1.0, 2.0], [3.0, 4.0]], 2: [], 3: [], 4: [[0.0, 0.0], [0.0, 0.0]]}


def test_encodings(spark):
    df = spark.createDataFrame([(1, 5), (None, 0), ((1 << 63) - 1, 2)], "a bigint, b bigint")
    rows = [tuple(r) for r in lookup.hash_encode(df, ["b", "a"]).select("b", "a").collect()]
    assert rows == [(5, 1_000_000_008), (0, None), (2, 1_000_000_006)]
    assert [tuple(r) for r in lookup.offset_encode(df.where("a is null or a < 9"), ["a", "b"]).collect()] == [(1, 7), (None, 2)]
    assert lookup.is_dense(64) and not lookup.is_dense(65) and lookup.is_dense(100, batch_size=101) and not lookup.is_dense(-1)


@pytest.mark.parametrize("dim", [2, None])
def test_push_reduce(spark, dim):
    df = spark.createDataFrame([(1, [1.0, 2.0], 9), (1, [0.5, None], 9), (2, None, 9), (None, [1.0, 1.0], 9)], "key bigint, grad array<double>, cnt int")
    got = {r.key: (r.grad, r.cnt) for r in gradients.push_reduce(df, ["key"], "grad", dim).collect()}
    assert got[1] == ([1.5, 2.0], 2)
    assert got[2] == (([0.0, 0.0] if dim else []), 1)
    assert got[None] == ([1.0, 1.0], 1)
    split = gradients.push_two_level(df.withColumn("w", F.lit(1)), "w", ["key"], "grad", 2)
    assert {r.key: r.cnt for r in split.collect()} == {1: 2, 2: 1, None: 1}
    assert gradients.push_reduce(df.limit(0), ["key"], "grad", dim).count() == 0


@pytest.mark.parametrize("dim", [1, 32, 33, 128, 129, 300])
def test_push_reduce_is_alike_for_every_dimension(spark, dim):
    """NULL keys, NULL gradients and counts below, at and above the width of a slice; known and unknown lengths."""
    v = [float(i) for i in range(dim)]
    rows = [(1, v, 2), (1, v, 3), (2, None, 4), (None, v, 1), (None, None, 1), (3, [None] * dim, None)]
    df = spark.createDataFrame(rows, "__s bigint, grad array<double>, cnt int")
    for known in (dim, None):
        got = {r[0]: (r.grad, r.cnt) for r in gradients.push_reduce(df, ["__s"], "grad", known, "cnt").collect()}
        assert got == {1: ([2 * x for x in v], 5), 2: ([0.0] * dim if known else [], 4), None: (v, 2), 3: ([0.0] * dim, 0)}


def test_unique_inverse_and_dense(spark):
    df = spark.createDataFrame([(0, 7), (1, 3), (2, 7), (3, 9), (4, 3)], "pos int, key bigint")
    assert [r.inverse for r in gradients.unique_inverse(df, "pos", "key").orderBy("pos").collect()] == [0, 1, 0, 2, 1]
    two = df.withColumn("v", F.pmod("pos", F.lit(2)))
    assert [r.inverse for r in gradients.unique_inverse(two, "pos", "key", ["v"]).orderBy("pos").collect()] == [0, 0, 0, 1, 1]
    reduced = spark.createDataFrame([(1, [4.0], 2), (2, [1.0], 0)], "key bigint, grad array<double>, cnt bigint")
    assert [(r.key, r.grad, r.cnt) for r in gradients.dense_gradient(reduced, 3, 1).orderBy("key").collect()] == [(0, [0.0], 0), (1, [4.0], 2), (2, [1.0], 0)]
    assert [r.grad for r in gradients.mean_gradient(reduced).orderBy("key").collect()] == [[2.0], [None]]


def test_keyed_totals(spark):
    df = spark.createDataFrame([("f", 1, 1.0)] * 40 + [("f", 2, None), ("f", None, 1.0), (None, 3, 2.0)], "field string, item bigint, n_rows double")
    got = {(r.field, r.item): (r.rows, r.s) for r in keyed_totals.keyed_totals(df, ["field", "item"], {"s": F.col("n_rows")}, rows="rows").collect()}
    assert got == {("f", 1): (40, 40.0), ("f", 2): (1, None), ("f", None): (1, 1.0), (None, 3): (1, 2.0)}
    hot = keyed_totals.share_of_group(df, ["field"], ["item"], "0.5", rows="rows").collect()
    assert sorted((r.field or "", r.item) for r in hot) == [("", 3), ("f", 1)]
    exact = keyed_totals.share_of_group(df.where("item in (1, 2) and field = 'f'").limit(40), ["field"], ["item"], "1.0").collect()
    assert len(exact) == 1
    assert keyed_totals.share_of_group(df.limit(0), ["field"], ["item"], "0.5").count() == 0
    vec = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0]), (2, None)], "k int, v array<double>")
    assert sorted(tuple(r) for r in keyed_totals.vector_totals(vec, ["k"], "v", "i").collect()) == [(1, 0, 2.0), (1, 1, 2.0)]


def test_rows_and_shards(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    numbered = sharding.row_numbers(df, ["k"], "rn").collect()
    assert all(r.k == r.rn for r in numbered)
    assert sharding.row_numbers(df.limit(0), ["k"], "rn").count() == 0
    parts = [sorted(r.k for r in sharding.worker_rows(df, i, 3, ["k"], contiguous=True).collect()) for i in range(3)]
    assert parts == [[0, 1, 2], [3, 4, 5], [6, 7, 8]]
    back = sharding.route(df, "k", 4).select("k", sharding.key_of(F.col("local"), F.col("shard"), 4).alias("b")).collect()
    assert all(r.k == r.b for r in back)


def test_features(spark):
    df = spark.createDataFrame([(1, float("nan"), "b", 5), (2, None, None, None), (3, 2.0, "a", -1), (4, 2.0, "b", 5)], "id int, x double, s string, c bigint")
    filled = features.fill_missing(df, ["c", "s"], ["x"]).orderBy("id").collect()
    assert [r.x for r in filled] == [0.0, 0.0, 2.0, 2.0] and [r.c for r in filled] == [5, -1, -1, 5] and filled[1].s == "-1"
    assert [r.code for r in features.label_encode_sorted(df, "s", "code").orderBy("id").collect()] == [1, None, 0, 1]
    assert [r.code for r in features.label_encode_first_seen(df, "c", "id", "code").orderBy("id").collect()] == [0, None, 1, 0]
    scaled = features.min_max_scale(spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (None, 3.0)], "a double, b double"), ["a", "b"]).collect()
    assert [tuple(r) for r in scaled] == [(0.0, 0.0), (1.0, 0.0), (None, 0.0)]
    tokens = spark.createDataFrame([("1a",), ("",), (None,), ("xyz",), ("ffffffffffffffff",), ("7fffffffffffffff",)], "t string")
    assert [r[0] for r in tokens.select(features.hex_parse(F.col("t"))).collect()] == [26, -1, -1, None, None, (1 << 63) - 1]
    assert tokens.select(features.hex_parse(F.col("t"), True)).first()[0] == 16
    assert features.batches(df, ["id"], 3, full_only=True).count() == 3
    assert features.by_prefix(spark.createDataFrame([], "label int, I1 int, C2 int, Cx int"), "CI") == ["I1", "C2"]
    assert features.first_rows(df, "c", ["id"]).count() == 3


def test_initializers(spark):
    keys = spark.createDataFrame([(1,), (None,), ((1 << 63) - 1,)], "key bigint")
    for c in ({"category": "uniform", "minval": 2, "maxval": 3}, {"category": "normal", "truncated": 2.0}, {"category": "constant", "value": 1}):
        v = initializers.initializer(c).vector(F.col("key"), 4)
        a, b = keys.select(v).collect(), keys.repartition(2).select("key", v).orderBy(F.col("key").isNull(), "key").collect()
        assert all(len(r[0]) == 4 for r in a) and [r[0] for r in a][0] == b[0][1]
    assert initializers.from_layer_config("Zeros")["value"] == 0.0 and initializers.from_layer_config("glorot", explicit=False)["category"] == "constant"
    for bad in (lambda: initializers.from_layer_config("Glorot"), lambda: initializers.initializer({"category": "x"})):
        with pytest.raises(StateError):
            bad()


def test_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.5), (0, 0.5), (None, 0.3)], "y int, p double")
    assert metrics.auc(df, "y", "p").first()[0] == 0.875
    assert metrics.auc(df.where("y = 1"), "y", "p").first()[0] is None
    assert metrics.error_rate(df.where("y is not null"), "y", "p").first()[0] == 0.25


def test_click_log_files(spark, tmp_path):
    (tmp_path / "day_3").write_text("\t".join(["1"] + [""] * 13 + ["7"] * 26) + "\n")
    rows = clicklog.read_days(spark, f"file://{tmp_path}").collect()
    assert rows[0].day_n == 3 and rows[0].I5 == 0.0 and rows[0].C26 == 7
    (tmp_path / "c.csv").write_text(",".join(["", "label"] + clicklog.DENSE + clicklog.SPARSE) + "\n" + ",".join(["0", "1"] + ["0.5"] * 13 + ["2"] * 26) + "\n")
    row = clicklog.read_csv(spark, f"file://{tmp_path}/c.csv").first()
    assert row.label == 1 and row.I13 == 0.5 and row.C1 == 2 and "_c0" not in row.asDict()


def test_records(spark, tmp_path):
    schema = "id bigint, label int, x double, s string"
    df = spark.createDataFrame([(1, 0, 0.5, "a"), (-5, 1, None, "ü"), ((1 << 63) - 1, None, -2.25, None)], schema)
    path = f"file://{tmp_path}/rec"
    tfrecord.write(df, path, 2)
    got = tfrecord.read(spark, path, df.schema).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(-5, 1, None, "ü"), (1, 0, 0.5, "a"), ((1 << 63) - 1, None, -2.25, None)]
    assert tfrecord.masked_crc(b"123456789") == ((0xE3069283 >> 15 | 0xE3069283 << 17) + 0xA282EAD8) & 0xFFFFFFFF
    name = next((tmp_path / "rec").glob("*.tfrecord"))
    raw = bytearray(name.read_bytes())
    raw[-6] ^= 1
    name.write_bytes(bytes(raw))
    with pytest.raises(Exception, match="damaged"):
        tfrecord.read(spark, path, df.schema).collect()


def test_traces_and_logs(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"traceEvents": [{"name": "a:x", "ts": 1, "dur": 2}, {"name": "b", "ts": 1}, {"ts": 4}]}')
    assert profiling.read_trace(spark, f"file://{tmp_path}/t.json").count() == 1
    (tmp_path / "deepfm_9_8.out").write_text("Epoch 1/2\n 12s - loss: 0.5\nx\n9s - loss: 0.4\n")
    got = profiling.read_epoch_logs(spark, f"file://{tmp_path}/*.out").orderBy("seconds").collect()
    assert [tuple(r) for r in got] == [("deepfm_9", 8, 9.0), ("deepfm_9", 8, 12.0)]


def test_cumulative_hits_covers_every_batch(spark):
    rows = spark.createDataFrame([("C1", b, k) for b, ks in enumerate(([1, 2, 2], [2, 3], [4], [1, 3, 5, 5])) for k in ks] + [("C2", 3, 1)], "column string, batch bigint, key bigint")
    got = sorted(tuple(r) for r in analysis.cumulative_hits(rows, "column", "batch", "key").collect())
    assert got == [("C1", 0, 2, 0), ("C1", 1, 2, 1), ("C1", 2, 1, 0), ("C1", 3, 3, 2), ("C2", 3, 1, 0)]


def test_every_day_is_written_and_read(spark, tmp_path):
    columns = ["label", *clicklog.DENSE, *clicklog.SPARSE]
    log = spark.range(60).select(*[F.col("id").cast("double" if c in clicklog.DENSE else "bigint").alias(c) for c in columns], F.when(F.col("id") < 56, F.floor(F.col("id") / 4)).cast("int").alias("day_n"))
    clicklog.write_all_days(log, f"file://{tmp_path}/days", 3)
    got = clicklog.read_days(spark, f"file://{tmp_path}/days").groupBy("day_n").agg(F.count(F.lit(1)), F.sum("C26")).collect()
    assert {tuple(r) for r in got} == {(n, 4, 16 * n + 6) for n in range(14)} | {(None, 4, 56 + 57 + 58 + 59)}


def test_ragged_pull_and_commit_metrics_per_variable(spark):
    """The same key of two variables is two keys."""
    state = spark.createDataFrame([(1, 7, [1.0]), (2, 7, [2.0]), (2, (1 << 62) + 1, [3.0])], "variable_id int, key bigint, weights array<double>")
    rows = spark.createDataFrame([(0, 1, [7, (1 << 62) + 1]), (0, 2, [(1 << 62) + 1, 7]), (1, 2, [])], "rec_id bigint, variable_id int, indices array<bigint>")
    got = lookup.pull_ragged(rows, state, "rec_id", "indices", init={"category": "constant", "value": 0.5}, dim=1, on=("variable_id",))
    assert sorted(tuple(r) for r in got.collect()) == [(0, 1, [[1.0], [0.5]]), (0, 2, [[3.0], [2.0]]), (1, 2, [])]
    before = state.where("variable_id = 1").unionByName(spark.createDataFrame([(2, 7, [9.0])], state.schema))
    assert sorted(tuple(r) for r in analysis.commit_metrics(before, state, on=("variable_id",)).collect()) == [(1, 0, 0, 1), (2, 1, 1, 0)]


def test_records_with_missing_features_come_back(spark):
    from quillstate.plans import registry

    got = registry.queries()["tfrecord_roundtrip_all"](spark, "/root/testdata/sf0.001")
    log = spark.read.parquet("/root/testdata/sf0.001/train100.parquet")
    assert got.count() == log.count() and got.where("I2 is null or C3 is null or label is null").count() == log.where("I2 is null or C3 is null or label is null").count() > 0
