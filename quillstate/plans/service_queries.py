"""Queries of storages, models, guards, block reads and file layouts, with their SQL oracles."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstate.api import Context, layer_variable
from quillstate.functions import features, metrics
from quillstate.operators import gradients, initializers, lookup, optimizers, sharding
from quillstate.plans import analysis
from quillstate.plans import store as st
from quillstate.plans.catalog import Catalog, load_beside, load_model, save_beside, save_model
from quillstate.plans.state_queries import DIM, _embeddings, _keys, _new_store, _r, _scalar_gradients, _variable
from quillstate.session import table, work_dir
from quillstate.sources import clicklog, profiling
from quillstate.streaming.loop import train_stream
from quillstate.streaming.prefetch import PrefetchQueue
from quillstate.types import StateError, Variable, VariableMeta


def _refused(call) -> bool:
    try:
        call()
    except Exception as e:
        if isinstance(e, StateError) or "out of range" in str(e):
            return True
        raise
    return False


# ---- gradients and guards ------------------------------------------------------------------------


def push_reduce_wide(spark, d):
    """200 elements, NULL keys and NULL gradients."""
    e = F.col("embedding").cast("array<double>")
    rows = table(spark, d, "embeddings").select(
        F.when(F.col("vec_id") % 7 != 0, F.col("label")).alias("key"), F.when(F.col("vec_id") % 5 != 0, F.concat(e, e, e, F.slice(e, 1, 8))).alias("grad"))
    g = gradients.push_reduce(rows, ["key"], "grad", 200)
    return g.select("key", F.size("grad").cast("bigint").alias("dim"), *[_r(F.get("grad", F.lit(i)), 4).alias(f"g{i}") for i in (0, 127, 128, 199)], "cnt")


def push_guard(spark, d):
    """A step with keys out of range is refused as a whole."""
    s = st.Store(spark, work_dir(spark, "guard"), "storage_0", 4)
    s.create_variable(Variable(0, "C0", VariableMeta("float64", 2, 500)))
    g = _scalar_gradients(spark, d).withColumn("key", F.col("key") * 7)
    refused = _refused(lambda: s.store(0, {0: gradients.push_reduce(g, ["key"], "grad", 2)}))
    bad = lookup.invalid_keys(g, "key", s.variables[0].meta).agg(F.count(F.lit(1)).alias("n_bad"))
    return bad.select("n_bad", F.lit(refused).alias("refused"), F.lit(s.read(0).count()).cast("bigint").alias("n_stored"))


def meta_guard(spark, d):
    """Which spellings of data types can be those of a variable."""
    kinds = [r[0] for r in table(spark, d, "embedding_variable_meta").select("datatype").where("datatype is not null").distinct().collect()]  # a few spellings
    return spark.createDataFrame([(k, not _refused(lambda k=k: VariableMeta(k, 1))) for k in kinds], "datatype string, accepted boolean")


def key_cast(spark, d):
    """Keys of a narrower type are cast to 64 bits."""
    keys = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 30).cast("int").alias("key"))
    got = lookup.pull(keys, _embeddings(spark, d), init={"category": "constant", "value": 0.5}, dim=DIM)
    return got.select("n_nationkey", "key", F.lit(dict(got.dtypes)["key"]).alias("kind"), _r(F.get("weights", F.lit(0))).alias("w0"))


# ---- initializers, properties, layers -----------------------------------------------------------------


def layer_initializers(spark, d):
    names = ["Zeros", "Ones", "Constant", "RandomUniform", "random_normal", "GlorotUniform"]
    rows = []
    for n in names:
        refused = _refused(lambda n=n: initializers.from_layer_config(n, {"value": 3.0}))
        c = initializers.from_layer_config(n, {"value": 3.0}, explicit=False)
        rows.append((n, refused, c["category"], float(c.get("value", c.get("minval", c.get("stddev"))))))
    return spark.createDataFrame(rows, "name string, refused boolean, category string, first double")


def unknown_properties(spark, d):
    """Unknown properties warn, unknown categories are refused."""
    rows = []
    for config in ({"category": "adam", "beta_1": 0.8}, {"category": "adam", "beta_9": 0.8}, {"category": "lamb"}):
        with warnings.catch_warnings(record=True) as seen:
            warnings.simplefilter("always")
            refused = _refused(lambda c=config: optimizers.optimizer(c))
        rows.append((config["category"], len(config) > 1 and "beta_9" in config, len(seen), refused))
    return spark.createDataFrame(rows, "category string, odd boolean, n_warnings bigint, refused boolean")


def layer_rows(spark, d):
    """A layer's variable: rows of its initializer, one step of its optimizer."""
    s = Context(spark, work_dir(spark, "layer")).create_storage(4)
    v = layer_variable(s, -1, 2, embeddings_initializer="Ones", optimizer="SGD", optimizer_config={"learning_rate": 0.5, "name": "sgd"})
    v.pull(_keys(spark, d, 7))
    v.push(_scalar_gradients(spark, d))
    s.update_weights()
    return v.rows().select("key", _r(F.get("weights", F.lit(0)).cast("double"), 2).alias("w0"))


# ---- storages -----------------------------------------------------------------------------------------------


def stream_after_load(spark, d):
    """A loaded model goes on with a new stream: every micro-batch counts, whatever was written before."""
    config = {"category": "sgd", "learning_rate": 0.5}
    first = _new_store(spark, "before", [_variable(0, 1, optimizer=config)])
    events = table(spark, d, "events")
    first.upsert(0, events.select(F.col("user_id").alias("key"), F.array(F.lit(10.0)).alias("weights")))
    uri = work_dir(spark, "model")
    save_model([first], uri, 1)
    s = _new_store(spark, "after", [_variable(0, 1, optimizer=config)], 3)
    load_model([s], uri)
    path = work_dir(spark, "stream-files")
    events.select(F.col("user_id").alias("key"), "value").repartition(4).write.parquet(path)
    stream = spark.readStream.schema("key bigint, value double").option("maxFilesPerTrigger", 1).parquet(path)
    train_stream(stream, s, 0, lambda b: b.select("key", F.array(F.col("value")).alias("grad")), work_dir(spark, "stream-checkpoint")).awaitTermination()
    return s.read(0).select("key", _r(F.get("weights", F.lit(0)), 4).alias("w"))


def _rounds(spark, d) -> DataFrame:
    """Saved rows with one number for each (variable, key), in four rounds of work ids."""
    saved = table(spark, d, "checkpoint_rows").where("work_id <> -1")
    ids = sharding.row_numbers(saved.select("variable_id", "key").distinct(), ["variable_id", "key"], "id")
    return saved.join(ids, ["variable_id", "key"]).select(F.col("id").cast("bigint").alias("key"), "weights", "slots", "work_id", F.least(F.lit(3), F.floor(F.col("work_id") / 200)).alias("round"))


def delta_write_restore(spark, d):
    """Four commits of changed rows, and the state as each of them left it."""
    s = _new_store(spark, "deltas", [_variable(0, 4, optimizer={"category": "adagrad"})])
    rows = _rounds(spark, d)
    for i in range(4):
        s.upsert(0, st.snapshot(rows.where(F.col("round") == i), ["key"], None).select("key", "weights", "slots"))
    return reduce(DataFrame.unionByName, [s.read(0, v).select(F.lit(v).alias("version"), "key", _r(F.get("weights", F.lit(0))).alias("w0"), _r(F.get("slots.accum", F.lit(0))).alias("a0")) for v in (1, 2, 3, 4)])


def compaction_rule(spark, d):
    """Per variable, whether the rows changed from work 400 on are enough for a new checkpoint."""
    n = table(spark, d, "checkpoint_rows").where("work_id <> -1").groupBy("variable_id").agg(F.count(F.when(F.col("work_id") >= 400, 1)).alias("changed"), F.count(F.when(F.col("work_id") < 400, 1)).alias("held"))
    rows = [(r.variable_id, r.changed, r.held, st.should_persist(r.changed, r.held, 0)) for r in n.collect()]  # one row per variable
    return spark.createDataFrame(rows, "variable_id int, changed bigint, held bigint, due boolean")


def block_reader(spark, d):
    blocks = st.numbered_blocks(_embeddings(spark, d).select("key", "weights"), 64)
    return blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n_rows"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def block_cursor(spark, d):
    """Reading goes on behind the last key read before."""
    state = _embeddings(spark, d).select("key", F.get("weights", F.lit(0)).alias("w"))
    rows = [(n, b.num_rows, b["key"][0].as_py(), b["key"][-1].as_py()) for n, b in enumerate(st.read_blocks(state, 100, after=149))]
    return spark.createDataFrame(rows, "block bigint, n_rows bigint, first_key bigint, last_key bigint")


def delete_storage(spark, d):
    c = Context(spark, work_dir(spark, "delete"))
    s, other = c.create_storage(2), c.create_storage(2)
    for x in (s, other):
        x.create_variable(-1, DIM, "float64").set_weights(_embeddings(spark, d).select("key", "weights"))
    c.delete_storage(s)
    return spark.createDataFrame([(len(c.storages), s.store.version is None, other.variables[0].num_items())], "n_storages bigint, gone boolean, n_rows bigint")


def batch_order(spark, d):
    """After two batches: which batches may be pulled for, which of them at once, and which stores are new."""
    s = _new_store(spark, "order", [_variable(0, 2)])
    for b in (0, 1):
        s.store(b, {}, {0: _keys(spark, d, b + 1).select("key")})
    made = [(b, not _refused(lambda b=b: s.check_ahead(b)), not _refused(lambda b=b: s.wait_for(b)), b > s.last_batch()) for b in (0, 1, 2, 3, 1025, 1026, 1027, 5000)]
    return spark.createDataFrame(made, "batch_id bigint, near boolean, ready boolean, is_new boolean")


# ---- models -----------------------------------------------------------------------------------------------------


def load_model_rows(spark, d):
    """Saved with 4 shards, loaded into 3 over older rows."""
    a = _new_store(spark, "save", [_variable(0)])
    a.upsert(0, _embeddings(spark, d).select("key", "weights"))
    uri = work_dir(spark, "model")
    save_model([a], uri, 2)
    b = _new_store(spark, "load", [_variable(0)], 3)
    b.upsert(0, _embeddings(spark, d).select((F.col("key") + 10_000).alias("key"), "weights"))
    load_model([b], uri)
    return b.read(0).select("key", _r(F.get("weights", F.lit(0))).alias("w0"))


def save_beside_rows(spark, d):
    out = []
    for file_style in (False, True):
        a, b = _new_store(spark, "beside", [_variable(0)]), _new_store(spark, "beside-loaded", [_variable(0)], 2)
        a.upsert(0, _embeddings(spark, d).select("key", "weights"))
        path = work_dir(spark, "dense-model")
        save_beside([a], path, file_style)
        load_beside([b], path)
        out.append(b.read(0).select(F.lit(file_style).alias("file_style"), "key", _r(F.get("weights", F.lit(1))).alias("w1")))
    return out[0].unionByName(out[1])


def create_after_crash(spark, d):
    """A creation that died behind its lock, and one that failed: both are taken up, and the copy has its own shards."""
    a = _new_store(spark, "crash", [_variable(0)])
    a.upsert(0, _embeddings(spark, d).select("key", "weights"))
    uri = work_dir(spark, "model")
    sign = save_model([a], uri, 1)
    c = Catalog(spark, work_dir(spark, "serving"), stale_seconds=0)
    c.files.create_exclusive("models", sign, "lock")
    c.delete_model(sign)
    c.files.create_exclusive("models", sign, "lock")
    c._put({"model_sign": sign, "status": "CREATING"})
    c.create_model(uri, 1, 5)
    v, rows = c.find_variable(sign, 0)
    return rows.select("key", _r(F.get("weights", F.lit(0))).alias("w0"), F.lit(c.show_model(sign)["status"]).alias("status"), F.lit(len(c.files.names("models", sign, "rows", "storage_0", "0", "variable_id=0"))).alias("n_shards"))


def prefetch_queue(spark, d):
    """Four batches, two of them pulled ahead; the others are pulled when they come."""
    state = _embeddings(spark, d)
    batches = [_keys(spark, d, 3).where(F.col("event_id") % 4 == b).select(F.col("event_id").alias("pos"), "key") for b in range(4)]
    q = PrefetchQueue(lambda keys: lookup.pull(keys, state.select("key", "weights"), init={"category": "constant", "value": 0.25}, dim=DIM), steps=2)
    for b in batches[:2]:
        q.prefetch(b)
    full = _refused(lambda: q.prefetch(batches[2]))
    out = []
    for b, keys in enumerate(batches):
        before = q.hits
        got = q.take(keys)
        out.append(got.select(F.lit(b).alias("batch"), F.lit(q.hits > before).alias("ahead"), F.lit(full).alias("was_full"), F.col("pos").alias("event_id"), _r(F.get("weights", F.lit(0))).alias("w0")))
    return reduce(DataFrame.unionByName, out)


# ---- files --------------------------------------------------------------------------------------------------------


def worker_day_files(spark, d):
    """Three workers, each with every third file, read all rows once."""
    log = table(spark, d, "train100").select("label", *[F.nanvl(F.coalesce(c, F.lit(0.0)), F.lit(0.0)).alias(c) for c in clicklog.DENSE], *clicklog.SPARSE, "day_n")
    path = work_dir(spark, "worker-days")
    clicklog.write_all_days(log, path, 400)
    parts = [clicklog.read_worker_days(spark, path, r, 3).select(F.lit(r).alias("rank"), "label", "C9") for r in range(3)]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.agg(F.countDistinct("rank").alias("n_workers"), F.count(F.lit(1)).alias("n_rows"), F.sum("label").alias("clicks"), F.sum("C9").alias("c9_sum"))


def trace_files(spark, d):
    """Traces written as files, a document to a file, and read back."""
    e = table(spark, d, "events").select(F.concat(F.lit("op:"), "event_type").alias("name"), F.col("event_id").cast("double").alias("ts"), F.col("value").alias("dur"))
    docs = e.groupBy(F.floor(F.col("ts") / 2000).alias("f")).agg(F.to_json(F.struct(F.collect_list(F.struct("name", "ts", "dur")).alias("traceEvents"))).alias("value"))  # up to 2,000 events a document
    path = work_dir(spark, "traces")
    docs.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return analysis.trace_rollup(profiling.read_trace(spark, path))


def epoch_log_files(spark, d):
    """Log files named by case and workers."""
    path = work_dir(spark, "log-files")
    files = st.Files(spark, path)
    for r in table(spark, d, "nation").collect():  # 25 rows
        files.write(f"Epoch 1/2\n{r.n_nationkey + 5}s - loss: 0.5\nstep\n {r.n_nationkey + 3}s - loss: 0.4\n", f"deepfm_{r.n_regionkey}_{r.n_nationkey}.out")
    got = profiling.read_epoch_logs(spark, f"{path}/*.out")
    return got.groupBy("case", "np").agg(F.min("seconds").alias("seconds"), F.count(F.lit(1)).alias("n"))


def sink_files(spark, d):
    """The same dump to a folder and to nowhere."""
    state, path = _embeddings(spark, d).select("key", "weights"), work_dir(spark, "sink")
    for p in (path, "null:///sink"):
        st.dump(state, p, 0, 3)
    n = st.load(spark, path, 0).agg(F.count(F.lit(1)).alias("n_rows"))
    return n.select("n_rows", F.lit(len(st.Files(spark, path).names("variable_id=0"))).cast("bigint").alias("n_folders"), F.lit(st.Files(spark, "null:///sink").exists("variable_id=0")).alias("kept"))


def worker_mean(spark, d):
    e = table(spark, d, "events").select(F.pmod("event_id", F.lit(4)).alias("worker"), "value", (F.col("value") * 2).alias("twice"))
    return metrics.worker_average(e, "worker", ["value", "twice"]).select(_r("value", 4).alias("value"), _r("twice", 4).alias("twice"))


def dense_columns(spark, d):
    """Columns that the library's rule replicates, alone and for batches of 4096."""
    sizes = {r["column"]: r["cardinality"] for r in table(spark, d, "train100").agg(*[(F.max(c) + 1).alias(c) for c in clicklog.SPARSE]).selectExpr(f"stack({len(clicklog.SPARSE)}, " + ", ".join(f"'{c}', {c}" for c in clicklog.SPARSE) + ") as (column, cardinality)").collect()}
    return spark.createDataFrame([(c, n, lookup.is_dense(n), lookup.is_dense(n, 4096)) for c, n in sizes.items()], "column string, cardinality bigint, dense boolean, dense_at_4096 boolean")


def mod_bucket_all(spark, d):
    """Every row; a missing id stays NULL."""
    return table(spark, d, "train100").select("rec_id", features.mod_bucket(F.col("C3")).alias("bucket"))


def hash_encode_all(spark, d):
    """Every row; a NULL id stays NULL in the common id space."""
    rows = table(spark, d, "train100").select("rec_id", "C3", "C5", (F.lit((1 << 63) - 5) + F.pmod("rec_id", F.lit(3))).alias("C99"))
    return lookup.hash_encode(rows, ["C3", "C5", "C99"])


QUERIES = {f.__name__: f for f in (
    push_reduce_wide, push_guard, meta_guard, key_cast, layer_initializers, unknown_properties, layer_rows, stream_after_load, delta_write_restore, compaction_rule, block_reader, block_cursor,
    delete_storage, batch_order, load_model_rows, save_beside_rows, create_after_crash, prefetch_queue, worker_day_files, trace_files, epoch_log_files, sink_files, worker_mean, dense_columns, mod_bucket_all, hash_encode_all,
)}

_ROWS = "SELECT vec_id AS key, ROUND(CAST(embedding[1] AS DOUBLE), 6) AS w0 FROM embeddings"

ORACLE = {
    "mod_bucket_all": "SELECT rec_id, ((C3 % 65536) + 65536) % 65536 AS bucket FROM train100",
    "hash_encode_all": """
SELECT rec_id, CAST(C3 AS BIGINT) AS C3, C5 + 1000000007 AS C5, CAST((CAST(9223372036854775803 AS HUGEINT) + rec_id % 3 + 2000000014) % 9223372036854775808 AS BIGINT) AS C99
FROM train100""",
    "push_reduce_wide": "SELECT CASE WHEN vec_id % 7 <> 0 THEN label END AS key, CAST(200 AS BIGINT) AS dim, "
    + ", ".join(f"ROUND(COALESCE(SUM(CAST(embedding[{j}] AS DOUBLE)) FILTER (vec_id % 5 <> 0), 0), 4) AS g{i}" for i, j in ((0, 1), (127, 64), (128, 1), (199, 8))) + ", COUNT(*) AS cnt FROM embeddings GROUP BY 1",
    "push_guard": "SELECT COUNT(*) FILTER (user_id * 7 >= 500) AS n_bad, COUNT(*) FILTER (user_id * 7 >= 500) > 0 AS refused, CASE WHEN COUNT(*) FILTER (user_id * 7 >= 500) > 0 THEN 0 ELSE COUNT(DISTINCT user_id) END AS n_stored FROM events",
    "meta_guard": "SELECT DISTINCT datatype, lower(trim(datatype)) IN ('float32', 'float', 'float64', 'double') AS accepted FROM embedding_variable_meta WHERE datatype IS NOT NULL",
    "key_cast": "SELECT n_nationkey, CAST(n_nationkey * 30 AS BIGINT) AS key, 'bigint' AS kind, ROUND(COALESCE(CAST(embedding[1] AS DOUBLE), 0.5), 6) AS w0 FROM nation LEFT JOIN embeddings ON vec_id = n_nationkey * 30",
    "layer_initializers": "SELECT * FROM (VALUES ('Zeros', FALSE, 'constant', 0e0), ('Ones', FALSE, 'constant', 1e0), ('Constant', FALSE, 'constant', 3e0), ('RandomUniform', FALSE, 'uniform', -0.05e0), ('random_normal', FALSE, 'normal', 0.05e0), ('GlorotUniform', TRUE, 'constant', 0e0)) t(name, refused, category, first)",
    "unknown_properties": "SELECT category, odd, CAST(n AS BIGINT) AS n_warnings, refused FROM (VALUES ('adam', FALSE, 0, FALSE), ('adam', TRUE, 1, FALSE), ('lamb', FALSE, 0, TRUE)) t(category, odd, n, refused)",
    "layer_rows": """
WITH g AS (SELECT user_id AS key, SUM(value / 100) AS g FROM events GROUP BY user_id), k AS (SELECT DISTINCT user_id * 7 AS key FROM events)
SELECT COALESCE(g.key, k.key) AS key, ROUND(CAST(CAST(1 - 0.5 * COALESCE(g.g, 0) AS FLOAT) AS DOUBLE), 2) AS w0 FROM g FULL JOIN k ON g.key = k.key""",
    "stream_after_load": "SELECT user_id AS key, ROUND(10 - 0.5 * SUM(value), 4) AS w FROM events GROUP BY user_id",
    "delta_write_restore": """
WITH s AS (SELECT *, DENSE_RANK() OVER (ORDER BY variable_id, key) - 1 AS id FROM checkpoint_rows WHERE work_id <> -1),
v AS (SELECT UNNEST([1, 2, 3, 4]) AS version),
r AS (SELECT version, s.*, ROW_NUMBER() OVER (PARTITION BY version, id ORDER BY work_id DESC) AS rn FROM v JOIN s ON least(3, work_id // 200) < version)
SELECT version, id AS key, ROUND(weights[1], 6) AS w0, ROUND(slots.accum[1], 6) AS a0 FROM r WHERE rn = 1""",
    "compaction_rule": """
WITH n AS (SELECT variable_id, COUNT(*) FILTER (work_id >= 400) AS changed, COUNT(*) FILTER (work_id < 400) AS held FROM checkpoint_rows WHERE work_id <> -1 GROUP BY variable_id)
SELECT *, changed > 0 AND changed >= 0.5 * greatest(1, held) AS due FROM n""",
    "block_reader": "SELECT CAST(rn // 64 AS BIGINT) AS block, COUNT(*) AS n_rows, MIN(vec_id) AS first_key, MAX(vec_id) AS last_key FROM (SELECT vec_id, ROW_NUMBER() OVER (ORDER BY vec_id) - 1 AS rn FROM embeddings) GROUP BY 1",
    "block_cursor": "SELECT CAST(rn // 100 AS BIGINT) AS block, COUNT(*) AS n_rows, MIN(vec_id) AS first_key, MAX(vec_id) AS last_key FROM (SELECT vec_id, ROW_NUMBER() OVER (ORDER BY vec_id) - 1 AS rn FROM embeddings WHERE vec_id > 149) GROUP BY 1",
    "delete_storage": "SELECT CAST(1 AS BIGINT) AS n_storages, TRUE AS gone, COUNT(*) AS n_rows FROM embeddings",
    "batch_order": "SELECT CAST(b AS BIGINT) AS batch_id, b < 1027 AS near, b <= 2 AS ready, b > 1 AS is_new FROM (SELECT UNNEST([0, 1, 2, 3, 1025, 1026, 1027, 5000]) AS b)",
    "load_model_rows": _ROWS,
    "save_beside_rows": "SELECT f AS file_style, vec_id AS key, ROUND(CAST(embedding[2] AS DOUBLE), 6) AS w1 FROM embeddings, (VALUES (FALSE), (TRUE)) t(f)",
    "create_after_crash": "SELECT vec_id AS key, ROUND(CAST(embedding[1] AS DOUBLE), 6) AS w0, 'NORMAL' AS status, 5 AS n_shards FROM embeddings",
    "prefetch_queue": """
SELECT CAST(event_id % 4 AS INT) AS batch, event_id % 4 < 2 AS ahead, TRUE AS was_full, event_id, ROUND(COALESCE(CAST(embedding[1] AS DOUBLE), 0.25), 6) AS w0
FROM events LEFT JOIN embeddings ON vec_id = user_id * 3""",
    "worker_day_files": "SELECT CAST(3 AS BIGINT) AS n_workers, COUNT(*) AS n_rows, CAST(SUM(label) AS BIGINT) AS clicks, CAST(SUM(C9) AS BIGINT) AS c9_sum FROM train100",
    "trace_files": """
SELECT event_type AS op, CAST(trunc(MIN(event_id) / 1000) AS BIGINT) AS start_ms, CAST(trunc(MAX(event_id + value) / 1000) AS BIGINT) AS end_ms, CAST(trunc(SUM(value) / 1000) AS BIGINT) AS total_ms, COUNT(*) AS n
FROM events WHERE value IS NOT NULL GROUP BY event_type""",
    "epoch_log_files": "SELECT 'deepfm_' || n_regionkey AS \"case\", n_nationkey AS np, CAST(n_nationkey + 3 AS DOUBLE) AS seconds, CAST(2 AS BIGINT) AS n FROM nation",
    "sink_files": "SELECT COUNT(*) AS n_rows, COUNT(DISTINCT vec_id % 3) AS n_folders, FALSE AS kept FROM embeddings",
    "worker_mean": "SELECT ROUND(AVG(v), 4) AS value, ROUND(AVG(2 * v), 4) AS twice FROM (SELECT AVG(value) AS v FROM events GROUP BY event_id % 4)",
    "dense_columns": " UNION ALL ".join(f"SELECT 'C{i}' AS \"column\", MAX(C{i}) + 1 AS cardinality, MAX(C{i}) + 1 <= 64 AS dense, MAX(C{i}) + 1 < 4096 OR MAX(C{i}) + 1 <= 64 AS dense_at_4096 FROM train100" for i in range(1, 27)),
}
