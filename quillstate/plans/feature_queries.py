"""Queries of preprocessing, sources and sinks, locality analysis, and metrics, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstate.functions import features, metrics
from quillstate.operators import initializers, lookup
from quillstate.plans import analysis
from quillstate.session import table, work_dir
from quillstate.sources import clicklog, profiling, tfrecord

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]  # unique together


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "train100")


# ---- preprocessing ---------------------------------------------------------------------------


def fill_missing(spark, d):
    log = _log(spark, d)
    done = features.fill_missing(log.select("rec_id", "I1", "I12", "C5", "C20"), ["C5", "C20"], ["I1", "I12"])
    return done.select("rec_id", F.round("I1", 6).alias("I1"), F.round("I12", 6).alias("I12"), "C5", "C20")


def column_prefix(spark, d):
    log = _log(spark, d)
    return spark.createDataFrame([(c,) for c in features.by_prefix(log, "CI")], "name string")


def minmax_scale(spark, d):
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    done = features.min_max_scale(table(spark, d, "lineitem").select(*LINE, "l_quantity", "l_discount", F.lit(3.0).alias("flat")), [*cols, "flat"])
    return done.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.round(c, 6).alias(c) for c in [*cols, "flat"]])


def standardise(spark, d):
    done = features.standardise(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax"), {"l_quantity": (25, 10), "l_tax": (0.04, 0.02)})
    return done.select("l_orderkey", "l_linenumber", "l_partkey", F.round("l_quantity", 6).alias("q"), F.round("l_tax", 6).alias("t"))


def label_encode_sorted(spark, d):
    return features.label_encode_sorted(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "code").select("p_partkey", "p_brand", "code")


def label_encode_first_seen(spark, d):
    return features.label_encode_first_seen(_log(spark, d).select("rec_id", "C20"), "C20", "rec_id", "code").select("rec_id", "C20", "code")


def hash_bucket_share(spark, d):
    b = table(spark, d, "events").select(F.pmod(features.string_bucket(F.col("event_type")), F.lit(1 << 20)).alias("b"), "event_type")
    return b.groupBy("event_type").agg(F.countDistinct("b").alias("n_buckets"), F.count(F.lit(1)).alias("n_rows"))


def offset_encode(spark, d):
    done = lookup.offset_encode(_log(spark, d).select("rec_id", "C1", "C2", "C9"), ["C1", "C2", "C9"])
    return done


def row_replicate(spark, d):
    src = table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("r_regionkey"), "r_name")
    return features.replicate(src, 3, "r_regionkey", "id").select("r_name", "id")


def hex_parse(spark, d):
    token = F.when(F.col("p_partkey") % 7 == 0, F.lit("")).otherwise(F.lower(F.hex("p_partkey")))
    rows = table(spark, d, "part").select("p_partkey", token.alias("token"))
    return rows.select("p_partkey", features.hex_parse(F.col("token")).alias("value"), features.hex_parse(F.col("token"), collide=True).alias("legacy"))


def batch_assign(spark, d):
    return features.batches(table(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"], 256).select("event_id", "batch")


def train_test_split(spark, d):
    return features.train_test_split(table(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"], 0.8, 64).select("event_id", "is_test")


def column_cardinality(spark, d):
    return features.cardinalities(_log(spark, d).select("C1", "C9", "C20"), ["C1", "C9", "C20"])


def init_uniform(spark, d):
    """Distribution of hash-based uniform rows: within bounds, mean and spread as they should be, the same twice."""
    v = initializers.initializer({"category": "uniform", "minval": -1, "maxval": 1, "seed": 3}).vector(F.col("key"), 16)
    rows = spark.range(5000).withColumnRenamed("id", "key").select("key", v.alias("a"), v.alias("b"))
    x = rows.select(F.explode("a").alias("x"), (F.col("a") == F.col("b")).alias("same"))
    return x.agg((F.min("x") >= -1).alias("above"), (F.max("x") < 1).alias("below"), (F.abs(F.avg("x")) < 0.02).alias("centred"), (F.abs(F.stddev("x") - 0.57735) < 0.01).alias("spread"), F.min("same").alias("stable"))


def init_normal(spark, d):
    v = initializers.initializer({"category": "normal", "mean": 2, "stddev": 0.5, "truncated": 1.5}).vector(F.col("key"), 16)
    x = spark.range(5000).withColumnRenamed("id", "key").select(F.explode(v).alias("x"))
    return x.agg((F.min("x") >= 1.25).alias("above"), (F.max("x") <= 2.75).alias("below"), (F.abs(F.avg("x") - 2) < 0.02).alias("centred"))


# ---- sources and sinks ---------------------------------------------------------------------------


def csv_roundtrip(spark, d):
    log = _log(spark, d)
    path = work_dir(spark, "csv")
    clicklog.write_csv(log.select(F.col("rec_id").alias("_c0"), "label", *clicklog.DENSE, *clicklog.SPARSE).fillna(0.0, subset=clicklog.DENSE), path)
    return clicklog.read_csv(spark, path).select("label", F.round("I2", 6).alias("I2"), F.round("I13", 6).alias("I13"), "C3", "C26")


def tsv_hex_scan(spark, d):
    log = _log(spark, d)
    path = work_dir(spark, "tsv")
    tokens = [F.when(F.col(c) >= 0, F.lower(F.hex(c))).alias(c) for c in clicklog.SPARSE]
    log.select("label", *clicklog.DENSE, *tokens).write.option("sep", "\t").csv(path)
    raw = clicklog.read_tsv(spark, path)
    return raw.select("label", features.hex_parse(F.col("C1")).alias("C1"), features.hex_parse(F.col("C26")).alias("C26"))


def day_files_scan_all(spark, d):
    """Every day passes through writer and reader."""
    log = _log(spark, d).select("label", *[F.nanvl(F.coalesce(c, F.lit(0.0)), F.lit(0.0)).alias(c) for c in clicklog.DENSE], *clicklog.SPARSE, "day_n")
    path = work_dir(spark, "days")
    clicklog.write_all_days(log, path, 400)
    rows = clicklog.read_days(spark, path)
    return rows.groupBy("day_n").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("label").alias("clicks"), F.sum("C9").alias("c9_sum"))


def tfrecord_roundtrip_all(spark, d):
    """Rows with missing features too: the writer leaves them out, the reader gives NULL."""
    log = _log(spark, d).select("rec_id", "label", "C3", "I2")
    path = work_dir(spark, "tfrecord")
    tfrecord.write(log, path)
    return tfrecord.read(spark, path, log.schema).select("rec_id", "label", "C3", F.round("I2", 6).alias("I2"))


def vocabulary_meta(spark, d):
    path = work_dir(spark, "vocabulary")
    clicklog.write_vocabulary(column_cardinality(spark, d), path)
    return clicklog.read_vocabulary(spark, path)


def record_files(spark, d):
    path = work_dir(spark, "records")
    clicklog.write_records(table(spark, d, "events").select("event_id", "user_id"), path, 3000)
    files = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).count()
    return files.agg(F.sum("count").alias("n_rows"), (F.max("count") <= 3000).alias("bounded"))


# ---- analysis ------------------------------------------------------------------------------------------


def _batched(spark, d, size: int = 100):
    rows = features.batches(_log(spark, d).select("rec_id", "C1", "C5", "C20"), ["rec_id"], size)
    return rows.select("batch", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("key")) for c in ("C1", "C5", "C20")])).alias("x")).select("batch", "x.*").where("key is not null and key <> -1")


def batch_locality(spark, d):
    got = analysis.batch_locality(_batched(spark, d), "column", "batch", "key")
    return got.select("column", "n_rows", "n_distinct", "hit_rows", "hit_distinct", F.round("row_ratio", 6).alias("row_ratio"), F.round("distinct_ratio", 6).alias("distinct_ratio"))


def cumulative_cache_hit_all(spark, d):
    """Every batch of 4096 rows, over all rows."""
    return analysis.cumulative_hits(_batched(spark, d, 4096), "column", "batch", "key")


def trace_rollup(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("op:"), "event_type").alias("name"), F.col("event_id").cast("double").alias("ts"), F.col("value").alias("dur"))
    # traces come as JSON documents of up to a hundred events
    docs = e.groupBy(F.floor(F.col("ts") / 100).alias("f")).agg(F.to_json(F.struct(F.collect_list(F.struct("name", "ts", "dur")).alias("traceEvents"))).alias("value"))
    return analysis.trace_rollup(profiling.trace_events(docs, "value"))


def log_pivot(spark, d):
    e = table(spark, d, "events")
    epochs = e.select(F.col("event_type").alias("case"), F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4), F.lit(8)), (F.pmod("event_id", F.lit(4)) + 1).cast("int")).alias("np"), F.col("value").alias("seconds"))
    got = analysis.log_pivot(epochs)
    return got.select("case", *[F.col(str(n)).alias(f"np{n}") for n in (1, 2, 4, 8)])


def epoch_logs(spark, d):
    path = work_dir(spark, "logs")
    lines = table(spark, d, "region").select(F.concat(F.lit("step - "), F.col("r_regionkey") + 10, F.lit("s - loss: 0.5")).alias("value"))
    lines.unionByName(spark.createDataFrame([("Epoch 1/5",)], "value string")).coalesce(1).write.text(path)
    files = spark.read.text(path).select("value", F.lit("dir/deepfm_9_4.out").alias("file"))
    return profiling.epoch_lines(files).groupBy("case", "np").agg(F.min("seconds").alias("seconds"), F.count(F.lit(1)).alias("n"))


# ---- metrics -----------------------------------------------------------------------------------------------


def _scored(spark, d):
    return table(spark, d, "events").select(F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("y"), (F.pmod(F.col("event_id") * 37, F.lit(100)) / 100.0).alias("p"))


def logloss(spark, d):
    return metrics.log_loss(_scored(spark, d), "y", "p").select(F.round("log_loss", 6).alias("log_loss"))


def auc(spark, d):
    return metrics.auc(_scored(spark, d), "y", "p").select(F.round("auc", 6).alias("auc"))


def error_rate(spark, d):
    return metrics.error_rate(_scored(spark, d), "y", "p").select(F.round("error_rate", 6).alias("error_rate"))


def metric_average(spark, d):
    """A metric per worker, averaged over workers."""
    rows = table(spark, d, "events").select(F.pmod("event_id", F.lit(4)).alias("worker"), (F.col("event_type") == "purchase").cast("double").alias("y"))
    return rows.groupBy("worker").agg(F.avg("y").alias("m")).agg(F.round(F.avg("m"), 6).alias("metric"))


def _event_vectors(spark, d):
    emb = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.slice(F.col("embedding").cast("array<double>"), 1, 4).alias("weights"))
    keys = table(spark, d, "events").select("event_id", "value", F.explode(F.array(F.col("user_id"), F.col("user_id") * 2, F.pmod(F.col("event_id"), F.lit(500)))).alias("key"))
    return lookup.pull(keys, emb, init={"category": "constant"}, dim=4)


def fm_second_order(spark, d):
    return metrics.fm_second_order(_event_vectors(spark, d), "event_id", "weights", 4).select("event_id", F.round("fm", 6).alias("fm"))


def lr_forward(spark, d):
    rows = _event_vectors(spark, d).withColumn("w", F.get("weights", F.lit(0)))
    return metrics.lr_forward(rows, "event_id", "w", F.col("value") * 0.001, 0.1).select("event_id", F.round("p", 6).alias("p"))


QUERIES = {f.__name__: f for f in (
    fill_missing, column_prefix, minmax_scale, standardise, label_encode_sorted, label_encode_first_seen, hash_bucket_share, offset_encode, row_replicate, hex_parse,
    batch_assign, train_test_split, column_cardinality, init_uniform, init_normal, csv_roundtrip, tsv_hex_scan, day_files_scan_all, tfrecord_roundtrip_all, vocabulary_meta, record_files,
    batch_locality, cumulative_cache_hit_all, trace_rollup, log_pivot, epoch_logs, logloss, auc, error_rate, metric_average, fm_second_order, lr_forward,
)}

_NAN0 = "CASE WHEN {0} IS NULL OR isnan({0}) THEN 0 ELSE {0} END"
_BATCHED = """
WITH r AS (SELECT (ROW_NUMBER() OVER (ORDER BY rec_id) - 1) // 100 AS batch, C1, C5, C20 FROM train100),
x AS (SELECT batch, 'C1' AS "column", C1 AS key FROM r UNION ALL SELECT batch, 'C5', C5 FROM r UNION ALL SELECT batch, 'C20', C20 FROM r),
b AS (SELECT "column", batch, key, COUNT(*) AS n FROM x WHERE key IS NOT NULL AND key <> -1 GROUP BY ALL)
"""
_SCORED = "WITH s AS (SELECT CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y, (event_id * 37 % 100) / 100.0 AS p FROM events)\n"
_VECTORS = """
WITH k AS (SELECT event_id, value, UNNEST([user_id, user_id * 2, event_id % 500]) AS key FROM events),
v AS (SELECT event_id, value, [COALESCE(CAST(embedding[i] AS DOUBLE), 0) FOR i IN [1, 2, 3, 4]] AS w FROM k LEFT JOIN embeddings ON vec_id = key)
"""
_HEX = "CASE WHEN p_partkey % 7 = 0 THEN -1 ELSE {} END"

ORACLE = {
    "fill_missing": f"SELECT rec_id, ROUND({_NAN0.format('I1')}, 6) AS I1, ROUND({_NAN0.format('I12')}, 6) AS I12, COALESCE(C5, -1) AS C5, COALESCE(C20, -1) AS C20 FROM train100",
    "column_prefix": "SELECT column_name AS name FROM (DESCRIBE train100) WHERE regexp_full_match(column_name, '[CI][0-9]+')",
    "minmax_scale": """
WITH m AS (SELECT MIN(l_quantity) a1, MAX(l_quantity) b1, MIN(l_extendedprice) a2, MAX(l_extendedprice) b2, MIN(l_discount) a3, MAX(l_discount) b3 FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ROUND((l_quantity - a1) / (b1 - a1), 6) AS l_quantity, ROUND((l_extendedprice - a2) / (b2 - a2), 6) AS l_extendedprice, ROUND((l_discount - a3) / (b3 - a3), 6) AS l_discount, CAST(0 AS DOUBLE) AS flat
FROM lineitem, m""",
    "standardise": "SELECT l_orderkey, l_linenumber, l_partkey, ROUND((l_quantity - 25) / 10, 6) AS q, ROUND((l_tax - 0.04e0) / 0.02e0, 6) AS t FROM lineitem",
    "label_encode_sorted": "SELECT p_partkey, p_brand, DENSE_RANK() OVER (ORDER BY p_brand) - 1 AS code FROM part",
    "label_encode_first_seen": """
WITH f AS (SELECT C20 AS v, ROW_NUMBER() OVER (ORDER BY MIN(rec_id)) - 1 AS code FROM train100 WHERE C20 IS NOT NULL GROUP BY C20)
SELECT rec_id, C20, code FROM train100 LEFT JOIN f ON v = C20""",
    "hash_bucket_share": "SELECT event_type, CAST(1 AS BIGINT) AS n_buckets, COUNT(*) AS n_rows FROM events GROUP BY event_type",
    "offset_encode": "WITH m AS (SELECT MAX(C1) + 1 AS a, MAX(C2) + 1 AS b FROM train100) SELECT rec_id, C1, C2 + a AS C2, C9 + a + b AS C9 FROM train100, m",
    "row_replicate": "SELECT r_name, CAST(r_regionkey AS BIGINT) * 3 + r AS id FROM region, (SELECT UNNEST([0, 1, 2]) AS r)",
    "hex_parse": f"""
SELECT p_partkey, CAST({_HEX.format('p_partkey')} AS BIGINT) AS value,
  CAST({_HEX.format("CAST(concat('0x', translate(lower(to_hex(p_partkey)), 'abcdef', '012345')) AS BIGINT)")} AS BIGINT) AS legacy
FROM part""",
    "batch_assign": "SELECT event_id, (ROW_NUMBER() OVER (ORDER BY ts, event_id) - 1) // 256 AS batch FROM events",
    "train_test_split": """
WITH r AS (SELECT event_id, ROW_NUMBER() OVER (ORDER BY ts, event_id) - 1 AS rn, CAST(floor(COUNT(*) OVER () * 0.8e0) AS BIGINT) AS s, COUNT(*) OVER () AS n FROM events)
SELECT event_id, rn >= s AS is_test FROM r WHERE rn < s // 64 * 64 OR (rn >= s AND rn < s + (n - s) // 64 * 64)""",
    "column_cardinality": """
SELECT 'C1' AS "column", MIN(C1) AS min, MAX(C1) AS max, MAX(C1) + 1 AS cardinality FROM train100
UNION ALL SELECT 'C9', MIN(C9), MAX(C9), MAX(C9) + 1 FROM train100 UNION ALL SELECT 'C20', MIN(C20), MAX(C20), MAX(C20) + 1 FROM train100""",
    "init_uniform": "SELECT TRUE AS above, TRUE AS below, TRUE AS centred, TRUE AS spread, TRUE AS stable",
    "init_normal": "SELECT TRUE AS above, TRUE AS below, TRUE AS centred",
    "csv_roundtrip": f"SELECT label, ROUND({_NAN0.format('I2')}, 6) AS I2, ROUND({_NAN0.format('I13')}, 6) AS I13, C3, C26 FROM train100",
    "tsv_hex_scan": "SELECT label, CASE WHEN C1 >= 0 THEN C1 ELSE -1 END AS C1, CASE WHEN C26 >= 0 THEN C26 ELSE -1 END AS C26 FROM train100",
    "day_files_scan_all": "SELECT CAST(day_n AS INT) AS day_n, COUNT(*) AS n_rows, CAST(SUM(label) AS BIGINT) AS clicks, CAST(SUM(C9) AS BIGINT) AS c9_sum FROM train100 GROUP BY day_n",
    "tfrecord_roundtrip_all": "SELECT rec_id, label, C3, ROUND(CAST(CAST(I2 AS FLOAT) AS DOUBLE), 6) AS I2 FROM train100",
    "vocabulary_meta": """SELECT 'C1' AS "column", MAX(C1) + 1 AS cardinality FROM train100 UNION ALL SELECT 'C9', MAX(C9) + 1 FROM train100 UNION ALL SELECT 'C20', MAX(C20) + 1 FROM train100""",
    "record_files": "SELECT COUNT(*) AS n_rows, TRUE AS bounded FROM events",
    "batch_locality": _BATCHED + """
SELECT b."column", CAST(SUM(b.n) AS BIGINT) AS n_rows, COUNT(*) AS n_distinct, CAST(COALESCE(SUM(b.n) FILTER (p.key IS NOT NULL), 0) AS BIGINT) AS hit_rows, COUNT(p.key) AS hit_distinct,
  ROUND(COALESCE(SUM(b.n) FILTER (p.key IS NOT NULL), 0) / SUM(b.n), 6) AS row_ratio, ROUND(COUNT(p.key) / COUNT(*), 6) AS distinct_ratio
FROM b LEFT JOIN b p ON p."column" = b."column" AND p.batch = b.batch - 1 AND p.key = b.key GROUP BY b."column" """,
    "cumulative_cache_hit_all": _BATCHED.replace("// 100 ", "// 4096 ") + """
SELECT "column", batch, COUNT(*) AS n_distinct, COUNT(*) FILTER (first < batch) AS n_seen FROM (SELECT *, MIN(batch) OVER (PARTITION BY "column", key) AS first FROM b) GROUP BY "column", batch""",
    "trace_rollup": """
SELECT event_type AS op, CAST(trunc(MIN(event_id) / 1000) AS BIGINT) AS start_ms, CAST(trunc(MAX(event_id + value) / 1000) AS BIGINT) AS end_ms, CAST(trunc(SUM(value) / 1000) AS BIGINT) AS total_ms, COUNT(*) AS n FROM events GROUP BY event_type""",
    "log_pivot": """
SELECT event_type AS "case", MIN(value) FILTER (event_id % 4 = 0) AS np1, MIN(value) FILTER (event_id % 4 = 1) AS np2, MIN(value) FILTER (event_id % 4 = 2) AS np4, MIN(value) FILTER (event_id % 4 = 3) AS np8 FROM events GROUP BY event_type""",
    "epoch_logs": """SELECT 'deepfm_9' AS "case", 4 AS np, CAST(MIN(r_regionkey) + 10 AS DOUBLE) AS seconds, COUNT(*) AS n FROM region""",
    "logloss": _SCORED + "SELECT ROUND(AVG(-(y * ln(greatest(least(p, 1 - 1e-15), 1e-15)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-15), 1e-15)))), 6) AS log_loss FROM s",
    "auc": _SCORED + """,
r AS (SELECT y, RANK() OVER (ORDER BY p) + (COUNT(*) OVER (PARTITION BY p) - 1) / 2.0e0 AS k FROM s)
SELECT ROUND((SUM(k) FILTER (y = 1) - SUM(y) * (SUM(y) + 1) / 2.0e0) / (CAST(SUM(y) AS DOUBLE) * SUM(1 - y)), 6) AS auc FROM r""",
    "error_rate": _SCORED + "SELECT ROUND(AVG(CASE WHEN floor(p + 0.5) <> y THEN 1.0e0 ELSE 0e0 END), 6) AS error_rate FROM s",
    "metric_average": "SELECT ROUND(AVG(m), 6) AS metric FROM (SELECT event_id % 4 AS w, AVG(CASE WHEN event_type = 'purchase' THEN 1.0e0 ELSE 0e0 END) AS m FROM events GROUP BY 1)",
    "fm_second_order": _VECTORS + """,
e AS (SELECT event_id, SUM(w[1]) s1, SUM(w[2]) s2, SUM(w[3]) s3, SUM(w[4]) s4, SUM(w[1]*w[1]+w[2]*w[2]+w[3]*w[3]+w[4]*w[4]) q FROM v GROUP BY event_id)
SELECT event_id, ROUND(0.5e0 * (s1*s1+s2*s2+s3*s3+s4*s4 - q), 6) AS fm FROM e""",
    "lr_forward": _VECTORS + "SELECT event_id, ROUND(1 / (1 + exp(-(SUM(w[1]) + MIN(value) * 0.001e0 + 0.1e0))), 6) AS p FROM v GROUP BY event_id",
}
