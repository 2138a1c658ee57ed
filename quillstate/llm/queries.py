"""Queries p1 to p4 and p6 to p8 with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstate.llm import distinct, frequent, mixture, percentiles, pii, seen, tokens
from quillstate.session import cut, table


def _present(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != -1)


# ---- p1: most frequent items -------------------------------------------------------

P1_SHARE, P1_K = "0.005", 20


def _p1_items(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "train100").select(F.lit(-1).alias("variable_id"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("item")) for c in ("C1", "C3")])).alias("x"))
    pulls = table(spark, d, "embedding_pull_items").select(F.lit("indices").alias("field"), "variable_id", F.explode("indices").alias("item"))
    return log.select("x.field", "variable_id", "x.item").unionByName(pulls).where(_present("item"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return frequent.frequent_by_share(_p1_items(spark, d), "field", ["variable_id", "item"], P1_SHARE).select("field", "variable_id", "item")


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return frequent.frequent_by_share(_p1_items(spark, d), "field", ["variable_id", "item"], P1_SHARE).select("field", "variable_id", "item", "n_rows", "field_rows")


def p1_top(spark: SparkSession, d: str) -> DataFrame:
    return frequent.frequent_by_rank(_p1_items(spark, d), "field", ["variable_id", "item"], P1_K).select("field", "variable_id", "item", "n_rows", "rank")


_P1_SQL = """
WITH v AS (
  SELECT 'C1' AS field, -1 AS variable_id, C1 AS item FROM train100
  UNION ALL SELECT 'C3', -1, C3 FROM train100
  UNION ALL SELECT 'indices', variable_id, unnest(indices) FROM embedding_pull_items),
u AS (SELECT * FROM v WHERE item IS NOT NULL AND item <> -1),
t AS (SELECT field, COUNT(*) AS field_rows FROM u GROUP BY field),
k AS (SELECT field, variable_id, item, COUNT(*) AS n_rows FROM u GROUP BY field, variable_id, item)
"""

# ---- p2: seen before ---------------------------------------------------------------

P2_HASH_BITS = 64


def _p2_stream(spark: SparkSession, d: str) -> DataFrame:
    clicks = table(spark, d, "train100").select(F.lit("C5").alias("stream"), F.col("rec_id").alias("rec"), F.lit(0).alias("pos"), F.lit(5).alias("variable_id"), F.col("C5").alias("id"))
    pulls = table(spark, d, "embedding_pull_items").select(F.lit("indices").alias("stream"), F.col("rec_id").alias("rec"), F.posexplode("indices").alias("pos", "id"), "variable_id")
    return clicks.unionByName(pulls).where(_present("id"))


def _p2_known(spark: SparkSession, d: str) -> DataFrame:
    saved = table(spark, d, "checkpoint_rows").select("variable_id", F.col("key").alias("id"))
    return saved.select(F.explode(F.array(F.lit("C5"), F.lit("indices"))).alias("stream"), "variable_id", "id").where(_present("id"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    hits = seen.seen_before(_p2_stream(spark, d), _p2_known(spark, d), ["variable_id", "id"], hash_bits=P2_HASH_BITS)
    return hits.select(F.col("stream").alias("field"), F.col("rec").alias("rec_id"), "pos")


def p2_error_rate(spark: SparkSession, d: str) -> DataFrame:
    """Records, those reported as seen, and the wrong answers among them, per stream.

    Exact truth: a record is new iff it is the first of its full key and the key is not saved.
    Both sides are reduced to first occurrences per key before they meet.
    """
    stream, known = _p2_stream(spark, d), _p2_known(spark, d)
    new = seen.first_occurrences(stream, known, ["variable_id", "id"], hash_bits=P2_HASH_BITS)
    truth = stream.groupBy("stream", "variable_id", "id").agg(F.count(F.lit(1)).alias("n")).join(known.distinct().withColumn("saved", F.lit(1)), ["stream", "variable_id", "id"], "left")
    totals = truth.groupBy("stream").agg(F.sum("n").alias("records"), F.count(F.when(F.col("saved").isNull(), 1)).alias("truly_new"))
    reported = new.groupBy("stream").agg(F.count(F.lit(1)).alias("reported_new"))
    both = totals.join(reported, "stream", "left").withColumn("reported_new", F.coalesce("reported_new", F.lit(0)))
    wrong = F.col("truly_new") - F.col("reported_new")
    return both.select(F.col("stream").alias("field"), "records", (F.col("records") - F.col("reported_new")).alias("reported_seen"), wrong.alias("wrong"), (wrong / F.col("records")).alias("wrong_rate"))


def p2_state(spark: SparkSession, d: str) -> DataFrame:
    """Coded sets kept between days: saved keys first, then each stream merged in; keys held, and those that each day added."""
    days = [table(spark, d, "checkpoint_rows").select("variable_id", F.col("key").alias("id")).where(_present("id"))]
    stream = _p2_stream(spark, d)
    days += [stream.where(F.col("stream") == s).select("variable_id", "id") for s in ("C5", "indices")]
    bits = seen.range_bits(sum(x.count() for x in days), 8)
    state, held = None, []
    for day in days:
        made = seen.build_state(day, ["variable_id", "id"], part_bits=bits) if state is None else seen.update_state(state, day, ["variable_id", "id"], part_bits=bits)
        state = cut(made)
        held.append(state.agg(F.sum("n")).first()[0] or 0)
    return spark.createDataFrame([(i, n, n - (held[i - 1] if i else 0)) for i, n in enumerate(held)], "day int, n_keys bigint, n_new bigint")


_P2_SQL = """
WITH s AS (
  SELECT 'C5' AS field, rec_id, 0 AS pos, 5 AS variable_id, C5 AS id FROM train100
  UNION ALL
  SELECT 'indices', rec_id, UNNEST(range(len(indices))), variable_id, UNNEST(indices) FROM embedding_pull_items),
u AS (SELECT * FROM s WHERE id IS NOT NULL AND id <> -1),
r AS (
  SELECT u.*, ROW_NUMBER() OVER (PARTITION BY field, u.variable_id, id ORDER BY rec_id, pos) AS nth,
         c.key IS NOT NULL AS saved
  FROM u LEFT JOIN (SELECT DISTINCT variable_id, key FROM checkpoint_rows) c
    ON u.variable_id = c.variable_id AND u.id = c.key)
"""

# ---- p3: distinct counts ------------------------------------------------------------

P3_FIELDS = ["C1", "C3", "C5"]
_P3_GROUPS = ["c9", "c20", "label"]


def _p3_counts(spark: SparkSession, d: str) -> DataFrame:
    meta = table(spark, d, "embedding_variable_meta").where(F.col("variable_name").isin(P3_FIELDS) & F.col("vocabulary_size").isNotNull() & (F.col("vocabulary_size") < F.lit(str(1 << 63)).cast("decimal(20,0)")))
    meta = meta.select("meta_id", F.col("variable_name").alias("field"), "vocabulary_size", "day_from", "day_to", *_P3_GROUPS).distinct()
    span = meta.agg(F.min("day_from").alias("a"), F.max("day_to").alias("b"), *[F.collect_set(F.struct(*[F.col(g).isNotNull() for g in _P3_GROUPS])).alias("p")]).first()
    log = table(spark, d, "train100")
    pairs = log.select(
        F.to_date("event_ts").alias("day"), F.col("C9").alias("c9"), F.col("C20").alias("c20"), "label",
        F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("id")) for c in P3_FIELDS])).alias("x"),
    ).select("x.field", "x.id", "day", *_P3_GROUPS)
    seen_days = log.agg(F.min(F.to_date("event_ts")).alias("a"), F.max(F.to_date("event_ts")).alias("b")).first()
    if span["a"] is None or span["b"] is None or seen_days["a"] is None:
        return meta.withColumn("n_ids", F.lit(0).cast("bigint"))
    # days that both a slice and the log have; one impossible date on either side widens nothing
    first, last = max(span["a"], seen_days["a"]), min(span["b"], seen_days["b"])
    counters = distinct.range_counters(pairs, _P3_GROUPS, sorted(tuple(x) for x in span["p"]), first, last)
    return meta.join(distinct.answer_ranges(counters, meta, "meta_id", _P3_GROUPS, first), "meta_id")


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return _p3_counts(spark, d).select("meta_id", "field", F.col("vocabulary_size").cast("bigint").alias("vocabulary_size"), "n_ids")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    off = F.abs(F.col("vocabulary_size") - F.col("n_ids").cast("decimal(20,0)")) * 10
    return _p3_counts(spark, d).where(off > F.col("n_ids").cast("decimal(20,0)")).select("meta_id").distinct()


_P3_SQL = """
WITH m AS (
  SELECT DISTINCT meta_id, variable_name AS field, vocabulary_size, day_from, day_to, c9, c20, label
  FROM embedding_variable_meta
  WHERE variable_name IN ('C1', 'C3', 'C5') AND vocabulary_size IS NOT NULL AND vocabulary_size < 9223372036854775808),
l AS (
  SELECT CAST(event_ts AS DATE) AS day, C9, C20, label, 'C1' AS field, C1 AS id FROM train100
  UNION ALL SELECT CAST(event_ts AS DATE), C9, C20, label, 'C3', C3 FROM train100
  UNION ALL SELECT CAST(event_ts AS DATE), C9, C20, label, 'C5', C5 FROM train100),
n AS (
  SELECT m.meta_id, COUNT(DISTINCT l.id) AS n_ids
  FROM m LEFT JOIN l ON l.field = m.field AND l.id IS NOT NULL AND l.id <> -1 AND l.day BETWEEN m.day_from AND m.day_to
    AND (m.c9 IS NULL OR l.C9 = m.c9) AND (m.c20 IS NULL OR l.C20 = m.c20) AND (m.label IS NULL OR l.label = m.label)
  GROUP BY m.meta_id)
"""

# ---- p4: percentiles ------------------------------------------------------------------

P4_FIELDS, P4_PCTS, P4_LEAST = ["I2", "I5", "I13"], [50, 90], 20
_P4_GROUPS = ["field", "event_day", "c9"]


def _p4_rows(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "train100").where(_present("C9"))
    return log.select(
        F.date_format("event_ts", "yyyy-MM-dd").alias("event_day"), F.col("C9").alias("c9"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in P4_FIELDS])).alias("x"),
    ).select("x.field", "event_day", "c9", "x.v")


def _p4_table(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.percentiles(percentiles.sketch(_p4_rows(spark, d), _P4_GROUPS, "v"), _P4_GROUPS, P4_PCTS)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "feature_baseline").select(F.col("field").alias("f"), F.col("c9").alias("g"), F.col("pct").alias("p"), "expected").distinct()
    got = _p4_table(spark, d).where(F.col("n") >= P4_LEAST)
    judged = got.join(base, (F.col("field") == F.col("f")) & (F.col("c9") == F.col("g")) & (F.col("pct") == F.col("p")))
    off = F.abs("expected") * 0.4
    judged = judged.withColumn("low_limit", F.col("expected") - off).withColumn("high_limit", F.col("expected") + off)
    out, inside = (F.col("low") > F.col("high_limit")) | (F.col("high") < F.col("low_limit")), (F.col("low") >= F.col("low_limit")) & (F.col("high") <= F.col("high_limit"))
    judged = cut(judged.withColumn("state", F.when(out, "out").when(inside, "in").otherwise("open")))
    clear = judged.where("state = 'out'").select(*_P4_GROUPS, "pct")
    # the limits lie within the error bound of these groups: decided by counting
    asked = judged.where("state = 'open'").select(*_P4_GROUPS, "pct", "low_limit", "high_limit")
    close = percentiles.exact_beyond(_p4_rows(spark, d), asked, _P4_GROUPS, "v").where("beyond").select(*_P4_GROUPS, "pct")
    return clear.unionByName(close).select("field", "event_day", "c9", "pct")


def p4_rank_error(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per group merged over all days, against their exact ranks.

    ``n`` values, the share of values below the sketched percentile and at most equal to it:
    the wanted share lies between both, but for the bounded rank error.
    """
    groups = ["field", "c9"]
    days = percentiles.sketch(_p4_rows(spark, d), _P4_GROUPS, "v")
    got = percentiles.percentiles(percentiles.merge_sketches(days, groups), groups, P4_PCTS)
    rows = _p4_rows(spark, d).where(F.col("v").isNotNull() & ~F.isnan("v")).select(F.col("field").alias("f"), F.col("c9").alias("g"), "v")
    ranked = rows.join(got, (F.col("f") == F.col("field")) & (F.col("g") == F.col("c9")))
    agg = ranked.groupBy("field", "c9", "pct", "n").agg(F.count(F.when(F.col("v") < F.col("value"), 1)).alias("below"), F.count(F.when(F.col("v") <= F.col("value"), 1)).alias("upto"))
    want = F.col("pct") / 100 * (F.col("n") - 1)
    off = F.greatest(F.lit(0.0), F.col("below") - 1 - want, want - F.col("upto"))
    return agg.select("field", "c9", "pct", "n", (off <= F.col("n") * 0.01).alias("within_1_percent"))


def p4_merged(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each field over all days and groups, from the sketches of days and ``c9`` groups merged twice.

    Most such groups are larger than a level, so compactors have worked. ``rank_ok``: the exact rank of the answer,
    counted over all rows, lies within the bound the sketch claims.
    """
    groups = ["field"]
    days = percentiles.sketch(_p4_rows(spark, d), _P4_GROUPS, "v")
    per = percentiles.merge_sketches(days, ["field", "c9"])
    sketches = cut(percentiles.merge_sketches(per, groups))
    got = percentiles.percentiles(sketches, groups, P4_PCTS).join(sketches.select(F.col("field").alias("__s"), "spread"), F.col("field") == F.col("__s"))
    asked = got.select("field", "pct", "n", "value", F.sqrt(2 * F.col("spread") * F.log(F.lit(2 / percentiles.DELTA))).alias("bound"))
    rows = _p4_rows(spark, d).where(F.col("v").isNotNull() & ~F.isnan("v")).select(F.col("field").alias("f"), "v")
    agg = rows.join(asked, F.col("f") == F.col("field")).groupBy("field", "pct", "n", "value", "bound").agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("v") < F.col("value"), 1)).alias("below"), F.count(F.when(F.col("v") <= F.col("value"), 1)).alias("upto"))
    want = F.col("pct") / 100 * (F.col("n") - 1)
    ok = (F.col("below") - 1 - want <= F.col("bound")) & (want - F.col("upto") <= F.col("bound"))
    return agg.select("field", "pct", "n", "n_rows", (F.col("bound") > 0).alias("compacted"), (ok & (F.col("bound") < 0.1 * F.col("n"))).alias("rank_ok"))


_P4_SQL = """
WITH l AS (
  SELECT strftime(event_ts, '%Y-%m-%d') AS event_day, C9 AS c9, 'I2' AS field, I2 AS v FROM train100
  UNION ALL SELECT strftime(event_ts, '%Y-%m-%d'), C9, 'I5', I5 FROM train100
  UNION ALL SELECT strftime(event_ts, '%Y-%m-%d'), C9, 'I13', I13 FROM train100),
u AS (SELECT * FROM l WHERE c9 IS NOT NULL AND c9 <> -1 AND v IS NOT NULL AND NOT isnan(v)),
"""

# ---- p6: encoding -----------------------------------------------------------------------


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents")).select("doc_id", "ids")


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Texts, tokens, and texts that decoding does not give back (0 where all is well)."""
    ids = tokens.encode(table(spark, d, "documents"), keep=["text"])
    both = tokens.decode(ids.withColumn("n", F.size("ids")), keep=["text", "n"], out="decoded")
    return both.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tokens"), F.count(F.when(F.coalesce("text", F.lit("")) != F.col("decoded"), 1)).alias("n_changed"))


# ---- p7: mixing ---------------------------------------------------------------------------


def _p7_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of the documents of listed sources, counted once."""
    listed = table(spark, d, "mix_target").select("source").where("source is not null").distinct()
    docs = table(spark, d, "documents").select("doc_id", "source", "text", F.xxhash64("text").alias("text_hash")).join(listed, "source", "left_semi")
    return cut(tokens.token_counts(docs, keep=["source", "text_hash"]))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mixture.short_sources(mixture.plan_mix(_p7_sizes(spark, d), table(spark, d, "mix_target"))[1])


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.shares(*mixture.plan_mix(_p7_sizes(spark, d), table(spark, d, "mix_target")))


def p7_schedule(spark: SparkSession, d: str) -> DataFrame:
    return mixture.plan_mix(_p7_sizes(spark, d), table(spark, d, "mix_target"))[1]


def p7_corpus(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(_p7_sizes(spark, d), table(spark, d, "mix_target"))[2]


# ---- p8: personal information ---------------------------------------------------------------


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(table(spark, d, "documents"), table(spark, d, "name_parts")).select("doc_id", "kind", "pii")


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(spark, d, "documents"), table(spark, d, "name_parts"))


QUERIES = {
    "p1_found": p1_found,
    "p1_counts": p1_counts,
    "p1_top": p1_top,
    "p2_found": p2_found,
    "p2_error_rate": p2_error_rate,
    "p2_state": p2_state,
    "p3_found": p3_found,
    "p3_counts": p3_counts,
    "p4_found": p4_found,
    "p4_rank_error": p4_rank_error,
    "p4_merged": p4_merged,
    "p6_ids": p6_ids,
    "p6_round_trip": p6_round_trip,
    "p7_found": p7_found,
    "p7_shares": p7_shares,
    "p7_schedule": p7_schedule,
    "p7_corpus": p7_corpus,
    "p8_found": p8_found,
    "p8_redacted": p8_redacted,
}

ORACLE = {
    "p1_found": _P1_SQL + "SELECT field, variable_id, item FROM k JOIN t USING (field) WHERE n_rows * 1000 >= field_rows * 5",
    "p1_counts": _P1_SQL + "SELECT field, variable_id, item, n_rows, field_rows FROM k JOIN t USING (field) WHERE n_rows * 1000 >= field_rows * 5",
    "p1_top": _P1_SQL + f"""SELECT field, variable_id, item, n_rows, CAST(rank AS INT) AS rank
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY field ORDER BY n_rows DESC, variable_id, item) AS rank FROM k) WHERE rank <= {P1_K}""",
    "p2_found": _P2_SQL + "SELECT field, rec_id, CAST(pos AS INT) AS pos FROM r WHERE saved OR nth > 1",
    "p2_error_rate": _P2_SQL + """
SELECT field, COUNT(*) AS records, COUNT(*) FILTER (saved OR nth > 1) AS reported_seen, CAST(0 AS BIGINT) AS wrong, CAST(0 AS DOUBLE) AS wrong_rate
FROM r GROUP BY field""",
    "p2_state": """
WITH a AS (
  SELECT 0 AS day, variable_id, key AS id FROM checkpoint_rows UNION ALL SELECT 1, 5, C5 FROM train100
  UNION ALL SELECT 2, variable_id, UNNEST(indices) FROM embedding_pull_items),
f AS (SELECT variable_id, id, MIN(day) AS day FROM a WHERE id IS NOT NULL AND id <> -1 GROUP BY variable_id, id),
n AS (SELECT d.day, COUNT(*) FILTER (f.day <= d.day) AS n_keys, COUNT(*) FILTER (f.day = d.day) AS n_new FROM (SELECT UNNEST([0, 1, 2]) AS day) d, f GROUP BY d.day)
SELECT * FROM n""",
    "p3_counts": _P3_SQL + "SELECT meta_id, field, CAST(vocabulary_size AS BIGINT) AS vocabulary_size, n_ids FROM m JOIN n USING (meta_id)",
    "p3_found": _P3_SQL + "SELECT DISTINCT meta_id FROM m JOIN n USING (meta_id) WHERE abs(CAST(vocabulary_size AS HUGEINT) - n_ids) * 10 > n_ids",
    "p4_found": _P4_SQL + """
q AS (SELECT field, event_day, c9, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.9) AS t FROM u GROUP BY field, event_day, c9 HAVING COUNT(*) >= 20),
x AS (SELECT field, event_day, c9, 50 AS pct, m AS value FROM q UNION ALL SELECT field, event_day, c9, 90, t FROM q)
SELECT x.field, x.event_day, x.c9, x.pct FROM x JOIN (SELECT DISTINCT * FROM feature_baseline) b ON b.field = x.field AND b.c9 = x.c9 AND b.pct = x.pct
WHERE abs(x.value - b.expected) > 0.4 * abs(b.expected)""",
    "p4_merged": _P4_SQL + """
n AS (SELECT field, COUNT(*) AS n FROM u GROUP BY field)
SELECT field, p AS pct, n, n AS n_rows, n > 2048 AS compacted, TRUE AS rank_ok FROM n, (SELECT UNNEST([50, 90]) AS p)""",
    "p4_rank_error": _P4_SQL + """
n AS (SELECT field, c9, COUNT(*) AS n FROM u GROUP BY field, c9)
SELECT field, c9, p AS pct, n, TRUE AS within_1_percent FROM n, (SELECT UNNEST([50, 90]) AS p)""",
}
