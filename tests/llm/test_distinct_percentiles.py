from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstate.llm import distinct, percentiles

FIRST = date(2020, 1, 1)


def test_ranges_and_combinations(spark):
    rng = np.random.default_rng(5)
    days = 150  # three words of days
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    rows = [("C1", pick([None, -1, 1, *range(40)]), FIRST + timedelta(int(rng.integers(-3, days + 3))), pick([None, 0, 1, -1]), pick([None, 0, 1])) for _ in range(3000)] + [("C1", 5, None, 0, 0)]
    pairs = spark.createDataFrame(rows, "field string, id bigint, day date, c9 bigint, label int").withColumn("pattern", F.lit(9)).withColumn("n_ids", F.lit(1))
    asked = [(i, "C1", FIRST + timedelta(a), FIRST + timedelta(b), c9, label) for i, (a, b, c9, label) in enumerate((a, b, c9, label) for a, b in ((0, 0), (-9, 30), (0, days - 1), (50, 70), (61, 62), (100, 149)) for c9 in (None, 0, -1, 7) for label in (None, 1))]
    asked.append((99, "C7", FIRST, FIRST, None, None))
    requests = spark.createDataFrame(asked, "meta_id int, field string, day_from date, day_to date, c9 bigint, label int")
    counters = distinct.range_counters(pairs, ["c9", "label"], [(False, False), (True, False), (False, True), (True, True)], FIRST, FIRST + timedelta(days - 1))
    got = {r.meta_id: r.n_ids for r in distinct.answer_ranges(counters, requests, "meta_id", ["c9", "label"], FIRST).collect()}
    for i, field, a, b, c9, label in asked:
        a = max(a, FIRST)
        want = {r[1] for r in rows if r[0] == field and r[1] not in (None, -1) and r[2] and a <= r[2] <= b and c9 in (None, r[3]) and label in (None, r[4])}
        assert got[i] == len(want), (a, b, c9, label)
    empty = distinct.range_counters(pairs.limit(0), ["c9", "label"], [(False, False)], FIRST, FIRST)
    assert {r.n_ids for r in distinct.answer_ranges(empty, requests, "meta_id", ["c9", "label"], FIRST).collect()} == {0}


def test_buckets_and_days_are_merged(spark):
    """Counters of separate ranges of buckets add up; states of separate days give what all days give."""
    rng = np.random.default_rng(8)
    rows = [("C1", int(rng.integers(200)), FIRST + timedelta(int(rng.integers(90))), int(rng.integers(3))) for _ in range(2000)]
    pairs = spark.createDataFrame(rows, "field string, id bigint, day date, c9 bigint")
    patterns, last = [(False,), (True,)], FIRST + timedelta(89)
    key = lambda df: sorted((r.pattern, -1 if r.c9 is None else r.c9, r.prev, r.day, r.n_ids) for r in df.collect())
    whole = key(distinct.range_counters(pairs, ["c9"], patterns, FIRST, last))
    third = distinct.BUCKETS // 3
    parts = [distinct.range_counters(pairs, ["c9"], patterns, FIRST, last, b) for b in (range(third), range(third, 2 * third), range(2 * third, distinct.BUCKETS))]
    assert all(key(p) for p in parts) and key(distinct.merge(parts)) == whole
    states = [distinct.bucket_state(pairs.where(c), ["c9"], FIRST, last) for c in ("day < '2020-02-01'", "day >= '2020-02-01'")]
    assert key(distinct.state_counters(distinct.merge_states(states, ["c9"]), ["c9"], patterns)) == whole


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(6)
    rows = [("big", 1, float(x)) for x in rng.lognormal(0, 2, 40_000)] + [("small", 1, float(x)) for x in range(101)] + [("tie", None, 3.0)] * 50
    rows += [("none", 2, None), ("none", 2, float("nan")), ("inf", 3, float("inf")), ("inf", 3, 1.0), ("inf", 3, 0.0), (None, 1, 4.0)]
    return spark.createDataFrame(rows, "g string, c9 bigint, v double").withColumn("n", F.lit(1)).repartition(9), rows


def test_percentiles_within_their_bound(spark, values):
    df, rows = values
    k = 256
    sketches = percentiles.sketch(df, ["g", "c9"], "v", k)
    got = {(r.g, r.c9, r.pct): r for r in percentiles.percentiles(sketches, ["g", "c9"], [0, 50, 90, 100], k).collect()}
    assert {x[:2] for x in got} == {("big", 1), ("small", 1), ("tie", None), ("inf", 3), (None, 1)}
    assert [got["small", 1, p].value for p in (0, 50, 90, 100)] == [0.0, 50.0, 90.0, 100.0]
    assert got["tie", None, 90].value == 3.0 and got[None, 1, 50].n == 1 and got["inf", 3, 100].value == float("inf") and got["inf", 3, 50].value == 1.0
    big = np.sort([r[2] for r in rows if r[0] == "big"])
    for p in (50, 90):
        r = got["big", 1, p]
        assert r.n == 40_000 and r.low <= np.percentile(big, p) <= r.high and r.low <= r.value <= r.high
        assert abs(np.searchsorted(big, r.value) / 40_000 - p / 100) < 0.02
    held = {(r.g): (len(r["items"]), sum(s * 2**i for i, s in enumerate(r.sizes))) for r in sketches.where("g = 'big'").collect()}
    assert held["big"][0] < 12 * k and held["big"][1] == 40_000


def test_sketches_merge(spark, values):
    df, _ = values
    daily = percentiles.sketch(df.withColumn("day", F.spark_partition_id()), ["g", "day"], "v", 512)
    merged = percentiles.merge_sketches(daily, ["g"], 512)
    r = percentiles.percentiles(merged.where("g = 'big'"), ["g"], [50], 512).first()
    exact = df.where("g = 'big'").agg(F.percentile("v", 0.5)).first()[0]
    assert r.n == 40_000 and r.low <= exact <= r.high
    assert percentiles.sketch(df.limit(0), ["g"], "v").count() == 0


def test_flushing_changes_nothing_for_small_groups(spark, values, monkeypatch):
    df, _ = values
    small = df.where("g in ('small', 'tie')")
    monkeypatch.setattr(percentiles, "FLUSH", 5)
    got = percentiles.percentiles(percentiles.sketch(small, ["g"], "v"), ["g"], [50]).collect()
    assert {r.g: r.value for r in got} == {"small": 50.0, "tie": 3.0}


def test_exact_side_of_a_limit(spark):
    rng = np.random.default_rng(9)
    rows, asked, want = [], [], {}
    for g in range(60):
        n = int(rng.integers(1, 40))
        x = np.round(rng.uniform(0, 1, n), 1)  # many ties
        rows += [(g, float(v)) for v in x] + [(g, None), (g, float("nan"))]
        pct = int(rng.choice([50, 90]))
        low, high = sorted(np.round(rng.uniform(0, 1, 2), 1).tolist())
        asked.append((g, pct, low, high))
        v = x[0] if n == 1 else float(np.percentile(x, pct))
        if min(abs(v - low), abs(v - high)) > 1e-9 or v in (low, high):
            want[g] = bool(v < low or v > high)
    got = percentiles.exact_beyond(spark.createDataFrame(rows, "g int, v double"), spark.createDataFrame(asked, "g int, pct int, low_limit double, high_limit double"), ["g"], "v")
    got = {r.g: r.beyond for r in got.collect()}
    assert {g: got[g] for g in want} == want
