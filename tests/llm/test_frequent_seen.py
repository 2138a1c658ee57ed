from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from quillstate.llm import frequent, seen
from quillstate.llm.eliasfano import EliasFano


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(1)
    rows = [("a", 1, int(x)) for x in rng.zipf(1.3, 4000) % 100_000] + [("b", int(v), 7) for v in rng.integers(0, 3, 900)] + [(None, 1, 5)] * 3 + [("a", None, 1)] * 60
    return spark.createDataFrame(rows, "field string, variable_id int, item bigint").withColumn("__extra", F.lit(1)).withColumn("n_rows", F.lit(2)), rows


@pytest.mark.parametrize("bits", [(4, 8), (14, 28), (6, 60)])
def test_share(spark, items, bits):
    df, rows = items
    count, total = Counter(rows), Counter(r[0] for r in rows)
    got = {(r.field, r.variable_id, r.item): (r.n_rows, r.field_rows) for r in frequent.frequent_by_share(df, "field", ["variable_id", "item"], "0.01", *bits).collect()}
    assert got == {k: (n, total[k[0]]) for k, n in count.items() if n * 100 >= total[k[0]]}


@pytest.mark.parametrize("k", [1, 5, 50])
def test_rank(spark, items, k):
    df, rows = items
    count = Counter(rows)
    key = lambda x: (x is not None, x)
    want = {}
    for f in {r[0] for r in rows}:
        best = sorted((r for r in count if r[0] == f), key=lambda r: (-count[r], key(r[1]), key(r[2])))[:k]
        want |= {r: (count[r], i + 1) for i, r in enumerate(best)}
    got = {(r.field, r.variable_id, r.item): (r.n_rows, r.rank) for r in frequent.frequent_by_rank(df, "field", ["variable_id", "item"], k, 5, 10).collect()}
    assert got == want


def test_many_survivors_are_shuffled(spark, items, monkeypatch):
    df, _ = items
    a = frequent.frequent_by_share(df, "field", ["variable_id", "item"], "0.01").collect()
    monkeypatch.setattr(frequent, "MAX_BROADCAST", 1)
    assert sorted(map(str, frequent.frequent_by_share(df, "field", ["variable_id", "item"], "0.01").collect())) == sorted(map(str, a))


def test_empty(spark, items):
    df, _ = items
    assert frequent.frequent_by_share(df.limit(0), "field", ["variable_id", "item"], "0.01").count() == 0
    assert frequent.frequent_by_rank(df.limit(0), "field", ["variable_id", "item"], 3).count() == 0


@settings(max_examples=60, deadline=None)
@given(hs.integers(3, 63).flatmap(lambda u: hs.tuples(hs.just(u), hs.sets(hs.integers(0, 2**u - 1), max_size=80), hs.lists(hs.integers(0, 2**u - 1), max_size=40))))
def test_elias_fano(case):
    bits, members, probes = case
    v = np.array(sorted(members), np.uint64)
    e = EliasFano.encode(v, bits)
    assert (e.decode() == v).all()
    p = np.array([*probes, *members], np.uint64)
    index, value = e.successor(p)
    ref = np.searchsorted(v, p)
    assert (index == ref).all() and (value[ref < len(v)] == v[ref[ref < len(v)]]).all()
    again = EliasFano.from_bytes(e.n, bits, *e.to_bytes()[1:])
    assert (again.contains(p) == np.isin(p, v)).all()
    new = np.setdiff1d(np.array(probes, np.uint64), v)
    assert (e.merge(new).decode() == np.union1d(v, new)).all()


def brute(rows, known):
    out, have = set(), {s: set(k) for s, k in known.items()}
    for s, rec, pos, v, i in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        if (v, i) in have.setdefault(s, set()):
            out.add((s, rec, pos))
        have[s].add((v, i))
    return out


@pytest.mark.parametrize("batches", [1, 7])
def test_seen_before(spark, batches):
    rng = np.random.default_rng(2)
    rows = [("x", int(r), p, int(rng.integers(0, 3)), int(rng.integers(0, 300)) if rng.random() > 0.4 else 42) for r in rng.permutation(500) for p in range(2)]
    rows += [("y", r, 0, None, 1 << 62) for r in range(3)] + [("y", None, 0, 1, 9), ("y", 5, 1, 1, 9)]
    schema = "stream string, rec bigint, pos int, variable_id int, id bigint"
    df = spark.createDataFrame(rows, schema).withColumn("h", F.lit(0)).withColumn("part", F.lit("clash"))
    known = spark.createDataFrame([("x", 1, 5), ("x", 1, 5), ("x", 2, 42)], "stream string, variable_id int, id bigint")
    got = seen.seen_before(df, known, ["variable_id", "id"], batches=batches).collect()
    assert {tuple(r) for r in got} == brute(rows, {"x": {(1, 5), (2, 42)}}) and len(got) == len(set(got))
    assert seen.seen_before(df.limit(0), known, ["variable_id", "id"]).count() == 0
    assert {tuple(r) for r in seen.seen_before(df, None, ["variable_id", "id"]).collect()} == brute(rows, {})


def test_short_hashes_only_err_one_way(spark):
    df = spark.range(3000).select(F.lit("s").alias("stream"), F.col("id").alias("rec"), F.lit(0).alias("pos"), "id")
    wrong = seen.seen_before(df, None, ["id"], hash_bits=16).count()  # all keys are new
    assert 0 < wrong <= 3000 * seen.error_bound(3000, 16) * 1.5
    assert seen.seen_before(df, None, ["id"]).count() == 0


def test_state_grows_by_batches(spark):
    a, b = spark.range(500).selectExpr("id as key"), spark.range(300, 900).selectExpr("id as key").union(spark.createDataFrame([(None,)], "key bigint")).where("key is not null")
    state = seen.build_state(a, ["key"], part_bits=3)
    assert state.count() == 8 and sum(r.n for r in state.collect()) == 500
    state = seen.update_state(state, b, ["key"], part_bits=3)
    assert sum(r.n for r in state.collect()) == 900
    sizes = [len(r.low) + len(r.high) for r in state.collect()]
    assert sum(sizes) < 900 * 8  # less than the plain hashes
