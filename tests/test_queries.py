import pytest
from compare import connect, same

from quillstate.plans import registry

DIR = "/root/testdata/sf0.001"
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    same(QUERIES[name](spark, DIR), con, ORACLE[name])


def test_pull_ordered_takes_every_key(spark, tmp_path):
    # beyond 500 with and without a row, negative, NULL, twice; vectors that are NULL or short
    spark.createDataFrame([(0, 3), (1, 1209), (2, 1209), (3, 700), (4, -1), (5, None), (6, 4), (7, 5), (8, (1 << 63) - 1)], "event_id bigint, user_id bigint").write.parquet(f"{tmp_path}/t/events.parquet")
    spark.createDataFrame([(3, [0.5, 1.5], 1), (1209, [0.1234567, -2.0], 2), (4, None, 3), (5, [7.0], 4)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/t/embeddings.parquet")
    own = connect(tmp_path / "none")
    for t in ("events", "embeddings"):
        own.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/t/{t}.parquet/*.parquet'")
    got = QUERIES["pull_ordered"](spark, str(tmp_path / "t"))
    assert got.count() == 9
    same(got, own, ORACLE["pull_ordered"])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
