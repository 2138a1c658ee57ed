import pytest
from compare import connect, same

from quillstate.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, con, name):
    same(queries.QUERIES[name](spark, DIR), con, queries.ORACLE[name])


def test_encoding_against_the_tokenizer(spark):
    from quillstate.llm import tokens

    enc = tokens.encoder(tokens.default_vocabulary())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = queries.QUERIES["p6_ids"](spark, DIR).collect()
    assert len(got) == len(texts)
    assert all(list(r.ids) == enc.encode_ordinary(texts[r.doc_id] or "") for r in got)
    back = queries.QUERIES["p6_round_trip"](spark, DIR).first()
    assert back.n_docs == len(texts) and back.n_changed == 0


def test_mixing_against_plain_python(spark):
    from quillstate.llm import tokens

    enc = tokens.encoder(tokens.default_vocabulary())
    size = {}
    for r in spark.read.parquet(f"{DIR}/documents.parquet").collect():
        size[r.source] = size.get(r.source, 0) + len(enc.encode_ordinary(r.text or ""))
    targets = spark.read.parquet(f"{DIR}/mix_target.parquet").collect()
    total = sum(size.get(t.source, 0) for t in targets)
    want = {t.source for t in targets if t.weight * total > t.max_repeats * size.get(t.source, 0)}
    assert {r.source for r in queries.QUERIES["p7_found"](spark, DIR).collect()} == want


def test_personal_information_reads_all_kinds(spark):
    rows = queries.QUERIES["p8_found"](spark, DIR).collect()
    assert {r.kind for r in rows} == {"email", "phone", "identity", "address", "name"}
    assert len(rows) == len(set(rows))
    clean = queries.QUERIES["p8_redacted"](spark, DIR).where("text like '%@%.example%' and text not like '%git@%' and text not like '%://%'")
    assert clean.count() == 0
