"""Every query on the smallest tables: the contract's columns, types and rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from helixframe.llm import queries
from helixframe.llm.common import CLEANUP, cleanup, held_out

SF = "/root/testdata/sf0.001"
LONG, TEXT, FLAG, REAL = "bigint", "string", "boolean", "double"
CONTRACT = {
    "op1_warc": [("page_id", LONG), ("payload_bytes", LONG), ("payload_digest", TEXT), ("record_type", TEXT), ("refers_to", LONG)],
    "op2_packing": [("doc_id", LONG), ("start", LONG), ("length", LONG), ("ids_crc32", LONG), ("doc_tokens", LONG), ("sequence_id", LONG), ("offset", LONG)],
    "op3_pii": [("doc_id", LONG), ("n_email", LONG), ("n_ip", LONG), ("n_card", LONG), ("n_phone", LONG), ("base_sha256", TEXT), ("spans", TEXT)],
    "op4_language": [("doc_id", LONG), ("held_out", FLAG), ("lang_pred", TEXT), ("score", REAL)],
    "op5_decontamination": [("doc_id", LONG), ("item_id", LONG)],
    "op6_token_counts": [("doc_id", LONG), ("n_bytes", LONG), ("n_tokens", LONG), ("over_limit", FLAG)],
    "op7_quality": [("doc_id", LONG), ("held_out", FLAG), ("expected_grade", REAL), ("tail_probability", REAL)],
    "op8_embeddings": [("vec_id", LONG), ("n_links", LONG), ("component_id", LONG), ("kept", FLAG)],
    "op9_simhash": [("doc_id", LONG), ("fingerprint", TEXT), ("component_id", LONG)],
    "op10_toxicity": [("doc_id", LONG), ("held_out", FLAG), ("score", REAL), ("predicted", "int")],
}


@pytest.fixture(scope="module")
def results(spark):
    made = {}

    def of(name):
        if name not in made:
            made[name] = queries.queries()[name](spark, SF).persist()
        return made[name]

    yield of
    for df in made.values():
        df.unpersist()


def test_operators_leave_the_session_as_it_was(spark):
    """Shuffle files go with the operators' own writes alone: a user's tables are read row by row without loss."""
    assert CLEANUP not in spark.conf.getAll
    with pytest.raises(ZeroDivisionError), cleanup(spark):
        assert spark.conf.get(CLEANUP) == "true"
        raise ZeroDivisionError
    assert CLEANUP not in spark.conf.getAll
    spark.conf.set(CLEANUP, "false")
    try:
        with cleanup(spark):
            assert spark.conf.get(CLEANUP) == "false"
    finally:
        spark.conf.unset(CLEANUP)
    for name in ("op1_warc", "op8_embeddings", "op9_simhash"):
        got = queries.queries()[name](spark, SF)
        key = got.columns[0]
        assert CLEANUP not in spark.conf.getAll
        assert len(list(got.orderBy(key).toLocalIterator())) == got.count()


def test_there_is_a_query_for_every_operator():
    assert list(queries.queries()) == list(CONTRACT)


@pytest.mark.parametrize("name", CONTRACT)
def test_columns_types_and_rows(spark, results, name):
    got = results(name)
    assert got.dtypes[: len(CONTRACT[name])] == CONTRACT[name]
    key = CONTRACT[name][0][0]
    source = {"page_id": "pages", "vec_id": "embeddings"}.get(key, "documents")
    want = spark.read.parquet(f"{SF}/{source}.parquet")
    if name == "op5_decontamination":
        assert got.join(want, key, "left_anti").count() == 0 and got.count() > 0
    elif name == "op2_packing":
        assert got.select(key).distinct().count() == want.count()
    else:
        assert sorted(r[0] for r in got.select(key).collect()) == sorted(r[0] for r in want.select(key).collect())


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_equals_its_sql(results, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(repr, (tuple(r) for r in results(name).select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_values_are_in_their_ranges(results):
    for name in ("op4_language", "op10_toxicity"):
        got = results(name)
        assert got.where(~F.col("score").between(0, 1)).count() == 0 and got.where(F.col("held_out") != held_out(F.col("doc_id"))).count() == 0
    assert results("op10_toxicity").where("predicted <> int(score >= 0.7)").count() == 0
    assert results("op9_simhash").where("not fingerprint rlike '^[0-9a-f]{16}$' or component_id > doc_id").count() == 0
    assert results("op6_token_counts").where("over_limit <> (n_tokens > 1024)").count() == 0
    pieces = results("op2_packing")
    assert pieces.where("length < 1 or offset + length > 2048").count() == 0
    assert pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).where("n <> m").count() == 0
