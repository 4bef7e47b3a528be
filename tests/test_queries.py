import pytest

from lectern.plans import curation_queries, queries, reading_queries, remediation_queries, source_queries
from tests.oracle import holds

PARTS = (queries, reading_queries, curation_queries, remediation_queries, source_queries)
QUERIES = {k: v for p in PARTS for k, v in p.QUERIES.items()}
ORACLES = {k: v for p in PARTS for k, v in p.ORACLES.items()}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    got = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and len(set(got.columns)) == len(got.columns)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    holds(spark, QUERIES[name], ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_stems_of_the_whole_text(spark, tmp_path):
    word = lambda i: "stem" + chr(97 + i // 26) + chr(97 + i % 26)
    texts = [" ".join(map(word, range(n))) for n in (20, 30)] + [" ".join(word(i) if i != 25 else "other" for i in range(30))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_stems"], r["stems"]) for r in QUERIES["q_f6_stems"](spark, str(tmp_path)).collect()}
    assert [got[i][0] for i in range(3)] == [20, 30, 30] and len({d for _, d in got.values()}) == 3


def test_edits_that_apply_and_that_conflict(spark):
    states = {r["state"] for r in QUERIES["q_c8_edit_states"](spark, "/root/testdata/sf0.001").select("state").distinct().collect()}
    assert states == {"ok", "conflict"}
