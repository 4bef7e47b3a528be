"""Every operator that hands rows on: columns of any name and all null, empty tables, repeated rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import chat_format, exact_dedup, jaccard_join, line_dedup, mixing, piece_sampling, quality_rules, secret_scan, url_filter, warc_revisit

NAMES = "_id _digest _sha _many _lines _words _copy _copies _quality _th _key _text _mark _rid _before _after _part rid name kept id th s size label sid gid token n d1 d2 rank a.b lines kept_lines".split()
PROSE = " ".join(f"word{i % 37} of{i % 11} line{i}" for i in range(60))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, PROSE, "x"), (1, PROSE, "x"), (2, PROSE + " end", None), (None, PROSE, "x"), (None, None, None), (3, "", "y"), (4, " \\n\\t", "y"), (5, PROSE.upper() + " and more", "y")]
    df = spark.createDataFrame([(i, t.replace("\\n", "\n").replace("\\t", "\t") if t else t, s, None) for i, t, s in rows], "doc_id long, text string, source string, lang string")
    return df.select("*", *[F.lit(k).cast("string").alias(n) for k, n in enumerate(NAMES)]).repartition(3)


def trusted(df):
    return df.where("doc_id = 2").select("doc_id")


HANDED_ON = {
    "quality rules": lambda df: quality_rules.keep_good(df, trusted(df)),
    "exact dedup": exact_dedup.drop_exact_duplicates,
    "line dedup": line_dedup.dedup_lines,
    "n-gram Jaccard join": jaccard_join.drop_near_duplicates,
    "mixing": mixing.drawn_copies,
}


@pytest.mark.parametrize("name", sorted(HANDED_ON))
def test_columns_of_any_name_are_handed_on(docs, name):
    got = HANDED_ON[name](docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert all(r[n] == str(k) for r in rows for k, n in enumerate(NAMES)) and all(r["lang"] is None for r in rows)
    none = docs.where("doc_id < -5")
    assert HANDED_ON[name](none).count() == 0 and HANDED_ON[name](none).columns == docs.columns


def test_what_stays(docs):
    told = lambda df: sorted(((r["doc_id"] or -1), len(r["text"] or "")) for r in df.select("doc_id", "text").collect())
    n = len(PROSE)
    assert told(exact_dedup.drop_exact_duplicates(docs)) == [(1, n), (2, n + 4), (3, 0), (4, 3), (5, n + 9)]
    assert told(jaccard_join.drop_near_duplicates(docs)) == [(-1, 0), (1, n), (3, 0), (4, 3)]
    assert told(quality_rules.keep_good(docs, trusted(docs), threshold=-5.0)) == [(-1, n), (1, n), (1, n), (2, n + 4), (5, n + 9)]


def test_pieces_of_any_columns(docs):
    got = piece_sampling.sample_pieces(docs)
    assert got.columns == [*docs.columns, "pieces"]
    assert all(r["back"] == (r["text"] or "") for r in piece_sampling.decode_pieces(got, out="back").collect())
    assert piece_sampling.sample_pieces(docs.where("doc_id < -5"), keep_text=False).count() == 0
    assert piece_sampling.pieces_report(docs.where("doc_id < -5")).count() == 0


def test_reports_read_nothing_else(docs):
    for report in (exact_dedup.exact_duplicates, line_dedup.line_report, jaccard_join.component_report, mixing.mixing_report, secret_scan.secrets_report, piece_sampling.pieces_report):
        assert report(docs).count() == docs.count(), report


def test_chats_of_any_columns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", None), (2, None, None, None), (None, 0, "assistant", "b"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    more = turns.select("*", F.lit(1).alias("turns"), F.lit(2).alias("starts"), F.lit(3).alias("formatted"))
    assert sorted((r["conv_id"] or -1, r["n_turns"]) for r in chat_format.chat_report(more).collect()) == [(-1, 1), (1, 3), (2, 1)]
    assert chat_format.chat_report(more.where("conv_id = 9")).count() == 0


def test_records_of_any_columns(spark):
    schema = "record_id long, url string, ts long, kind string, headers map<string,string>"
    rows = [(1, "http://a.b/c", 5, "response", {"etag": "x"}), (2, "http://a.b/c", 9, "revisit", {"etag": "x"}), (2, "http://a.b/c", 9, "revisit", {"etag": "x"}), (3, None, None, None, None), (None, None, 1, "revisit", None)]
    records = spark.createDataFrame(rows, schema).select("*", F.lit(1).alias("slice"), F.lit(2).alias("found"), F.lit(3).alias("status"), F.lit(4).alias("full"))
    got = sorted((r["record_id"] or -1, r["status"], r["refers_to"]) for r in warc_revisit.resolve_revisits(records).collect())
    assert got == [(-1, "no-earlier-response", None), (2, "resolved", 1), (2, "resolved", 1)]
    assert warc_revisit.resolve_revisits(records.where("ts > 99")).count() == 0


def test_pages_of_any_columns(spark):
    pages = spark.createDataFrame([(1, "http://bad.org/x", "c"), (1, "http://bad.org/x", "c"), (None, None, None)], "page_id long, url string, host string").withColumns({"_block": F.lit(1), "_level0": F.lit(2), "_on_list": F.lit(3)})
    listed = spark.createDataFrame([("bad.org",)], "host string")
    assert sorted((r["page_id"] or -1, r["verdict"]) for r in url_filter.filter_urls(pages, listed).collect()) == [(-1, "allow"), (1, "block"), (1, "block")]


def test_pipeline_of_an_empty_table(spark, tmp_path, docs):
    docs.where("doc_id < -5").select("doc_id", "text", "source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
