"""Registered queries of the sources: documents written from the tables in the shared folder and read again, with DuckDB SQL of the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import canonical as C
from lectern.plans.bindings import bind, with_views
from lectern.sources import registry, sinks
from lectern.storage import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str, views: bool = True) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = with_views(sql) if views else sql
        return f

    return put


def _documents(rows: DataFrame, by: str, lead: str, end: str) -> str:
    """The folder of JSON documents, one file for each value of `by`, of the rows (by, entry) between `lead` and `end`."""
    path = f"{shared_folder(rows.sparkSession).rstrip('/')}/documents-{uuid.uuid4().hex}"
    body = F.array_join(F.sort_array(F.collect_list(F.to_json("entry"))), ", ")
    rows.groupBy(by).agg(F.concat(F.lit(lead), body, F.lit(end)).alias("value")).write.partitionBy(by).text(path)
    return path


@_query("""
, d AS (SELECT id, month, day, entry, asterisk, unnumbered, p_partkey FROM b_ids)
SELECT id, month, day, CASE WHEN p_partkey % 11 = 0 THEN p_partkey ELSE entry END AS entry, asterisk AND p_partkey % 11 > 0 AS asterisk, unnumbered AND p_partkey % 11 > 0 AS unnumbered, p_partkey % 11 = 0 AS deprecated, CASE WHEN p_partkey % 11 = 0 THEN concat('ed_', p_partkey % 9) END AS attested_in FROM d
UNION ALL SELECT concat(id, '-only'), month, day, p_partkey, false, false, true, concat('ed_', p_partkey % 9) FROM d WHERE p_partkey % 11 = 0
""")
def q_s1_u1_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry of current ids and that of deprecated ones, whose entries take the place of current ones; null fields are absent."""
    (ids,) = bind(spark, sf_dir, "b_ids")
    current = ids.select("month", F.struct("id", "month", "day", "entry", F.when(F.col("asterisk"), True).alias("asterisk"), F.when(F.col("unnumbered"), True).alias("unnumbered")).alias("entry"))
    old = ids.where("p_partkey % 11 = 0").withColumn("id", F.explode(F.array("id", F.concat("id", F.lit("-only")))))
    told = old.select("month", F.struct("id", "month", "day", F.col("p_partkey").alias("entry"), F.concat(F.lit("ed_"), (F.col("p_partkey") % 9).cast("string")).alias("attested_in")).alias("entry"))
    found = registry.read_ids(spark, _documents(current, "month", '{"entries": [', "]}"), _documents(told, "month", "[", "]"))
    return found.select("id", "month", "day", "entry", "asterisk", "unnumbered", "deprecated", "attested_in")


@_query("""
SELECT id, scope, nature, language, CASE WHEN s_suppkey % 7 > 0 THEN year END AS year, CASE WHEN s_suppkey % 7 > 0 THEN concat(year, '-05-01') ELSE 'undated' END AS promulgated FROM b_editions WHERE s_suppkey % 3 > 0
""")
def q_s3_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry of editions of several books; of one book's the year is read from the date."""
    (editions,) = bind(spark, sf_dir, "b_editions")
    k = F.col("s_suppkey")
    told = F.struct("id", F.when(k % 3 > 0, "mr").otherwise("other").alias("book"), "nature", "language", "scope", F.when(k % 7 > 0, F.concat(F.col("year").cast("string"), F.lit("-05-01"))).otherwise("undated").alias("promulgated"))
    found = registry.read_editions(spark, _documents(editions.select((k % 4).alias("part"), told.alias("entry")), "part", '{"entries": [', "]}"), "mr")
    return found.select("id", "scope", "nature", "language", "year", "promulgated")


@_query("""
SELECT concat(id, CASE WHEN s_suppkey % 5 = 0 THEN '-x' ELSE '' END) AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'unknown-edition' WHEN s_suppkey % 3 = 0 THEN 'already-exists' END AS error, CASE WHEN s_suppkey % 5 > 0 AND s_suppkey % 3 > 0 THEN 12 ELSE 0 END AS months,
       CASE WHEN s_suppkey % 5 > 0 AND s_suppkey % 3 > 0 THEN concat(CASE WHEN s_suppkey % 2 = 0 THEN concat('note=', nature, ';') ELSE '' END, 'shape=days') END AS meta FROM b_editions
""")
def q_s12_scaffolds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New editions are begun: those that aren't registered, and those that have metadata already, are refused."""
    (editions,) = bind(spark, sf_dir, "b_editions")
    k = F.col("s_suppkey")
    asked = editions.select(F.concat("id", F.when(k % 5 == 0, "-x").otherwise("")).alias("id"), F.lit("days").alias("shape"), F.when(k % 2 == 0, F.col("nature")).otherwise("").alias("note"))
    meta, months, errors = sinks.scaffold_editions(asked, editions, editions.where(k % 3 == 0).select(F.col("id").alias("edition")))
    told = F.array_join(F.array_sort(F.transform(F.map_entries("meta"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    counted = months.groupBy(F.col("edition").alias("id")).agg(F.count("*").alias("months"))
    both = asked.select("id").join(errors, "id", "left").join(counted, "id", "left").join(meta.select(F.col("edition").alias("id"), told.alias("meta")), "id", "left")
    return both.select("id", "error", F.coalesce("months", F.lit(0)).alias("months"), "meta")


@_query("""
, h AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN locale END AS q, CASE o_orderkey % 4 WHEN 0 THEN concat(' ', locale, ';q=0.9, la') WHEN 1 THEN concat(coalesce(locale, ''), ',en') WHEN 2 THEN locale END AS header FROM b_requests)
SELECT o_orderkey, coalesce(q, nullif(trim(split_part(split_part(header, ',', 1), ';', 1)), '')) AS locale FROM h
""")
def q_p7_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The locale that a request names, or the first of its header."""
    (requests,) = bind(spark, sf_dir, "b_requests")
    k, locale = F.col("o_orderkey"), F.col("locale")
    header = F.when(k % 4 == 0, F.concat(F.lit(" "), locale, F.lit(";q=0.9, la"))).when(k % 4 == 1, F.concat(F.coalesce(locale, F.lit("")), F.lit(",en"))).when(k % 4 == 2, locale)
    return requests.select("o_orderkey", C.pick_locale(F.when(k % 3 == 0, locale), header).alias("locale"))


@_query("""
SELECT doc_id, md5(replace(replace(replace(replace(translate(nfc_normalize(coalesce(text, '')), 'áàâäãéèêëíìîïóòôöõúùûüñçÁÀÂÄÉÈÊËÍÓÖÚÜÑÇ', 'aaaaaeeeeiiiiooooouuuuncAAAAEEEEIOOUUNC'), 'æ', 'ae'), 'œ', 'oe'), 'Æ', 'Ae'), 'Œ', 'Oe')) AS told FROM documents
""", views=False)
def q_f4_deaccented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts without marks, ligatures spelled out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.md5(C.deaccented(F.coalesce("text", F.lit("")))).alias("told"))
