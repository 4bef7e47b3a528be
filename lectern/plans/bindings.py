"""The registries, texts, requests and logs of an edition corpus, bound onto the given tables; in Spark and as SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: SQL that both engines run, over the given tables.
VIEWS = {
    "b_ids": """
        SELECT concat('mr:', lpad(CAST(m AS STRING), 2, '0'), lpad(CAST(d AS STRING), 2, '0'), '-', replace(p_name, ' ', '-'), '-', CAST(p_partkey AS STRING)) AS id,
               p_partkey, p_name, m AS month, d AS day, CASE WHEN p_partkey % 17 <> 0 THEN p_size END AS entry, p_size % 2 = 1 AS asterisk,
               p_partkey % 23 = 0 AS unnumbered, p_partkey % 11 = 0 AS deprecated
        FROM (SELECT *, CAST(p_partkey % 12 + 1 AS INT) AS m, CAST(CAST(floor(p_partkey / 12) AS INT) % 28 + 1 AS INT) AS d FROM part) p""",
    "b_editions": """
        SELECT concat('ed_', CAST(s_suppkey AS STRING)) AS id, CAST(1500 + (s_suppkey * 37) % 520 AS INT) AS year,
               CASE WHEN s_suppkey % 3 = 0 THEN 'universal' ELSE concat('N', chr(65 + s_nationkey)) END AS scope,
               CASE s_suppkey % 4 WHEN 0 THEN 'la' WHEN 1 THEN 'en' WHEN 2 THEN 'it-IT' ELSE 'fr' END AS language,
               CASE WHEN s_suppkey % 5 = 4 THEN 'translatio' ELSE 'editio_typica' END AS nature, s_suppkey
        FROM supplier""",
    "b_printed": """
        SELECT concat('ed_', CAST(l_suppkey AS STRING)) AS edition, i.id, i.month AS anchor_month, i.day AS anchor_day,
               CAST(CASE WHEN l_orderkey % 10 = 0 THEN month(l_shipdate) ELSE i.month END AS INT) AS month,
               CAST(CASE WHEN l_orderkey % 10 = 0 THEN day(l_shipdate) ELSE i.day END AS INT) AS day,
               l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate, concat(i.p_name, ' ', CAST(l_orderkey AS STRING), '.', CAST(l_linenumber AS STRING)) AS text
        FROM lineitem JOIN b_ids i ON l_partkey = i.p_partkey""",
    "b_elogia": """
        SELECT edition, id, anchor_month, anchor_day, month, day, text,
               CAST(row_number() OVER (PARTITION BY edition, month, day ORDER BY l_orderkey, l_linenumber, id, l_suppkey, l_extendedprice, l_shipdate) AS INT) AS pos, l_orderkey
        FROM b_printed""",
    "b_requests": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN concat('N', chr(65 + c_nationkey)) END AS nation,
               CAST(CASE WHEN o_orderkey % 5 <> 0 THEN 1480 + o_orderkey % 560 END AS INT) AS year,
               CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'la' WHEN '2' THEN 'en-GB' WHEN '3' THEN 'de' WHEN '4' THEN 'it' END AS locale,
               CAST(month(o_orderdate) AS INT) AS month, CAST(day(o_orderdate) AS INT) AS day
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "b_grants": """
        SELECT event_id AS seq, user_id AS "user", CASE event_type WHEN 'click' THEN 'reader' WHEN 'view' THEN 'editor' WHEN 'purchase' THEN 'admin' ELSE event_type END AS relation,
               concat('ed_', CAST(user_id % 10 AS STRING)) AS body, CASE WHEN event_id % 3 = 0 THEN 'revoke' ELSE 'grant' END AS op
        FROM events""",
    "b_edits": """
        SELECT e.event_id AS seq, concat('u', CAST(e.user_id % 7 AS STRING)) AS branch,
               CASE WHEN e.event_id % 13 = 0 THEN 'ed_none' ELSE concat('ed_', CAST(e.event_id * 7 % (SELECT count(*) FROM supplier) AS STRING)) END AS edition,
               CASE WHEN e.event_id % 17 = 0 THEN concat(i.id, '-x') ELSE i.id END AS id, i.month,
               CAST(CASE WHEN e.event_id % 11 = 0 THEN NULL WHEN e.event_id % 19 = 0 THEN 31 ELSE i.day END AS INT) AS day,
               CASE e.event_type WHEN 'click' THEN 'put' WHEN 'signup' THEN 'put' WHEN 'error' THEN 'delete' ELSE 'patch' END AS op,
               concat(upper(i.p_name), ' ', CAST(e.event_id AS STRING)) AS text, CAST(CASE WHEN e.event_id % 5 <> 0 THEN e.event_id % 6 END AS INT) AS position
        FROM events e JOIN b_ids i ON i.p_partkey = e.event_id % (SELECT count(*) FROM part)""",
    "b_subjects": """
        SELECT 'la' AS locale, id, concat('Sanctus ', p_name) AS subject FROM b_ids WHERE p_partkey % 13 <> 0
        UNION ALL SELECT 'en' AS locale, id, concat('Saint ', p_name) AS subject FROM b_ids WHERE p_partkey % 3 = 0""",
    "b_days": """
        SELECT edition, month, day, concat('dies ', CAST(day AS STRING)) AS titulus, CASE WHEN day % 3 = 0 THEN 'Et alibi' END AS conclusio,
               CAST(substr(edition, 4) AS INT) % 4 = 1 AND month * day % 5 = 0 AS unaligned
        FROM (SELECT DISTINCT edition, month, day FROM b_printed) d""",
}


#: What a join may broadcast, by Spark's estimate. That counts a file's encoded bytes; as rows with ids and texts made of
#: them they take some thirty times as much on the driver, and a job has several broadcasts at once.
BROADCAST = "1MB"


def session(spark: SparkSession, measured: bool = False) -> SparkSession:
    """A child session for one call of a query. measured: a join broadcasts only what was shuffled and found to be small, nothing by an estimate."""
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", "UTC")
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1" if measured else BROADCAST)
    own.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", BROADCAST)
    return own


def bind(spark: SparkSession, sf_dir: str, *views: str) -> list[DataFrame]:
    """The views as DataFrames. Names are fresh temporary views of a child session, so that calls don't meet."""
    own = session(spark)
    for t in ("part", "supplier", "lineitem", "orders", "customer", "events"):
        own.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for name, sql in VIEWS.items():
        own.sql(sql.replace('"user"', "user")).createOrReplaceTempView(name)
    return [own.table(v) for v in views]


def with_views(sql: str) -> str:
    """DuckDB SQL with the views it may use in front."""
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in VIEWS.items()) + "\n" + sql
