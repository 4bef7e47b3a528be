"""Registered queries of remediation, coining and gates, with DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import canonical as C
from lectern.operators import remediation
from lectern.operators.align import ENTRY
from lectern.plans.bindings import bind, session, with_views
from lectern.sources import publishing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str, recursive: bool = False) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        told = with_views(sql)
        ORACLES[f.__name__] = told.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else told
        return f

    return put


#: Every part is an id with a set of names; those of every eleventh are deprecated, and each edition prints ids of both kinds.
_NAMES = """
, w AS (SELECT concat('mr:', lpad(CAST(CAST(p_partkey % 12 + 1 AS INT) AS STRING), 2, '0'), lpad(CAST(CAST(CAST(floor(p_partkey / 12) AS INT) % 28 + 1 AS INT) AS STRING), 2, '0'), '-', CASE WHEN p_partkey % 11 = 0 THEN concat('martyres-', p_partkey) WHEN p_partkey % 7 = 0 THEN concat(string_split(p_name, ' ')[1], '-et-socii') ELSE concat(replace(p_name, ' ', '-'), '-', p_partkey) END) AS id,
           CAST(p_partkey % 12 + 1 AS INT) AS month, CAST(CAST(floor(p_partkey / 12) AS INT) % 28 + 1 AS INT) AS day, p_partkey, p_partkey % 11 = 0 AS old,
           CASE WHEN p_partkey % 11 = 0 AND p_partkey % 5 = 0 THEN [] WHEN p_partkey % 11 = 0 AND p_partkey % 3 = 0 THEN string_split(p_name, ' ') ELSE list_concat(string_split(p_name, ' '), [lower(p_type), replace(lower(p_brand), 'brand#', 'b')]) END AS persons FROM part),
i AS (SELECT id, min(month) AS month, min(day) AS day, list_sort(list_distinct(flatten(list(list_transform(persons, lambda x: x[1:6]))))) AS names FROM w WHERE NOT old GROUP BY id),
d AS (SELECT *, list_sort(list_distinct(list_transform(persons, lambda x: x[1:6]))) AS names, concat('mr:', lpad(CAST(month AS STRING), 2, '0'), lpad(CAST(day AS STRING), 2, '0'), '-',
             CASE WHEN len(persons) >= 3 THEN concat(persons[1], '-et-socii') ELSE array_to_string(persons, '-et-') END) AS own FROM w WHERE old),
e AS (SELECT 'e' AS edition, w.id, w.month, w.day, CAST(row_number() OVER (PARTITION BY w.month, w.day ORDER BY p_partkey) AS INT) AS pos, concat(w.id, ' ', p_partkey) AS text FROM w WHERE old OR p_partkey % 9 = 0),
s AS (SELECT id, CASE WHEN p_partkey % 2 = 0 THEN 'MATCH' ELSE 'RESLUG' END AS kind, concat(left(id, 8), 'sacerdos') AS new_id FROM d WHERE p_partkey % 13 = 0),
x AS (SELECT id FROM d WHERE p_partkey % 4 = 0),
m AS (SELECT d.id AS old, d.month, d.day, i.id, i.month AS m2, i.day AS d2, len(list_intersect(d.names, i.names)) AS shared, len(list_intersect(d.names, i.names)) / CAST(len(list_distinct(list_concat(d.names, i.names))) AS DOUBLE) AS jac
      FROM d JOIN i ON len(list_intersect(d.names, i.names)) >= 2),
o AS (SELECT m.*, shared + jac AS score FROM m LEFT JOIN e ON m.id = e.id AND m.month = e.month AND m.day = e.day WHERE e.id IS NULL OR m.id = m.old),
sm AS (SELECT * FROM (SELECT *, row_number() OVER z AS n, lead(score) OVER z AS nxt FROM o WHERE month = m2 AND day = d2 WINDOW z AS (PARTITION BY old ORDER BY score DESC, jac DESC, shared DESC, id DESC)) WHERE n = 1 AND (nxt IS NULL OR score - nxt >= 0.3)),
cr AS (SELECT * FROM (SELECT *, row_number() OVER z AS n, lead(score) OVER z AS nxt FROM o WHERE jac >= 0.66 AND id NOT IN (SELECT id FROM e) AND old NOT IN (SELECT old FROM sm) WINDOW z AS (PARTITION BY old ORDER BY score DESC, jac DESC, shared DESC, id DESC)) WHERE n = 1 AND (nxt IS NULL OR score - nxt >= 0.3)),
f AS (SELECT old, id, 'same' AS scope, score FROM sm UNION ALL SELECT old, id, 'cross', score FROM cr WHERE old NOT IN (SELECT id FROM x)),
c AS (SELECT d.id, d.month, d.day, s.kind AS given, s.new_id AS given_id, f.id AS hit, scope, f.score, d.own, len(persons) AS n, len(persons) > 0 AND i.id IS NOT NULL AND e.id IS NULL AS slug
      FROM d LEFT JOIN s ON d.id = s.id LEFT JOIN i ON d.own = i.id LEFT JOIN e ON d.own = e.id AND d.month = e.month AND d.day = e.day LEFT JOIN f ON d.id = f.old),
k AS (SELECT *, CASE WHEN given = 'MATCH' THEN 'MATCH-slug' WHEN given IS NOT NULL THEN given WHEN n = 0 THEN 'ANON' WHEN slug THEN 'MATCH-slug' WHEN hit IS NOT NULL THEN concat('MATCH-', scope) ELSE 'RESLUG' END AS kind,
      CASE WHEN given IS NOT NULL THEN given_id WHEN n = 0 THEN id WHEN slug THEN own ELSE coalesce(hit, own) END AS new_id FROM c),
q AS (SELECT k.id, k.kind, k.new_id, CASE WHEN k.kind LIKE 'MATCH%' THEN CASE WHEN k.kind = 'MATCH-same' OR (k.kind = 'MATCH-slug' AND i.month = k.month AND i.day = k.day) THEN 'same-day' ELSE 'cross-day' END END AS method,
      CASE WHEN k.kind IN ('MATCH-same', 'MATCH-cross') THEN score END AS score FROM k LEFT JOIN i ON k.new_id = i.id)
"""


def _named(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables of _NAMES: current ids, deprecated ones, printed entries, special decisions, rejected matches."""
    key, words = F.col("p_partkey"), F.split("p_name", " ")
    month, day = (key % 12 + 1).cast("int"), (F.floor(key / 12).cast("int") % 28 + 1).cast("int")
    slug = F.when(key % 11 == 0, F.concat(F.lit("martyres-"), key.cast("string"))).when(key % 7 == 0, F.concat(words[0], F.lit("-et-socii"))).otherwise(F.concat_ws("-", F.replace("p_name", F.lit(" "), F.lit("-")), key.cast("string")))
    more = F.concat(words, F.array(F.lower("p_type"), F.replace(F.lower("p_brand"), F.lit("brand#"), F.lit("b"))))
    persons = F.when((key % 11 == 0) & (key % 5 == 0), F.array().cast("array<string>")).when((key % 11 == 0) & (key % 3 == 0), words).otherwise(more)
    part = session(spark, measured=True).read.parquet(f"{sf_dir}/part.parquet").select(key, month.alias("month"), day.alias("day"), persons.alias("persons"), F.concat(F.format_string("mr:%02d%02d-", month, day), slug).alias("id"))
    ids = part.where("p_partkey % 11 <> 0").groupBy("id").agg(F.min("month").alias("month"), F.min("day").alias("day"), remediation.name_stems(F.flatten(F.collect_list("persons"))).alias("names"))
    old = part.where("p_partkey % 11 = 0").select(F.lit("e").alias("edition"), "p_partkey", "id", "month", "day", F.lit("Sancti Martyres").alias("subject"), "persons", F.lit("sanctorum").alias("marker"))
    pos = F.row_number().over(Window.partitionBy("month", "day").orderBy("p_partkey"))
    printed = part.where("p_partkey % 11 = 0 or p_partkey % 9 = 0").select(F.lit("e").alias("edition"), "month", "day", pos.alias("pos"), "id", F.concat_ws(" ", "id", key.cast("string")).alias("text"))
    special = old.where("p_partkey % 13 = 0").select("id", F.when(key % 2 == 0, "MATCH").otherwise("RESLUG").alias("kind"), F.concat(F.left("id", F.lit(8)), F.lit("sacerdos")).alias("new_id"), F.lit("Sanctus Sacerdos").alias("subject"))
    return {"ids": ids, "old": old.drop("p_partkey"), "printed": printed, "special": special, "rejects": old.where("p_partkey % 4 = 0").select("id")}


def _decided(t: dict[str, DataFrame]) -> DataFrame:
    return remediation.decide(t["old"], t["ids"], t["printed"], t["special"], t["rejects"])


@_query(_NAMES + "SELECT old, id, 'same' AS scope, CAST(shared AS INT) AS shared, jac FROM sm UNION ALL SELECT old, id, 'cross', CAST(shared AS INT), jac FROM cr")
def q_j15_name_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _named(spark, sf_dir)
    entries = t["old"].select("edition", F.col("id").alias("old"), "month", "day", remediation.name_stems(F.col("persons")).alias("names"))
    return remediation.name_matches(entries, t["ids"], t["printed"]).select("old", "id", "scope", "shared", "jac")


@_query(_NAMES + "SELECT * FROM q")
def q_m10_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(_named(spark, sf_dir)).select("id", "kind", "new_id", "method", "score")


@_query(_NAMES + "SELECT kind AS outcome, count(*) AS n FROM q GROUP BY kind")
def q_a8_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remediation.outcome_counts(_decided(_named(spark, sf_dir)))


@_query(_NAMES + """
, v AS (SELECT new_id AS id, count(*) AS n FROM q WHERE kind = 'RESLUG' GROUP BY new_id)
SELECT 'reslug-twice' AS rule, id FROM v WHERE n > 1 UNION ALL SELECT 'reslug-is-current', id FROM v JOIN i USING (id)
""")
def q_m10_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _named(spark, sf_dir)
    return remediation.collisions(_decided(t), t["ids"], t["old"])


_APPLIED = _NAMES + """
, r AS (SELECT id, kind, new_id, method, score FROM q WHERE kind <> 'ANON'),
y AS (SELECT e.*, r.new_id, r.kind, r.method, r.score, coalesce(r.new_id, e.id) AS now, row_number() OVER (PARTITION BY e.id ORDER BY e.month, e.day, e.pos) AS nth FROM e LEFT JOIN r ON e.id = r.id),
b AS (SELECT id, 'coined-deprecated' AS method, CAST(pos AS DOUBLE) AS score FROM e WHERE pos % 2 = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY month, day, pos) = 1)
"""


def _sidecar(t: dict[str, DataFrame]) -> DataFrame:
    first = t["printed"].where("pos % 2 = 0").groupBy("edition", "id").agg(F.min_by("pos", F.struct("month", "day", "pos")).alias("pos"))
    return first.select("edition", "id", F.lit(remediation.COINED).alias("method"), F.col("pos").cast("double").alias("score"))


@_query(_APPLIED + "SELECT month, day, min(pos) AS pos, now AS id, string_agg(text, ' ' ORDER BY pos) AS text FROM y GROUP BY month, day, now")
def q_m11_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries after all decisions, those that come to share an id on a day merged."""
    t = _named(spark, sf_dir)
    return remediation.apply_decisions(t["printed"], t["old"].select("edition", "id", "month", "day", "subject"), _sidecar(t), _decided(t))[0].drop("edition")


@_query(_APPLIED + """
, u AS (SELECT now AS id, CASE WHEN y.kind = 'RESLUG' THEN 'coined-deprecated' ELSE y.method END AS method, CASE WHEN y.kind = 'RESLUG' THEN CASE WHEN nth = 1 THEN b.score END ELSE y.score END AS score, y.month, y.day, y.pos
        FROM y LEFT JOIN b ON y.id = b.id WHERE y.new_id IS NOT NULL),
l AS (SELECT id, method, score FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY month DESC, day DESC, pos DESC) = 1)
SELECT id, method, score FROM l UNION ALL SELECT id, method, score FROM b WHERE id NOT IN (SELECT id FROM l) AND id NOT IN (SELECT id FROM y WHERE new_id IS NOT NULL)
""")
def q_m11_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _named(spark, sf_dir)
    return remediation.apply_decisions(t["printed"], t["old"].select("edition", "id", "month", "day", "subject"), _sidecar(t), _decided(t))[2].drop("edition")


@_query(_APPLIED + """
SELECT coalesce(r.new_id, d.id) AS id, CASE WHEN r.new_id IS NULL THEN 'Sancti Martyres' WHEN s.id IS NOT NULL THEN 'Sanctus Sacerdos' ELSE
       concat(CASE WHEN len(persons) >= 2 THEN 'Sancti ' WHEN persons[1] LIKE '%a' THEN 'Sancta ' ELSE 'Sanctus ' END, upper(left(persons[1], 1)), lower(substr(persons[1], 2)),
              CASE WHEN len(persons) >= 3 THEN ' et socii' WHEN len(persons) = 2 THEN concat(' et ', upper(left(persons[2], 1)), lower(substr(persons[2], 2))) ELSE '' END) END AS subject
FROM d LEFT JOIN r ON d.id = r.id LEFT JOIN s ON d.id = s.id WHERE r.kind IS NULL OR r.kind = 'RESLUG'
""")
def q_m11_deprecated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deprecated ids that are left, renamed and with their new subjects."""
    t = _named(spark, sf_dir)
    return remediation.apply_decisions(t["printed"], t["old"].select("edition", "id", "month", "day", "subject"), _sidecar(t), _decided(t))[1].select("id", "subject")


_COINED = """
, h AS (SELECT concat(left(id, 8), split_part(p_name, ' ', 1), CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('-', p_partkey % 6) END) AS id FROM b_ids UNION SELECT id FROM b_ids),
n AS (SELECT e.edition, e.month, e.day, e.pos AS idx, concat('mr:', lpad(CAST(e.month AS STRING), 2, '0'), lpad(CAST(e.day AS STRING), 2, '0'), '-', split_part(substr(e.id, 9), '-', 1)) AS base,
             CASE WHEN e.pos % 4 > 0 THEN split_part(substr(e.id, 9), '-', 2) ELSE 'loco' END AS place, row_number() OVER (PARTITION BY e.month, e.day ORDER BY e.edition, e.pos) AS n FROM b_elogia e),
g AS (SELECT month, day, 0 AS n, coalesce(used, []) AS used, NULL::VARCHAR AS id FROM (SELECT DISTINCT month, day FROM n) LEFT JOIN (SELECT CAST(substr(id, 4, 2) AS INT) AS month, CAST(substr(id, 6, 2) AS INT) AS day, list(id) AS used FROM h GROUP BY ALL) USING (month, day)
      UNION ALL SELECT month, day, n, list_append(used, own), own FROM
      (SELECT n.month, n.day, n.n, used, CASE WHEN NOT list_contains(used, base) THEN base WHEN NOT list_contains(used, concat(base, '-', place)) THEN concat(base, '-', place)
              ELSE concat(base, '-', list_filter(range(2, len(used) + 3), lambda k: NOT list_contains(used, concat(base, '-', k)))[1]) END AS own
       FROM g JOIN n ON g.month = n.month AND g.day = n.day AND n.n = g.n + 1))
"""


def _to_coin(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every entry of all editions to be given an id by one word of its name, with another as its place; and the ids that are there."""
    elogia, ids = bind(spark, sf_dir, "b_elogia", "b_ids")
    word = lambda k: F.get(F.split(C.slug_of(F.col("id")), "-"), F.lit(k))
    entries = elogia.select("edition", "month", "day", F.col("pos").alias("idx"), word(0).alias("slug"), F.when(F.col("pos") % 4 > 0, word(1)).alias("place"))
    lead = F.concat(F.left("id", F.lit(8)), F.split("p_name", " ")[0])
    more = ids.select(F.when(F.col("p_partkey") % 3 == 0, lead).otherwise(F.concat_ws("-", lead, (F.col("p_partkey") % 6).cast("string"))).alias("id"))
    return entries, ids.select("id").unionByName(more)


@_query(_COINED + "SELECT n.edition, n.month, n.day, n.idx, g.id FROM g JOIN n ON g.month = n.month AND g.day = n.day AND g.n = n.n", recursive=True)
def q_w13_m7_coined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remediation.coined(*_to_coin(spark, sf_dir))


@_query("""
, e AS (SELECT edition, month, day, pos AS idx, CASE WHEN l_orderkey % 19 = 0 THEN id END AS id, id AS own, l_orderkey AS k FROM b_elogia),
a AS (SELECT * FROM e WHERE k % 3 = 0), c AS (SELECT edition, month, day, idx, CASE WHEN k % 29 = 0 THEN own WHEN k % 31 = 0 THEN concat(own, '-x') ELSE concat(own, '-', edition, '-', month, '-', day, '-', idx) END AS id FROM e WHERE k % 3 = 1),
g AS (SELECT edition, month, day, idx, own AS id FROM a UNION ALL SELECT * FROM c)
SELECT 'aligned-input' AS rule, edition, month, day, idx, id FROM e WHERE id IS NOT NULL
UNION ALL SELECT 'unmatched', edition, month, day, idx, NULL FROM e WHERE k % 3 = 2
UNION ALL SELECT 'given-twice', edition, month, day, idx, id FROM (SELECT *, count(*) OVER (PARTITION BY edition, id) AS n FROM g) WHERE n > 1
UNION ALL SELECT 'coined-exists', c.edition, c.month, c.day, c.idx, c.id FROM c JOIN b_ids i ON c.id = i.id
UNION ALL SELECT 'coined-twice', edition, month, day, idx, id FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM c) WHERE n > 1
""")
def q_m9_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why an alignment of all editions would be refused: a third of the entries is matched, a third has coined ids, some of them wrong, a third is left."""
    elogia, ids = bind(spark, sf_dir, "b_elogia", "b_ids")
    k = F.col("l_orderkey")
    entries = elogia.select("edition", "month", "day", F.col("pos").alias("idx"), F.when(k % 19 == 0, F.col("id")).alias("id"))
    told = elogia.select("edition", "month", "day", F.col("pos").alias("idx"), "id", k)
    own = F.when(k % 29 == 0, F.col("id")).when(k % 31 == 0, F.concat("id", F.lit("-x"))).otherwise(F.concat_ws("-", "id", "edition", *[F.col(c).cast("string") for c in ("month", "day", "idx")]))
    return publishing.alignment_violations(entries, told.where("l_orderkey % 3 = 0").select(*ENTRY, "id"), told.where("l_orderkey % 3 = 1").select(*ENTRY, own.alias("id")), ids)
