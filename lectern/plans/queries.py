"""Registered queries of the edition engine, named by the rows of the survey, each with DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import canonical as C
from lectern.functions.requests import parse_requests
from lectern.operators import access, placement, resolve, structure
from lectern.plans.bindings import bind, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None, views: bool = True) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql) if views else sql
        return f

    return put


@_query("""
, u AS (SELECT o_orderkey, nation, year, locale, lower(split_part(locale, '-', 1)) AS lang FROM b_requests),
e AS (SELECT *, nature = 'translatio' AS tr, lower(split_part(language, '-', 1)) AS el FROM b_editions),
c AS (SELECT DISTINCT nation, year, locale, lang FROM u),
p AS (SELECT c.*, e.id, e.year AS ey, e.tr, coalesce(e.scope = c.nation, false) AS own, e.scope = 'universal' AS uni, coalesce(e.el = c.lang, false) AS same, e.el = 'la' AS la FROM c CROSS JOIN e),
h AS (SELECT *, bool_or(own) OVER w AS has_own, bool_or(own AND same) OVER w AS own_same, bool_or(uni AND same) OVER w AS uni_same FROM p WINDOW w AS (PARTITION BY nation, year, locale)),
t AS (SELECT *, CASE WHEN has_own THEN own ELSE uni END AS base, CASE WHEN has_own THEN own_same ELSE uni_same END AS base_same FROM h),
f AS (SELECT *,
  CASE WHEN lang IS NULL THEN base AND NOT tr WHEN base_same THEN base AND same WHEN uni_same THEN uni AND same ELSE uni AND la END AS first,
  CASE WHEN nation IS NOT NULL THEN CASE WHEN lang IS NULL THEN uni AND NOT tr WHEN uni_same THEN uni AND same ELSE uni AND la END
       WHEN lang IS NOT NULL THEN uni AND la AND NOT tr ELSE false END AS second,
  year IS NULL OR ey <= year AS intime FROM t),
r AS (SELECT nation, year, locale,
  max({'y': ey, 'o': NOT tr, 'id': id}) FILTER (first AND intime) AS a,
  max({'y': ey, 'o': NOT tr, 'id': id}) FILTER (second AND intime AND year IS NOT NULL) AS b FROM f GROUP BY ALL),
won AS (SELECT nation, year, locale, coalesce(a, b).id AS won FROM r)
SELECT u.o_orderkey, CASE WHEN CAST(substr(won, 4) AS INT) % 7 <> 0 THEN won END AS resolved_edition,
  CASE WHEN won IS NULL THEN CASE WHEN u.year IS NULL THEN 'no-edition' ELSE 'pre-first-edition' END
       WHEN CAST(substr(won, 4) AS INT) % 7 = 0 THEN 'edition-unavailable' END AS resolve_error
FROM u LEFT JOIN won ON u.nation IS NOT DISTINCT FROM won.nation AND u.year IS NOT DISTINCT FROM won.year AND u.locale IS NOT DISTINCT FROM won.locale
""")
def q_j3_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, editions = bind(spark, sf_dir, "b_requests", "b_editions")
    got = resolve.resolve(requests.select("o_orderkey", "nation", "year", "locale"), editions, editions.where("s_suppkey % 7 <> 0"))
    return got.select("o_orderkey", "resolved_edition", "resolve_error")


@_query("""
SELECT id, regexp_full_match(id, 'mr:[0-9]{4}-[a-z0-9-]+') AS canonical, CAST(substr(id, 4, 2) AS INT) AS anchor_month, CAST(substr(id, 6, 2) AS INT) AS anchor_day,
       substr(id, 9) AS slug, substr(id, 4, 2) || '-' || substr(id, 6, 2) AS label FROM b_ids
""")
def q_p1_p2_p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    (ids,) = bind(spark, sf_dir, "b_ids")
    i = F.col("id")
    return ids.select("id", C.is_canonical(i).alias("canonical"), C.anchor_month(i).alias("anchor_month"), C.anchor_day(i).alias("anchor_day"), C.slug_of(i).alias("slug"), C.mmdd(F.col("month"), F.col("day")).alias("label"))


@_query("""
, p AS (SELECT o_orderkey, nation, year, month, day, o_orderkey % 8 AS k FROM b_requests)
SELECT o_orderkey, CASE WHEN k NOT IN (1, 2, 3) THEN nation END AS nation, CASE WHEN k NOT IN (1, 2, 3) THEN year END AS year,
       CASE WHEN k NOT IN (1, 2, 3) THEN month END AS month, CASE WHEN k NOT IN (1, 2, 3) THEN day END AS day,
       CASE WHEN k = 4 THEN 'concordius' END AS slug, CASE WHEN k IN (1, 2, 3) THEN 'malformed-path' END AS error
FROM p
""")
def q_p3_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    (r,) = bind(spark, sf_dir, "b_requests")
    k, two = F.col("o_orderkey") % 8, lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    path = F.concat_ws("/", F.concat(F.lit("nation/"), "nation"), F.col("year").cast("string"), F.when(k == 1, F.lit("13")).otherwise(two("month")),
                       F.when(k == 2, F.lit("32")).otherwise(two("day")), F.when(k == 4, F.lit("concordius")))
    path = F.when(k == 3, F.concat(path, F.lit("/x/y"))).otherwise(path)
    return parse_requests(r.select("o_orderkey", path.alias("path"))).select("o_orderkey", "nation", "year", "month", "day", "slug", "error")


@_query("""
SELECT id, CASE WHEN scope = 'universal' THEN 'Dicastery for Divine Worship and the Discipline of the Sacraments' WHEN scope = 'IT' THEN 'Conferenza Episcopale Italiana' ELSE 'Bishops'' Conference (' || scope || ')' END AS governing_body,
       CASE WHEN scope = 'universal' THEN 'dicastery' ELSE 'bishops_conference' END AS governing_type, CASE WHEN scope <> 'universal' THEN scope END AS nation,
       CASE WHEN s_suppkey % 5 = 0 THEN 'copyrighted texts, a grant is needed' WHEN s_suppkey % 7 = 0 THEN 'registered, no texts attached' END AS note,
       regexp_full_match(id, '[a-z0-9_]+') AS edition_ok, regexp_full_match(concat(CASE WHEN s_suppkey % 2 = 0 THEN '-' ELSE '' END, lower(id)), '[a-z0-9][a-z0-9._-]{0,63}') AS topic_ok,
       regexp_full_match(concat('curation/', id, '/', CASE WHEN s_suppkey % 3 = 0 THEN 'a..b' ELSE 'edits' END), 'curation/[A-Za-z0-9._-]+/[A-Za-z0-9._-]+') AND s_suppkey % 3 <> 0 AS branch_ok,
       CASE WHEN s_suppkey % 5 = 0 THEN 'restricted-texts' WHEN s_suppkey % 7 <> 0 THEN 'public' ELSE 'unavailable' END AS availability,
       CASE WHEN s_suppkey % 5 = 0 OR s_suppkey % 2 = 0 THEN 'private' WHEN s_suppkey % 3 = 0 THEN 'immutable' ELSE 'daily' END AS cache,
       regexp_replace(regexp_replace('-.' || id || ' x/y', '[^A-Za-z0-9._-]', '-', 'g'), '^[-.]+', '') AS safe
FROM b_editions
""")
def q_p5_p6_p12_p13_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = bind(spark, sf_dir, "b_editions")
    k, scope = F.col("s_suppkey"), C.governance(F.col("scope"))
    told, topic = C.availability(k % 5 == 0, k % 7 != 0), F.concat(F.when(k % 2 == 0, "-").otherwise(""), F.lower("id"))
    branch = F.concat(F.lit("curation/"), "id", F.lit("/"), F.when(k % 3 == 0, "a..b").otherwise("edits"))
    return e.select(
        "id", scope["governing_body"].alias("governing_body"), scope["type"].alias("governing_type"), scope["nation"].alias("nation"), told["status"].alias("availability"), told["note"].alias("note"),
        C.cache_class(k % 5 == 0, k % 2 == 0, k % 3 == 0).alias("cache"), C.sanitized(F.concat(F.lit("-."), "id", F.lit(" x/y"))).alias("safe"),
        C.valid_edition(F.col("id")).alias("edition_ok"), C.valid_topic(topic).alias("topic_ok"), C.valid_branch(branch).alias("branch_ok"),
    )


@_query("""
SELECT id, CASE WHEN scope = 'universal' THEN 'universal' ELSE 'national' END AS scope_type, CASE WHEN scope <> 'universal' THEN scope END AS scope_nation,
       CASE WHEN s_suppkey % 4 = 0 THEN concat('Prot. ', s_suppkey) END AS decree, CASE WHEN s_suppkey % 4 = 0 OR s_suppkey % 2 = 1 THEN CASE WHEN s_suppkey % 2 = 1 THEN CAST(year AS STRING) END END AS date
FROM b_editions
""")
def q_p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = bind(spark, sf_dir, "b_editions")
    k = F.col("s_suppkey")
    record = C.edition_record(F.col("scope"), F.when(k % 4 == 0, F.concat(F.lit("Prot. "), k.cast("string"))), F.when(k % 2 == 1, F.col("year").cast("string")))
    return e.select("id", record.alias("r")).select("id", F.col("r.scope.type").alias("scope_type"), F.col("r.scope.nation").alias("scope_nation"), F.col("r.promulgation.decree").alias("decree"), F.col("r.promulgation.date").alias("date"))


@_query("SELECT id, row_number() OVER (ORDER BY year, id) AS rank FROM b_editions")
def q_o2_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.edition_order(bind(spark, sf_dir, "b_editions")[0]).select("id", "rank")


@_query("""
SELECT e.edition, e.id, e.month, e.day, e.pos, coalesce(i.asterisk, false) AS asterisk, coalesce(i.unnumbered, false) AS unnumbered
FROM b_elogia e LEFT JOIN b_ids i USING (id)
""")
def q_j1_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = bind(spark, sf_dir, "b_elogia", "b_ids")
    return placement.with_registry(e, i).select("edition", "id", "month", "day", "pos", "asterisk", "unnumbered")


@_query("""
SELECT id, row_number() OVER (PARTITION BY month, day ORDER BY NOT unnumbered, entry ASC NULLS LAST, id) AS rank FROM b_ids WHERE NOT deprecated
""")
def q_w2_registry_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.registry_order(bind(spark, sf_dir, "b_ids")[0]).select("id", "rank")


@_query("SELECT id, row_number() OVER (ORDER BY month, day, entry ASC NULLS LAST, id) AS rank FROM b_ids")
def q_o1_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.catalog_order(bind(spark, sf_dir, "b_ids")[0]).select("id", "rank")


_FIRST = """
, f AS (SELECT *, row_number() OVER (PARTITION BY edition, id ORDER BY month <> anchor_month, month, day, pos) AS n, count(*) OVER (PARTITION BY edition, id) AS times FROM b_elogia)
"""


@_query(_FIRST + "SELECT edition, id, month, day, pos, times FROM f WHERE n = 1")
def q_w3_first_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.first_placements(bind(spark, sf_dir, "b_elogia")[0])


@_query(_FIRST + "SELECT i.id, lpad(CAST(f.month AS STRING), 2, '0') || '-' || lpad(CAST(f.day AS STRING), 2, '0') AS day_printed, f.pos AS p_entry, f.id IS NOT NULL AS present FROM b_ids i LEFT JOIN f ON f.id = i.id AND n = 1 AND edition = 'ed_1'")
def q_j7_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = bind(spark, sf_dir, "b_elogia", "b_ids")
    return placement.with_presence(i, placement.first_placements(e), "ed_1").select("id", "day_printed", "p_entry", "present")


@_query(_FIRST + """SELECT id, string_agg(edition || ':' || lpad(CAST(month AS STRING), 2, '0') || '-' || lpad(CAST(day AS STRING), 2, '0'), ',' ORDER BY edition || ':' || lpad(CAST(month AS STRING), 2, '0') || '-' || lpad(CAST(day AS STRING), 2, '0')) AS places, count(*) AS n_editions FROM f WHERE n = 1 GROUP BY id""")
def q_a3_across_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.across_editions(placement.first_placements(bind(spark, sf_dir, "b_elogia")[0]))


@_query("""
SELECT b.id, b.year, s.days, s.entries, a.aligned, a.aligned IS NOT NULL AS available FROM b_editions b
LEFT JOIN (SELECT edition, count(DISTINCT month * 100 + day) AS days, count(*) AS entries FROM b_elogia GROUP BY edition) s ON b.id = s.edition
LEFT JOIN (SELECT edition, bool_and(NOT unaligned) AS aligned FROM b_days GROUP BY edition) a ON b.id = a.edition
""")
def q_a4_a11_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, b, d = bind(spark, sf_dir, "b_elogia", "b_editions", "b_days")
    return placement.edition_summary(b, e, d).select("id", "year", "days", "entries", "aligned", "available")


@_query("""
SELECT d.edition, d.month, d.day, d.titulus, d.conclusio, string_agg(pos || '=' || id || '|' || text, ';' ORDER BY pos) AS entries
FROM b_days d JOIN b_elogia e ON d.edition = e.edition AND d.month = e.month AND d.day = e.day GROUP BY ALL
""")
def q_a1_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = placement.assemble_days(*bind(spark, sf_dir, "b_elogia", "b_days"))
    told = F.transform("entries", lambda x: F.concat(x["pos"].cast("string"), F.lit("="), x["id"], F.lit("|"), x["text"]))
    return days.select("edition", "month", "day", "titulus", "conclusio", F.array_join(told, ";").alias("entries"))


@_query("SELECT edition, month, day, id, min(pos) AS pos, string_agg(text, ' ' ORDER BY pos) AS text FROM b_elogia GROUP BY edition, month, day, id")
def q_a10_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.merge_collisions(bind(spark, sf_dir, "b_elogia")[0])


@_query("SELECT edition, id, count(*) AS times FROM b_elogia GROUP BY edition, id HAVING count(*) > 1")
def q_a9_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.duplicate_ids(bind(spark, sf_dir, "b_elogia")[0])


GRANTS = """
, g AS (SELECT "user", relation, body, arg_max(op, seq) AS op FROM b_grants WHERE relation IN ('admin', 'editor', 'reader') GROUP BY ALL)
"""


@_query(GRANTS + """SELECT "user", relation, body FROM g WHERE op = 'grant'""")
def q_c11_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.fold_grants(bind(spark, sf_dir, "b_grants")[0]).select("user", "relation", "body")


@_query(GRANTS + """
, h AS (SELECT DISTINCT "user", body FROM g WHERE op = 'grant')
SELECT e.edition, e.id, e.month, e.day, e.pos, e.l_orderkey % 50 AS reader,
  CASE WHEN CAST(substr(e.edition, 4) AS INT) % 5 <> 0 OR h.body IS NOT NULL THEN e.text END AS text,
  CASE WHEN CAST(substr(e.edition, 4) AS INT) % 5 <> 0 THEN 'public' WHEN h.body IS NULL THEN 'masked' ELSE 'granted' END AS access
FROM b_elogia e LEFT JOIN h ON h."user" = e.l_orderkey % 50 AND h.body = e.edition
""")
def q_p9_j9_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    elogia, editions, log = bind(spark, sf_dir, "b_elogia", "b_editions", "b_grants")
    closed = editions.where("s_suppkey % 5 = 0").select(F.col("id").alias("edition"))
    got = access.mask_texts(elogia.withColumn("user", F.col("l_orderkey") % 50), closed, access.fold_grants(log))
    return got.select("edition", "id", "month", "day", "pos", F.col("user").alias("reader"), "text", "access")


@_query(GRANTS + """
, a AS (SELECT "user", body FROM g WHERE op = 'grant' AND relation = 'admin'),
r AS (SELECT event_id AS seq, user_id * 7 % 50 AS caller, CASE WHEN event_id % 23 = 0 THEN NULL ELSE user_id END AS "user", CASE WHEN event_id % 9 = 0 THEN 'owner' ELSE 'reader' END AS relation, concat('ed_', CAST(user_id * 7 % 50 % 10 AS STRING)) AS body FROM events)
SELECT seq, CASE WHEN r."user" IS NULL THEN 'invalid-payload' WHEN relation = 'owner' THEN 'unknown-relation' ELSE 'forbidden' END AS error
FROM r LEFT JOIN a ON a."user" = r.caller AND a.body = r.body WHERE r."user" IS NULL OR relation = 'owner' OR a.body IS NULL
""")
def q_c11_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, (log,) = spark.read.parquet(f"{sf_dir}/events.parquet"), bind(spark, sf_dir, "b_grants")
    e, caller = F.col("event_id"), F.col("user_id") * 7 % 50
    asked = events.select(e.alias("seq"), caller.alias("caller"), F.when(e % 23 != 0, F.col("user_id")).alias("user"), F.when(e % 9 == 0, "owner").otherwise("reader").alias("relation"), F.concat(F.lit("ed_"), (caller % 10).cast("string")).alias("body"))
    return access.refused_grants(asked, access.fold_grants(log))


@_query(GRANTS + """
, h AS (SELECT DISTINCT "user", body FROM g WHERE op = 'grant' AND relation IN ('admin', 'editor'))
SELECT e.edition, e.id, e.month, e.day, e.pos FROM b_elogia e JOIN h ON h."user" = e.l_orderkey % 50 AND h.body = e.edition WHERE h."user" % 3 <> 0
""")
def q_j9_may_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    elogia, log = bind(spark, sf_dir, "b_elogia", "b_grants")
    roles = log.select("user", F.when(F.col("user") % 3 == 0, "guest").otherwise("editor").alias("role")).distinct()
    return access.may_edit(elogia.withColumn("user", F.col("l_orderkey") % 50), access.fold_grants(log), roles).select("edition", "id", "month", "day", "pos")


#: White space in SQL, and lines of the texts with tabs at some ends, blank lines and footnotes.
_WHITE = "concat(chr(9), chr(10), chr(11), chr(12), chr(13), chr(28), chr(29), chr(30), chr(31), ' ', chr(133), chr(160), chr(8195))"
_LINES = """SELECT doc_id, pos, CASE WHEN pos % 6 = 5 THEN chr(9) WHEN pos % 11 = 3 THEN chr(160) || '*' || t WHEN pos % 7 = 2 THEN t || chr(9) || ' ' ELSE t END AS text
  FROM (SELECT doc_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))"""


def _lined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the lines of the texts that _LINES has, as an array."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    line = lambda t, p: F.when(p % 6 == 5, "\t").when(p % 11 == 3, F.concat(F.lit("\xa0*"), t)).when(p % 7 == 2, F.concat(t, F.lit("\t "))).otherwise(t)
    return docs.select("doc_id", F.transform(structure.lines_of(F.col("text")), line).alias("lines"))


@_query(rf"""
WITH l AS ({_LINES}), o AS (SELECT *, coalesce(regexp_matches(rtrim(lag(text) OVER (PARTITION BY doc_id ORDER BY pos), {_WHITE}), '[.!?]$'), true) AS opens FROM l),
i AS (SELECT *, CAST(sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS island FROM o),
n AS (SELECT *, lead(island) OVER (PARTITION BY doc_id ORDER BY pos) IS DISTINCT FROM island AS last FROM i)
SELECT doc_id, island, count(*) AS fragments, string_agg(CASE WHEN last THEN text ELSE rtrim(text, {_WHITE}) END, ' ' ORDER BY pos) AS text FROM n GROUP BY doc_id, island
""", views=False)
def q_w5_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _lined(spark, sf_dir).select("doc_id", F.posexplode(structure.merge_fragments(F.col("lines"))).alias("k", "e"))
    return told.select("doc_id", (F.col("k") + 1).cast("long").alias("island"), "e.fragments", "e.text")


_MONTHS = "['Januarii', 'Februarii', 'Martii', 'Aprilis', 'Maii', 'Junii', 'Julii', 'Augusti', 'Septembris', 'Octobris', 'Novembris', 'Decembris']"
#: Lines of books: every 17th is a day's header, and days come again after three.
_BOOK = f"""SELECT doc_id, pos, CASE WHEN pos % 17 = 0 THEN concat(' ', CAST(floor(pos / 17) AS INT) % 3 + 1, ' ', {_MONTHS}[doc_id % 12 + 1], ' Pridie Idus ', left(text, 9)) ELSE text END AS text FROM ({_LINES})"""


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(m) for m in structure.MONTHS])
    header = lambda t, p: F.concat(F.lit(" "), (F.floor(p / 17) % 3 + 1).cast("string"), F.lit(" "), F.get(names, (F.col("doc_id") % 12).cast("int")), F.lit(" Pridie Idus "), F.left(t, F.lit(9)))
    return _lined(spark, sf_dir).select("doc_id", F.transform("lines", lambda t, p: F.when(p % 17 == 0, header(t, p)).otherwise(t)).alias("lines"))


@_query(rf"""
WITH l AS ({_BOOK}), h AS (SELECT *, regexp_matches(text, '^\s*[0-9]{{1,2}}\s+[A-Z][a-z]+\b.*(Idus)') AS header FROM l),
s AS (SELECT *, sum(CAST(header AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM h),
d AS (SELECT doc_id, nth, max(CASE WHEN header THEN text END) AS head, count(*) FILTER (NOT header) AS n_lines, md5(coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER (NOT header), '')) AS body FROM s GROUP BY doc_id, nth),
p AS (SELECT doc_id, nth, n_lines, body, list_position({_MONTHS}, regexp_extract(head, '^\s*[0-9]+\s+([A-Z][a-z]+)', 1))::INT AS month, CAST(regexp_extract(head, '[0-9]+') AS INT) AS day FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, month, day ORDER BY nth DESC) AS k FROM p)
SELECT doc_id, month, day, n_lines, body FROM r WHERE k = 1
""", views=False)
def q_w7_w14_f22_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines under the headers of their days; of a day that a book has several times the last."""
    cut = structure.sections(F.col("lines"), lambda x, i: x.rlike(structure.DAY_HEADER))
    each = _books(spark, sf_dir).select("doc_id", F.posexplode(cut).alias("nth", "s")).where("s.header is not null").withColumn("h", structure.latin_header(F.col("s.header")))
    told = each.select("doc_id", "h.month", "h.day", "nth", F.size("s.lines").cast("long").alias("n_lines"), F.md5(F.array_join("s.lines", "\n")).alias("body"))
    return told.groupBy("doc_id", "month", "day").agg(F.max_by(F.struct("n_lines", "body"), "nth").alias("d")).select("doc_id", "month", "day", "d.*")


def _numbered_by_header(at: str) -> str:
    return f"SELECT *, CAST(sum(CASE WHEN pos % 17 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS section FROM ({at})"


@_query(_numbered_by_header("SELECT doc_id, pos FROM (" + _LINES + ")").replace("SELECT *,", "SELECT doc_id, pos,"), views=False)
def q_w7_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = structure.sections(F.col("lines"), lambda x, i: i % 17 == 0)
    lines = _lined(spark, sf_dir).select("doc_id", F.posexplode(F.flatten(F.transform(cut, lambda s, k: F.transform(F.concat(F.array(s["header"]), s["lines"]), lambda x: k + 1)))).alias("pos", "section"))
    return lines.select("doc_id", "pos", F.col("section").cast("long").alias("section"))


@_query(rf"""
WITH l AS ({_LINES}), b AS (SELECT *, sum(CAST(trim(text, {_WHITE}) = '' AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM l),
n AS (SELECT *, max(CAST(starts_with(ltrim(text, {_WHITE}), '*') AS INT)) OVER (PARTITION BY doc_id, block ORDER BY pos) AS note FROM b)
SELECT doc_id, count(*) FILTER (note = 0) AS n_lines, md5(coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER (note = 0), '')) AS body FROM n GROUP BY doc_id
""", views=False)
def q_w9_footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lined(spark, sf_dir).select("doc_id", structure.drop_footnotes(F.col("lines")).alias("l")).select("doc_id", F.size("l").cast("long").alias("n_lines"), F.md5(F.array_join("l", "\n")).alias("body"))


@_query(rf"""
WITH l AS ({_LINES}), h AS (SELECT doc_id, pos, CASE WHEN pos % 4 = 0 AND pos % 6 <> 5 THEN text || '-' ELSE text END AS text FROM l)
SELECT doc_id, regexp_replace(regexp_replace(coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER (text <> ''), ''), '-\n(\p{{Ll}})', '\1', 'g'), '[\s\x0b\x{{85}}\x{{a0}}]+', ' ', 'g') AS text FROM h GROUP BY doc_id
""", views=False)
def q_f18_join_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    hyphened = F.transform("lines", lambda t, p: F.when((p % 4 == 0) & (p % 6 != 5), F.concat(t, F.lit("-"))).otherwise(t))
    return _lined(spark, sf_dir).select("doc_id", structure.join_lines(hyphened).alias("text"))


@_query(rf"""
WITH l AS (SELECT doc_id, pos, regexp_replace(trim(text, {_WHITE}), '[\s\x0b\x{{85}}\x{{a0}}]+', ' ', 'g') AS t FROM ({_LINES})),
c AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS pos FROM l WHERE NOT regexp_full_match(t, '[0-9]{{1,3}}') AND NOT list_contains({_MONTHS}, t) AND upper(t) NOT IN ('MARTYROLOGIUM', 'ROMANUM', 'MARTYROLOGIUM ROMANUM')),
o AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY doc_id ORDER BY pos) = '', true) AS blank FROM c),
k AS (SELECT *, sum(CAST(blank AS INT)) OVER w AS one, coalesce(ends_with(rtrim(lag(t) OVER w, ' '), '.') AND regexp_matches(t, '^\p{{Lu}}'), true) AS ends FROM o WHERE t <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
m AS (SELECT *, sum(CAST(ends AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS two FROM k),
a AS (SELECT doc_id, one AS p, string_agg(t, ' ' ORDER BY pos) AS t FROM m GROUP BY doc_id, one), b AS (SELECT doc_id, two AS p, string_agg(t, ' ' ORDER BY pos) AS t FROM m GROUP BY doc_id, two),
f AS (SELECT doc_id, count(*) <= 2 AND sum(length(t)) > 400 AS fall FROM a GROUP BY doc_id),
x AS (SELECT * FROM a WHERE doc_id NOT IN (SELECT doc_id FROM f WHERE fall) UNION ALL SELECT * FROM b WHERE doc_id IN (SELECT doc_id FROM f WHERE fall)),
y AS (SELECT *, sum(CAST(NOT regexp_matches(t, '^[\p{{Ll}},;)]') AS INT)) OVER (PARTITION BY doc_id ORDER BY p) AS j, min(p) OVER (PARTITION BY doc_id) AS f0 FROM x),
z AS (SELECT doc_id, CASE WHEN j = 0 THEN 1 ELSE j + CASE WHEN (SELECT regexp_matches(v.t, '^[\p{{Ll}},;)]') FROM x v WHERE v.doc_id = y.doc_id AND v.p = y.f0) THEN 1 ELSE 0 END END AS n, p, t FROM y)
SELECT doc_id, CAST(n AS BIGINT) AS n, string_agg(t, ' ' ORDER BY p) AS text FROM z GROUP BY doc_id, n
""", views=False)
def q_w6_f17_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = structure.paragraphs(structure.clean_latin(F.col("lines")))
    return _lined(spark, sf_dir).select("doc_id", F.posexplode(told).alias("n", "text")).select("doc_id", (F.col("n") + 1).cast("long").alias("n"), "text")


_THANKS = "' Et alibi aliorum plurimorum sanctorum Martyrum et Confessorum. Deo gratias.'"


@_query(rf"""
WITH l AS (SELECT doc_id, pos, CASE WHEN pos % 9 = 4 AND doc_id % 3 > 0 THEN text || {_THANKS} ELSE text END AS t FROM ({_LINES})),
c AS (SELECT *, min(CASE WHEN contains(t, 'Et alibi aliorum plur') THEN pos END) OVER (PARTITION BY doc_id) AS cut FROM l),
k AS (SELECT doc_id, pos, cut, CASE WHEN pos = cut THEN trim(left(t, instr(t, 'Et alibi aliorum plur') - 1), {_WHITE}) ELSE t END AS t FROM c WHERE cut IS NULL OR pos <= cut)
SELECT doc_id, count(*) FILTER (pos IS DISTINCT FROM cut OR t <> '') AS n, md5(coalesce(string_agg(t, chr(10) ORDER BY pos) FILTER (pos IS DISTINCT FROM cut OR t <> ''), '')) AS entries, CASE WHEN max(cut) IS NOT NULL THEN substr({_THANKS}, 2) END AS conclusio
FROM k GROUP BY doc_id
""", views=False)
def q_w15_conclusio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries up to the first conclusio; the one that holds it keeps what comes before."""
    thanks = F.lit(_THANKS.strip("'"))
    lines = F.transform("lines", lambda t, p: F.when((p % 9 == 4) & (F.col("doc_id") % 3 > 0), F.concat(t, thanks)).otherwise(t))
    told = _lined(spark, sf_dir).select("doc_id", structure.cut_at_conclusio(lines).alias("d"))
    return told.select("doc_id", F.size("d.entries").cast("long").alias("n"), F.md5(F.array_join("d.entries", "\n")).alias("entries"), F.col("d.conclusio").alias("conclusio"))


@_query(rf"""
WITH l AS (SELECT doc_id, pos, CASE WHEN pos % 9 = 4 AND doc_id % 3 > 0 THEN concat('  12 INDEX ', text) ELSE text END AS t FROM ({_LINES})),
c AS (SELECT *, min(CASE WHEN regexp_matches(left(t, 30), '^\s*[^\s]{{0,4}}\s*INDEX') THEN pos END) OVER (PARTITION BY doc_id) AS cut FROM l)
SELECT doc_id, count(*) FILTER (cut IS NULL OR pos < cut) AS pages, md5(coalesce(string_agg(t, chr(10) ORDER BY pos) FILTER (cut IS NULL OR pos < cut), '')) AS body FROM c GROUP BY doc_id
""", views=False)
def q_w16_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages (here lines) strictly before the first that opens with INDEX."""
    pages = F.transform("lines", lambda t, p: F.when((p % 9 == 4) & (F.col("doc_id") % 3 > 0), F.concat(F.lit("  12 INDEX "), t)).otherwise(t))
    cut = _lined(spark, sf_dir).select("doc_id", structure.cut_at_index(pages).alias("p"))
    return cut.select("doc_id", F.size("p").cast("long").alias("pages"), F.md5(F.array_join("p", "\n")).alias("body"))


@_query(rf"""
WITH l AS ({_LINES}), b AS (SELECT *, sum(CAST(trim(text, {_WHITE}) = '' AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM l),
n AS (SELECT *, trim(text, {_WHITE}) AS t, max(CAST(starts_with(ltrim(text, {_WHITE}), '*') AS INT)) OVER (PARTITION BY doc_id, block ORDER BY pos) AS note FROM b),
k AS (SELECT * FROM n WHERE note = 0 AND t <> '' AND NOT regexp_full_match(t, '[0-9]{{1,3}}') AND regexp_matches(t, '[A-Za-z]{{3}}')),
j AS (SELECT doc_id, string_agg(t, ' — ' ORDER BY pos) AS body FROM k GROUP BY doc_id),
e AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(body, '[\s\x0b\x{{85}}\x{{a0}}]+', ' ', 'g'), '[.,;]?\s*[—–]+\s*([A-Z(“"])', concat(chr(1), '\1'), 'g'), chr(1))) AS p FROM j),
s AS (SELECT doc_id, trim(p, ' .') AS p FROM e WHERE trim(p, ' .—-') <> '')
SELECT doc_id, CASE WHEN ends_with(p, '.') THEN p ELSE p || '.' END AS entry, count(*) AS n FROM s GROUP BY ALL
""", views=False)
def q_f17_f19_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a body whose lines are parted by dashes, each with how often the text has it."""
    clean = _lined(spark, sf_dir).select("doc_id", structure.clean_english(F.col("lines")).alias("l"))
    body = clean.where(F.size("l") > 0).select("doc_id", structure.join_lines(F.array(F.array_join("l", " — "))).alias("body"))
    return body.select("doc_id", F.explode(structure.split_entries(F.col("body"))).alias("entry")).groupBy("doc_id", "entry").agg(F.count("*").alias("n"))


def q_q3_f21_w8_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of orders by customer, named with a scan's spellings, that name another day than their turn in the month."""
    orders, o = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_orderkey")
    names = F.array(*[F.lit(x) for x in structure.ORDINALS])
    word = F.translate(F.get(names, (o % 31).cast("int")), "y", "p")
    headers = orders.select(F.col("o_custkey").alias("book"), o.alias("nth"), F.month("o_orderdate").alias("month"), F.when(o % 3 == 0, F.regexp_replace(word, "^T", "C")).otherwise(word).alias("word"))
    return structure.ordinal_report(headers)


def q_latin_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole books to days: headers, cleaning, paragraphs, conclusio and fragments in one pass over each text."""
    thanks = F.lit(_THANKS.strip("'"))
    text = F.array_join(F.transform("lines", lambda t, p: F.when((p % 17 == 12) & (F.col("doc_id") % 3 > 0), F.concat(t, thanks)).when((p % 17 == 1) & (F.col("doc_id") % 5 == 0), " Maii. xij. A ").otherwise(t)), "\n")
    days = structure.latin_days(_books(spark, sf_dir).select("doc_id", text.alias("text")))
    return days.select(F.col("book").alias("doc_id"), "month", "day", "titulus", F.size("entries").alias("n_entries"), F.md5(F.array_join("entries", "\n")).alias("entries"), "conclusio")


QUERIES |= {f.__name__: f for f in (q_q3_f21_w8_ordinals, q_latin_days)}


@_query("""
WITH t AS (SELECT doc_id, lower(translate(text, 'æœÆŒ', 'eeee')) AS text FROM documents),
f AS (SELECT doc_id, regexp_replace(translate(strip_accents(text), 'j', 'i'), '[^a-z ]', ' ', 'g') AS folded, trim(regexp_replace(strip_accents(text), '[^a-z]+', '-', 'g'), '-') AS slug FROM t)
SELECT doc_id, md5(folded) AS folded, md5(slug) AS slug,
  array_to_string(list_transform(list_filter(string_split(slug, '-'), lambda p: length(p) >= 4 AND p NOT IN ('the', 'that', 'with')), lambda p: p[1:6]), ',') AS stems
FROM f
""", views=False)
def q_f1_f3_f6_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    t = F.col("text")
    stems = C.slug_stems(F.col("slug"), ["the", "that", "with"])
    return d.select("doc_id", C.folded(t).alias("folded"), C.fold_slug(t).alias("slug")).select("doc_id", F.md5("folded").alias("folded"), F.md5("slug").alias("slug"), F.array_join(stems, ",").alias("stems"))


@_query("""
WITH t AS (SELECT doc_id, lower(translate(text, 'æœÆŒ', 'eeee')) AS text FROM documents),
f AS (SELECT doc_id, trim(regexp_replace(strip_accents(text), '[^a-z]+', '-', 'g'), '-') AS slug FROM t),
s AS (SELECT doc_id, list_transform(list_filter(string_split(slug, '-'), lambda p: length(p) >= 4 AND p NOT IN ('the', 'that', 'with')), lambda p: p[1:6]) AS stems FROM f)
SELECT doc_id, len(stems) AS n_stems, md5(array_to_string(stems, ',')) AS stems FROM s
""", views=False)
def q_f6_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number and the digest of all stems of every text."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stems = d.select("doc_id", C.slug_stems(C.fold_slug(F.col("text")), ["the", "that", "with"]).alias("stems"))
    return stems.select("doc_id", F.size("stems").alias("n_stems"), F.md5(F.array_join("stems", ",")).alias("stems"))


@_query("SELECT doc_id, sha256(text) AS sha256 FROM documents", views=False)
def q_s10_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("sha256"))
