"""The registered queries of the training-data operators, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import chat_format, collocations, exact_dedup, jaccard_join, licenses, line_dedup, merkle_manifest, mixing, piece_sampling, quality_rules, secret_scan, url_filter, warc_revisit


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets_report(_table(spark, sf_dir, "documents"), known=secret_scan.known_samples(spark))


def secret_models_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.held_out_report(_table(spark, sf_dir, "documents"), known=secret_scan.known_samples(spark))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_table(spark, sf_dir, "documents"))


def op4_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_revisit.revisit_report(_table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    trusted, junk = (labels.where(x).select("doc_id") for x in ("quality = 1 and toxic = 0", "quality = 0"))
    return quality_rules.judge(_table(spark, sf_dir, "documents"), trusted, junk=junk)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, url_filter.listed_hosts(pages))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.component_report(_table(spark, sf_dir, "documents"))


def op8_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.pieces_report(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_report(_table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    return chat_format.chat_report(turns.unionByName(own))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest_report(_table(spark, sf_dir, "documents"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_exact_dedup, op2_secret_scan, op3_line_dedup, op4_warc_revisit, op5_quality_rules, op6_url_filter, op7_jaccard_join, op8_piece_sampling, op9_mixing, op10_chat_format]
    own += [op11_merkle_manifest, op12_license_scan, op13_collocations, secret_models_held_out]
    return {f.__name__: f for f in own}


_WS = r"[\x20\x09-\x0D]"

_OP1 = rf"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_WS}+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY s) AS kept, s AS text_sha256
FROM t
"""

_OP3 = rf"""
WITH l AS (SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
k AS (SELECT doc_id, pos, line,
             translate(regexp_replace(line, '^{_WS}+|{_WS}+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM l),
f AS (SELECT *, length(key) >= 10 AND min(doc_id) OVER (PARTITION BY key) < doc_id AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

_OP4 = r"""
WITH b AS (SELECT page_id AS p, octet_length(encode(coalesce(html, ''))) AS size, nullif(regexp_extract(url, '^([^:/?#]+://[^/?#]*(?:/[^/?#]*)?)', 1), '') AS base, coalesce(url, '') AS raw, page_id * 7919 % 50021 AS t FROM pages),
c AS (SELECT *, lower(split_part(base, '://', 1)) AS scheme, regexp_replace(regexp_replace(lower(regexp_extract(base, '://([^/]*)', 1)), ':(80|443)$', ''), '^www\.', '') AS host, rtrim(regexp_extract(base, '://[^/]*(.*)$', 1), '/') AS path FROM b),
k AS (SELECT *, CASE WHEN base IS NULL THEN raw ELSE concat(CASE WHEN scheme IN ('http', 'https') THEN 'https' ELSE scheme END, '://', host, CASE WHEN path = '' THEN '/' ELSE path END) END AS url_key FROM c),
r AS (SELECT p, p * 2 AS record_id, url_key, t AS ts, CASE WHEN p % 3 = 0 THEN 'revisit' ELSE 'response' END AS kind, size FROM k
      UNION ALL SELECT p, p * 2 + 1, url_key, t + p % 17 - 4, 'revisit', 0 FROM k),
h AS (SELECT *, CASE WHEN p % 5 <> 0 THEN concat('v', CAST(floor(ts / 9000) AS BIGINT)) END AS etag, CASE WHEN p % 2 = 0 THEN concat('day ', CAST(floor(ts / 9000) AS BIGINT)) END AS modified FROM r),
f AS (SELECT url_key, ts, arg_max({'id': record_id, 'etag': etag, 'modified': modified, 'size': size}, record_id) AS e FROM h WHERE kind = 'response' GROUP BY url_key, ts),
j AS (SELECT v.*, f.e FROM (SELECT * FROM h WHERE kind = 'revisit') v ASOF LEFT JOIN f ON v.url_key = f.url_key AND v.ts > f.ts),
s AS (SELECT *, CASE WHEN e IS NULL THEN 'no-earlier-response' WHEN coalesce(e.etag <> etag, e.modified <> modified, false) THEN 'validator-mismatch' ELSE 'resolved' END AS status FROM j),
m AS (SELECT *, status = 'resolved' AS ok FROM s)
SELECT record_id, url_key, CASE WHEN ok THEN e.id END AS refers_to, status,
       concat_ws(';', concat('content-length=', CASE WHEN ok THEN e.size ELSE size END), concat('date=', ts),
                 'etag=' || CASE WHEN ok THEN coalesce(etag, e.etag) ELSE etag END, 'last-modified=' || CASE WHEN ok THEN coalesce(modified, e.modified) ELSE modified END) AS headers
FROM m
"""

_HOST = r"coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH = r"coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"


def _rule_case(at: int) -> str:
    whens = []
    for h, p, verdict in sorted(url_filter.RULES, key=lambda r: (-len(r[0] + r[1]), r)):
        whens.append(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{(h + p, verdict)[at]}'")
    return "CASE " + " ".join(whens) + " END"


_OP6 = rf"""
WITH u AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages)
SELECT page_id, host, path, {_rule_case(0)} AS rule,
       coalesce({_rule_case(1)}, CASE WHEN list_has_any(string_split(host, '.'), {url_filter.LISTED_LABELS!r}) THEN 'block' ELSE 'allow' END) AS verdict
FROM u
"""

_OP10 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\2\\\3', 'g')) AS n,
             coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) = role, false) AS same
      FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n + CASE WHEN same THEN 10 ELSE 24 + length(role) END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_OP11 = r"""
WITH RECURSIVE v AS (
    SELECT doc_id, lang, n_chars, CASE WHEN doc_id IS NOT NULL AND xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ord(d)::BIGINT)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS changed,
           list_transform([doc_id::VARCHAR, source, lang], lambda x: coalesce(octet_length(encode(x)) || ':' || x, '-')) AS a, coalesce(octet_length(encode(text)) || ':' || text, '-') AS z
    FROM documents),
f AS (SELECT doc_id, lang, sha256(a[1] || a[2] || a[3] || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || z) AS leaf,
             sha256(a[1] || a[2] || a[3] || coalesce(length(changed::VARCHAR) || ':' || changed, '-') || z) AS tampered FROM v),
l AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM f),
lower_nodes AS (SELECT tree, 0 AS k, pos, n, leaf AS h FROM l
                UNION ALL SELECT tree, k + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM lower_nodes WHERE n > 1 GROUP BY tree, k, pos // 2, n),
subs AS (SELECT tree AS place, count(*) OVER () AS n, h FROM lower_nodes WHERE n = 1),
upper_nodes AS (SELECT 0 AS k, place AS pos, n, h FROM subs
                UNION ALL SELECT k + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM upper_nodes WHERE n > 1 GROUP BY k, pos // 2, n),
steps AS (SELECT l.tree, l.pos, m.k AS k, (l.pos >> m.k) % 2 AS odd, s.h
          FROM l JOIN (SELECT DISTINCT tree, k, n FROM lower_nodes WHERE n > 1) m ON m.tree = l.tree
          LEFT JOIN lower_nodes s ON s.tree = l.tree AND s.k = m.k AND s.pos = xor(l.pos >> m.k, 1)
          UNION ALL
          SELECT l.tree, l.pos, 1000 + m.k, (l.tree >> m.k) % 2, s.h
          FROM l JOIN (SELECT DISTINCT k, n FROM upper_nodes WHERE n > 1) m ON true
          LEFT JOIN upper_nodes s ON s.k = m.k AND s.pos = xor(l.tree >> m.k, 1)),
paths AS (SELECT tree, pos, list({'odd': odd, 'h': h} ORDER BY k) AS path FROM steps GROUP BY tree, pos),
r AS (SELECT doc_id, leaf, b.h AS subroot, (SELECT h FROM upper_nodes WHERE n = 1) AS root, coalesce(path, []) AS path,
             CASE WHEN path IS NULL THEN tampered ELSE list_reduce(list_prepend({'odd': 0::BIGINT, 'h': tampered}, path),
                  lambda acc, x: {'odd': 0::BIGINT, 'h': sha256(CASE WHEN x.h IS NULL THEN acc.h WHEN x.odd = 1 THEN x.h || acc.h ELSE acc.h || x.h END)}).h END AS folded_root
      FROM l JOIN subs b ON b.place = l.tree LEFT JOIN paths USING (tree, pos))
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: coalesce(x.h, '')), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM r
"""

_TEMPLATES = ", ".join(f"({n}, '{label}', {licenses.plain_words(text)!r}, {[f' {k} ' for k in keys]!r})" for n, (label, text, keys) in enumerate(licenses.TEMPLATES))
_PHRASES = ", ".join(f"('{label}', {p.split()!r})" for label, p in licenses.PHRASES)

_OP12 = rf"""
WITH t(n, label, tw, keys) AS (VALUES {_TEMPLATES}),
q(label, pw) AS (VALUES {_PHRASES}),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_AZ}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
v AS (SELECT DISTINCT unnest(tw) AS w FROM t),
f AS (SELECT w, count(*) AS c FROM (SELECT r, unnest(list_distinct(ws)) AS w FROM d) JOIN v USING (w) GROUP BY w),
i AS (SELECT w, ln(1 + ((SELECT count(*) FROM d) + 1) / (coalesce(c, 0) + 1)) AS idf FROM v LEFT JOIN f USING (w)),
x AS (SELECT n, w, k - 1 AS spot, idf FROM (SELECT n, unnest(tw) AS w, generate_subscripts(tw, 1) AS k FROM t) JOIN i USING (w) QUALIFY row_number() OVER (PARTITION BY n ORDER BY idf DESC, w, k) <= {licenses.INDEXED}),
p AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM d),
s AS (SELECT r, n, pos - spot AS b, sum(idf) AS weight FROM p JOIN x USING (w) GROUP BY ALL),
a AS (SELECT r, n, b, weight / total AS score FROM s JOIN (SELECT n, sum(idf) AS total FROM x GROUP BY n) USING (n) WHERE weight / total >= {licenses.LEAST}),
h AS (SELECT r, label, least(score, 1.0) AS score,
             list_bool_and(list_transform(keys, lambda k: contains(concat(' ', array_to_string(ws[greatest(b - {licenses.SLACK}, 0) + 1:greatest(b - {licenses.SLACK}, 0) + len(tw) + {2 * licenses.SLACK}], ' '), ' '), k))) AS held
      FROM a JOIN t USING (n) JOIN d USING (r)),
m AS (SELECT r, max(score) AS score, list(DISTINCT label) FILTER (held) AS labels FROM h GROUP BY r),
o AS (SELECT r, label, k - 1 AS place FROM (SELECT r, ws, label, pw, unnest(range(1, len(ws) + 1)) AS k FROM d, q) WHERE ws[k:k + len(pw) - 1] = pw),
b AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM o GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE round(coalesce(m.score, 0), 6) END AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN m USING (r)
"""

_OP13 = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_AZ}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT lang, k, g, count(*) AS a
      FROM (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) AS g FROM p, unnest([1, 2, 3, 4]) AS t(k)) GROUP BY ALL),
t AS (SELECT lang, sum(a)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM g WHERE k > 1 AND a >= 30),
cuts AS (SELECT c.*, i, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a) // (l.a::HUGEINT + r.a) AS score
         FROM (SELECT c.*, unnest(range(1, k)) AS i FROM c) c JOIN g l ON l.lang = c.lang AND l.g = c.g[1:i] JOIN g r ON r.lang = c.lang AND r.g = c.g[i + 1:c.k]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, i) = 1),
inside AS (SELECT lang, sub, max(a) AS most
           FROM (SELECT lang, a, unnest(list_transform(range(1, k - m + 2), lambda i: g[i:i + m - 1])) AS sub FROM c, unnest([2, 3]) AS t(m) WHERE m < k) GROUP BY ALL),
kept AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, score::BIGINT AS score FROM best b LEFT JOIN inside s ON s.lang = b.lang AND s.sub = b.g
         WHERE s.most IS NULL OR 100 * s.most < 80 * b.a)
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, score FROM kept JOIN t USING (lang)
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER w <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": _OP1, "op3_line_dedup": _OP3, "op4_warc_revisit": _OP4, "op6_url_filter": _OP6, "op10_chat_format": _OP10, "op11_merkle_manifest": _OP11, "op12_license_scan": _OP12, "op13_collocations": _OP13}
