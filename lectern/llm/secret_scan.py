"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two order-1 character models are trained from labelled samples, one of random strings and one of ordinary identifiers.
A long token that no pattern covers becomes a span where the mean log-likelihood ratio of its character pairs reaches a
threshold. Everything is DataFrame expressions; the texts are read once and never shuffled. Positions are code points.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import constant_doubles, let, materialize, running, text_of

# Fixed values of the contract: the patterns, in the order in which kinds are listed.
ASSIGN_HEAD = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
ASSIGN = ASSIGN_HEAD + r"[A-Za-z0-9+/_.=-]+"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "random"]

#: A token that the models judge, and an ordinary identifier that they learn from.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]{7,}"
SPANS = "array<struct<start:int,kind:int,stop:int,match:string>>"
SIZE = 128  # characters of the models: ASCII

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: The usual alphabets of random strings.
ALPHABETS = {"base32": _UPPER + "234567", "upper": _UPPER + _DIGITS, "base62": _UPPER + _LOWER + _DIGITS, "base64": _UPPER + _LOWER + _DIGITS + "+/"}


def _matches(text: Column, pattern: str, order: int) -> Column:
    """All leftmost non-overlapping matches as structs (start, kind order, stop, match).

    The pieces between the matches give the positions: the i-th match starts after i + 1 pieces and i matches. The sums
    are made by doubling, so that a text of n matches takes n log n steps.
    """

    def placed(found: Column) -> Column:
        before = lambda i: F.coalesce(F.char_length(F.get(found, i - 1)), F.lit(0))
        steps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda piece, i: F.char_length(piece) + before(i))
        starts = running(steps, lambda x, earlier: x + F.coalesce(earlier, F.lit(0)))
        return F.zip_with(starts, found, lambda start, match: F.struct(start.alias("start"), F.lit(order).alias("kind"), (start + F.char_length(match)).alias("stop"), match.alias("match")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, F.array().cast(SPANS)).otherwise(placed(found)))


def _outside(long: Column, base: Column) -> Column:
    """The spans of `long` that overlap none of `base`, by one merge of both in the order of their starts.

    A base span at or before a token's start overlaps it if one of them reaches beyond that start, a later one if the
    next of them starts before the token's end.
    """
    told = lambda spans, mine: F.transform(spans, lambda m, i: F.struct(m["start"].alias("start"), F.lit(mine).alias("mine"), m["stop"].alias("stop"), i.alias("at")))

    def left(merged: Column) -> Column:
        reach = running(F.transform(merged, lambda m: F.when(m["mine"], 0).otherwise(m["stop"])), lambda x, earlier: F.greatest(x, earlier))
        following = F.reverse(running(F.reverse(F.transform(merged, lambda m: F.when(m["mine"], 2**31 - 1).otherwise(m["start"]))), lambda x, later: F.least(x, later)))
        clear = let(reach, lambda r: let(following, lambda f: F.filter(merged, lambda m, i: m["mine"] & (F.get(r, i) <= m["start"]) & (F.get(f, i) >= m["stop"]))))
        return F.transform(clear, lambda m: F.get(long, m["at"]))

    both = let(F.sort_array(F.concat(told(long, True), told(base, False))), left)
    return F.when((F.size(long) == 0) | (F.size(base) == 0), long).otherwise(both)


def _value(match: Column) -> Column:
    """What an assign match gives as its value."""
    return F.regexp_replace(match, "^" + ASSIGN_HEAD, "")


def find_candidates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One pass over the whole texts: base spans, long tokens outside of them, and this document's samples.

    The samples are the values of its base spans (label: random) and its identifier of least hash outside of base
    spans (label: ordinary). A null text counts as empty.
    """
    text = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    found = text.select(
        "doc_id",
        F.filter(_matches(F.col("text"), ASSIGN, 0), lambda m: F.char_length(_value(m["match"])) >= 6).alias("assign"),
        _matches(F.col("text"), ACCESS, 1).alias("access"),
        _matches(F.col("text"), HEX, 2).alias("hex"),
        _matches(F.col("text"), CANDIDATE, 3).alias("long"),
        F.array_min(F.transform(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0)), lambda w: F.struct(F.xxhash64(w).alias("h"), w.alias("w"))))["w"].alias("ordinary"),
    )
    base = found.withColumn("base", F.sort_array(F.concat("assign", "access", "hex")))
    covers = lambda w: F.exists("base", lambda b: F.contains(b["match"], w))
    return base.select(
        "doc_id",
        "base",
        _outside(F.col("long"), F.col("base")).alias("long"),
        F.concat(F.transform("assign", lambda m: _value(m["match"])), F.transform(F.concat("access", "hex"), lambda m: m["match"])).alias("random"),
        F.when(~covers(F.col("ordinary")), F.col("ordinary")).alias("ordinary"),
    )


def random_strings(seed: int, each: int = 500) -> dict[str, list[str]]:
    """For each of ALPHABETS `each` strings of 20 to 60 characters, each character drawn evenly; one seed gives the same ones."""
    draw = random.Random(seed)
    return {name: ["".join(draw.choices(chars, k=draw.randint(20, 60))) for _ in range(each)] for name, chars in ALPHABETS.items()}


def known_samples(spark: SparkSession, seed: int = 1) -> DataFrame:
    """(sample, random): the strings of random_strings() as random ones, a set of fixed size to train on besides the documents' own."""
    return spark.createDataFrame([(x, True) for found in random_strings(seed).values() for x in found], "sample string, random boolean")


def train(samples: DataFrame, limit: int = 20_000, known: DataFrame | None = None) -> list[float]:
    """The log-likelihood ratio of every pair of characters, random against ordinary: SIZE * SIZE numbers.

    samples: (sample string, random boolean). Of each label at most `limit` distinct samples are used, those of least
    hash; nulls, and characters that aren't ASCII, are left out. known: samples of a fixed set, all of which are used
    besides, so that many others can't crowd them out. With no sample of a label all ratios are 0, so that the models
    judge nothing. What reaches the driver is a count for each pair of ASCII characters and label, at most 32768.
    """
    by_label = [samples.where(F.col("random") == label).where("sample is not null").select("sample", "random").distinct().orderBy(F.xxhash64("sample"), "sample").limit(limit) for label in (True, False)]
    at = lambda i: F.ascii(F.substring("sample", i, F.lit(1)))
    pairs = F.transform(F.sequence(F.lit(1), F.char_length("sample") - 1), lambda i: at(i) * SIZE + at(i + 1))
    both = by_label[0].unionByName(by_label[1])
    used = (both if known is None else both.unionByName(known.select("sample", "random"))).where(F.char_length("sample") >= 2).where(~F.col("sample").rlike(r"[^\x00-\x7F]"))
    counts = {True: {}, False: {}}
    for r in used.select("random", F.explode(pairs).alias("pair")).groupBy("random", "pair").agg(F.count("*").alias("n")).collect():
        counts[r["random"]][r["pair"]] = r["n"]
    if not counts[True] or not counts[False]:
        return [0.0] * (SIZE * SIZE)
    rows = {label: [0] * SIZE for label in counts}
    for label, found in counts.items():
        for pair, n in found.items():
            rows[label][pair // SIZE] += n
    # one count is spread over the 64 characters that the tokens are made of
    share = lambda label, pair: (counts[label].get(pair, 0) + 1 / 64) / (rows[label][pair // SIZE] + 1)
    return [math.log(share(True, pair) / share(False, pair)) for pair in range(SIZE * SIZE)]


def ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of the pairs of characters of an ASCII token of two characters or more."""
    weights = constant_doubles(model)

    def total(codes: Column) -> Column:
        pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.get(weights, a * SIZE + b))
        return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x) / (F.size(codes) - 1)

    return let(F.transform(F.split(token, ""), lambda c: F.ascii(c)), total)


def learned(found: DataFrame, samples: DataFrame | None = None, limit: int = 20_000, known: DataFrame | None = None) -> list[float]:
    """train() on `samples`, or without them on those that find_candidates() has found, and on the known ones besides."""
    if samples is None:
        samples = found.select(F.explode("random").alias("sample"), F.lit(True).alias("random")).unionByName(found.select(F.col("ordinary").alias("sample"), F.lit(False).alias("random")))
    return train(samples, limit, known)


def scan_secrets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", samples: DataFrame | None = None, limit: int = 20_000, threshold: float = 0.5, known: DataFrame | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, spans (array of start, kind, stop), sorted by start, then kind.

    samples: (sample, random) to train from; without it the documents' own, labelled by the patterns: what the base
    spans hold against identifiers outside of any span. known: more of them, of a fixed set, to train from besides. A
    null or empty text has no spans; an empty table gives no rows; repeated rows give repeated results. Other columns
    are not read. A very long text takes n log n steps for its n matches.
    """
    found = materialize(find_candidates(docs, text_col, id_col))
    model = learned(found, samples, limit, known)
    judged = F.filter("long", lambda m: ratio(m["match"], model) >= threshold)
    spans = F.sort_array(F.transform(F.concat("base", judged), lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["stop"].alias("stop"))))
    return found.select("doc_id", spans.alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["stop"])), ",")


def secrets_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans as text, of every row; else as scan_secrets()."""
    spans = scan_secrets(docs, **options)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return spans.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(spans_text(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


def held_out_report(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.5, known: DataFrame | None = None, seed: int = 7) -> DataFrame:
    """(kind, n, flagged, share): how the models that scan_secrets() trains judge labelled tokens that they haven't learnt from.

    The tokens are made of every document: random ones of 40 characters of base64, 30 of base62 and 24 capitals and digits,
    from a digest of its text and the seed, which differ from document to document; and an ordinary one, four distinct words
    of the text joined by underscores, where it has them and they make 20 characters. flagged counts the tokens whose ratio
    reaches the threshold: of a random kind its share is the recall, of `ordinary` the false alarms. A null text is empty; an
    empty table gives no rows. The models learn from the documents' base spans (random), their identifiers outside of them
    (ordinary), and `known`.
    """
    model = learned(materialize(find_candidates(docs, text_col, id_col)), known=known)
    text = text_of(text_col)
    drawn = F.replace(F.base64(F.unhex(F.sha2(F.concat(F.lit(f"{seed}:"), text), 512))), F.lit("="), F.lit(""))
    plain = F.regexp_replace(drawn, "[+/]", "")
    words = F.array_join(F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[a-z]{4,12}\b"), F.lit(0))), 1, 4), "_")
    kinds = {"base64": F.left(drawn, F.lit(40)), "base62": F.left(plain, F.lit(30)), "capitals": F.left(F.upper(plain), F.lit(24)), "ordinary": words}
    told = docs.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), t.alias("token")) for k, t in kinds.items()])).alias("x")).select("x.*").where(F.char_length("token") >= 20)
    judged = told.select("kind", (ratio(F.col("token"), model) >= threshold).alias("hit"))
    return judged.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("hit").alias("flagged"), F.avg(F.col("hit").cast("int")).alias("share"))
