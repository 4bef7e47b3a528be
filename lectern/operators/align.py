"""Alignment of an edition's entries with canonical ids: candidates by shared keys, scores, one-to-one choice, residuals.

Entries are rows (edition, month, day, idx, text), ids rows (id, month, day) with a text of their own. No step compares
everything with everything: a pair is made where entry and id share a stem (or one that is nearly the same) or a word.
"""

from __future__ import annotations

import difflib
from bisect import insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import canonical as C
from lectern.operators.placement import merge_collisions
from lectern.storage import kept, stored

ENTRY = ["edition", "month", "day", "idx"]
# Marks of sanctity before a name, and beginnings of words of rank, which are no names.
MARKER = r"(?i:sanct[iaeous]+r?u?m?|beat[iaeous]+r?u?m?)\s+"
RANKS = "martyr episco confes virgin presby abbati diacon papae regis ducis monach militu matron vidua sacerd item eodem levita pontif anacho eremit".split()
#: How much of a text is compared letter by letter.
COMPARED = 300
#: So many lines of a day one task finds the leading ids of.
LINES_A_TASK = 20_000


def similarity(pairs: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """`pairs` with difflib's ratio of two text columns, in this order: the ratio isn't symmetric. Null or empty gives 0.

    Pairs of one second text are compared one after the other, so that it is indexed once, and equal pairs once.
    """
    schema = pairs.withColumn(out, F.lit(0.0)).schema

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher, held, first, ratio = difflib.SequenceMatcher(), None, None, 0.0
        for pdf in batches:
            rates = []
            for x, y in zip(pdf[a], pdf[b], strict=True):
                if not x or not y:
                    rates.append(0.0)
                    continue
                if y != held:
                    matcher.set_seq2(y)
                    held, first = y, None
                if x != first:
                    matcher.set_seq1(x)
                    first, ratio = x, matcher.ratio()
                rates.append(ratio)
            yield pdf.assign(**{out: rates})

    return pairs.repartition(a, b).sortWithinPartitions(b, a).mapInPandas(rate, schema)


def _letters(texts: list[str]) -> np.ndarray:
    """The code points of texts, a row each, zeros behind."""
    return np.array(texts, dtype=str).view(np.uint32).reshape(len(texts), -1)


def most_shared(left: list[str], right: list[str]) -> np.ndarray:
    """(left, right): for every two texts no fewer letters than difflib matches, which are in order in both.

    It is the length of the longest common subsequence, worked out in bits for all pairs at once; where a left text has
    more than 64 letters, the letters that both have in any order.
    """
    a, b = _letters(left), _letters(right)
    known = np.unique(a)
    code, other = np.searchsorted(known, a), np.minimum(np.searchsorted(known, b), len(known) - 1)
    other = np.where((known[other] == b) & (b > 0), other, len(known))
    if a.shape[1] > 64:
        counts = lambda t: np.stack([(t == c).sum(axis=1) for c in known if c], axis=0)
        return sum((np.minimum.outer(x, y) for x, y in zip(counts(a), counts(b), strict=True)), np.zeros((len(left), len(right)), np.int64))
    masks = np.zeros((len(left), len(known) + 1), np.uint64)
    for j in range(a.shape[1]):
        some = np.flatnonzero(a[:, j])
        masks[some, code[some, j]] |= np.uint64(1 << j)
    state = np.full((len(left), len(right)), np.uint64(2**64 - 1))
    for j in range(b.shape[1]):
        met = state & masks[:, other[:, j]]
        state = (state + met) | (state - met)
    size = (a > 0).sum(axis=1)
    whole = np.array([(1 << int(n)) - 1 for n in size], np.uint64)
    return size[:, None] - np.bitwise_count(state & whole[:, None]).astype(np.int64)


def text_leaders(lines: DataFrame, ids: DataFrame, pairs: DataFrame, weight: float) -> DataFrame:
    """(line, id, total, r): of each line its first n accepted pairs with ids of its day, by total, then id, the largest first.

    lines: month, day, line, profile, text, n; ids: month, day, id, id_profile, id_text; pairs: month, day, profile,
    id_profile, before, after, least: what texts of these profiles score besides their similarity s, which counts `weight`
    at most 1; before + weight * s + after is the total, and s must be `least`. Profiles of a pair are few, however many
    texts have them. No pair of texts is written: a task holds some lines of one day and the day's ids, takes the pairs of
    profiles from the best on, and compares letter by letter only what may still lead by the letters that both texts share.
    """
    day = ["month", "day"]
    sized = kept(lines.groupBy(*day).agg(F.ceil(F.count("*") / LINES_A_TASK).cast("int").alias("_parts")))
    left = lines.join(F.broadcast(sized), day).withColumn("_part", F.pmod(F.xxhash64("profile"), F.col("_parts")).cast("int")).drop("_parts")
    none = lambda kind: F.lit(None).cast(kind)
    known = ids.select(*day, "id", "id_profile", "id_text", none("string").alias("profile"), *[none("double").alias(c) for c in ("before", "after", "least")])
    known = known.unionByName(pairs.select(*day, none("string").alias("id"), "id_profile", none("string").alias("id_text"), "profile", *[F.col(c).cast("double").alias(c) for c in ("before", "after", "least")]))
    known = known.join(F.broadcast(sized), day).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")

    def lead(lines: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out, matchers = [], {}
        of = {p: (g["id"].tolist(), g["id_text"].tolist()) for p, g in known[known["id"].notna()].sort_values("id", ascending=False).groupby("id_profile")}
        met = known[known["id"].isna()]
        groups = {p: sorted(zip((g["before"] + weight) + g["after"], g["id_profile"], g["before"], g["after"], g["least"], strict=True), reverse=True) for p, g in met.groupby("profile")}

        def ratio(text: str, profile: str, k: int) -> float:
            other = of[profile][1][k]
            if not text or not other:
                return 0.0
            if (profile, k) not in matchers:
                if len(matchers) > 5000:
                    matchers.clear()
                matchers[profile, k] = difflib.SequenceMatcher(None, "", other)
            matchers[profile, k].set_seq1(text)
            return matchers[profile, k].ratio()

        for profile, rows in lines[lines["profile"].isin(groups)].groupby("profile"):
            texts, wanted = rows["text"].tolist(), rows["n"].tolist()
            # the pairs found by now, the best last
            found: list[list[tuple[float, str]]] = [[] for _ in texts]
            for most, id_profile, before, after, least in groups[profile]:
                there = [i for i, n in enumerate(wanted) if len(found[i]) < n or found[i][0][0] <= most]
                if not there or id_profile not in of:
                    continue
                names, others = of[id_profile]
                size = np.array([len(texts[i]) for i in there])[:, None] + np.array([len(t) for t in others])[None, :]
                # no less than difflib's ratio, by the same division; two texts are as soon compared
                bound = 2.0 * most_shared([texts[i] for i in there], others) / np.maximum(size, 1) if len(others) > 2 else np.ones(size.shape)
                rate = (before + weight * bound) + after
                for i, bounds, rates in zip(there, bound, rate, strict=True):
                    best, n = found[i], wanted[i]
                    for k in np.argsort(-rates, kind="stable"):
                        if len(best) >= n and (rates[k], names[k]) < best[0]:
                            break
                        if bounds[k] < least or (s := ratio(texts[i], id_profile, k)) < least:
                            continue
                        insort(best, ((before + weight * s) + after, names[k]))
                        if len(best) > n:
                            del best[0]
            out += [(line, name, total, r) for line, best in zip(rows["line"].tolist(), found, strict=True) for r, (total, name) in enumerate(reversed(best), 1)]
        return pd.DataFrame(out, columns=["line", "id", "total", "r"])

    key = [*day, "_part"]
    # the work is in the texts, not in the bytes, so that tasks are not put together by size
    left = left.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
    return left.groupBy(*key).cogroup(known.groupBy(*key)).applyInPandas(lead, "line long, id string, total double, r int")


def least_text(accept: Callable[[Column], Column], steps: list[float]) -> Column:
    """The least similarity of texts that accept() takes, which is one of `steps`, ascending, or 0; null for none."""
    found = F.when(accept(F.lit(0.0)), 0.0)
    for s in steps:
        found = found.when(accept(F.lit(s)), s)
    return found


def profile(*columns: Column) -> Column:
    """One string of arrays of words and other values, equal where all of them are."""
    return F.concat_ws("\x1e", *[F.coalesce(c, F.lit("\x1d")) for c in columns])


def spelled(words: str | Column) -> Column:
    return F.concat_ws("\x1f", words)


def name_zone(raw: Column) -> Column:
    """Folded capitalised words within 80 characters after each mark of sanctity, words of rank left out."""
    zones = F.regexp_extract_all(C.rejoined(raw), F.lit(rf"{MARKER}(?=((?s:.{{0,80}})))"), F.lit(1))
    words = F.flatten(F.transform(zones, lambda z: F.regexp_extract_all(z, F.lit("[A-Z][a-zA-Z]+"), F.lit(0))))
    return F.filter(F.transform(words, lambda w: F.trim(C.folded(w))), lambda w: (w != "") & ~F.substring(w, 1, 6).isin(RANKS))


def _deletions(word: Column) -> Column:
    """A word and the words with one letter less."""
    cut = lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word)))
    return F.array_distinct(F.concat(F.array(word), F.transform(F.sequence(F.lit(1), F.length(word)), cut)))


def stem_hits(stems: DataFrame, tokens: DataFrame, by_five: bool = False) -> DataFrame:
    """(stem, token, hit): 1 where the token begins with the stem, 0.8 where its beginning is nearly the stem.

    by_five: 1 too where the stem begins with the first five letters of the token; and shorter stems count, which nothing
    but themselves is nearly.

    stems: stem, of four to six letters. tokens: token. Nearly means a ratio of 0.8 or more with as much of the token,
    which has four letters or more. Such words share all but at most one letter of each, in order, so they share a key:
    one of them or one of them with a letter less; a stem of six letters and a token of four have two less. Only
    distinct words are compared.
    """
    s = stems.select("stem").where("length(stem) >= 4").distinct()
    twice = F.array_distinct(F.flatten(F.transform(_deletions(F.col("stem")), _deletions)))
    s = s.select("stem", F.explode(F.when(F.length("stem") == 6, twice).otherwise(_deletions(F.col("stem")))).alias("key"))
    t = tokens.select("token").where("token is not null").distinct()
    cuts = F.array_distinct(F.transform(F.array(*[F.lit(n) for n in (4, 5, 6)]), lambda n: F.substring(F.col("token"), F.lit(1), n)))
    t = t.select("token", F.explode(F.array_distinct(F.flatten(F.transform(cuts, _deletions)))).alias("key"))
    pairs = kept(s.join(t, "key").select("stem", "token").distinct().withColumn("cut", F.expr("substring(token, 1, length(stem))")))
    begins = F.col("token").startswith(F.col("stem"))
    if by_five:
        # a stem of six letters whose first five the token has shares a key with it: the five letters
        begins = begins | ((F.length("token") >= 5) & F.col("stem").startswith(F.substring("token", 1, 5)))
    exact = pairs.where(begins).select("stem", "token", F.lit(1.0).alias("hit"))
    if by_five:
        short = t.select("token").distinct().select("token", F.explode(F.array(*[F.substring("token", 1, n) for n in (1, 2, 3)])).alias("stem")).distinct()
        exact = exact.unionByName(short.join(stems.select("stem").where("length(stem) < 4").distinct(), "stem").select("stem", "token", F.lit(1.0).alias("hit")))
    near = similarity(pairs.where(~begins & (F.length("token") >= 4)), "stem", "cut", "ratio").where("ratio >= 0.8")
    return exact.unionByName(near.select("stem", "token", F.lit(0.8).alias("hit")))


def entry_features(entries: DataFrame, stop: list[str]) -> DataFrame:
    """Entries with folded text, capitalised tokens, name zone and signature."""
    text, folded = F.col("text"), F.col("folded")
    return entries.withColumn("folded", C.folded(text)).withColumns({"caps": C.capitalised(text), "zone": name_zone(text), "sig": C.signature(folded, stop)})


def id_features(ids: DataFrame, stop: list[str]) -> DataFrame:
    """Ids (id, month, day, text) with the stems of their slug, the folded beginning of their text, and its signature."""
    folded = C.folded(F.coalesce("text", F.lit("")))
    return ids.select("id", "month", "day", C.slug_stems(C.slug_of(F.col("id")), C.SLUG_STOP).alias("stems"), F.substring(folded, 1, COMPARED).alias("id_text"), C.signature(folded, stop).alias("id_sig"))


def stem_scores(entries: DataFrame, ids: DataFrame, words: str, on: list[str]) -> DataFrame:
    """(entry key, id, s_stem): the mean over an id's stems of its hit by the entry's words, for pairs with a hit.

    Of a stem the first word that hits it counts, be it only nearly. `on` are columns that both sides must share. The first
    six letters of a word tell its hits, as no stem is longer.
    """
    token = entries.select(*ENTRY, F.posexplode(F.transform(words, lambda w: F.substring(w, 1, 6))).alias("at", "token"))
    stem = ids.select("id", *[F.col(c).alias(f"_{c}") for c in on], F.size("stems").alias("n"), F.posexplode("stems").alias("nth", "stem"))
    hits = stem_hits(stem, token)
    met = token.join(hits, "token").join(stem, "stem")
    for c in on:
        met = met.where(F.col(c) == F.col(f"_{c}"))
    first = met.groupBy(*ENTRY, "id", "n", "nth").agg(F.min_by("hit", "at").alias("hit"))
    return first.groupBy(*ENTRY, "id").agg((F.sum("hit") / F.first("n")).alias("s_stem"))


def word_pairs(entries: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    """(entry key, id, jac): Jaccard similarity of signatures, for pairs that share a word."""
    left = entries.select(*ENTRY, F.size("sig").alias("a"), F.explode("sig").alias("w"))
    right = ids.select("id", *on, F.size("id_sig").alias("b"), F.explode("id_sig").alias("w"))
    shared = left.join(right, [*on, "w"]).groupBy(*ENTRY, "id", "a", "b").agg(F.count("*").alias("n"))
    return shared.select(*ENTRY, "id", (F.col("n") / (F.col("a") + F.col("b") - F.col("n"))).alias("jac"))


def leading_pairs(entries: DataFrame, ids: DataFrame, on: list[str], k: int | None = None, key: list[str] = ENTRY, rivals: list[str] | None = None) -> DataFrame:
    """(key, id, jac, rank): of each entry its first k pairs of word_pairs(), by jac, then id, the largest first.

    Without k it is as many as the entry has rivals, itself among them: the entries that agree with it in the columns
    `rivals`, of which `on` are some. In a one-to-one choice in an order in which each entry's pairs come by jac, then id,
    no entry gets a later one, if only rivals take an id from it: it has one more than they can take. Pairs are made of
    the distinct signatures of `on`, each with its largest ids, and never written for every entry and id.
    """
    entries = kept(entries.select(*key, *[c for c in on if c not in key], "sig"))
    if k is None:
        sized = entries.groupBy(*rivals).agg(F.count("*").cast("int").alias("_k"))
        entries, most = entries.join(sized, rivals), sized.groupBy(*on).agg(F.max("_k").alias("_most"))
    else:
        entries, most = entries.withColumn("_k", F.lit(k)), ids.select(*on).distinct().withColumn("_most", F.lit(k))
    best = leading_ids(entries.select(*on, "sig").distinct(), ids, on, most)
    return entries.join(best, [*on, "sig"]).where(F.col("rank") <= F.col("_k")).select(*key, "id", "jac", "rank")


def leading_ids(signatures: DataFrame, ids: DataFrame, on: list[str], most: DataFrame) -> DataFrame:
    """(on, sig, id, jac, rank): leading_pairs() of distinct signatures (on, sig), as many as `most` (on, _most) tells."""
    larger = Window.partitionBy(*on, "id_sig").orderBy(F.col("id").desc())
    largest = ids.select("id", *on, "id_sig").join(most, on).withColumn("_r", F.row_number().over(larger)).where(F.col("_r") <= F.col("_most")).drop("_r")
    left = signatures.withColumn("w", F.explode("sig"))
    right = ids.select(*on, "id_sig").distinct().withColumn("w", F.explode("id_sig"))
    shared = left.join(right, [*on, "w"]).groupBy(*on, "sig", "id_sig").agg(F.count("*").alias("n"))
    rated = shared.select(*on, "sig", "id_sig", (F.col("n") / (F.size("sig") + F.size("id_sig") - F.col("n"))).alias("jac"))
    first = Window.partitionBy(*on, "sig").orderBy(F.col("jac").desc(), F.col("id").desc())
    best = rated.join(largest, [*on, "id_sig"]).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= F.col("_most"))
    return best.select(*on, "sig", "id", "jac", "rank")


def strong_pairs(entries: DataFrame, ids: DataFrame, words: str, least: float) -> DataFrame:
    """(entry key, id, s_stem) of the pairs of any day whose s_stem is `least` or more.

    Such a pair misses (1 - least) of an id's n stems at most, so that it has one of as many and one more, the rarest by
    the entries that hit them: only these pair entries with ids, and popular stems pair nothing.
    """
    token = kept(entries.select(*ENTRY, F.posexplode(words).alias("at", "token")))
    stem = kept(ids.dropDuplicates(["id"]).select("id", F.size("stems").alias("n"), F.posexplode("stems").alias("nth", "stem")))
    hits = kept(stem_hits(stem, token))
    df = hits.join(token.groupBy("token").agg(F.count("*").alias("df")), "token").groupBy("stem").agg(F.sum("df").alias("df"))
    turn = F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("df", F.lit(0)), "nth"))
    leading = stem.join(df, "stem", "left").withColumn("turn", turn).where(F.col("turn") <= F.floor((1 - least) * F.col("n") + 1e-9) + 1).select("id", "stem")
    pairs = token.join(hits.select("stem", "token"), "token").join(leading, "stem").select(*ENTRY, "id").distinct()
    met = pairs.join(stem, "id").join(hits, "stem").join(token, [*ENTRY, "token"])
    first = met.groupBy(*ENTRY, "id", "n", "nth").agg(F.min_by("hit", "at").alias("hit"))
    return first.groupBy(*ENTRY, "id").agg((F.sum("hit") / F.first("n")).alias("s_stem")).where(F.col("s_stem") >= least)


def scored_pairs(entries: DataFrame, ids: DataFrame, words: str, on: list[str], possible: Column | None = None) -> DataFrame:
    """(entry key, folded, id, s_stem, jac, s_text, total) of the pairs that share a stem or a word.

    possible: what must hold of s_stem, jac and folded before a pair's texts are compared letter by letter. Ids that come
    without id_text are not compared, their pairs come without s_text and total.
    """
    both = stem_scores(entries, ids, words, on).join(word_pairs(entries, ids, on), [*ENTRY, "id"], "full").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("s_stem", "jac")})
    return _compared(both, entries, ids, possible)


def _compared(pairs: DataFrame, entries: DataFrame, ids: DataFrame, possible: Column | None = None) -> DataFrame:
    """Pairs with s_stem and jac, and then s_text and total. Texts that repeat are compared once."""
    told = pairs.join(entries.select(*ENTRY, "folded"), ENTRY)
    told = told if possible is None else told.where(possible)
    if "id_text" not in ids.columns:
        return told
    told = told.join(ids.select("id", "id_text").dropDuplicates(["id"]), "id").withColumn("_text", F.substring("folded", 1, COMPARED))
    rated = similarity(told, "_text", "id_text", "s_text").drop("_text", "id_text")
    return rated.withColumn("total", 1.5 * F.col("s_stem") + 1.3 * F.col("s_text") + 0.8 * F.col("jac"))


def _feast(folded: Column) -> Column:
    return F.ltrim(folded).rlike(r"\A(octava|vigilia)")


def _same_day(s_text: Column) -> Column:
    """Whether a pair of one day may be chosen at a similarity of its texts; with 1 for it, whether it ever may be."""
    stem, jac = F.col("s_stem"), F.col("jac")
    feast = (stem >= 0.5) & ((jac >= 0.15) | (s_text >= 0.5))
    return F.when(_feast(F.col("folded")), feast).otherwise((stem >= 0.65) | ((s_text >= 0.42) & (jac >= 0.15)))


def accepted_same_day(pairs: DataFrame) -> DataFrame:
    return pairs.where(_same_day(F.col("s_text")))


def greedy(pairs: DataFrame, left: list[str], right: list[str], order: list[Column]) -> DataFrame:
    """A one-to-one choice: pairs in this strict order, each taken if neither of its ends was taken before.

    That is the same as taking, round by round, every pair that is the first for both of its ends, so no group is
    gathered anywhere; pairs that lose an end go. What is left of a round is written, and the rounds are few.
    """
    chosen, rest = None, kept(pairs)
    while not rest.isEmpty():
        by = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        best = kept(rest.withColumns({"_l": by(left), "_r": by(right)}).where("_l = 1 and _r = 1").drop("_l", "_r"))
        chosen = best if chosen is None else chosen.unionByName(best)
        rest = kept(rest.join(best.select(*left), left, "left_anti").join(best.select(*right), right, "left_anti"))
    return pairs.limit(0) if chosen is None else chosen


def match_same_day(entries: DataFrame, ids: DataFrame, stop: list[str]) -> DataFrame:
    """(entry key, id, score, method) of entries matched with ids of their own day, one to one in each day."""
    numbered, texts = lines(entries)
    day, folded = ["month", "day"], F.col("folded")
    begun = F.array_distinct(F.transform("caps", lambda w: F.substring(w, 1, 6)))
    told = entry_features(texts, stop).select(*day, F.col("idx").alias("line"), begun.alias("caps"), F.array_sort("sig").alias("sig"), F.when(_feast(folded), "octava").otherwise("").alias("folded"), F.substring(folded, 1, COMPARED).alias("text"))
    told = stored(told.withColumn("profile", profile(spelled("caps"), spelled("sig"), folded)))
    known = id_features(ids, stop).distinct().withColumn("id_sig", F.array_sort("id_sig"))
    known = stored(known.withColumn("id_profile", profile(spelled("stems"), spelled("id_sig"))))
    # what a pair scores but for its texts goes by profiles: the beginnings of names, words and whether it is a feast
    mine = kept(told.select(*day, "profile", "caps", "sig", "folded").distinct().select(F.lit("").alias("edition"), *day, F.monotonically_increasing_id().alias("idx"), "profile", "caps", "sig", "folded"))
    theirs = known.select(F.col("id_profile").alias("id"), *day, "stems", "id_sig").distinct()
    met = scored_pairs(mine, theirs, "caps", day, _same_day(F.lit(1.0))).join(mine.select(*ENTRY, "profile"), ENTRY)
    pairs = kept(met.select(*day, "profile", F.col("id").alias("id_profile"), (1.5 * F.col("s_stem")).alias("before"), (0.8 * F.col("jac")).alias("after"), least_text(_same_day, [0.42, 0.5]).alias("least")))
    leaders = lambda asked: text_leaders(told.join(asked, "line"), known, pairs, 1.3)
    found = greedy_lines(numbered, leaders, ["edition", "month", "day", "id"], [F.col("idx").desc()], ["edition", "month", "day"])
    return found.select(*ENTRY, "id", F.col("total").alias("score"), F.lit("same-day").alias("method"))


def lines(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entry key, line) of the entries, and the distinct texts of each day, under keys of their own: no edition, and line as idx.

    What a pair scores depends on the day and the text alone, so that pairs are made of lines, however many editions print them.
    """
    told = stored(entries.select(*ENTRY, F.coalesce("text", F.lit("")).alias("text")))
    own = stored(told.select("month", "day", "text").distinct().withColumn("line", F.monotonically_increasing_id()))
    numbered = stored(told.join(own, ["month", "day", "text"]).select(*ENTRY, "line"))
    return numbered, own.select(F.lit("").alias("edition"), "month", "day", F.col("line").alias("idx"), "text")


def greedy_lines(entries: DataFrame, pairs: DataFrame | Callable[[DataFrame], DataFrame], right: list[str], order: list[Column], apart: list[str] | None = None) -> DataFrame:
    """(entry key, id, total): greedy() over every entry's pairs, which are those of its line, without a row for each.

    entries: entry key, line; pairs: line, id, total, or a function that gives (line, id, total, r) of asked lines (line,
    n): their first n pairs and the turn of each. Pairs are taken by total, then `order` of the entry, whose last is idx,
    then id, the largest first; an id is taken once of what `right` tells apart. Each entry asks for its best id, an id goes
    to the first that asks, and who loses it asks for the next: with one order for all that is the greedy choice, and an id
    once lost stays lost. Entries of one line ask for the same ids and the largest idx gets the better one, so that each
    asks for a later one than those before it. apart: columns such that entries that differ in them ask for no common id;
    those among whom nobody lost are settled and go no further round.
    """
    same, done = Window.partitionBy("edition", "line").orderBy(F.col("idx").desc()), None

    def in_turn(asked: DataFrame) -> DataFrame:
        place = F.row_number().over(same)
        upto = same.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return stored(asked.withColumn("_n", place).withColumn("r", F.max(F.col("r") - F.col("_n")).over(upto) + F.col("_n")).drop("_n"))

    asked = in_turn(entries.select(*ENTRY, "line", F.lit(1).alias("r")))
    if callable(pairs):
        told = stored(asked.groupBy("line").agg(F.max("r").alias("n")))
        ranked = stored(pairs(told))
    else:
        nth = F.row_number().over(Window.partitionBy("line").orderBy(F.col("total").desc(), F.col("id").desc()))
        told, ranked = None, stored(pairs.select("line", "id", "total", nth.alias("r")))
    while True:
        turn = F.row_number().over(Window.partitionBy(*right).orderBy(F.col("total").desc(), *order))
        judged = stored(asked.join(ranked, ["line", "r"]).withColumn("lost", turn > 1))
        lost = judged.where("lost")
        if apart:
            groups = stored(lost.select(*apart).distinct())
            settled, judged = judged.join(groups, apart, "left_anti").select(*ENTRY, "id", "total"), judged.join(groups, apart, "left_semi")
            done = settled if done is None else done.unionByName(settled)
            lost = groups
        if lost.isEmpty():
            return judged.select(*ENTRY, "id", "total") if done is None else done
        asked = in_turn(judged.select(*ENTRY, "line", (F.col("r") + F.col("lost").cast("int")).alias("r")))
        if told is not None:
            more = stored(asked.groupBy("line").agg(F.max("r").alias("r")).join(told, "line").where("r > n").select("line", (2 * F.col("r")).alias("n")))
            if not more.isEmpty():
                ranked = stored(ranked.join(asked.select("line").distinct(), "line", "left_semi").join(more, "line", "left_anti").unionByName(pairs(more)))
                told = stored(told.join(asked.select("line").distinct(), "line", "left_semi").join(more, "line", "left_anti").unionByName(more))


def linked(edges: DataFrame) -> DataFrame:
    """(id, label) of every end of the edges (a, b): the least end that it hangs together with.

    An end takes the least label of its neighbours and then that label's own, so that the rounds follow the logarithm of
    the longest way.
    """
    both = kept(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = kept(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("n")).select("id", F.least("id", "n").alias("label")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        taken = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        own = taken.select(F.col("id").alias("label"), F.col("label").alias("next"))
        moved = kept(taken.join(own, "label", "left").select("id", "old", F.least("label", F.coalesce("next", "label")).alias("label")))
        labels = moved.select("id", "label")
        if moved.where("old <> label").isEmpty():
            return labels


def match_in_turn(pairs: DataFrame, gap: float, method: str) -> DataFrame:
    """Entries in their order, each taking its best free id if that leads the next free one by `gap` or is alone.

    pairs: entry key, id, total, all eligible. Entries that share no id, over any number of steps, don't touch one
    another: each such component is walked through in order in one task.
    """
    pairs, key = kept(pairs), F.concat_ws("|", *ENTRY)
    edges = pairs.select(F.concat(F.lit("e:"), key).alias("a"), F.concat(F.lit("i:"), "edition", F.lit("|"), "id").alias("b"))
    labels = linked(edges).select(F.col("id").alias("_key"), "label")
    marked = pairs.withColumn("_key", F.concat(F.lit("e:"), key)).join(labels, "_key").drop("_key")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*ENTRY, "id").schema) + ", score double"

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for entry, rows in pdf.sort_values(ENTRY).groupby(ENTRY, sort=True):
            free = sorted(((r.total, r.id) for r in rows.itertuples() if r.id not in taken), reverse=True)
            if free and (len(free) == 1 or free[0][0] - free[1][0] >= gap):
                taken.add(free[0][1])
                out.append((*entry, free[0][1], free[0][0]))
        return pd.DataFrame(out, columns=[*ENTRY, "id", "score"])

    found = marked.select(*ENTRY, "id", "total", "label").groupBy("label").applyInPandas(walk, ddl)
    return found.withColumn("method", F.lit(method))


def match_cross_day(entries: DataFrame, ids: DataFrame, assigned: DataFrame, stop: list[str]) -> DataFrame:
    """(entry key, id, score, method) of entries that are left, matched with ids of any day that are left in their edition.

    Octaves and vigils, and entries without a name zone, are left out. stem 0.75, words 0.15, text 0.40, margin 0.3.
    """
    left = entry_features(entries.join(assigned.select(*ENTRY), ENTRY, "left_anti"), stop).where(F.size("zone") > 0).where(~_feast(F.col("folded")))
    left, features = kept(left), kept(id_features(ids, stop))
    strong = strong_pairs(left, features, "zone", 0.75).join(left.select(*ENTRY, "sig"), ENTRY).join(features.select("id", "id_sig").dropDuplicates(["id"]), "id")
    words = strong.withColumn("jac", C.jaccard(F.col("sig"), F.col("id_sig"))).drop("sig", "id_sig").where("jac >= 0.15")
    free = _compared(words, left, features).where("s_text >= 0.4").join(assigned.select("edition", "id").distinct(), ["edition", "id"], "left_anti")
    return match_in_turn(free.select(*ENTRY, "id", "total"), 0.3, "cross-day")


def pair_scores(pairs: DataFrame, entries: DataFrame, ids: DataFrame, words: str) -> DataFrame:
    """The given pairs (entry key, id) with s_stem, jac, s_text and total, whether they share anything or not.

    entries, ids: as entry_features() and id_features() give them. Of a stem the first word that hits it counts.
    """
    told = kept(pairs.select(*ENTRY, "id").join(entries.select(*ENTRY, "folded", "sig", words), ENTRY).join(ids.dropDuplicates(["id"]).select("id", "stems", "id_text", "id_sig"), "id"))
    token, stem = told.select(*ENTRY, "id", F.posexplode(words).alias("at", "token")), told.select(*ENTRY, "id", F.posexplode("stems").alias("nth", "stem"))
    met = token.join(stem_hits(stem, token), "token").join(stem, [*ENTRY, "id", "stem"])
    first = met.groupBy(*ENTRY, "id", "nth").agg(F.min_by("hit", "at").alias("hit")).groupBy(*ENTRY, "id").agg(F.sum("hit").alias("hits"))
    text = similarity(told.select(F.substring("folded", 1, COMPARED).alias("_text"), "id_text").distinct(), "_text", "id_text", "s_text")
    both = told.join(first, [*ENTRY, "id"], "left").withColumn("_text", F.substring("folded", 1, COMPARED)).join(text, ["_text", "id_text"])
    scored = both.select(*ENTRY, "id", F.coalesce(F.col("hits") / F.size("stems"), F.lit(0.0)).alias("s_stem"), C.jaccard(F.col("sig"), F.col("id_sig")).alias("jac"), "s_text")
    return scored.withColumn("total", 1.5 * F.col("s_stem") + 1.3 * F.col("s_text") + 0.8 * F.col("jac"))


def forced_pairs(entries: DataFrame, ids: DataFrame, assigned: DataFrame) -> DataFrame:
    """(entry key, id): the one entry and the one id that a day has left."""
    key = ["edition", "month", "day"]
    entry = entries.join(assigned.select(*ENTRY), ENTRY, "left_anti").groupBy(*key).agg(F.count("*").alias("n"), F.first("idx").alias("idx")).where("n = 1").drop("n")
    free = entry.select(*key).join(ids.select("id", "month", "day").distinct(), ["month", "day"])
    free = free.join(assigned.select("edition", "id").distinct(), ["edition", "id"], "left_anti").groupBy(*key).agg(F.count("*").alias("n"), F.first("id").alias("id")).where("n = 1").drop("n")
    return entry.join(free, key).select(*ENTRY, "id")


def forced_by_words(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """(entry key, words, id, id_words): forced_pairs() where each entry that is `matched` holds all ids of its day that have its words.

    entries: entry key, words, matched; ids: id, month, day, words. The ids that a day has left are counted by sets of
    words, and the one that is left is looked for only where it is one, among the sets of one id: no pairs of an entry
    and all ids of its day are made. Entries are read once.
    """
    key, free = ["edition", "month", "day"], ~F.col("matched")
    days = entries.groupBy(*key).agg(F.count_if(free).alias("n"), F.min(F.when(free, F.struct("idx", "words"))).alias("one"), F.collect_set(F.when(F.col("matched"), F.col("words"))).alias("held")).where("n = 1")
    left = kept(days.select(*key, "one.idx", "one.words", "held"))
    sets = kept(ids.distinct().groupBy("month", "day", F.col("words").alias("id_words")).agg(F.count("*").alias("k"), F.min("id").alias("id")))
    held = left.select(*key, F.explode("held").alias("id_words")).join(sets.drop("id"), ["month", "day", "id_words"])
    gone = held.groupBy(*key).agg(F.sum("k").alias("gone"))
    one = left.join(sets.groupBy("month", "day").agg(F.sum("k").alias("all")), ["month", "day"]).join(gone, key, "left").where(F.col("all") - F.coalesce("gone", F.lit(0)) == 1)
    return one.join(sets.where("k = 1").drop("k"), ["month", "day"]).where(~F.array_contains("held", F.col("id_words"))).select(*ENTRY, "words", "id", "id_words")


def match_elimination(entries: DataFrame, ids: DataFrame, assigned: DataFrame, stop: list[str], least: float = 0.25) -> DataFrame:
    """The one entry and the one id that a day has left, if their total is above `least`; a pair that shares no word has its texts'."""
    forced = forced_pairs(entries, ids, assigned)
    left = entry_features(entries.join(forced.select(*ENTRY), ENTRY, "left_semi"), stop)
    found = pair_scores(forced, left, id_features(ids.join(forced.select("id").distinct(), "id", "left_semi"), stop), "caps").where(F.col("total") > least)
    return found.select(*ENTRY, "id", F.col("total").alias("score"), F.lit("elimination").alias("method"))


def same_month_pairs(entries: DataFrame, ids: DataFrame, claimed: DataFrame, whole: bool = False) -> DataFrame:
    """(entry key, id, cand_day, jac) of entries and unclaimed ids (edition, id) of the same month on other days that share a word.

    whole: only the pairs that share all words of both, which are joined on all of them at once.
    """
    if whole:
        words = lambda c: F.concat_ws("\x1f", F.array_sort(F.array_distinct(c))).alias("words")
        # few rows make very many pairs, so that tasks are not put together by the bytes they read
        tasks = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        there = ids.where(F.size("id_sig") > 0).select("id", "month", F.col("day").alias("cand_day"), words("id_sig")).repartition(tasks, "month", "words")
        asked = entries.where(F.size("sig") > 0).select(*ENTRY, words("sig")).repartition(tasks, "month", "words")
        met = asked.join(there.hint("shuffle_hash"), ["month", "words"]).where("cand_day <> day").withColumn("jac", F.lit(1.0))
        return met.join(claimed.select("edition", "id").distinct(), ["edition", "id"], "left_anti").select(*ENTRY, "id", "cand_day", "jac")
    left = entries.select(*ENTRY, F.size("sig").alias("a"), F.explode("sig").alias("w"))
    free = ids.select("id", "month", F.col("day").alias("cand_day"), F.size("id_sig").alias("b"), F.explode("id_sig").alias("w"))
    met = left.join(free, ["month", "w"]).where("cand_day <> day").groupBy(*ENTRY, "id", "cand_day", "a", "b").agg(F.count("*").alias("n"))
    found = met.select(*ENTRY, "id", "cand_day", (F.col("n") / (F.col("a") + F.col("b") - F.col("n"))).alias("jac"))
    return found.join(claimed.select("edition", "id").distinct(), ["edition", "id"], "left_anti").select(*ENTRY, "id", "cand_day", "jac")


def candidate_pool(older: DataFrame, ids: DataFrame, latin: DataFrame, english: DataFrame) -> DataFrame:
    """(month, day, id, la, en, from_older): the older edition's ids of a day and the day's current ids, with their texts.

    The Latin text is the older edition's where it has one, else the newer one's.
    """
    pool = older.select("month", "day", "id", F.col("text").alias("older_text")).join(ids.select("month", "day", "id", F.lit(True).alias("current")), ["month", "day", "id"], "full")
    texts = pool.join(latin.select("id", F.col("text").alias("la_text")), "id", "left").join(english.select("id", F.col("text").alias("en_text")), "id", "left")
    now = F.col("current").isNotNull()
    return texts.select("month", "day", "id", F.coalesce("older_text", F.when(now, F.col("la_text"))).alias("la"), F.when(now, F.col("en_text")).alias("en"), F.col("older_text").isNotNull().alias("from_older"))


def residuals(entries: DataFrame, ids: DataFrame, assigned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries without an id, ids that no entry has)."""
    return entries.join(assigned.select(*ENTRY), ENTRY, "left_anti"), ids.join(assigned.select("id").distinct(), "id", "left_anti")


def near_misses(pairs: DataFrame, unmatched: DataFrame, k: int = 3) -> DataFrame:
    """Of each unmatched entry its k best pairs (by total, then id) with their rank. Pairs that aren't given don't count."""
    w = Window.partitionBy(*ENTRY).orderBy(F.col("total").desc(), F.col("id").desc())
    return pairs.join(unmatched.select(*ENTRY), ENTRY, "left_semi").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(entries: DataFrame, ids: DataFrame, unmatched: DataFrame, stop: list[str], k: int = 3) -> DataFrame:
    """Of each unmatched entry the k best of all ids of its day, with their scores and rank.

    Pairs that share a stem or a word come from a join on it. Only an entry with fewer than k of them is held against the
    other ids of its day, by their texts.
    """
    left = kept(entry_features(entries.join(unmatched.select(*ENTRY), ENTRY, "left_semi"), stop))
    features = kept(id_features(ids, stop))
    sharing = kept(scored_pairs(left, features, "caps", ["month", "day"]).select(*ENTRY, "id", "s_stem", "jac", "s_text", "total"))
    few = left.select(*ENTRY).join(sharing.groupBy(*ENTRY).agg(F.count("*").alias("n")), ENTRY, "left").where(F.coalesce("n", F.lit(0)) < k)
    others = few.select(*ENTRY).join(features.select("month", "day", "id").distinct(), ["month", "day"]).join(sharing.select(*ENTRY, "id"), [*ENTRY, "id"], "left_anti")
    return near_misses(sharing.unionByName(pair_scores(others, left, features, "caps").select(*sharing.columns)), unmatched, k)


def low_scores(assigned: DataFrame, below: float = 1.0) -> DataFrame:
    return assigned.where(F.col("score") < below)


def apply_overrides(assigned: DataFrame, overrides: DataFrame) -> DataFrame:
    """(entry key, id, score, method, action) after overrides (entry key, ord, action, id), one an entry.

    action: merge, conclusio, drop and coin take the entry's id away; assign gives it an id, taken from whoever holds it,
    by a later override from an earlier one. What isn't overridden stays, with a null action, unless its id is taken.
    """
    return overridden(assigned.join(overrides.select(*ENTRY), ENTRY, "left_anti"), overrides)


def overridden(rest: DataFrame, overrides: DataFrame) -> DataFrame:
    """apply_overrides() where `rest`, what is assigned, has no entry that is overridden."""
    given = overrides.where("action = 'assign'")
    last = given.groupBy("edition", "id").agg(F.max("ord").alias("ord"))
    held = given.join(last, ["edition", "id", "ord"], "left_semi").select(*ENTRY, "id", F.lit(None).cast("double").alias("score"), F.lit("override").alias("method"), "action")
    rest = rest.join(last, ["edition", "id"], "left_anti").select(*ENTRY, "id", "score", "method", F.lit(None).cast("string").alias("action"))
    gone = overrides.where("action <> 'assign'").select(*ENTRY, F.lit(None).cast("string").alias("id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("method"), "action")
    return rest.unionByName(held).unionByName(gone)


def merged_entries(entries: DataFrame, overrides: DataFrame) -> DataFrame:
    """(edition, month, day, idx, text): entries marked merge joined to the one before, those marked drop or conclusio out."""
    marked = entries.join(overrides.select(*ENTRY, "action"), ENTRY, "left").where("action is null or action not in ('drop', 'conclusio')")
    day = Window.partitionBy("edition", "month", "day").orderBy("idx")
    island = marked.withColumn("_at", F.sum(F.when(F.col("action").eqNullSafe("merge"), 0).otherwise(1)).over(day))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x, i: F.when(i == 0, x["text"]).otherwise(F.ltrim(x["text"], F.lit(C.WHITE))))
    kept_right = lambda t: F.transform(t, lambda x, i: F.when(i < F.size(t) - 1, C.right_stripped(x)).otherwise(x))
    told = island.groupBy("edition", "month", "day", "_at").agg(F.min("idx").alias("idx"), texts.alias("t"))
    return told.select("edition", "month", "day", "idx", F.array_join(kept_right(F.col("t")), " ").alias("text"))


def mine_lemmas(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """(form, lemma): what form of a slug's part texts (id, text) use, where one part leads clearly.

    For every part the first of the text's words with the longest common beginning is its form, if that covers five
    letters, or all but one of a shorter part. A form's lemma is the part it stands for most often, the first by name,
    if it is the only one or has twice as many as the next.
    """
    rows = ids.select("id").join(texts.select("id", "text"), "id").select(F.explode(C.slug_parts(C.slug_of(F.col("id")), C.SLUG_STOP)).alias("part"), "text")
    told = kept(rows.groupBy("part", "text").agg(F.count("*").alias("n")))
    # the length of the common beginning is worked out once for each part and word
    words = told.select("part", "text", "n", F.posexplode(C.tokens(C.folded(F.col("text")))).alias("at", "form"))
    differs = F.filter(F.sequence(F.lit(1), F.least(F.length("part"), F.length("form"))), lambda i: F.substring("form", i, F.lit(1)) != F.substring("part", i, F.lit(1)))
    common = words.select("part", "form").distinct().withColumn("same", F.coalesce(F.get(differs, F.lit(0)) - 1, F.least(F.length("part"), F.length("form"))))
    best = words.join(common, ["part", "form"]).groupBy("part", "text").agg(F.max(F.struct(F.col("same").alias("n"), (-F.col("at")).alias("at"), "form")).alias("b"), F.first("n").alias("n"))
    forms = best.where((F.col("b.n") > 0) & (F.col("b.n") >= F.least(F.lit(5), F.length("part") - 1)) & (F.col("b.form") != F.col("part")))
    counts = forms.groupBy(F.col("b.form").alias("form"), "part").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("form").orderBy(F.col("n").desc(), "part")
    ranked = counts.withColumns({"_r": F.row_number().over(w), "_next": F.lead("n").over(w)})
    return ranked.where("_r = 1 and (_next is null or n >= 2 * _next)").select("form", F.col("part").alias("lemma"))


def remapped(elogia: DataFrame, mapping: DataFrame) -> DataFrame:
    """Entries (edition, month, day, pos, id, text) with ids replaced by a mapping (old, new), equal ones of a day merged."""
    new = elogia.join(mapping.select(F.col("old").alias("id"), "new"), "id", "left").withColumn("id", F.coalesce("new", "id"))
    return merge_collisions(new).select("edition", "month", "day", "pos", "id", "text")
