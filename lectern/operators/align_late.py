"""Alignment of a later edition in another language: one score of texts and translated names, and three passes over it.

Entries are rows (edition, month, day, idx, text). The pool (align.candidate_pool()) has the ids that an older edition
prints on a day and those that are current on it, each with a Latin text, a text in the entries' language, or both; one id
may lie in the pools of several days. The passes are: the best pairs of a day, one entry an id in the whole edition; then
entries that are left, in their order, against what other days of their month have left; then the one entry and the one
older id that a day has left. Pairs are made where entry and id share a stem or a word, and only such are scored; a pair's
texts are compared letter by letter only where the other scores leave it a chance. Entries of one day with one text score
the same, so that pairs are made of lines, the distinct texts of a day.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import canonical as C
from lectern.operators.align import COMPARED, ENTRY, greedy, greedy_lines, least_text, lines, match_in_turn, profile, similarity, spelled, stem_hits, text_leaders
from lectern.storage import kept, stored

# Words of slugs that are no names: stop words, groups of people and numbers; beginnings of feasts.
LATE_STOP = [*C.SLUG_STOP, "sociorum", "sancti", "sanctae", "sanctorum", "beati", "beatae"]
GROUPS = (
    "martyres milites virgines monachi fratres socii presbyteri episcopi confessores pueri mulieres innocentes martyrum "
    "duo tres quattuor quinque sex septem octo novem decem undecim duodecim tredecim viginti triginta quadraginta quinquaginta "
    "sexaginta septuaginta octoginta nonaginta centum mille multi plurimi omnes alii aliae"
).split()
FEAST = r"\A(octava|vigilia|the octave|the vigil)"

DAY = ["month", "day"]
#: The key of a place in the pool, beside an entry's own.
PLACE = ["cand_month", "cand_day", "id"]
PAIR = [*ENTRY, *PLACE]


def translated(entries: DataFrame, names: DataFrame, words: DataFrame, stop: list[str]) -> DataFrame:
    """`entries` with toks: their capitalised words, by a dictionary of names, and their other words that are in a dictionary.

    names, words: (word, latin), a word has any number of translations. A capitalised word that isn't in `names` stays as
    it is, unless it is a stop word; of all words those in `words`, or else in `names`, count as what they mean.
    """
    text, lookup = F.col("text"), lambda df, out: df.groupBy("word").agg(F.collect_set("latin").alias(out))
    caps = F.transform(F.regexp_extract_all(text, F.lit("[A-Z][a-zA-Z]{2,}"), F.lit(0)), lambda w: F.trim(C.folded_english(w)))
    caps = F.array_distinct(F.filter(caps, lambda w: (w != "") & ~w.isin(stop)))
    said = entries.select(*ENTRY, F.explode(caps).alias("word")).withColumn("cap", F.lit(True))
    said = said.unionByName(entries.select(*ENTRY, F.explode(F.array_distinct(C.tokens(C.folded_english(text)))).alias("word")).withColumn("cap", F.lit(False)))
    found = said.join(lookup(names, "as_name"), "word", "left").join(lookup(words, "as_word"), "word", "left")
    meant = F.when(F.col("cap"), F.coalesce("as_name", F.array("word"))).otherwise(F.coalesce("as_word", "as_name"))
    toks = found.select(*ENTRY, F.explode(meant).alias("tok")).groupBy(*ENTRY).agg(F.sort_array(F.collect_set("tok")).alias("toks"))
    return entries.join(toks, ENTRY, "left").withColumn("toks", F.coalesce("toks", F.array().cast("array<string>")))


def entry_features(entries: DataFrame, names: DataFrame, words: DataFrame, stop: list[str], own_stop: list[str]) -> DataFrame:
    """Entries with toks, the beginnings of their toks, folded text and signature. own_stop: stop words of the entries' language."""
    folded = F.col("folded")
    found = translated(entries, names, words, stop).withColumn("folded", C.folded_english(F.col("text")))
    return stored(found.select(*ENTRY, "toks", F.array_distinct(F.transform("toks", lambda t: F.substring(t, 1, 5))).alias("begun"), "folded", C.signature(folded, own_stop, 5).alias("sig")))


def pool_features(pool: DataFrame, la_stop: list[str], own_stop: list[str]) -> DataFrame:
    """The pool's places (cand_month, cand_day, id) with the stems of the id's slug, signatures, and whether an older edition has the id."""
    older = pool.where("from_older").select("id").distinct().withColumn("older", F.lit(True))
    slug = C.slug_of(F.col("id"))
    bases = C.slug_parts(F.translate(slug, "j", "i"), LATE_STOP)
    la, en = (C.folded_english(F.coalesce(c, F.lit(""))) for c in ("la", "en"))
    lead = F.get(F.filter(F.transform(bases, lambda b, i: F.when(~b.isin(GROUPS), i)), lambda i: i.isNotNull()), F.lit(0))
    return stored(pool.join(older, "id", "left").select(
        F.col("month").alias("cand_month"), F.col("day").alias("cand_day"), "id", "from_older", C.stem_variants(slug, LATE_STOP).alias("stems"), lead.alias("lead"),
        C.signature(la, la_stop, 5).alias("la_sig"), C.signature(en, own_stop, 5).alias("en_sig"), F.substring(en, 1, COMPARED).alias("en_text"),
        (F.col("la").isNotNull() & F.coalesce("older", F.lit(False))).alias("in_older"), F.coalesce("older", F.lit(False)).alias("older"),
    ))


def _stems(places: DataFrame) -> DataFrame:
    """(id, nth, stem), every variant of every part of the ids' slugs."""
    one = places.groupBy("id").agg(F.first("stems").alias("stems"))
    return one.select("id", F.posexplode("stems").alias("nth", "variants")).select("id", "nth", F.explode("variants").alias("stem"))


def _begun(entries: DataFrame) -> DataFrame:
    """(entry key, token), the first six letters of each tok: no stem is longer, so that they tell all of its hits."""
    return entries.select(*ENTRY, F.explode(F.array_distinct(F.transform("toks", lambda t: F.substring(t, 1, 6)))).alias("token"))


def best_hits(entries: DataFrame, places: DataFrame) -> DataFrame:
    """(id, nth, token, hit): what the beginning of a token says of an id's part at best over the part's variants, 1 or 0.8."""
    stems = _stems(places)
    hits = stem_hits(stems, _begun(entries).select("token"), by_five=True)
    return kept(stems.join(hits, "stem").groupBy("id", "nth", "token").agg(F.max("hit").alias("hit")))


def scores(pairs: DataFrame, entries: DataFrame, places: DataFrame, hits: DataFrame) -> DataFrame:
    """The pairs (PAIR) with s_stem, s_first, jac_la, jac_en and what accepted() and the total need besides."""
    toks = pairs.join(_begun(entries), ENTRY)
    best = toks.join(hits, ["id", "token"]).groupBy(*PAIR, "nth").agg(F.max("hit").alias("hit"))
    stem = best.groupBy(*PAIR).agg(F.sort_array(F.collect_list(F.struct("nth", "hit"))).alias("hits"))
    told = pairs.join(entries.select(*ENTRY, "begun", "folded", "sig"), ENTRY).join(places, PLACE).join(stem, PAIR, "left")
    n = F.size("stems")
    total = F.aggregate("hits", F.lit(0.0), lambda acc, h: acc + h["hit"])
    first = F.get(F.filter("hits", lambda h: h["nth"] == F.col("lead")), F.lit(0))["hit"]
    return told.select(
        *PAIR, F.coalesce(F.when(n > 0, total / n), F.lit(0.0)).alias("s_stem"), F.coalesce(first, F.lit(0.0)).alias("s_first"), C.jaccard(F.col("begun"), F.col("la_sig")).alias("jac_la"),
        C.jaccard(F.col("sig"), F.col("en_sig")).alias("jac_en"), F.ltrim("folded").rlike(FEAST).alias("feast"), n.alias("n_stems"), "older", "in_older", F.substring("folded", 1, COMPARED).alias("text"), "en_text",
    )


def accepted(s_text: Column) -> Column:
    """Whether a scored pair of one day may be chosen, at a similarity of its texts. With 1 for it: whether it ever may be.

    Of an id that no older edition has, its whole name must stand there, or the texts agree; of others less is asked for.
    """
    stem, first, la, en = (F.col(c) for c in ("s_stem", "s_first", "jac_la", "jac_en"))
    feast = (stem >= 0.5) & ((la >= 0.1) | (s_text >= 0.4))
    new = ((stem >= 0.75) & ((en >= 0.1) | (la >= 0.1))) | ((s_text >= 0.55) & (en >= 0.2))
    old = (stem >= 0.65) | ((stem >= 0.4) & ((la >= 0.15) | (en >= 0.15))) | ((s_text >= 0.45) & (en >= 0.15)) | (la >= 0.3) | ((first >= 1.0) & ((la >= 0.05) | (F.col("n_stems") == 1)))
    return F.when(F.col("feast"), feast).when(~F.col("in_older"), new).otherwise(old)


def totals(scored: DataFrame) -> DataFrame:
    """Scored pairs with s_text, the similarity of their texts, and their total. Texts that repeat are compared once."""
    total = 1.5 * F.col("s_stem") + 1.2 * F.col("jac_la") + 1.0 * F.col("s_text") + 0.8 * F.col("jac_en")
    return similarity(scored, "text", "en_text", "s_text").withColumn("total", total).drop("text", "en_text")


def _of_places(places: DataFrame, *columns) -> DataFrame:
    return places.select(*PLACE, *columns)


def same_day_pairs(entries: DataFrame, places: DataFrame, hits: DataFrame) -> DataFrame:
    """The pairs of one day that share a stem or a word of either language."""
    on_day = dict(zip(DAY, (F.col("cand_month"), F.col("cand_day")), strict=True))
    stem = _begun(entries).join(hits.select("id", "token").distinct().join(_of_places(places), "id").withColumns(on_day), [*DAY, "token"]).select(*PAIR)

    def shared(mine: str, theirs: str) -> DataFrame:
        word = _of_places(places, F.explode(theirs).alias("w")).withColumns(on_day)
        return entries.select(*ENTRY, F.explode(mine).alias("w")).join(word, [*DAY, "w"]).select(*PAIR)

    return stem.unionByName(shared("begun", "la_sig")).unionByName(shared("sig", "en_sig")).distinct()


def leading_stems(hits: DataFrame, places: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, nth) of the parts that tell a strong pair: the first name's, and of an id's n parts the n // 4 + 1 rarest.

    A pair of three quarters of an id's parts misses n // 4 of them at most, so that it has one of the rarest; how rare a
    part is tell the entries that hit it.
    """
    known = _begun(entries).groupBy("token").agg(F.count("*").alias("n"))
    df = hits.join(known, "token").groupBy("id", "nth").agg(F.sum("n").alias("df"))
    one = places.groupBy("id").agg(F.first("stems").alias("stems"), F.first("lead").alias("lead"), F.first("older").alias("older"))
    every = one.select("id", "lead", "older", F.size("stems").alias("k"), F.explode(F.sequence(F.lit(0), F.size("stems") - 1)).alias("nth")).where("k > 0")
    turn = F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("df", F.lit(0)), "nth"))
    ranked = every.join(df, ["id", "nth"], "left").withColumn("turn", turn)
    return ranked.where((F.col("turn") <= F.floor(F.col("k") / 4) + 1) | (F.col("older") & F.col("nth").eqNullSafe(F.col("lead")))).select("id", "nth")


def same_month_pairs(entries: DataFrame, places: DataFrame, hits: DataFrame) -> DataFrame:
    """The pairs of one month on other days that share a leading part."""
    leading = hits.join(leading_stems(hits, places, entries), ["id", "nth"]).select("id", "token").distinct()
    there = leading.join(_of_places(places), "id").withColumn("month", F.col("cand_month"))
    return _begun(entries).join(there, ["month", "token"]).where("day <> cand_day").select(*PAIR).distinct()


def day_order() -> list[Column]:
    """The order of entries that ask for one id at one total: by the day as text, then idx, the largest first."""
    return [F.concat_ws("-", "month", "day").desc(), F.col("idx").desc()]


def match_day(pairs: DataFrame) -> DataFrame:
    """Pairs of one day with their totals, one entry an id in the whole edition: the best first, ties by the day as text, idx and id, the largest first."""
    order = [F.col("total").desc(), *day_order(), F.col("id").desc()]
    found = greedy(pairs.select(*ENTRY, "id", "total"), ENTRY, ["edition", "id"], order)
    return found.select(*ENTRY, "id", F.col("total").alias("score"), F.lit("same-day").alias("method"))


def match_month(pairs: DataFrame, assigned: DataFrame) -> DataFrame:
    """Entries that are left, in turn, with their best free place of another day that is strong and leads by 0.3 or is alone.

    An id in the pools of two days is two places, which compete.
    """
    strong = (F.col("s_stem") >= 0.75) | ((F.col("s_first") >= 1.0) & F.col("older"))
    free = pairs.where(strong & ((F.col("jac_la") >= 0.08) | (F.col("jac_en") >= 0.08))).join(assigned.select("edition", "id").distinct(), ["edition", "id"], "left_anti")
    return match_in_turn(totals(free.join(assigned.select(*ENTRY), ENTRY, "left_anti")).select(*ENTRY, "id", "total"), 0.3, "cross-day")


def match_last(entries: DataFrame, places: DataFrame, hits: DataFrame, assigned: DataFrame, least: float = 0.25) -> DataFrame:
    """The one entry and the one id of an older edition that a day has left, if their total is above `least`.

    Each such pair is scored, whether it shares a word or not: there is one a day at most. Days go in their order: an id
    that an earlier day takes is not left on a later one. Days that share no id are settled at once, the others in rounds.
    """
    key = ["edition", *DAY]
    left = kept(entries.select(*ENTRY).join(assigned.select(*ENTRY), ENTRY, "left_anti").groupBy(*key).agg(F.count("*").alias("n"), F.first("idx").alias("idx")).where("n = 1").drop("n"))
    old = places.where("from_older").select(F.col("cand_month").alias("month"), F.col("cand_day").alias("day"), "id").distinct()
    free = left.select(*key).join(old, DAY).join(assigned.select("edition", "id").distinct(), ["edition", "id"], "left_anti")
    found = None
    while True:
        free = kept(free)
        order = F.struct(*DAY)
        blocked = free.withColumn("begin", F.min(order).over(Window.partitionBy("edition", "id"))).where(F.col("begin") < order).select(*key).distinct()
        ready = free.join(blocked, key, "left_anti").groupBy(*key).agg(F.count("*").alias("n"), F.first("id").alias("id")).where("n = 1").drop("n")
        pairs = left.join(ready, key).select(*ENTRY, F.col("month").alias("cand_month"), F.col("day").alias("cand_day"), "id")
        told = kept(totals(scores(pairs, entries, places, hits)).where(F.col("total") > least).select(*ENTRY, "id", F.col("total").alias("score"), F.lit("elimination").alias("method")))
        found = told if found is None else found.unionByName(told)
        free = free.join(blocked, key, "left_semi").join(told.select("edition", "id"), ["edition", "id"], "left_anti")
        if free.isEmpty():
            return found


def day_leaders(texts: DataFrame, places: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What greedy_lines() asks for the pairs of one day: of asked lines the first accepted pairs, by total.

    texts, places: as entry_features(), of lines, and pool_features() give them. What a pair scores but for its texts goes
    by profiles: the beginnings of tokens, words and whether it is a feast; an id's stems, words and where it comes from.
    """
    feast = F.ltrim("folded").rlike(FEAST)
    begun = F.array_sort(F.array_distinct(F.transform("toks", lambda t: F.substring(t, 1, 6))))
    told = texts.select("edition", *DAY, F.col("idx").alias("line"), begun.alias("toks"), F.array_sort("begun").alias("begun"), F.array_sort("sig").alias("sig"), F.when(feast, "octava").otherwise("").alias("folded"), F.substring("folded", 1, COMPARED).alias("text"))
    told = stored(told.withColumn("profile", profile(spelled("toks"), spelled("begun"), spelled("sig"), F.col("folded"))))
    mine = kept(told.drop("line", "text").distinct().withColumn("idx", F.monotonically_increasing_id()))
    known = places.withColumns({c: F.array_sort(c) for c in ("la_sig", "en_sig")})
    stems = F.array_join(F.transform("stems", spelled), "\x1c")
    known = stored(known.withColumn("id_profile", profile(stems, F.col("lead").cast("string"), spelled("la_sig"), spelled("en_sig"), *[F.col(c).cast("string") for c in ("in_older", "older")])))
    theirs = kept(known.select("cand_month", "cand_day", F.col("id_profile").alias("id"), "stems", "lead", "la_sig", "en_sig", "in_older", "older").withColumn("en_text", F.lit("")).distinct())
    hits = best_hits(mine, theirs)
    met = scores(same_day_pairs(mine, theirs, hits), mine, theirs, hits).where(accepted(F.lit(1.0))).join(mine.select(*ENTRY, "profile"), ENTRY)
    before, after = 1.5 * F.col("s_stem") + 1.2 * F.col("jac_la"), 0.8 * F.col("jac_en")
    pairs = kept(met.select(*DAY, "profile", F.col("id").alias("id_profile"), before.alias("before"), after.alias("after"), least_text(accepted, [0.4, 0.45, 0.55]).alias("least")))
    ids = known.select(F.col("cand_month").alias("month"), F.col("cand_day").alias("day"), "id", "id_profile", F.col("en_text").alias("id_text"))
    return lambda asked: text_leaders(told.select(*DAY, "line", "profile", "text").join(asked, "line"), ids, pairs, 1.0)


def align_late(entries: DataFrame, pool: DataFrame, names: DataFrame, words: DataFrame, stop: list[str], la_stop: list[str], own_stop: list[str]) -> DataFrame:
    """(entry key, id, score, method) of the entries that the three passes match; an id is taken once an edition."""
    entries, texts = lines(entries)
    e, p = entry_features(texts, names, words, stop, own_stop), pool_features(pool, la_stop, own_stop)
    # days whose pools share no id are chosen on apart from each other
    roams = p.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    found = greedy_lines(entries, day_leaders(e, p), ["edition", "id"], day_order(), ["edition", *DAY] if roams.isEmpty() else ["edition"])
    assigned = stored(found.select(*ENTRY, "id", F.col("total").alias("score"), F.lit("same-day").alias("method")))
    left = stored(entries.join(assigned.select(*ENTRY), ENTRY, "left_anti"))
    if left.isEmpty():
        return assigned
    rest = kept(left.join(e.drop("edition", *DAY).withColumnRenamed("idx", "line"), "line"))
    unread = stored(e.join(left.select(F.col("line").alias("idx")).distinct(), "idx", "left_semi"))
    hits = best_hits(unread, p)
    month = scores(same_month_pairs(unread, p, hits), unread, p, hits).drop("edition", *DAY).withColumnRenamed("idx", "line")
    assigned = stored(assigned.unionByName(match_month(left.join(month, "line").drop("line"), assigned)))
    return assigned.unionByName(match_last(rest, p, hits, assigned))
