"""N-gram Jaccard join: a grouped prefix join, and the components of its links.

A document's set holds the hashes of its distinct word shingles. Copies have one set. Sets are written in one global
order of shingles, rare ones first (by the counts of a sketch over the whole corpus, then by hash); two sets of a
Jaccard similarity of t share a shingle among the first n - ceil(t n) + 1 of each. Sets of one prefix and one size form a
group, which posts its prefix once. Candidate pairs of groups come from shingles that two groups post, filtered by size
and by position; groups are expanded to members, and members verified on their whole sets.

What is asked for is who is connected, so no group's pairs are spelled out where one link a member says the same. First
every group is held against one pivot a shingle, the one most made of common shingles, which near copies descend from.
Then a second prefix join runs over what is left: pairs of sets in different components. It is held to the shingles of
the prefixes that others post too, rarest first; a pair must find its first shared one early enough in both to reach the
similarity, and is made there and not again at those that follow. Within a group the same join runs over the rest of the
sets. Every pair that may be similar is tested, and no link between different texts is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import bloom_holds, bloom_words, joined, own_columns, renamed, small_batches, stored, text_of
from lectern.llm.components import components
from lectern.llm.shingles import mixed, shingle_sets

WORDS = 5
#: The least similarity, as a fraction of whole numbers: intersection * DEN >= union * NUM.
NUM, DEN = 75, 100
SKETCH_BITS = 18
PACK = 1 << 12
#: How many of the shared shingles before one are looked at to tell whether a pair was made at an earlier one.
LOOK_BACK = 4
#: Largest Bloom filter of wanted ids, in 64-bit words: 1 MB, which lets few others through for a million ids and more.
BLOOM_WORDS = 1 << 17


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sketch(docs: DataFrame, words: int) -> tuple[np.ndarray, int]:
    """How many (document, shingle) fall in each bucket, and the number of documents. They come back in 65 packed rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, np.zeros(1 << SKETCH_BITS, np.int64)
        for pdf in batches:
            n += len(pdf)
            for s in shingle_sets(pdf["text"].tolist(), words):
                total += np.bincount(_bucket(s), minlength=len(total)) if len(s) > len(total) else 0
                if len(s) <= len(total):
                    np.add.at(total, _bucket(s), 1)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(total[at], n)})

    def packed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return pd.DataFrame({"at": [-1], "counts": [pdf["n"].to_numpy(np.int64).tobytes()]})
        out = np.zeros(PACK, np.int64)
        out[pdf["bucket"].to_numpy(np.int64) % PACK] = pdf["n"].to_numpy()
        return pd.DataFrame({"at": [key[0] * PACK], "counts": [out.tobytes()]})

    counts = docs.select("text").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    n_docs, total = 0, np.zeros(1 << SKETCH_BITS, np.int64)
    for r in counts.groupBy(F.floor(F.col("bucket") / PACK).alias("key")).applyInPandas(packed, "at long, counts binary").collect():
        found = np.frombuffer(r["counts"], np.int64)
        if r["at"] < 0:
            n_docs = int(found[0])
        else:
            total[r["at"] : r["at"] + PACK] = found
    return total, n_docs


def _digest(s: np.ndarray, salt: int) -> int:
    """64 bits of a sequence, its order included."""
    with np.errstate(over="ignore"):
        x = mixed(s + np.uint64(salt)) * (np.arange(1, 2 * len(s), 2, dtype=np.uint64))
        return int(mixed(np.array([x.sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _described(docs: DataFrame, sketch: np.ndarray, n_docs: int, words: int) -> DataFrame:
    """rid, doc_id, th (the text's hash), n, d1, d2 (the set's digest), pd (the prefix's), common, hot (position of the first hot shingle), prefix."""
    level = np.floor(8 * np.log2(sketch + 1)).astype(np.uint8)
    mean = float(sketch.mean())
    frequent = sketch >= 1.3 * mean + 1
    # by level, so that the class of a shingle follows from the order: heavy shingles come last, in every set the same ones
    heavy = level >= np.floor(8 * np.log2(mean + max(1000, 0.002 * n_docs) + 1))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for s in shingle_sets(pdf["text"].tolist(), words):
                n = len(s)
                length = n - -(-NUM * n // DEN) + 1 if n else 0
                at = _bucket(s)
                order = np.lexsort((s, level[at]))[:length]
                prefix = s[order]
                light = int((~heavy[at[order]]).sum())
                common = float(frequent[at].mean()) if n else 0.0
                rows.append((n, _digest(s, 1), _digest(s, 2), _digest(prefix, 3), round(common, 3), light, prefix.view(np.int64)))
            out = pd.DataFrame(rows, columns=["n", "d1", "d2", "pd", "common", "hot", "prefix"])
            out.insert(0, "doc_id", pdf["doc_id"].values)
            out.insert(1, "th", pdf["th"].values)
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInPandas(describe, f"doc_id {kind}, th long, n int, d1 long, d2 long, pd long, common double, hot int, prefix array<long>")
    return stored(found.select(F.monotonically_increasing_id().alias("rid"), "*"))


def _sizes_fit(n1: Column, n2: Column) -> Column:
    return F.least(n1, n2) * DEN >= F.greatest(n1, n2) * NUM


def _similar_enough(n1: Column, p1: Column, n2: Column, p2: Column) -> Column:
    """Whether sets of these sizes that share these positions, and none before, can reach the similarity."""
    least = F.ceil(F.lit(NUM) * (n1 + n2) / F.lit(NUM + DEN) - 1e-9)
    return _sizes_fit(n1, n2) & (1 + F.least(n1 - p1 - 1, n2 - p2 - 1) >= least)


def _shared_prefix(n1: Column, n2: Column) -> Column:
    """How many shingles the prefixes of similar sets of these sizes share at least."""
    rest = F.ceil(F.lit(NUM) * F.greatest(n1, n2) / F.lit(DEN) - 1e-9) - 1
    return F.ceil(F.lit(NUM) * (n1 + n2) / F.lit(NUM + DEN) - 1e-9) - rest


def _plausible(pairs: DataFrame, rows: DataFrame, sids: DataFrame) -> DataFrame:
    """The pairs (a, b) whose prefixes share as many shingles as those of similar sets must.

    Of two prefixes one ends first in the global order; what the sets share up to there lies in both prefixes, and what
    they share beyond is no more than the rest of that set. So the prefixes share at least the overlap that is needed
    less the larger of the two rests. A prefix is a quarter of its set: this leaves most pairs out before sets are moved.
    """
    own = rows.where(_maybe_in(F.col("rid"), sids)).select("rid", "n", "prefix")
    left, right = own.toDF("a", "an", "ap"), own.toDF("b", "bn", "bp")
    both = pairs.join(left, "a").join(right, "b")
    return both.where(F.size(F.array_intersect("ap", "bp")) >= _shared_prefix(F.col("an"), F.col("bn"))).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of set ids whose whole sets are similar enough."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["xs"], pdf["ys"], strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(DEN * common >= NUM * (len(x) + len(y) - common))
            yield pdf.loc[keep, ["a", "b"]]

    left, right = sets.select(F.col("sid").alias("a"), F.col("shingles").alias("xs")), sets.select(F.col("sid").alias("b"), F.col("shingles").alias("ys"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "xs", "ys").mapInPandas(verify, "a long, b long")


def _in_turn(posted: DataFrame, room: list[str]) -> DataFrame:
    """Shared shingles (token, sid, df, ...) with room, how many a set has (within the columns `room`), turn, the place
    among them, rarest first, and back, the last few before."""
    own = Window.partitionBy(*room)
    turn = own.orderBy("df", "token")
    return posted.withColumns({"room": F.count("*").over(own), "turn": F.row_number().over(turn), "back": F.collect_list("token").over(turn.rowsBetween(-LOOK_BACK, -1))})


def _first_met(need: Column) -> Column:
    """Whether sets x and y that share this token can share `need` of all, if it is the first; false at most later ones.

    The first shared one has at least need - 1 after it in either set. Where the shingles just before this one have one
    in common, the pair is made at that one: it comes earlier in both.
    """
    early = (F.col("xturn") <= F.col("xroom") - need + 1) & (F.col("turn") <= F.col("room") - need + 1)
    return early & ~F.arrays_overlap("xback", "back")


def _side(turns: DataFrame, more: list[str]) -> DataFrame:
    """The columns of one side of a join, x in front of their names."""
    return turns.select("token", F.col("sid").alias("x"), *[F.col(c).alias("x" + c) for c in ("comp", "n", "room", "turn", "back")], *more)


def _ordered(x: str, y: str) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _within(inside: DataFrame, sets: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of a group's members (gid, sid, n, comp) of different components whose sets may be similar.

    The prefix is the same for all; of what the sets hold besides, a pair must share what is missing.
    """
    rest = sets.join(inside, "sid").join(rows.select(F.col("rid").alias("gid"), "prefix"), "gid")
    rest = rest.select("gid", "sid", "n", "comp", F.size("prefix").alias("same"), F.explode(F.array_except("shingles", "prefix")).alias("token"))
    rest = _in_turn(rest.withColumn("df", F.count("*").over(Window.partitionBy("gid", "token"))).where("df > 1"), ["gid", "sid"])
    missing = F.ceil(F.lit(2 * NUM) * F.col("n") / F.lit(NUM + DEN) - 1e-9) - F.col("same")
    met = _side(rest, ["gid"]).join(rest, ["gid", "token"])
    return met.where((F.col("x") < F.col("sid")) & (F.col("xcomp") != F.col("comp")) & _first_met(missing)).select(*_ordered("x", "sid")).distinct()


def _maybe_in(key: Column, keys: DataFrame) -> Column:
    """True for every key of the one-column frame, false for most others: a Bloom filter of bounded size."""
    words = min(BLOOM_WORDS, max(64, keys.count() // 6))
    return bloom_holds(key, bloom_words(keys, words, hashes=3), hashes=3)


def _fetched(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(sid, shingles) of the wanted sets (sid, doc_id, d1, d2), read from their texts again.

    A Bloom filter over the wanted ids, of 11 bits an id, leaves most other texts out before they are unpacked.
    """
    wanted = wanted.withColumn("key", F.xxhash64("doc_id"))
    holds = _maybe_in(F.xxhash64("doc_id"), wanted.select("key"))

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = shingle_sets(pdf["text"].tolist(), words)
            yield pd.DataFrame({"key": pdf["key"], "d1": [_digest(s, 1) for s in found], "d2": [_digest(s, 2) for s in found], "shingles": [s.view(np.int64) for s in found]})

    read = docs.where(holds).select(F.xxhash64("doc_id").alias("key"), "text").mapInPandas(sets_of, "key long, d1 long, d2 long, shingles array<long>")
    once = read.groupBy("key", "d1", "d2").agg(F.first("shingles").alias("shingles"))
    return stored(wanted.select("sid", "key", "d1", "d2").join(once, ["key", "d1", "d2"]).select("sid", "shingles"))


def link_components(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = WORDS) -> DataFrame:
    """One row per row of `docs`: rid, doc_id, th (xxhash64 of the text), n_shingles, component_id, kept.

    A text without words (or null) has an empty set and is linked with nothing; one with fewer words than a shingle has
    the one shingle of all its words. component_id is the smallest id of the component, null ids left out; kept marks
    one row of each component, of the row of that id, and every row without words. Repeated rows are copies of each
    other. An empty table gives no rows. Other columns are not read. A very long text has all its shingles in its set; a
    quarter of them and one is posted.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    with small_batches(spark):
        sketch, n_docs = _sketch(docs, words)
        rows = _described(docs, sketch, n_docs, words)

        # distinct sets; sid is the first row that has one
        sets = stored(rows.where("n > 0").groupBy("n", "d1", "d2").agg(
            F.min(F.struct("rid", "doc_id")).alias("first"), F.first("pd").alias("pd"), F.first("common").alias("common"), F.count("*").alias("copies")
        ).select(F.col("first.rid").alias("sid"), F.col("first.doc_id").alias("doc_id"), "n", "d1", "d2", "pd", "common", "copies"))
        # groups of one prefix and size; gid is the first member
        groups = sets.groupBy("n", "pd").agg(F.min("sid").alias("gid"))
        members = stored(sets.join(groups, ["n", "pd"]).select("gid", "sid", "n", "common"))

        # of a text with very many copies only the first posts: at most a thousand such texts
        many = F.broadcast(sets.where(F.col("copies") >= max(1000, n_docs // 1000)).select("d1", "d2", "sid"))
        posting = rows.where("n > 0").join(many, ["d1", "d2"], "left").where("sid is null or sid = rid").select("rid", "n", "hot", F.posexplode("prefix").alias("pos", "token"))
        by_token = Window.partitionBy("token")
        cold = posting.where("pos < hot").select("token", "rid", "n", "pos").withColumn("lo", F.min("rid").over(by_token)).withColumn("hi", F.max("rid").over(by_token)).where("lo <> hi").drop("lo", "hi")
        shared = cold.unionByName(posting.where("pos >= hot").select("token", "rid", "n", "pos"))
        leaders = members.where("sid = gid").select(F.col("gid").alias("rid"), "gid", "common")
        posted = stored(shared.join(leaders, "rid").select("token", "gid", "n", "pos", "common"))

        # every group against the pivot of each shingle, and every member against its group's leader
        pivots = stored(posted.groupBy("token").agg(
            F.max(F.struct("common", (-F.col("gid")).alias("by"), "gid", "n", "pos")).alias("p"), F.min("gid").alias("lo"), F.max("gid").alias("hi"), F.count("*").alias("df")
        ).where("lo <> hi").select("token", "df", F.col("p.gid").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.pos").alias("pp")))
        star = posted.join(pivots, "token").where((F.col("gid") != F.col("pivot")) & _similar_enough(F.col("n"), F.col("pos"), F.col("pn"), F.col("pp"))).select("gid", "pivot").distinct()
        one = star.join(members.select("gid", "sid"), "gid").select("sid", F.col("pivot").alias("other")).unionByName(members.where("sid <> gid").select("sid", F.col("gid").alias("other")))
        first = stored(one.select(*_ordered("sid", "other")).distinct())
        ids = lambda pairs: pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
        wanted = sets.select("sid", "doc_id", "d1", "d2")
        likely = stored(_plausible(first, rows, ids(first)))
        links = stored(_verified(likely, _fetched(docs, wanted.join(ids(likely), "sid"), words)))
        labels = components(links)

        # what several components post, outside of the pivot's own, against all else that posts it
        labelled = lambda df, key, out: df.join(labels.select(F.col("id").alias(key), F.col("label").alias(out)), key, "left").withColumn(out, F.coalesce(out, key))
        each = labelled(posted.join(members.select("gid", "sid"), "gid").select("token", "gid", "sid", "n"), "sid", "comp")
        at_pivot = labelled(pivots.select("token", "df", F.col("pivot").alias("gid")), "gid", "pcomp").select("token", "df", "pcomp")
        each = stored(each.join(at_pivot, "token"))
        # Of a prefix only the shingles that others post too can be shared. Of two sets of different components one at least
        # lies outside of the pivot's.
        turns = _in_turn(each, ["sid"])
        need = _shared_prefix(F.col("xn"), F.col("n"))
        met = _side(turns.where("comp <> pcomp"), [F.col("gid").alias("xgid")]).join(turns, "token")
        cross = met.where((F.col("xcomp") != F.col("comp")) & (F.col("xgid") != F.col("gid")) & _sizes_fit(F.col("xn"), F.col("n")) & _first_met(need)).select(*_ordered("x", "sid")).distinct()
        # members of one group in different components: their prefix is the same, the rest of the sets must share enough
        inside = labelled(members.select("gid", "sid", "n"), "sid", "comp")
        several = inside.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("gid")
        inside = stored(inside.join(several, "gid"))
        pairs = cross if inside.isEmpty() else cross.unionByName(_within(inside, _fetched(docs, wanted.join(inside.select("sid"), "sid"), words), rows)).distinct()
        second = stored(pairs.join(first, ["a", "b"], "left_anti"))
        likely = stored(_plausible(second, rows, ids(second)))
        links = stored(links.unionByName(_verified(likely, _fetched(docs, wanted.join(ids(likely), "sid"), words))))
    labels = components(links)

    # a component's least id, and the row of it that stays, by set and then by label; large sets and components are not dealt by them
    first = F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "rid"))
    known = stored(sets.join(labels, sets["sid"] == labels["id"], "left").select("n", "d1", "d2", "copies", F.coalesce("label", "sid").alias("label")))
    of_set = rows.where("n > 0").groupBy("n", "d1", "d2").agg(first.alias("first")).join(known, ["n", "d1", "d2"])
    least = stored(of_set.groupBy("label").agg(F.min("first").alias("first"), F.count("*").alias("sets")).select("label", F.col("first.doc_id").alias("component_id"), F.col("first.rid").alias("keeper"), "sets"))
    of_set = stored(joined(known, least, ["label"], "sets").select("n", "d1", "d2", "component_id", "keeper", "copies"))
    worded = joined(rows.where("n > 0").select("rid", "doc_id", "th", "n", "d1", "d2"), of_set, ["n", "d1", "d2"], "copies")
    worded = worded.select("rid", "doc_id", "th", F.col("n").cast("long").alias("n_shingles"), "component_id", (F.col("rid") == F.col("keeper")).alias("kept"))
    none = rows.where("n = 0").select("rid", "doc_id", "th", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return worded.unionByName(none)


def component_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, null, empty and repeated ones as link_components() has them."""
    return link_components(docs, **options).select("doc_id", "n_shingles", "component_id")


def drop_near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs` that stay, one of each component, with all their columns, whatever these are called.

    A row is told by its id and its text's hash, so that of rows without an id, or of one id, each text stays or goes by
    itself. Rows of one id and one text are told apart by nothing; where several of them are there, one stays. Texts
    without words, null and empty ones, all stay. An empty table stays empty.
    """
    mark, many, own, th = renamed(docs, "_mark", "_many", "_id", "_th")
    found = link_components(docs, text_col, id_col, **options)
    stay = stored(found.groupBy("doc_id", "th").agg(F.max("kept").alias("kept"), F.count("*").alias("rows"), F.max(F.when(F.col("n_shingles") > 0, 1)).alias("worded")).where("kept").select(
        F.col("doc_id").alias(own), F.col("th").alias(th), ((F.col("rows") > 1) & F.col("worded").isNotNull()).alias(many)
    ))
    marked = docs.withColumn(mark, F.xxhash64(text_of(text_col)))
    both = marked.join(stay, F.col(id_col).eqNullSafe(F.col(own)) & (F.col(mark) == F.col(th)))
    if stay.where(F.col(many)).isEmpty():
        return both.select(*own_columns(docs))
    once, more = both.where(~F.col(many)), both.where(F.col(many))
    return once.unionByName(more.dropDuplicates([id_col, mark])).select(*own_columns(docs))
