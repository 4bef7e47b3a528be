"""Phrase collocations by relational mining (SETM): occurrence relations, adjacent merge joins, counted groups.

The relation of length k has one row a text: the positions at which a frequent phrase of k words begins, ascending, and
the phrase's name at each. Positions run through the text; between two pieces one is left out, so that adjacent positions
are adjacent words of one piece. Extending a relation is a merge join of it with itself on position and next position: the
pair of names tells the longer phrase, without collisions, as its first k and its last k words. The groups are counted in
tasks and then by a shuffle of counts; the frequent ones are numbered in the order of their keys, and the next relation is
the semi-join of the occurrences with them, written for the next length.

The semi-join finds the frequent keys in a broadcast array where they are MOST_KEYS at most (8 bytes a key); beyond that
occurrences are laid out as rows and joined by a shuffle, the keys of very many of them apart. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import ascii_lower, joined, met, ordered, small_batches, stored, text_of

#: Fixed values of the contract: what parts a text into pieces, and what parts a piece into words.
CUT, GAP = r".,;:!?\x0A-\x0D", r"\x20\x09"
LEAST, LONGEST, TOP = 30, 4, 2000
NO_LANG = "und"
#: Score of a phrase that occurs wherever one of its parts does; part of the share of the longer phrase that drops one.
SCALE, COVERED = 2_000_000, 80
#: So many frequent keys of one length are broadcast at most: 32 MB.
MOST_KEYS = 4_000_000
#: Occurrences that a task gathers before it counts them.
CHUNK = 1 << 21
RELATION = "at array<int>, name array<int>"


def _tokens(text: Column) -> Column:
    """The words in order, with "." where one piece or several end; a first or last one may be empty."""
    return F.split(F.regexp_replace(ascii_lower(text), f"[{CUT}][{CUT}{GAP}]*", " . "), f"[{GAP}]+", -1)


def _word_key(lang: Column, word: Column, salt: int) -> Column:
    return F.xxhash64(F.lit(salt), lang, word)


def _words(texts: DataFrame) -> tuple[DataFrame, int]:
    """(lang, word, key, n) of every distinct word, and the salt for which no two of them have one key."""
    seen = texts.select("lang", F.explode(_tokens(F.col("text"))).alias("word")).where(~F.col("word").isin("", "."))
    counted = seen.groupBy("lang", "word").agg(F.count("*").alias("n"))
    for salt in range(1, 9):
        words = stored(counted.withColumn("key", _word_key(F.col("lang"), F.col("word"), salt)))
        if words.groupBy("key").agg(F.count("*").alias("words")).where("words > 1").isEmpty():
            return words, salt
    raise RuntimeError("no collision-free word key found")


def _frequent(groups: DataFrame, least: int) -> DataFrame:
    """The groups (key, n, ...) of `least` occurrences or more, named from 0 in the order of their keys."""
    named = stored(ordered(groups.where(F.col("n") >= least), ["key"], rank="name"))
    if named.count() >= 1 << 31:
        raise RuntimeError("more frequent phrases of one length than names")
    return named


def _ragged(lengths: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, kind))


def _laid_out(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each element, element) of a batch's lists."""
    offsets = column.offsets.to_numpy()
    return np.repeat(np.arange(len(column)), np.diff(offsets)), column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]


def _extended(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The merge join of a relation with itself by text and adjacent position: (row, position, key of the pair)."""
    (row, at), (_, name) = _laid_out(batch.column("at")), _laid_out(batch.column("name"))
    met = (row[1:] == row[:-1]) & (at[1:] == at[:-1] + 1)
    key = (name[:-1].astype(np.int64) << 32) | name[1:].astype(np.int64)
    return row[:-1][met], at[:-1][met], key[met]


def _counts(relation: DataFrame) -> DataFrame:
    """(key, n) of the pairs of adjacent occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def told() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])

        for batch in batches:
            held.append(_extended(batch)[2])
            size += len(held[-1])
            if size >= CHUNK:
                yield told()
                held, size = [], 0
        if size:
            yield told()

    return relation.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _sorted_keys(frequent: DataFrame) -> np.ndarray:
    """The keys, ascending, 8 bytes each: the driver gets one packed value of each task and no row of a key."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch.column("key").to_numpy(zero_copy_only=False).tobytes() for batch in batches]
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["keys"])

    keys = np.frombuffer(bytearray().join(r["keys"] for r in frequent.select("key").mapInArrow(pack, "keys binary").toLocalIterator()), np.int64)
    keys.sort()
    return keys


def _semi_joined(rows: DataFrame, frequent: DataFrame, most_keys: int, extend: bool) -> DataFrame:
    """The relation of the occurrences whose key is frequent, written.

    rows: for words, (rid, keys), a key for every position of the text; to extend, a relation (rid, at, name), whose
    pairs of adjacent occurrences are taken.
    """

    def occurrences(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if extend:
            return _extended(batch)
        row, key = _laid_out(batch.column("keys"))
        starts = np.searchsorted(row, np.arange(batch.num_rows))
        return row, (np.arange(len(row)) - starts[row]).astype(np.int32), key

    def relation(batch: pa.RecordBatch, row: np.ndarray, at: np.ndarray, value: np.ndarray, kind: pa.DataType, name: str) -> pa.RecordBatch:
        lengths = np.bincount(row, minlength=batch.num_rows)
        some = np.flatnonzero(lengths)
        lists = [_ragged(lengths[some], at, pa.int32()), _ragged(lengths[some], value, kind)]
        return pa.RecordBatch.from_arrays([batch.column("rid").take(pa.array(some)), *lists], ["rid", "at", name])

    if frequent.count() <= most_keys:
        sent = rows.sparkSession.sparkContext.broadcast(_sorted_keys(frequent))

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = sent.value
            for batch in batches:
                row, at, key = occurrences(batch)
                name = np.searchsorted(held, key)
                known = np.zeros(len(key), bool) if not len(held) else held[np.minimum(name, len(held) - 1)] == key
                yield relation(batch, row[known], at[known], name[known].astype(np.int32), pa.int32(), "name")

        found = stored(rows.mapInArrow(find, f"rid long, {RELATION}"))
        sent.destroy()
        return found

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield relation(batch, *occurrences(batch), pa.int64(), "key")

    flat = rows.mapInArrow(lay_out, "rid long, at array<int>, key array<long>").select("rid", F.explode(F.arrays_zip("at", "key")).alias("o")).select("rid", "o.at", "o.key")
    found = joined(flat, frequent.select("key", "n", F.col("name").cast("int").alias("name")), ["key"], "n")
    lists = found.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("at", "name"))).alias("s"))
    return stored(lists.select("rid", F.col("s.at").alias("at"), F.col("s.name").alias("name")))


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, most_keys: int = MOST_KEYS) -> tuple[list[DataFrame], DataFrame]:
    """The frequent phrases of 1 to `longest` words, one written table a length, and (lang, n), each language's words.

    A table has (lang, name, left, right, words, first, last): left and right are the names of the phrase without its
    last and its first word; `first` has the occurrences of its first 1, 2, ... words, `last` those of its last ones, the
    phrase's own at the end of both. A null text is empty; a null language is NO_LANG; repeated rows count each time; an
    empty table gives empty ones. A text of any length is one row of a relation: 8 bytes a position.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit(NO_LANG)).alias("lang"), text_of(text_col).alias("text"))
    words, salt = _words(texts)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = _frequent(words, least)
    none = F.lit(None).cast("long")
    found = [frequent.select("lang", "name", none.alias("left"), none.alias("right"), F.array("word").alias("words"), F.array("n").alias("first"), F.array("n").alias("last"))]
    with small_batches(spark):
        keys = F.transform(_tokens(F.col("text")), lambda w: _word_key(F.col("lang"), w, salt))
        relation = _semi_joined(texts.select(F.monotonically_increasing_id().alias("rid"), keys.alias("keys")), frequent, most_keys, extend=False)
        for k in range(2, longest + 1):
            frequent = _frequent(_counts(relation), least)
            named = frequent.select("name", "n", F.shiftright("key", 32).alias("left"), F.col("key").bitwiseAND((1 << 32) - 1).alias("right"))
            left = found[-1].select("lang", F.col("name").alias("left"), F.col("words").alias("lw"), F.col("first").alias("lf"))
            right = found[-1].select(F.col("name").alias("right"), F.col("words").alias("rw"), F.col("last").alias("rl"))
            own = F.array("n")
            found.append(stored(met(met(named, left, ["left"]), right, ["right"]).select(
                "lang", "name", "left", "right", F.concat("lw", F.slice("rw", -1, 1)).alias("words"), F.concat("lf", own).alias("first"), F.concat("rl", own).alias("last")
            )))
            if k < longest:
                relation = _semi_joined(relation, frequent, most_keys, extend=True)
    return found, totals


def _weakest_cut(k: int) -> Column:
    """Struct (score, cut, l, r) of a phrase of k words at its lowest-scoring cut, the first of several."""
    whole = lambda c: c.cast("decimal(20,0)")
    n = F.get("first", F.lit(k - 1))

    def cut(i: int) -> Column:
        left, right = F.get("first", F.lit(i - 1)), F.get("last", F.lit(k - i - 1))
        score = F.call_function("div", whole(n) * F.lit(SCALE).cast("decimal(7,0)"), whole(left) + whole(right))
        return F.struct(score.cast("long").alias("score"), F.lit(i).alias("cut"), left.alias("l"), right.alias("r"))

    return F.array_min(F.array(*[cut(i) for i in range(1, k)]))


def _covers(found: list[DataFrame], k: int) -> DataFrame:
    """(name, most): for phrases of k words the largest count of a longer phrase that holds them."""
    sides = lambda df, more: df.select(F.explode(F.array("left", "right")).alias("name"), *more)
    covers = None
    for longer in range(k + 1, len(found) + 1):
        held = sides(found[longer - 1], [F.get("first", F.lit(longer - 1)).alias("n")])
        for size in range(longer - 1, k, -1):
            held = met(held, found[size - 1].select("name", "left", "right"), ["name"]).select(F.explode(F.array("left", "right")).alias("name"), "n")
        covers = held if covers is None else covers.unionByName(held)
    return covers.groupBy("name").agg(F.max("n").alias("most"))


def collocations(docs: DataFrame, top: int = TOP, text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best `top` phrases of each language, as frequent_phrases() finds them.

    a is the phrase's count; the cut of the lowest score floor(SCALE * a / (l + r)) counts, the first of several. A phrase
    that lies in a longer one which has COVERED hundredths of its count is left out. Ties of score and count go by the
    phrase. Arithmetic is in whole numbers of 38 digits.
    """
    found, totals = frequent_phrases(docs, text_col, lang_col, **options)
    scored = None
    for k in range(2, len(found) + 1):
        one = found[k - 1].select("lang", "name", F.array_join("words", " ").alias("phrase"), F.get("first", F.lit(k - 1)).alias("a"), _weakest_cut(k).alias("cut"))
        if k < len(found):
            one = one.join(_covers(found, k).hint("merge"), "name", "left").where(F.col("most").isNull() | (100 * F.col("most") < COVERED * F.col("a"))).drop("most")
        one = one.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        scored = one if scored is None else scored.unionByName(one)
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language's phrases are dealt to several tasks, which leave out all but their own best
    dealt = stored(scored).withColumn("way", F.pmod(F.xxhash64("phrase"), F.lit(max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))))
    dealt = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "way").orderBy(*best))).where(F.col("rank") <= top)
    ranks = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranks.join(F.broadcast(totals) if totals.count() <= 2000 else totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
