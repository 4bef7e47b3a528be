"""Line deduplication: hashes range-partitioned with a secondary sort, first occurrences streamed, bitmaps returned.

No text is shuffled to find the repeats: a line is its 128-bit hash, its document and its position. The hashes are
range-partitioned and sorted by (hash, document, position); a running first value over each hash's rows tells every
occurrence whether an earlier document holds the line. A line that very many documents share is dealt to many ranges by
a second key drawn from the document; each range drops all but its own first document, and a second, much smaller round
over what is left finds the first document of all. What comes back is one sparse keep bitmap a document, 64 lines a
word, of only the words in which a line goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import let, own_columns, renamed, text_of

MIN_CHARS = 10


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def trimmed(line: Column) -> Column:
    """The line without white space at both ends."""
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def folded(line: Column) -> Column:
    """A string that two lines share exactly if they are equal with A-Z lower-cased.

    lower() does it for ASCII. Elsewhere each byte of the line's UTF-8 is read as one Latin-1 character before: lower()
    then leaves accented letters alone. It moves some lead bytes, but none onto one with as many bytes to follow, so
    that different lines stay different.
    """
    bytewise = F.lower(F.decode(line.cast("binary"), "ISO-8859-1"))
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(line)).otherwise(bytewise)


def line_bitmaps(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_chars: int = MIN_CHARS, ways: int | None = None) -> DataFrame:
    """(id, th, words): for each text that loses lines, its id, its text's hash, and its sparse keep bitmap.

    words is an array of (word, keep): bit j of `keep` is set if line 64 * word + j stays; a word that isn't listed
    keeps all its lines. A line goes if its key has at least `min_chars` code points and an earlier id (null ids last)
    holds it too. Rows that share an id count as one document. ways: over how many ranges one line's documents may be
    dealt; by default as many as there are shuffle partitions.
    """
    spark = docs.sparkSession
    ways = ways or max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    # hashed and split before the lines are laid out: else the text would be hashed again for every line
    split = text.select("id", F.xxhash64("text").alias("th"), _lines(F.col("text")).alias("lines"))
    lines = split.select("id", "th", F.posexplode("lines").alias("pos", "line")).select("id", "th", "pos", trimmed(F.col("line")).alias("line"))
    key = folded(F.col("line"))
    keyed = lines.where(F.char_length("line") >= min_chars).select(
        F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"), "id", "th", "pos", F.pmod(F.xxhash64("id"), F.lit(ways)).cast("int").alias("way")
    )

    def firsts(rows: DataFrame, on: list[str]) -> DataFrame:
        """Each row with whether it is in the first document of its group, in the order of a stream over the sorted rows."""
        stream = Window.partitionBy(*on).orderBy(F.col("id").asc_nulls_last(), "th", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.withColumn("stays", F.first("id").over(stream).eqNullSafe(F.col("id")))

    dealt = keyed.repartitionByRange("h1", "way").sortWithinPartitions("h1", "h2", "way", F.col("id").asc_nulls_last(), "th", "pos")
    here = firsts(dealt, ["h1", "h2", "way"])
    there = firsts(here.where("stays").drop("stays", "way"), ["h1", "h2"])
    gone = here.where(~F.col("stays")).select("id", "th", "pos").unionByName(there.where(~F.col("stays")).select("id", "th", "pos"))
    word = F.floor(F.col("pos") / 64).cast("int")
    bits = gone.groupBy("id", "th", word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % 64)).alias("gone"))
    return bits.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("keep")))).alias("words"))


def _kept(lines: Column, words: Column) -> Column:
    """The lines whose bit is set. The sparse words are laid out once, by the gaps between them, so that a line is one look-up."""
    gap = lambda w, i: w["word"] - F.coalesce(F.get(words, i - 1)["word"], F.lit(-1)) - 1
    dense = F.flatten(F.transform(words, lambda w, i: F.concat(F.array_repeat(F.lit(-1).cast("long"), gap(w, i)), F.array(w["keep"]))))
    stays = lambda word, i: F.coalesce(F.getbit(word, i % 64) == 1, F.lit(True))
    kept = let(dense, lambda d: F.filter(lines, lambda line, i: stays(F.get(d, F.floor(i / 64).cast("int")), i)))
    return F.when(words.isNull(), lines).otherwise(kept)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, text_col: str = "text", id_col: str = "doc_id", before: str = "lines", after: str = "kept_lines") -> DataFrame:
    """`docs` with two more columns of lines, `before` and `after` the bitmaps are applied; both names must be free.

    A null or empty text is one empty line. A row finds its bitmap by its id and its text's hash: repeated rows have the
    same one, and a row without one keeps all lines.
    """
    own, mark, words = renamed(docs, "_id", "_th", "_words")
    found = bitmaps.select(F.col("id").alias(own), F.col("th").alias(mark), F.col("words").alias(words))
    text = text_of(text_col)
    both = docs.join(found, F.col(id_col).eqNullSafe(F.col(own)) & (F.xxhash64(text) == F.col(mark)), "left")
    split = both.select(*own_columns(docs), F.col(words), _lines(text).alias(before))
    return split.withColumn(after, _kept(F.col(before), F.col(words))).drop(words)


def dedup_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """`docs` with the text column replaced by the lines that stay, joined by line feeds; other columns as they are.

    A null or empty text is one empty line, which stays. Repeated rows lose the same lines. An empty table stays empty.
    """
    before, after = renamed(docs, "_before", "_after")
    kept = apply_bitmaps(docs, line_bitmaps(docs, text_col, id_col, **options), text_col, id_col, before, after)
    return kept.withColumn(text_col, F.array_join(after, "\n")).select(*own_columns(docs))


def line_report(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 (of the kept lines joined by line feeds), for every row.

    A null or empty text has one empty line. Repeated rows give repeated results; an empty table gives none. A very long
    text is hashed once, and its lines are rows of their own until its bitmap comes back.
    """
    only = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kept = apply_bitmaps(only, line_bitmaps(only, **options))
    return kept.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept_lines")).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("kept_lines", "\n"), 256).alias("kept_sha256"),
    )
