"""Text structuring: lines to days, paragraphs and entries. A text is one row, and its lines an array of it.

All functions are column expressions over arrays of lines or paragraphs: no line leaves its row before the entries are
there, so nothing is shuffled. What runs over several rows, as the last header of a day, is a DataFrame operator.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.arrays import let, places, runs
from lectern.functions.canonical import right_stripped, stripped

# Months as the Latin book's headers have them, and English months and ordinals.
MONTHS = ["Januarii", "Februarii", "Martii", "Aprilis", "Maii", "Junii", "Julii", "Augusti", "Septembris", "Octobris", "Novembris", "Decembris"]
ENGLISH_MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
UNITS = ["First", "Second", "Third", "Fourth", "Fifth", "Sixth", "Seventh", "Eighth", "Ninth"]
TEENS = ["Tenth", "Eleventh", "Twelfth", "Thirteenth", "Fourteenth", "Fifteenth", "Sixteenth", "Seventeenth", "Eighteenth", "Nineteenth"]
ORDINALS = [*UNITS, *TEENS, "Twentieth", *[f"Twenty-{u}" for u in UNITS], "Thirtieth", "Thirty-First"]
# How a day's name may be spelled in a header, what ends a day, and running heads.
DAY_HEADER = r"^\s*([0-9]{1,2})\s+(" + "|".join(MONTHS) + r")\b([^\n]*(?:Kalend|Nonas|Nonis|Idus|Idibus|Pridie)[^\n]*)"
HEADING_TAIL = r"^\s*(?:" + "|".join(MONTHS) + r")?\.?\s*[xvij]+\.?\s+[A-Ga-g]\s*$"
CONCLUSIO = r"(?s)Et alibi aliorum.{0,120}?Deo gratias\.?"
ALIBI = r"Et\s*a\s*l\s*i\s*b\s*i\b"
HEADS = ["MARTYROLOGIUM", "ROMANUM", "MARTYROLOGIUM ROMANUM"]
RUNNING_HEAD = r"""\A\s*[|:.;\-'"“”]*\s*[0-9]*\s*(?:""" + "|".join(m.upper() for m in ENGLISH_MONTHS) + r""")\s*[.,!]?\s*[0-9]*\s*[|:.;]*\s*\z"""
FINAL = r"[.!?]\z"
# A day's header as scans of the English book have it, and how they spell the months.
NOISY_HEADER = (
    r"(?m)^.{0,8}\b(?:Che|The|Cbe|Ehe|Ghe|che|he|[CGE]he)\s+(\S{2,25})"
    r"\s+(?:Dap|Day|Davy|Dav|Bay|Pap|day|Dan|Dayp|Duy|Oap)\s+of\s+(\S{3,12})"
)
MONTH_SPELLINGS = [
    "january januarp fjanuarp fanuarp", "february februarp februaty", "march warch mwarch watch ware warcd warci", "april", "may wap map mav wav", "june jume",
    "july fulp fjulp fulv julp", "august", "september septenrder", "october dctober dectober", "november movember wovmber", "december decenrber",
]
_OTHER = "\\t\\n\\x{b}\\f\\r\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{1c}-\\x{1f}"
#: White space that isn't one space: single spaces, by far the most, are left alone without a match.
SPACES = f"[{_OTHER}][ {_OTHER}]*| [ {_OTHER}]+"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _joined(parts: Column) -> Column:
    """Fragments as one text: all but the last without white space at their end."""
    return F.array_join(F.transform(parts, lambda x, i: F.when(i == F.size(parts) - 1, x).otherwise(right_stripped(x))), " ")


def merge_fragments(entries: Column) -> Column:
    """Entries of a day, each a struct (fragments, text): one continues the entry before where that lacks a final . ! or ?."""
    ended = lambda x: right_stripped(x).rlike(FINAL)
    told = let(entries, lambda e: runs(e, lambda x, i: ended(F.get(e, i - 1))))
    return F.transform(told, lambda r: F.struct(F.size(r).alias("fragments"), _joined(r).alias("text")))


def sections(lines: Column, header: Callable[[Column, Column], Column]) -> Column:
    """Lines cut at headers: an array of structs (header, lines); what lies before the first header has a null header."""
    def cut(all_lines: Column) -> Column:
        found = runs(all_lines, header)
        named = lambda r, k: (k > 0) | F.coalesce(header(F.get(r, F.lit(0)), F.lit(0)), F.lit(False))
        return F.transform(found, lambda r, k: F.when(named(r, k), F.struct(F.get(r, F.lit(0)).alias("header"), F.slice(r, F.lit(2), F.size(r)).alias("lines"))).otherwise(F.struct(F.lit(None).cast("string").alias("header"), r.alias("lines"))))

    return let(lines, cut)


def drop_footnotes(lines: Column) -> Column:
    """Lines without footnotes, which run from a line that begins with * to the next blank line, which stays."""
    def of_block(block: Column) -> Column:
        star = F.get(places(block, lambda x, i: stripped(x).startswith("*")), F.lit(0))
        return F.slice(block, F.lit(1), F.coalesce(star, F.size(block)))

    return let(lines, lambda p: F.flatten(F.transform(runs(p, lambda x, i: stripped(x) == ""), of_block)))


def clean_latin(lines: Column) -> Column:
    """Lines stripped, runs of white space as one space; page numbers, month names and the book's title go, blank lines stay."""
    plain = F.transform(lines, stripped)
    return F.transform(F.filter(plain, lambda s: ~(s.rlike(r"\A[0-9]{1,3}\z") | s.isin(MONTHS) | F.upper(s).isin(HEADS))), lambda s: F.regexp_replace(s, SPACES, " "))


def clean_english(lines: Column) -> Column:
    """Lines stripped, without footnotes, running heads, page numbers, blank lines and lines without three letters in a row."""
    plain = F.transform(drop_footnotes(lines), stripped)
    return F.filter(plain, lambda s: (s != "") & ~s.rlike(RUNNING_HEAD) & ~s.rlike(r"\A[0-9]{1,3}\z") & s.rlike("[A-Za-z]{3}"))


def join_lines(lines: Column) -> Column:
    """Lines as one text: a hyphen at a line's end goes before a lower-case letter, runs of white space become one space."""
    whole = F.regexp_replace(F.array_join(F.filter(lines, lambda s: s != ""), "\n"), r"-\n(?=\p{Ll})", "")
    return F.regexp_replace(whole, SPACES, " ")


def paragraphs(lines: Column) -> Column:
    """Paragraphs of a day's cleaned lines.

    Blank lines part them; where that gives two at most, of more than 400 characters in all, a line after a period that
    begins with a capital does. One that begins with a small letter or , ; ) continues the one before.
    """
    def of_lines(p: Column) -> Column:
        told = F.filter(F.transform(p, lambda x, i: F.struct(x.alias("t"), ((i == 0) | (F.get(p, i - 1) == "")).alias("opens"))), lambda s: s["t"] != "")

        def both(kept: Column) -> Column:
            text = lambda rs: F.transform(rs, lambda r: F.array_join(F.transform(r, lambda s: s["t"]), " "))
            blank = text(runs(kept, lambda s, i: s["opens"]))
            ends = text(runs(kept, lambda s, i: right_stripped(F.get(kept, i - 1)["t"]).endswith(".") & s["t"].rlike(r"\A\p{Lu}")))
            long = lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + F.char_length(x)) > 400
            return let(blank, lambda b: F.when((F.size(b) <= 2) & long(b), ends).otherwise(b))

        return let(told, both)

    merged = lambda b: F.transform(runs(b, lambda x, i: ~x.rlike(r"\A[\p{Ll},;)]")), lambda r: F.array_join(r, " "))
    return let(let(lines, of_lines), merged)


def cut_at_conclusio(parts: Column) -> Column:
    """Struct (entries, conclusio): entries end at the first paragraph with a conclusio; what lies before it in that stays."""
    def cut(p: Column) -> Column:
        def at_first(at: Column) -> Column:
            last = F.get(p, at)
            before = stripped(F.call_function("substring_index", last, F.regexp_extract(last, CONCLUSIO, 0), F.lit(1)))
            kept = F.concat(F.slice(p, F.lit(1), at), F.when(before == "", F.array().cast("array<string>")).otherwise(F.array(before)))
            found = F.regexp_replace(F.regexp_extract(last, CONCLUSIO, 0), SPACES, " ")
            return F.when(at.isNull(), F.struct(p.alias("entries"), F.lit(None).cast("string").alias("conclusio"))).otherwise(F.struct(kept.alias("entries"), found.alias("conclusio")))

        return let(F.get(places(p, lambda x, i: x.rlike(CONCLUSIO)), F.lit(0)), at_first)

    return let(parts, cut)


def split_conclusio(day: Column) -> Column:
    """cut_at_conclusio()'s struct, where it found none: from the last entry, if it ends with thanks, the end is split off."""
    def split(d: Column) -> Column:
        last = F.element_at(d["entries"], -1)

        def parted(begin: Column) -> Column:
            before, rest = right_stripped(F.call_function("substring_index", last, begin, F.lit(1))), F.slice(d["entries"], F.lit(1), F.size(d["entries"]) - 1)
            mine = F.concat(rest, F.when(before == "", F.array().cast("array<string>")).otherwise(F.array(before)))
            inside = (begin != "") & (F.instr(last, begin) > 1)
            ending = F.regexp_replace(F.substring(last, F.instr(last, begin), F.char_length(last)), SPACES, " ")
            return F.when(inside, F.struct(mine.alias("entries"), ending.alias("conclusio"))).otherwise(F.struct(rest.alias("entries"), last.alias("conclusio")))

        thanks = d["conclusio"].isNull() & (F.size(d["entries"]) > 0) & F.contains(F.right(last, F.lit(40)), F.lit("Deo gratias"))
        return F.when(F.coalesce(thanks, F.lit(False)), let(F.regexp_extract(last, ALIBI, 0), parted)).otherwise(d)

    return let(day, split)


def latin_header(line: Column) -> Column:
    """Struct (day, month, rest) of a day's header, else null."""
    at = lambda g: F.regexp_extract(line, DAY_HEADER, g)
    found = F.struct(at(1).cast("int").alias("day"), F.array_position(F.array(*[F.lit(m) for m in MONTHS]), at(2)).cast("int").alias("month"), at(3).alias("rest"))
    return F.when(line.rlike(DAY_HEADER), found)


def latin_days(books: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(book, month, day, titulus, entries, conclusio), one row a day, of whole texts with Latin headers.

    A heading's tail may stand on the line after the header. Where a book has a day several times, the last one counts.
    """
    cut = sections(lines_of(F.col(text_col)), lambda x, i: x.rlike(DAY_HEADER))
    each = books.select(F.col(id_col).alias("book"), F.posexplode(cut).alias("nth", "s")).where("s.header is not null").select("book", "nth", latin_header(F.col("s.header")).alias("h"), clean_latin(F.col("s.lines")).alias("lines"))
    first = F.get(places(F.col("lines"), lambda x, i: x != ""), F.lit(0))
    tail = F.when(F.get("lines", first).rlike(HEADING_TAIL), F.get("lines", first))
    body = F.when(F.col("tail").isNotNull(), F.concat(F.slice("lines", F.lit(1), first), F.slice("lines", first + 2, F.size("lines")))).otherwise(F.col("lines"))
    each = each.withColumn("tail", tail).withColumn("d", split_conclusio(cut_at_conclusio(paragraphs(body))))
    title = stripped(F.regexp_replace(F.concat(F.col("h.day").cast("string"), F.lit(" "), F.get(F.array(*[F.lit(m) for m in MONTHS]), F.col("h.month") - 1), right_stripped(F.col("h.rest")), F.coalesce(F.concat(F.lit(" "), "tail"), F.lit(""))), SPACES, " "))
    told = each.select("book", "h.month", "h.day", "nth", title.alias("titulus"), F.transform(merge_fragments(F.col("d.entries")), lambda e: e["text"]).alias("entries"), F.col("d.conclusio").alias("conclusio"))
    last = F.max_by(F.struct("titulus", "entries", "conclusio"), "nth").alias("d")
    return told.groupBy("book", "month", "day").agg(last).select("book", "month", "day", "d.*")


def cut_at_index(pages: Column) -> Column:
    """The pages before the first that opens with INDEX; all if there is none."""
    opens = lambda p, i: F.left(p, F.lit(30)).rlike(r"\A\s*\S{0,4}\s*INDEX")
    return let(pages, lambda p: F.slice(p, F.lit(1), F.coalesce(F.get(places(p, opens), F.lit(0)), F.size(p))))


def split_entries(body: Column) -> Column:
    """A day's body cut into entries at dashes before a capital, quote or bracket; each ends with a period."""
    cut = F.filter(F.split(body, r"[.,;]?\s*[—–]+\s*(?=[A-Z(“\"])", -1), lambda p: F.btrim(p, F.lit(" .—-")) != "")
    ends = lambda p: F.when(p.endswith("."), p).otherwise(F.concat(p, F.lit(".")))
    return F.transform(F.transform(cut, lambda p: F.btrim(p, F.lit(" ."))), ends)


def english_heading(day: Column, month: Column) -> Column:
    ordinal, name = F.get(F.array(*[F.lit(o) for o in ORDINALS]), day - 1), F.get(F.array(*[F.lit(m) for m in ENGLISH_MONTHS]), month - 1)
    return F.concat(F.lit("The "), ordinal, F.lit(" Day of "), name)


def month_read(word: Column) -> Column:
    """The month that a word of a header names, by its known spellings, else null."""
    told = F.create_map(*[F.lit(x) for m, found in enumerate(MONTH_SPELLINGS, 1) for w in found.split() for x in (w, m)])
    return F.try_element_at(told, F.btrim(F.lower(word), F.lit(",.")))


def english_days(books: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(book, month, day, word, titulus, entries), one row a day, of whole texts with noisy English headers.

    A header may run over a line's end. One whose month can't be read is none: it stays in the day's text. A header's day
    is its turn among those of its month; `word` is the day as it was read. A text without headers, or null, has no days.
    """
    text = F.col(text_col)

    def heads(pieces: Column) -> Column:
        words, months = (F.regexp_extract_all(text, F.lit(NOISY_HEADER), F.lit(g)) for g in (1, 2))
        return F.transform(F.regexp_extract_all(text, F.lit(NOISY_HEADER), F.lit(0)), lambda h, i: F.struct(h.alias("header"), F.get(words, i).alias("word"), month_read(F.get(months, i)).alias("month"), F.get(pieces, i + 1).alias("rest")))

    def day(run: Column) -> Column:
        first = F.get(run, F.lit(0))
        return F.struct(first["month"].alias("month"), first["word"].alias("word"), F.array_join(F.transform(run, lambda h, i: F.when(i == 0, h["rest"]).otherwise(F.concat(h["header"], h["rest"]))), "").alias("body"))

    found = let(let(F.split(text, NOISY_HEADER, -1), heads), lambda h: F.transform(runs(h, lambda x, i: x["month"].isNotNull()), day))
    turn = lambda all_, d, i: F.size(F.filter(F.slice(all_, F.lit(1), i + 1), lambda x: x["month"] == d["month"]))
    known = let(F.filter(found, lambda d: d["month"].isNotNull()), lambda ds: F.transform(ds, lambda d, i: F.struct(d["month"].alias("month"), turn(ds, d, i).alias("day"), d["word"].alias("word"), d["body"].alias("body"))))
    each = books.where(text.isNotNull()).select(F.col(id_col).alias("book"), F.explode(known).alias("d")).select("book", "d.*")
    entries = split_entries(join_lines(clean_english(lines_of(F.col("body")))))
    return each.select("book", "month", "day", "word", english_heading(F.col("day"), F.col("month")).alias("titulus"), entries.alias("entries"))


def missing_days(days: DataFrame, lengths: list[int]) -> DataFrame:
    """(book, month, day) of the days of a year, months of these lengths, that a book of `days` lacks."""
    year = F.explode(F.array(*[F.struct(F.lit(m).alias("month"), F.lit(d).alias("day")) for m, n in enumerate(lengths, 1) for d in range(1, n + 1)]))
    return days.select("book").distinct().select("book", year.alias("y")).select("book", "y.month", "y.day").join(days.select("book", "month", "day"), ["book", "month", "day"], "left_anti")


def ordinals_read(rows: DataFrame, word_col: str = "word") -> DataFrame:
    """Distinct words of `rows` with the day that each names best: (word, ordinal), the first of equally similar ones.

    A word is read with c for t at its begin and p for y, as scans have them. Similarity is difflib's, over the distinct
    words only.
    """
    lowered = [o.lower() for o in ORDINALS]

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for word in pdf["word"]:
                seen = ("t" + word.lower()[1:] if word.lower().startswith("c") else word.lower()).replace("p", "y")
                score = [difflib.SequenceMatcher(None, seen, o).ratio() for o in lowered]
                found.append(score.index(max(score)) + 1)
            yield pdf.assign(ordinal=found)

    words = rows.select(F.col(word_col).alias("word")).where("word is not null").distinct()
    return words.mapInPandas(best, "word string, ordinal int")


def ordinal_report(headers: DataFrame) -> DataFrame:
    """(book, month, day, word, ordinal) of headers (book, nth, month, word) whose word names another day than their turn.

    The day of a header is its turn among those of its month in its book.
    """
    turn = F.transform(F.array_sort(F.collect_list(F.struct("nth", "word"))), lambda x, i: F.struct((i + 1).alias("day"), x["word"].alias("word")))
    days = headers.groupBy("book", "month").agg(turn.alias("t")).select("book", "month", F.explode("t").alias("d")).select("book", "month", "d.day", "d.word")
    return days.join(ordinals_read(days), "word").where("ordinal <> day").select("book", "month", "day", "word", "ordinal")
