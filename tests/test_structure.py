"""Texts structured: small books with known answers."""

import re

from pyspark.sql import functions as F

from lectern.operators import structure as S

BOOK = """front matter
 1 Januarii Kalendis Januarii. Luna
 Januarii. xij. A
Circumcisio Domini nostri, et octava
Nativitatis.

Romae sancti Almachii Martyris, qui
, jubente praefecto,\t occisus est
12
MARTYROLOGIUM

Et alibi aliorum plurimorum sanctorum Martyrum. Deo gratias. Extra
lost after
 2 Januarii Quarto Nonas Januarii.
First one.
 1 Januarii Kalendis Januarii again.
Only this counts. Et alibi sanctorum virginum et Deo gratias."""


def test_latin_days(spark):
    got = {(r["month"], r["day"]): r for r in S.latin_days(spark.createDataFrame([(1, BOOK), (2, None), (3, "no header")], "doc_id int, text string")).collect()}
    assert set(got) == {(1, 1), (1, 2)}
    assert got[1, 2]["titulus"] == "2 Januarii Quarto Nonas Januarii." and got[1, 2]["entries"] == ["First one."] and got[1, 2]["conclusio"] is None
    assert got[1, 1]["titulus"] == "1 Januarii Kalendis Januarii again." and got[1, 1]["entries"] == ["Only this counts."] and got[1, 1]["conclusio"] == "Et alibi sanctorum virginum et Deo gratias."
    first = spark.createDataFrame([(1, BOOK.rsplit("\n", 2)[0])], "doc_id int, text string")
    one = [r for r in S.latin_days(first).collect() if r["day"] == 1][0]
    assert one["titulus"] == "1 Januarii Kalendis Januarii. Luna Januarii. xij. A"
    assert one["entries"] == ["Circumcisio Domini nostri, et octava Nativitatis.", "Romae sancti Almachii Martyris, qui , jubente praefecto, occisus est"]
    assert one["conclusio"] == "Et alibi aliorum plurimorum sanctorum Martyrum. Deo gratias."


def of(spark, column, lines):
    return spark.createDataFrame([(lines,)], "lines array<string>").select(column(F.col("lines")).alias("x")).first()["x"]


def test_lines(spark):
    assert of(spark, S.drop_footnotes, ["a", "\xa0* note", "more", "\t", "b"]) == ["a", "\t", "b"]
    assert of(spark, S.clean_english, [" JANUARY 12 ", "* note", "on", "", "the text", "12", "ab", " kept too "]) == ["the text", "kept too"]
    assert of(spark, S.join_lines, ["one hyphen-", "ated", "Anglo-", "Saxon", "two\t  spaces"]) == "one hyphenated Anglo- Saxon two spaces"
    assert of(spark, S.merge_fragments, ["ends here.\t", "goes on", "to here!", "last"]) == [(1, "ends here.\t"), (2, "goes on to here!"), (1, "last")]
    assert of(spark, S.cut_at_index, ["p1", "x INDEX of names", "p3"]) == ["p1"] and of(spark, S.cut_at_index, ["p1"]) == ["p1"]
    assert of(spark, lambda c: S.split_entries(c[0]), ["At Rome, St. A.— At Lyons, B —and so on. — . – “C said"]) == ["At Rome, St. A.", "At Lyons, B —and so on. —.", "“C said."]
    long = ["A" * 150 + ".", "B" * 150, "c" * 150 + ".", "Dd."]
    assert of(spark, S.paragraphs, long) == [long[0], long[1] + " " + long[2], "Dd."]
    assert of(spark, S.paragraphs, ["Aa.", "Bb.", "", "cc.", "", "Dd"]) == ["Aa. Bb. cc.", "Dd"] and of(spark, S.paragraphs, []) == []


def test_ordinals(spark):
    rows = [(1, 1, 1, "First"), (1, 2, 1, "Cwentp-Second"), (1, 3, 1, "Chird"), (1, 4, 2, "Eirst"), (2, 9, 1, "Second")]
    got = S.ordinal_report(spark.createDataFrame(rows, "book int, nth int, month int, word string")).collect()
    assert sorted((r["book"], r["day"], r["ordinal"]) for r in got) == [(1, 2, 22), (2, 1, 2)]
    assert spark.range(1).select(S.english_heading(F.lit(31), F.lit(12)).alias("h")).first()["h"] == "The Thirty-First Day of December"


def test_english_days_of_noisy_headers(spark):
    """Against a plain reading of the same text: headers over a line's end, months misread or unreadable, days in turn."""
    book = (
        "front matter\nThe First Day of Januarp.\nAt Rome, Saint A.— In Spain, Saint\nB, mar-\ntyr — \n* note\nmore note\n\n12\nJANUARY 3\nSaint C\n"
        "Che Second\nDap of fjanuarp, Octave of X.\nThe Fourth Day of Whatever in the text.—Also D.\nxx The Twenty-First Day of map\nSaint E, bishop.\nThe Fifth Day of Jume:\nnothing\nEhe Third Dav of JANUARY\n..\n"
    )
    months = {w: m for m, found in enumerate(S.MONTH_SPELLINGS, 1) for w in found.split()}
    matches = [m for m in re.finditer(S.NOISY_HEADER, book) if m.group(2).lower().strip(",.") in months]
    seen, want = {}, {}
    for i, m in enumerate(matches):
        month = months[m.group(2).lower().strip(",.")]
        seen[month] = seen.get(month, 0) + 1
        want[month, seen[month]] = (m.group(1), book[m.end() : matches[i + 1].start() if i + 1 < len(matches) else len(book)])
    days = S.english_days(spark.createDataFrame([(1, book), (2, None), (3, "no header"), (4, "")], "doc_id int, text string"))
    got = {(r["month"], r["day"]): r for r in days.collect()}
    assert set(got) == set(want) == {(1, 1), (1, 2), (1, 3), (5, 1)} and {k: r["word"] for k, r in got.items()} == {k: w for k, (w, _) in want.items()}
    assert got[1, 1]["entries"] == ["At Rome, Saint A.", "In Spain, Saint B, martyr.", "Saint C."] or got[1, 1]["entries"][:2] == ["At Rome, Saint A.", "In Spain, Saint B, martyr — Saint C."]
    assert got[1, 2]["titulus"] == "The Second Day of January" and any("Whatever" in e for e in got[1, 2]["entries"]) and got[5, 1]["entries"][0].startswith("Saint E, bishop")
    lacking = S.missing_days(days, [3, 0, 0, 0, 2]).collect()
    assert [(r["book"], r["month"], r["day"]) for r in lacking] == [(1, 5, 2)]
