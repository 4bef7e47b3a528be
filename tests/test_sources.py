"""Readers and the edit stream on small files with known answers."""

import hashlib
import json

import pytest

from lectern.operators import curation
from lectern.sources import registry as R
from lectern.sources import sinks


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(data if isinstance(data, str) else json.dumps(data, ensure_ascii=False))
    return str(path)


@pytest.fixture(scope="module")
def ids(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("ids")
    current = [
        {"id": "mr:0101-maria", "month": 1, "day": 1, "entry": 1, "unnumbered": True}, {"id": "mr:0101-basilius", "month": 1, "day": 1, "entry": 2, "asterisk": True},
        {"id": "mr:0102-argeus", "month": 1, "day": 2, "entry": 2, "country": "TR"}, {"id": "mr:0102-concordius", "month": 1, "day": 2, "entry": None}, {"id": "mr:0201-old", "month": 2, "day": 1, "entry": 1},
    ]
    old = [{"id": "mr:0201-old", "month": 2, "day": 1, "entry": 1, "attested_in": "e1749"}]
    return R.read_ids(spark, put(root / "ids.json", {"entries": current}), put(root / "deprecated.json", old))


def test_ids(ids):
    got = {r["id"]: r for r in ids.collect()}
    assert len(got) == 5 and got["mr:0201-old"]["deprecated"] and got["mr:0201-old"]["attested_in"] == "e1749"
    assert got["mr:0101-basilius"]["asterisk"] and got["mr:0102-argeus"]["asterisk"] is False and got["mr:0102-argeus"]["country"] == "TR"


def test_editions_and_subjects(spark, tmp_path):
    path = put(tmp_path / "editions.json", {"entries": [{"id": "a", "book": "mr", "promulgated": 1749}, {"id": "b", "book": "mr", "promulgated": "1914-05-01"}, {"id": "c", "book": "other", "promulgated": "1570"}]})
    assert {(r["id"], r["year"]) for r in R.read_editions(spark, path, "mr").collect()} == {("a", 1749), ("b", 1914)}
    put(tmp_path / "i18n/la.json", '{"x": "prima", "y": "Æ", "x": "ultima"}')
    put(tmp_path / "i18n/en.json", {})
    assert {tuple(r) for r in R.read_subjects(spark, str(tmp_path / "i18n")).collect()} == {("la", "x", "ultima"), ("la", "y", "Æ")}


def test_months(spark, tmp_path, ids):
    first, second = tmp_path / "private", tmp_path / "public"
    put(first / "e2004/01.json", {})
    put(first / "e2004/02.json", {"mr:0201-old": "gone"})
    put(first / "flat/01.json", {"mr:0102-concordius": "C", "mr:0101-basilius": "B", "mr:0101-maria": "M", "mr:0102-argeus": "A", "mr:0109-unknown": "U"})
    put(second / "flat/01.json", {"mr:0101-maria": "hidden by the first base"})
    put(second / "e1749/01.json", '{"2": {"titulus": "T", "elogia": {"mr:0102-z": "z", "mr:0102-a": "a"}, "conclusio": null}, "1": {"elogia": {}}}')
    put(second / "e1914/01.json", {"1": {"elogia": ["one", "two"]}})
    put(second / "e1914/notes.json", {"1": {}})
    months = R.read_month_files(spark, [str(first), str(second)])
    assert {tuple(r) for r in R.edition_shapes(months).collect()} == {("e2004", "flat"), ("flat", "flat"), ("e1749", "days"), ("e1914", "days")}
    days = R.parse_days(months)
    assert {(r["edition"], r["day"], r["titulus"], r["unaligned"]) for r in days.collect()} == {("e1749", 2, "T", False), ("e1749", 1, None, False), ("e1914", 1, None, True)}
    assert sorted((r["edition"], r["day"], r["pos"], r["id"], r["text"]) for r in R.parse_elogia(days).where("id is not null").collect()) == [("e1749", 2, 1, "mr:0102-z", "z"), ("e1749", 2, 2, "mr:0102-a", "a")]
    assert sorted((r["pos"], r["text"]) for r in R.parse_elogia(days).where("id is null").collect()) == [(1, "one"), (2, "two")]
    flat = sorted((r["edition"], r["day"], r["pos"], r["text"]) for r in R.parse_flat(months, ids).collect())
    assert flat == [("flat", 1, 1, "M"), ("flat", 1, 2, "B"), ("flat", 2, 1, "A"), ("flat", 2, 2, "C")]


def test_conflicts(spark):
    elogia = spark.createDataFrame([("e", 1, 2, 1, "i", "t")], "edition string, month int, day int, pos int, id string, text string")
    edits = spark.createDataFrame([(1, "e", 1, "x"), (2, "e", 1, None), (3, "f", 1, "x")], "seq long, edition string, month int, expected_hash string")
    found = {r["seq"]: r["current_hash"] for r in curation.conflicts(edits, elogia).collect()}
    assert set(found) == {1, 3} and found[3] is None
    good = spark.createDataFrame([(1, "e", 1, found[1])], edits.schema)
    assert curation.conflicts(good, elogia).count() == 0


def test_every_edit_has_a_state(spark):
    elogia = spark.createDataFrame([("e", 1, 2, 1, "i", "t"), ("e", 1, 2, 2, "j", "u")], "edition string, month int, day int, pos int, id string, text string")
    true = hashlib.sha256(b"02-0001\ni\nt\n02-0002\nj\nu").hexdigest()
    edits = spark.createDataFrame([(1, "e", 1, "x"), (2, "e", 1, None), (3, "f", 1, "x"), (4, "e", 1, true), (5, "f", 1, None)], "seq long, edition string, month int, expected_hash string")
    got = {r["seq"]: (r["state"], r["current_hash"]) for r in curation.check_expected(edits, elogia).collect()}
    assert got == {1: ("conflict", true), 2: ("ok", true), 3: ("conflict", None), 4: ("ok", true), 5: ("ok", None)}


def test_side_sources(spark, tmp_path):
    over = {"assignments": {"1-2-0": "MERGE_PREV", "1-2-1": "mr:0102-x", "2-29-13": {"coin": "novus", "subject_la": "Novus"}, "1-3-0": "DROP", "1-3-1": "CONCLUSIO"}}
    got = [tuple(r) for r in R.read_overrides(spark, put(tmp_path / "overrides.json", over)).orderBy("ord").collect()]
    assert got[:3] == [(1, 2, 0, 0, "merge", None, None, None), (1, 2, 1, 1, "assign", "mr:0102-x", None, None), (2, 29, 13, 2, "coin", None, "novus", "Novus")] and [g[4] for g in got[3:]] == ["drop", "conclusio"]
    put(tmp_path / "eds/a/alignment.json", {"ids": {"x": {"method": "same-day", "score": 1.5}, "y": {"method": "override", "score": None}}})
    put(tmp_path / "eds/a/errata.json", [{"id": "x", "source": "s", "correction": "c"}])
    put(tmp_path / "eds/b/errata.json", {"errata": [{"id": "y", "note": "n"}]})
    assert {tuple(r) for r in R.read_alignment(spark, str(tmp_path / "eds")).collect()} == {("a", "x", "same-day", 1.5), ("a", "y", "override", None)}
    assert {tuple(r) for r in R.read_errata(spark, str(tmp_path / "eds")).collect()} == {("a", "x", "s", "c", None), ("b", "y", None, None, "n")}
    put(tmp_path / "pages/book/2.txt", "two\nlines")
    put(tmp_path / "pages/book/10.txt", "ten")
    put(tmp_path / "pages/book/index.txt", "no page")
    assert {tuple(r) for r in R.read_page_text(spark, str(tmp_path / "pages")).collect()} == {("book", 2, "two\nlines"), ("book", 10, "ten")}
    want = {(p, hashlib.sha256((tmp_path / "pages" / p).read_bytes()).hexdigest()) for p in ("book/2.txt", "book/10.txt", "book/index.txt")}
    assert {tuple(r) for r in R.hash_tree(spark, str(tmp_path / "pages")).collect()} == want


def test_repeated_ids_keep_the_last(spark, tmp_path):
    path = put(tmp_path / "ids.json", {"entries": [{"id": "a", "day": 1}, {"id": "b", "day": 2}, {"id": "a", "day": 3}]})
    assert {(r["id"], r["day"]) for r in R.read_ids(spark, path).collect()} == {("a", 3), ("b", 2)}


def test_manifests(spark, tmp_path):
    good = {"bundle_format": 1, "api_version": "1", "api_commit": "c", "data": {"texts": "a", "ids": "b", "editions": "c", "more": "d"}, "python_requires": "3", "files": {"f": "h"}}
    for name, m in (("good", good), ("future", good | {"bundle_format": 2}), ("part", good | {"data": {"texts": "a"}}), ("lacks", {k: v for k, v in good.items() if k != "files"}), ("bad", "{no json")):
        put(tmp_path / f"m/{name}.json", m)
    got = {r["file"]: (r["usable"], r["reason"]) for r in R.read_manifests(spark, str(tmp_path / "m")).collect()}
    assert got == {"good.json": (True, None), "future.json": (False, "unknown-format"), "part.json": (False, "missing-repository"), "lacks.json": (False, "incomplete"), "bad.json": (False, "malformed")}


def test_shapes_and_scaffolds(spark, tmp_path):
    put(tmp_path / "a/edition.json", {"shape": "flat", "note": "n"})
    put(tmp_path / "b/edition.json", {"shape": "round"})
    put(tmp_path / "a/01.json", {"1": {}})
    put(tmp_path / "b/01.json", {"mr:0101-x": "t"})
    put(tmp_path / "c/02.json", {"mr:0101-x": "t"})
    meta, months = R.read_edition_meta(spark, [str(tmp_path)]), R.read_month_files(spark, [str(tmp_path)])
    assert {tuple(r) for r in R.shapes_by_precedence(meta, months).collect()} == {("a", "flat"), ("b", "flat"), ("c", "days")}
    asked = spark.createDataFrame([("a", "flat", None), ("d", "days", "n"), ("x", "days", None)], "id string, shape string, note string")
    new, empty, errors = sinks.scaffold_editions(asked, spark.createDataFrame([("a",), ("d",)], "id string"), meta)
    assert {tuple(r) for r in errors.collect()} == {("a", "already-exists"), ("x", "unknown-edition")}
    assert new.first()["meta"] == {"shape": "days", "note": "n"} and empty.count() == 12


def test_months_round_trip(spark, tmp_path):
    elogia = spark.createDataFrame([("e", 1, 2, 1, "mr:0102-z", 'say "z"\n'), ("e", 1, 2, 2, "mr:0102-a", "a\\\\"), ("f", 3, 1, 1, None, "é"), ("f", 3, 1, 2, None, "two")], "edition string, month int, day int, pos int, id string, text string")
    days = spark.createDataFrame([("e", 1, 2, "T", None, False), ("e", 1, 10, None, "C", False), ("f", 3, 1, None, None, True)], "edition string, month int, day int, titulus string, conclusio string, unaligned boolean")
    documents = sinks.month_documents(elogia, days)
    back = R.parse_days(documents)
    assert sorted(map(tuple, R.parse_elogia(back).collect()), key=str) == sorted(map(tuple, elogia.collect()), key=str)
    assert {(r["day"], r["titulus"], r["conclusio"]) for r in back.where("edition = 'e'").collect()} == {(2, "T", None), (10, None, "C")}
    assert {tuple(r) for r in R.edition_alignment(back).collect()} == {("e", True), ("f", False)}
    for r in documents.collect():
        assert list(json.loads(r["raw"])) == (["2", "10"] if r["edition"] == "e" else ["1"])
    sinks.write_elogia(elogia, str(tmp_path / "elogia"))
    assert spark.read.parquet(str(tmp_path / "elogia")).count() == 4
    sinks.write_months(documents, str(tmp_path / "months"))
    assert spark.read.text(str(tmp_path / "months"), wholetext=True).count() == 2
    side = sinks.sidecars(spark.createDataFrame([("e", "b", "same-day", 1.5), ("e", "a", "override", None)], "edition string, id string, method string, score double")).first()
    assert json.loads(side["raw"]) == {"ids": {"a": {"method": "override", "score": None}, "b": {"method": "same-day", "score": 1.5}}}
