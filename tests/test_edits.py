"""Edits, checks of months and the read path on small rows with known answers."""

import random

from pyspark.sql import functions as F

from lectern.operators import access, curation, edits, placement, read
from lectern.plans.bindings import bind
from lectern.streaming.edits import LOG, branch_state, log_stream

ENTRY = "edition string, month int, day int, pos int, id string, text string"
IDS = ["mr:0101-a", "mr:0101-b", "mr:0102-c", "mr:0201-d"]


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def ids(spark):
    return spark.createDataFrame([(i, int(i[3:5]), int(i[5:7])) for i in IDS], "id string, month int, day int")


def test_months_are_checked(spark):
    raw = [
        ("ok", '{"1": {"titulus": null, "elogia": {"mr:0101-a": "x", "mr:0201-d": "y"}, "conclusio": "z"}, "31": {}}'),
        ("days", '{"01": {}, "32": {}, "١": {}, "0": {}, "1": [], "2": "x"}'),
        ("keys", '{"1": {"more": 1, "titulus": 5, "conclusio": {}, "elogia": []}}'),
        ("ids", '{"1": {"elogia": {"bad": "x", "mr:0101-z": "x", "mr:0101-a": " \\t\\n", "mr:0101-b": null}}, "2": {"elogia": {"mr:0101-a": "x"}}}'),
    ]
    months = spark.createDataFrame([(e, 1, r) for e, r in raw], "edition string, month int, raw string")
    got = rows(edits.validate_days(months, ids(spark)), "edition", "day_key", "rule")
    want = [("days", k, "bad-day") for k in ("01", "32", "١", "0")] + [("days", k, "not-an-object") for k in "12"]
    want += [("keys", "1", r) for r in ("unknown-key", "bad-field", "bad-field", "bad-elogia")]
    want += [("ids", "1", r) for r in ("bad-id", "unknown-id", "empty-text", "empty-text")] + [("ids", "2", "repeated-id")]
    assert got == sorted(want, key=str)
    february = spark.createDataFrame([("e", 2, '{"29": {}, "30": {}}')], months.schema)
    assert rows(edits.validate_days(february, ids(spark)), "day_key", "rule") == [("30", "bad-day")]
    flat = spark.createDataFrame([("e", 1, i, t) for i, t in [("mr:0101-a", "x"), ("mr:0201-d", "x"), ("nope", "x"), ("mr:0101-q", "x"), ("mr:0101-b", "\n\t ")]], "edition string, month int, id string, text string")
    assert rows(curation.violations(flat, ids(spark)), "id", "rule") == [("mr:0101-b", "empty-text"), ("mr:0101-q", "unknown-id"), ("mr:0201-d", "wrong-month"), ("nope", "bad-id")]


PUBLISHED = {(1, 1): ("t", "c", [("mr:0101-a", "A"), ("mr:0101-b", "B")]), (1, 2): (None, None, [("mr:0102-c", "C"), ("mr:0201-d", "X")]), (2, 1): ("u", None, [("mr:0201-d", "D"), ("mr:0101-a", "A in February")])}
DAYS = "edition string, month int, day int, titulus string, conclusio string"


def _random_log(n, seed=0):
    """Edits of two branches and two editions; a day's edit asks for a random order, which is a permutation at times."""
    draw, log = random.Random(f"{n} {seed}"), []
    for s in range(n):
        op, i = draw.choice(["put", "put", "patch", "delete", "day"]), draw.choice(IDS)
        month = draw.randint(1, 2) if op == "day" else int(i[3:5])
        order = draw.choice([None, draw.sample(IDS, draw.randint(0, 4))]) if op == "day" else None
        flags = (draw.random() < 0.5, draw.random() < 0.5) if op == "day" else (None, None)
        log.append((f"b{draw.randint(0, 1)}", s, draw.choice("eg"), month, op, draw.randint(1, 3), i, f"t{s}", draw.choice([None, -1, 0, 1, 2, 9]), draw.choice([None, f"T{s}"]), flags[0], f"C{s}", flags[1], order))
    return log


def _plain(log):
    """The state {(branch, edition): {(month, day): [titulus, conclusio, entries]}} and {seq: error} after the log, one edit after the other."""
    state, errors = {}, {}
    for b, s, e, m, op, d, i, t, p, titulus, set_t, conclusio, set_c, order in log:
        days = state.setdefault((b, e), {k: [v[0], v[1], list(v[2])] for k, v in PUBLISHED.items()} if e == "e" else {})
        if op == "put":
            day = days.setdefault((m, d), [None, None, []])
            day[2] = [x for x in day[2] if x[0] != i]
            day[2].insert(len(day[2]) if p is None else max(0, p - 1), (i, t))
        elif op == "day":
            if (m, d) not in days:
                errors[s] = "unknown-day"
            elif order is not None and sorted(order) != sorted(x for x, _ in days[m, d][2]):
                errors[s] = "bad-order"
            else:
                day = days[m, d]
                day[0], day[1] = titulus if set_t else day[0], conclusio if set_c else day[1]
                day[2] = day[2] if order is None else [(x, dict(day[2])[x]) for x in order]
        else:
            at = min(((k[0] != m, k) for k, v in days.items() if i in dict(v[2])), default=None)
            if at is None:
                errors[s] = "unknown-eulogy"
            else:
                day = days[at[1]]
                day[2] = [(x, t if x == i else old) for x, old in day[2] if op == "patch" or x != i]
    return state, errors


def _published(spark):
    days = spark.createDataFrame([("e", *k, v[0], v[1]) for k, v in PUBLISHED.items()], DAYS)
    return days, spark.createDataFrame([("e", *k, n, *x) for k, v in PUBLISHED.items() for n, x in enumerate(v[2], 1)], ENTRY)


def _holds_state(got_days, got, got_errors, log):
    state, errors = _plain(log)
    assert rows(got_days, "branch", "edition", "month", "day", "titulus", "conclusio") == sorted(((*k, *d, v[0], v[1]) for k, days in state.items() for d, v in days.items()), key=str)
    assert rows(got, "branch", "edition", "month", "day", "pos", "id", "text") == sorted(((*k, *d, n, *x) for k, days in state.items() for d, v in days.items() for n, x in enumerate(v[2], 1)), key=str)
    assert {r["seq"]: r["error"] for r in got_errors.collect()} == errors


def test_a_log_of_all_edits(spark):
    days, elogia = _published(spark)
    for n in (1, 40, 400):
        log = _random_log(n)
        read_on = spark.createDataFrame(sorted({(x[0], x[2]) for x in log}), "branch string, edition string")
        _holds_state(*edits.apply_log(days.join(read_on, "edition"), elogia.join(read_on, "edition"), spark.createDataFrame(log, LOG).repartition(3)), log)
    assert set(_plain(log)[1].values()) == {"unknown-day", "bad-order", "unknown-eulogy"}
    out = edits.apply_log(days.join(read_on, "edition"), elogia.join(read_on, "edition"), spark.createDataFrame([], LOG))
    assert out[1].count() == 2 * elogia.count() and out[2].count() == 0


def test_a_log_over_entries_without_branches(spark):
    days, elogia = _published(spark)
    log = _random_log(200)
    read_on = spark.createDataFrame(sorted({(x[0], x[2]) for x in log}), "branch string, edition string")
    _holds_state(*edits.apply_log(days, elogia, spark.createDataFrame(log, LOG), read_on), log)


def test_bound_tables_are_not_broadcast_by_their_encoded_size(spark):
    """Parts of some megabytes in the file are hundreds as rows on the driver."""
    (ids,) = bind(spark, "/root/testdata/sf0.001", "b_ids")
    big = ids.sparkSession.range(100_000).select("id", F.col("id").cast("string").alias("text"))
    plan = ids.join(big, ids["p_partkey"] == big["id"])._jdf.queryExecution().sparkPlan().toString()
    assert ids.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold") == "1MB" and "BuildRight" not in plan


def test_a_log_as_a_stream(spark, tmp_path):
    """Two branches, a restart, generations taken away: the same as the whole log at once."""
    days, elogia = _published(spark)
    log, (source, state, mark) = _random_log(70), [f"{tmp_path}/{x}" for x in ("log", "state", "mark")]
    for k in range(7):
        spark.createDataFrame(log[10 * k : 10 * k + 10], LOG).coalesce(1).write.mode("append").parquet(source)
        if k in (3, 6):
            stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(source)
            log_stream(stream, days, elogia, state, mark, compact=2).awaitTermination()
            _holds_state(*[branch_state(spark, state, t) for t in ("days", "entries", "errors")], log[: 10 * k + 10])
    assert not [x for x in (tmp_path / "state").iterdir() if x.name in ("days-0000000001", "entries-0000000003")]


def test_puts_and_logs(spark):
    start = [("e", 1, 1, 1, "mr:0101-a", "A"), ("e", 1, 1, 2, "mr:0101-b", "B"), ("e", 1, 2, 1, "mr:0102-c", "C")]
    elogia = spark.createDataFrame(start, ENTRY)
    new = "edition string, month int, day int, id string, text string, position int"
    for at, want in ((1, "dab"), (2, "adb"), (3, "abd"), (9, "abd"), (None, "abd"), (-3, "dab")):
        got = edits.put_entries(elogia, spark.createDataFrame([("e", 1, 1, "mr:0201-d", "D", at)], new))
        assert "".join(i[-1] for _, i in rows(got.where("day = 1"), "pos", "id")) == want and got.where("day = 2").count() == 1
    moved = edits.put_entries(elogia, spark.createDataFrame([("e", 1, 1, "mr:0101-a", "A2", 2), ("e", 1, 7, "mr:0101-a", "A7", 4)], new))
    assert rows(moved, "day", "pos", "id", "text") == [(1, 1, "mr:0101-b", "B"), (1, 2, "mr:0101-a", "A2"), (2, 1, "mr:0102-c", "C"), (7, 1, "mr:0101-a", "A7")]


def test_days_months_and_metadata(spark):
    elogia = spark.createDataFrame([("e", 1, 1, 1, "x", "X"), ("e", 1, 1, 2, "y", "Y"), ("e", 1, 2, 1, "z", "Z"), ("f", 1, 1, 1, "w", "W")], ENTRY)
    days = spark.createDataFrame([("e", 1, 1, "t", "c"), ("e", 1, 2, "t", "c"), ("f", 1, 1, None, None)], "edition string, month int, day int, titulus string, conclusio string")
    asked = [("e", 1, 1, None, True, "n", False, ["y", "x"]), ("e", 1, 2, "q", True, None, True, ["z", "z"]), ("e", 1, 9, "q", True, None, False, None)]
    out, entries, errors = edits.patch_days(days, elogia, spark.createDataFrame(asked, "edition string, month int, day int, titulus string, set_titulus boolean, conclusio string, set_conclusio boolean, order array<string>"))
    assert rows(out, "edition", "day", "titulus", "conclusio") == sorted([("e", 1, None, "c"), ("e", 2, "t", "c"), ("f", 1, None, None)], key=str)
    assert rows(entries.where("edition = 'e' and day = 1"), "pos", "id") == [(1, "y"), (2, "x")] and rows(errors, "day", "error") == [(2, "bad-order"), (9, "unknown-day")]
    put = edits.put_months(elogia, spark.createDataFrame([("e", 1)], "edition string, month int"), spark.createDataFrame([("e", 1, 3, 1, "v", "V"), ("g", 1, 1, 1, "u", "U")], ENTRY))
    assert rows(put, "edition", "id") == [("e", "v"), ("f", "w")]
    meta = spark.createDataFrame([("e", {"note": "n", "shape": "flat"}), ("f", {"shape": "days"})], "edition string, meta map<string,string>")
    got = edits.patch_meta(meta, spark.createDataFrame([("e", {"note": None, "shape": "days", "more": "m"})], "edition string, fields map<string,string>"))
    assert {r["edition"]: r["meta"] for r in got.collect()} == {"e": {"shape": "days", "more": "m"}, "f": {"shape": "days"}}
    assert rows(edits.routed(meta.select("edition"), spark.createDataFrame([("f",)], "edition string")), "edition", "repository") == [("e", "public"), ("f", "private")]


def test_members_of_few_and_of_many_keys(spark):
    """A repeated key has its first place and its last value, however many keys there are."""
    from lectern.sources.registry import FEW, members

    for n in (0, 1, 3, FEW - 1, FEW, FEW + 1, 3 * FEW):
        for keys in ([f"k{n - i}" for i in range(n)], [f"k{n - i}" for i in range(n)] + ["k1", "z", "k1"]):
            raw = "{" + ",".join(f'"{k}": "v{i}"' for i, k in enumerate(keys)) + "}"
            got = spark.createDataFrame([(raw,)], "raw string").select(members(F.col("raw")).alias("m")).first()["m"]
            assert [tuple(m) for m in got] == list({k: f"v{i}" for i, k in enumerate(keys)}.items())


def test_documents_and_days_are_read_once(spark):
    """The printed lines are joined once for documents, and no more than three times where days and edits come of them too."""
    from lectern.plans import curation_queries, reading_queries

    read_ = lambda q: q(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_orderkey")
    assert read_(curation_queries.QUERIES["q_c1_u5_validate_days"]) == 1
    assert read_(curation_queries.QUERIES["q_c6_patch_days"]) <= 3
    assert read_(curation_queries.QUERIES["q_c4_c5_apply_edits"]) == 1
    assert read_(reading_queries.QUERIES["q_s5_s6_s11_documents"]) <= 2
    assert read_(reading_queries.QUERIES["q_j2_s6_flat"]) == 1


def test_an_edit_meets_the_first_place_only(spark):
    elogia = spark.createDataFrame([("e", 1, 1, 1, "i", "one", 2), ("e", 2, 3, 1, "i", "two", 2), ("e", 2, 3, 2, "j", "three", 2)], ENTRY + ", anchor_month int")
    log = spark.createDataFrame([(1, "e", "i", "patch", "no"), (2, "e", "i", "patch", "yes"), (3, "e", "j", "delete", None)], "seq long, edition string, id string, op string, text string")
    assert rows(curation.apply_edits(elogia, log), "month", "id", "text") == [(1, "i", "one"), (2, "i", "yes")]


def test_read_path(spark):
    elogia = spark.createDataFrame([("e", 1, 1, 2, "mr:0101-a", "second"), ("e", 1, 1, 1, "mr:0102-a", "first"), ("e", 1, 1, 3, None, "no id"), ("e", 1, 2, 1, "mr:0102-c", "x")], ENTRY)
    days = spark.createDataFrame([("e", 1, 1), ("e", 1, 2), ("e", 1, 3)], "edition string, month int, day int")
    asked = [(1, "e", 1, None, None), (2, "e", 1, 1, None), (3, "e", 1, 1, "a"), (4, "e", 1, 9, None), (5, "e", 1, 9, "a"), (6, "e", 1, 2, "a"), (7, "e", 5, None, None), (8, "e", 1, 3, None)]
    got = read.read_content(spark.createDataFrame(asked, "request int, edition string, month int, day int, slug string"), elogia, days)
    found = {}
    for r in got.collect():
        found.setdefault(r["request"], []).append((r["day"], r["text"], r["error"]))
    assert len(found[1]) == 5 and len(found[2]) == 3 and found[3] == [(1, "first", None)] and found[8] == [(3, None, None)] and 7 not in found
    assert [found[k][0][2] for k in (4, 5, 6)] == ["unknown-day", "unknown-day", "unknown-eulogy"]
    editions = spark.createDataFrame([("e",), ("f",)], "id string")
    said = read.resolve_explicit(spark.createDataFrame([(1, "e"), (2, "f"), (3, "g"), (4, None)], "request int, edition string"), editions, editions.where("id = 'e'"))
    assert rows(said, "request", "resolved_edition", "resolve_error") == [(1, "e", None), (2, None, "edition-unavailable"), (3, None, "unknown-edition"), (4, None, None)]


def test_records_days_and_grants(spark):
    subjects = spark.createDataFrame([("la", IDS[0], "A"), ("en", IDS[0], "a")], "locale string, id string, subject string")
    places = spark.createDataFrame([(IDS[0], "e", "01-01", 1), (IDS[0], "f", "01-02", 3)], "id string, edition string, day_printed string, entry int")
    got = {r["id"]: r for r in read.id_records(ids(spark).withColumn("deprecated", F.lit(False)), subjects, places).collect()}
    assert got[IDS[0]]["subjects"] == {"en": "a", "la": "A"} and got[IDS[0]]["editions"]["f"]["entry"] == 3 and got[IDS[3]]["editions"] == {} and got[IDS[3]]["anchor_day"] == "02-01"
    assert rows(read.with_subjects(ids(spark), subjects, "en-GB"), "id", "subject")[0] == (IDS[0], "a")
    elogia = spark.createDataFrame([("e", 1, 2, 1, "i", "t")], ENTRY)
    days = spark.createDataFrame([("e", 1, 2, "T", None), ("e", 1, 1, None, "C")], "edition string, month int, day int, titulus string, conclusio string")
    month = placement.assemble_months(placement.assemble_days(elogia, days)).first()["days"]
    assert list(month) == ["01", "02"] and month["02"]["titulus"] == "T" and month["02"]["entries"][0]["id"] == "i" and month["01"]["entries"] == []
    log = [(1, 1, "reader", "e", "grant"), (2, 1, "reader", "e", "revoke"), (3, 2, "admin", "e", "grant"), (4, None, "reader", "e", "grant"), (5, 3, "owner", "e", "grant"), (6, 4, "reader", "e", "grant")]
    grants = access.fold_grants(spark.createDataFrame(log, "seq long, user int, relation string, body string, op string"))
    assert rows(grants, "user", "relation") == [(2, "admin"), (4, "reader")] and rows(access.held(grants, "can_edit"), "user") == [(2,)] and rows(access.held(grants, "can_read_texts"), "user") == [(2,), (4,)]
    asked = spark.createDataFrame([(1, 2, 9, "reader", "e"), (2, 4, 9, "reader", "e"), (3, 2, 9, "owner", "e"), (4, 2, None, "reader", "e")], "seq int, caller int, user int, relation string, body string")
    assert rows(access.refused_grants(asked, grants), "seq", "error") == [(2, "forbidden"), (3, "unknown-relation"), (4, "invalid-payload")]


def test_entries_meet_branches_and_edited_days_in_one_join(spark):
    """Rows of no branch are laid out by their edition alone; a day goes to the branches that don't edit it, one without a number to all."""
    rows = spark.createDataFrame([("e", 1, 1, "a"), ("e", 1, 2, "b"), ("e", None, None, "c"), ("f", 1, 1, "d"), ("g", 1, 1, "x")], "edition string, month int, day int, id string")
    touched = spark.createDataFrame([("u", "e", 1, 1), ("v", "f", 1, 1), ("v", "f", None, None)], "branch string, edition string, month int, day int")
    read_on = spark.createDataFrame([("u", "e"), ("v", "e"), ("v", "f")], "branch string, edition string")
    out = edits._untouched(rows, touched, ["branch", "edition", "month", "day"], read_on)
    assert sorted((r["branch"], r["id"]) for r in out.collect()) == [("u", "b"), ("u", "c"), ("v", "a"), ("v", "b"), ("v", "c")]
    met = edits._met(rows, touched, read_on)
    assert {(r["id"], tuple(b["branch"] for b in r["_edited"] or ())) for r in met.collect()} == {("a", ("u",)), ("b", ()), ("c", ()), ("d", ("v",))}
