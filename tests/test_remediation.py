"""Coining, remediation and gates on small rows with known answers and plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import remediation as R
from lectern.operators.read import read_content
from lectern.plans import remediation_queries
from lectern.sources import publishing as P

ENTRY = "edition string, month int, day int, idx int"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_coined_as_in_order(spark, seed):
    """Slugs that look like another's numbers or places, and ids that are there, against one entry after the other."""
    draw = random.Random(seed)
    entries = [("e", 1, draw.randint(1, 2), i, draw.choice(["a", "a", "a", "a-2", "a-b", "a-b-2", "b"]), draw.choice([None, "b", "2", "c"])) for i in range(40)]
    existing = [f"mr:010{d}-{s}" for d in (1, 2) for s in draw.sample(["a", "a-2", "a-3", "a-5", "a-02", "a-b", "b-loco", "zz"], 4)]
    used, want = set(existing), {}
    for e in sorted(entries):
        base, place, n = f"mr:010{e[2]}-{e[4]}", e[5] or "loco", 2
        own = base if base not in used else f"{base}-{place}"
        while own in used:
            own, n = f"{base}-{n}", n + 1
        used.add(own)
        want[e[:4]] = own
    got = R.coined(spark.createDataFrame(entries, ENTRY + ", slug string, place string").repartition(3), spark.createDataFrame([(x,) for x in existing], "id string"))
    assert {tuple(r)[:4]: r["id"] for r in got.collect()} == want and len(set(want.values())) == 40


def test_decisions_and_what_follows(spark):
    names = "macarius basilius leo felix".split()
    ids = spark.createDataFrame([("mr:0101-macarius-et-socii", 1, 1, names[:3]), ("mr:0102-leo", 1, 2, ["leo", "felix", "maximu"]), ("mr:0505-quintus", 5, 5, ["quintu", "sextus"]), ("mr:0606-far", 6, 6, ["petrus", "paulus"]), ("mr:0707-near", 7, 7, ["petrus", "paulus", "linus"])], "id string, month int, day int, names array<string>")
    ids = ids.withColumn("names", R.name_stems(F.col("names")))
    old = [
        ("mr:0101-martyres-1", 1, 1, names[:3], "sanctorum"), ("mr:0102-martyres-2", 1, 2, ["leo", "felix"], "sanctorum"), ("mr:0303-martyres-3", 3, 3, ["petrus", "paulus"], "beatorum"), ("mr:0404-martyres-4", 4, 4, [], None),
        ("mr:0404-martyres-5", 4, 4, ["agatha"], "sanctae"), ("mr:0505-martyres-6", 5, 5, ["x"], "sancti"), ("mr:0808-martyres-7", 8, 8, ["petrus", "paulus"], "sanctorum"),
    ]
    dep = spark.createDataFrame([("e", i, m, d, "Sancti Martyres", p, k) for i, m, d, p, k in old], "edition string, id string, month int, day int, subject string, persons array<string>, marker string")
    printed = spark.createDataFrame([("e", m, d, n, i, f"{i} ") for n, (i, m, d, *_) in enumerate(old, 1)] + [("e", 1, 2, 9, "mr:0102-leo", "old leo"), ("e", 4, 4, 9, "mr:0404-agatha", "last")], "edition string, month int, day int, pos int, id string, text string")
    special = spark.createDataFrame([("mr:0505-martyres-6", "MATCH", "mr:0505-quintus", None)], "id string, kind string, new_id string, subject string")
    decided = R.decide(dep, ids, printed, special, spark.createDataFrame([("mr:0808-martyres-7",)], "id string"))
    got = {r["id"][-1]: (r["kind"], r["new_id"], r["subject"], r["method"]) for r in decided.collect()}
    assert got == {
        "1": ("MATCH-slug", "mr:0101-macarius-et-socii", None, "same-day"), "2": ("RESLUG", "mr:0102-leo-et-felix", "Sancti Leo et Felix", None), "3": ("MATCH-cross", "mr:0606-far", None, "cross-day"),
        "4": ("ANON", "mr:0404-martyres-4", "Sancti Martyres", None), "5": ("RESLUG", "mr:0404-agatha", "Sancta Agatha", None), "6": ("MATCH-slug", "mr:0505-quintus", None, "same-day"), "7": ("RESLUG", "mr:0808-petrus-et-paulus", "Sancti Petrus et Paulus", None),
    }
    sidecar = spark.createDataFrame([("e", "mr:0404-martyres-5", "coined-deprecated", 1.5), ("e", "mr:0102-leo", "same-day", 2.0), ("e", "mr:0101-martyres-1", "coined-deprecated", None)], "edition string, id string, method string, score double")
    entries, left, side = R.apply_decisions(printed, dep.drop("persons", "marker"), sidecar, decided)
    assert rows(entries.where("month = 4 and day = 4"), "pos", "id", "text") == [(4, "mr:0404-martyres-4", "mr:0404-martyres-4 "), (5, "mr:0404-agatha", "mr:0404-martyres-5 last")] and entries.count() == printed.count() - 1
    assert rows(left, "id", "subject") == [("mr:0102-leo-et-felix", "Sancti Leo et Felix"), ("mr:0404-agatha", "Sancta Agatha"), ("mr:0404-martyres-4", "Sancti Martyres"), ("mr:0808-petrus-et-paulus", "Sancti Petrus et Paulus")]
    assert {r["id"]: (r["method"], r["score"] and round(r["score"], 6)) for r in side.collect()} == {
        "mr:0102-leo": ("same-day", 2.0), "mr:0404-agatha": ("coined-deprecated", 1.5), "mr:0101-macarius-et-socii": ("same-day", None), "mr:0102-leo-et-felix": ("coined-deprecated", None), "mr:0606-far": ("cross-day", 3.0),
        "mr:0505-quintus": ("same-day", None), "mr:0808-petrus-et-paulus": ("coined-deprecated", None),
    }
    twice = decided.where("id like '%-7'").unionByName(decided.where("id like '%-7'").withColumn("id", F.lit("other")))
    assert rows(R.collisions(twice, ids.unionByName(ids.limit(1).withColumn("id", F.lit("mr:0808-petrus-et-paulus"))), dep), "rule") == [("reslug-is-current",), ("reslug-twice",)]
    assert dict(rows(R.outcome_counts(decided), "outcome", "n"))["RESLUG"] == 3


@pytest.mark.parametrize("name", ["q_m10_decisions", "q_m11_sidecar"])
def test_no_broadcast_by_estimate(spark, name):
    """Names and ids made of an encoded file are many times its size: what is broadcast is told by rows that were shuffled."""
    planned = remediation_queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "Join" in planned and "Broadcast" not in planned


def test_names_of_an_id(spark):
    df = spark.createDataFrame([(["macarius", "leo"], "basilii", "basilius"), (["leo"], "martyres", "martyres"), ([], "12345", "12345")], "p array<string>, lead string, lemma string")
    got = [r["n"] for r in df.select(R.id_names(F.col("p"), F.col("lead"), F.col("lemma"), ["martyres"]).alias("n")).collect()]
    assert got == [["basili", "leo", "macari"], ["leo"], []]


def test_gates_and_reads_take_entries_once(spark):
    read = spark.sparkContext.accumulator(0)

    def told(row):
        read.add(1)
        return row

    counted = lambda rows, schema: spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(told), schema)
    entries, given, made = ([("e", 1, 1, k, i) for k, i in x] for x in ([(1, None), (2, "old"), (3, None)], [(1, "a"), (1, "b")], [(2, "a"), (2, "a")]))
    found = P.alignment_violations(*[counted(x, ENTRY + ", id string") for x in (entries, given, made)], spark.createDataFrame([("a",)], "id string"))
    assert rows(found, "rule", "idx", "id") == sorted([
        ("aligned-input", 2, "old"), ("unmatched", 3, None), *[("given-twice", k, i) for k, i in ((1, "a"), (1, "b"), (2, "a"))], *[("coined-exists", 2, "a")] * 2, *[("coined-twice", 2, "a")] * 2,
    ], key=str)
    assert read.value == 7
    read.value = 0
    printed = counted([("e", 1, 1, 1, "mr:0101-a", "x"), ("e", 1, 1, 2, "mr:0101-a", "y"), ("e", 1, 2, 1, None, "z")], "edition string, month int, day int, pos int, id string, text string")
    days = spark.createDataFrame([("e", 1, 1), ("e", 1, 2), ("e", 1, 3)], "edition string, month int, day int")
    asked = spark.createDataFrame([(1, "e", 1, None, None), (2, "e", 1, 1, "a"), (3, "e", 1, 2, "a"), (4, "e", 1, 9, None), (5, "e", 1, 3, None)], "request int, edition string, month int, day int, slug string")
    got = rows(read_content(asked, printed, days), "request", "day", "pos", "text", "error")
    assert got == sorted([(1, 1, 1, "x", None), (1, 1, 2, "y", None), (1, 2, 1, "z", None), (1, 3, None, None, None), (2, 1, 1, "x", None), (3, 2, None, None, "unknown-eulogy"), (4, 9, None, None, "unknown-day"), (5, 3, None, None, None)], key=str)
    assert read.value == 3


def test_gates(spark, tmp_path):
    """What breaks a rule is written but never published; what is published is read until the next one is."""
    path = str(tmp_path / "book")
    entries = spark.createDataFrame([("e", 1, 1, k, None) for k in range(3)], ENTRY + ", id string")
    given = lambda *ids: spark.createDataFrame([("e", 1, 1, k, i) for k, i in ids], ENTRY + ", id string")
    there = spark.createDataFrame([("x",), ("y",)], "id string")

    def attempt(assigned, coined, older=None):
        audit = lambda t: P.alignment_violations(entries, t["assigned"], t["coined"], there, older)
        return rows(P.publish({"assigned": assigned, "coined": coined}, path, audit), "rule", "idx", "id")

    with pytest.raises(LookupError):
        P.published(spark, path, "assigned")
    assert attempt(given((0, "x"), (1, "x")), given((2, "y"))) == [("coined-exists", 2, "y"), ("given-twice", 0, "x"), ("given-twice", 1, "x")]
    with pytest.raises(LookupError):
        P.published(spark, path, "assigned")
    assert attempt(given((0, "x")), given((1, "n"), (2, "m"))) == [] and rows(P.published(spark, path, "coined"), "id") == [("m",), ("n",)]
    assert attempt(given((0, "x")), given((1, "n"))) == [("unmatched", 2, None)] and P.published(spark, path, "coined").count() == 2
    assert attempt(given((0, "x"), (1, "y")), given((2, "k")), given((0, None))) == [("unaligned-older", 0, None)]
    assert attempt(given((0, "x"), (1, "y")), given((2, "k"))) == [] and rows(P.published(spark, path, "coined"), "id") == [("k",)]
    aligned = P.alignment_violations(given((0, "z")), given((0, "x")), given(), there)
    assert rows(aligned, "rule") == [("aligned-input",)]


def test_name_matches_of_copies(spark):
    """Ids of equal names by the hundred, some of them printed, in two editions: the same as a plain loop, and no row for every pair."""
    draw = random.Random(4)
    pool = [sorted(draw.sample("abcdefgh", n)) for n in (1, 2, 2, 3, 3, 4, 5, 6)]
    ids = [(f"i{k:03}", draw.randint(1, 2), 1, draw.choice(pool)) for k in range(120)] + [("one", 1, 1, list("mnopq")), ("two", 2, 1, list("uvwxy")), ("own", 1, 1, list("rstz"))]
    entries = [(e, f"o{e}{k:03}", draw.randint(1, 2), 1, draw.choice([*pool, list("mnop"), list("uvwx"), list("uvw")])) for e in "ef" for k in range(40)] + [("e", "own", 1, 1, list("rstz"))]
    printed = [(e, draw.randint(1, 2), 1, draw.choice(ids[:120])[0]) for e in "ef" for _ in range(60)] + [("e", 1, 1, "own"), ("f", 1, 1, "one"), ("f", 2, 1, "i000")]
    printed += [(e, m, d, i) for e in "e" for i, m, d, n in ids[:120] if n == pool[6]][1:]
    want = set()
    for e, old, m, d, names in entries:
        def best(free, scope):
            told = sorted(((s + s / len(set(names) | set(n)), s / len(set(names) | set(n)), s, i) for i, n, s in free), reverse=True)
            return [(e, old, told[0][3], scope, told[0][2])] if told and (len(told) == 1 or told[0][0] - told[1][0] >= 0.3) else []
        met = [(i, m2, d2, n, len(set(names) & set(n))) for i, m2, d2, n in ids if len(set(names) & set(n)) >= 2]
        same = best([(i, n, s) for i, m2, d2, n, s in met if (m2, d2) == (m, d) and (i == old or (e, m, d, i) not in printed)], "same")
        want |= set(same or best([(i, n, s) for i, m2, d2, n, s in met if s / len(set(names) | set(n)) >= 0.66 and i not in {p[3] for p in printed if p[0] == e}], "cross"))
    got = R.name_matches(spark.createDataFrame(entries, "edition string, old string, month int, day int, names array<string>"), spark.createDataFrame(ids, "id string, month int, day int, names array<string>"), spark.createDataFrame(printed, "edition string, month int, day int, id string"))
    assert {(r["edition"], r["old"], r["id"], r["scope"], r["shared"]) for r in got.collect()} == want and {w[3] for w in want} == {"same", "cross"}


def test_sets_of_names_are_paired_once(spark):
    """A hundred ids of one set are two rows for all entries of that set."""
    ids = spark.createDataFrame([(f"i{k:03}", ["a", "b", "c"]) for k in range(100)], "id string, names array<string>")
    free = R._best_free(ids, spark.createDataFrame([("e", "i099"), ("e", "i097")], "edition string, id string"), ["names"]).collect()
    assert [(r["first"], r["others"]) for r in free] == [(["i099", "i098"], {"e": ["i098", "i096"]})]
    sets = spark.createDataFrame([(["a", "b", "c"],), (["a", "x"],)], "names array<string>")
    assert [(r["names"], r["theirs"], r["shared"]) for r in R._alike(sets, ids.select("names").distinct(), []).collect()] == [(["a", "b", "c"], ["a", "b", "c"], 3)]
