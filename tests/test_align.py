"""Alignment and text features on small rows, against plain Python."""

import difflib
import random
import unicodedata

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import canonical as C
from lectern.operators import align, align_late

NAMES = "Concordius Basilius Gregorius Macarius Euphrosyna Telesphorus Genovefa Lucianus Raimundus Marcellinus Hyginus Theodosius".split()


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_unmarked_is_the_compatible_decomposition(spark):
    texts = ["Stanisław Žižka, Św. Józef", "ﬁne Ⅳ ½ ﬀ", "\U0001d400\U0001d41a İstanbul", "ǄǅＡ①⑴", "éß", "плаќа ёж", ""] + ["".join(map(chr, range(a, a + 256))) for a in range(0xA0, 0x2000, 256)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", C.unmarked(F.col("t")).alias("u"), C.folded(F.col("t")).alias("f"), C.fold_slug(F.col("t")).alias("s")).collect()
    for r in got:
        plain = "".join(c for c in unicodedata.normalize("NFKD", texts[r["i"]]) if not unicodedata.combining(c))
        assert r["u"] == plain, texts[r["i"]]
    assert got[0]["f"] == "stanis aw zizka  sw  iozef" and got[0]["s"] == "stanis-aw-zizka-sw-jozef"


def test_white_space_of_every_kind(spark):
    space = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
    got = spark.createDataFrame([(space + "a b" + space,), (space,)], "t string").select(C.stripped(F.col("t")).alias("s"), C.right_stripped(F.col("t")).alias("r")).collect()
    assert [(r["s"], r["r"]) for r in got] == [("a b", space + "a b"), ("", "")]


def test_names_and_lemmas(spark):
    raw = "Romae sancti Con cordii Martyris, et beatae Euphrosynae Virginis; sanctorum Juliani et Basilissae"
    one = spark.range(1).select(
        align.name_zone(F.lit(raw)).alias("zone"), C.capitalised(F.lit(raw)).alias("caps"), C.lemma_variants(F.lit("basilii")).alias("v"), C.stem_variants(F.lit("juliae-et-socii-12-macarii"), C.SLUG_STOP).alias("sv"),
        C.new_id(F.lit(1), F.lit(2), F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("id"), C.new_subject(F.array(F.lit("anna"), F.lit("maria-rosa")), F.lit("sanctarum")).alias("pair"), C.new_subject(F.array(F.lit("macarius")), F.lit("beati")).alias("one"),
    ).first()
    assert one["zone"][:2] == ["concordii", "euphrosynae"] or one["zone"][0] == "concordii"
    assert "romae" in one["caps"] and "concordii" in one["caps"] and set(one["v"]) == {"basilii", "basilius", "basilius"[:0] + "basilius"}
    assert one["sv"] == [["iulie", "iulia"], ["macari"]] and one["id"] == "mr:0102-a-et-socii" and one["pair"] == "Sanctae Anna et Maria Rosa" and one["one"] == "Beatus Macarius"


def test_stem_hits_miss_nothing(spark):
    draw = random.Random(5)
    word = lambda n: "".join(draw.choices("abcd", k=n))
    stems, tokens = sorted({word(n) for n in (4, 5, 6) for _ in range(60)}), sorted({word(n) for n in (3, 4, 5, 6, 7, 9) for _ in range(60)})
    got = {(r["stem"], r["token"]): r["hit"] for r in align.stem_hits(spark.createDataFrame([(s,) for s in stems], "stem string"), spark.createDataFrame([(t,) for t in tokens], "token string")).collect()}
    want = {}
    for s in stems:
        for t in tokens:
            if t.startswith(s):
                want[s, t] = 1.0
            elif len(t) >= 4 and difflib.SequenceMatcher(None, s, t[: len(s)]).ratio() >= 0.8:
                want[s, t] = 0.8
    assert got == want and len(want) > 50


def test_greedy_is_one_to_one_in_order(spark):
    draw = random.Random(3)
    pairs = [(a, b, draw.randint(0, 12) / 4) for a in range(30) for b in range(30) if draw.random() < 0.3]
    df = spark.createDataFrame(pairs, "a int, b int, total double").repartition(4)
    got = rows(align.greedy(df, ["a"], ["b"], [F.col("total").desc(), F.col("a").desc(), F.col("b").desc()]), "a", "b")
    left, right, want = set(), set(), []
    for a, b, _ in sorted(pairs, key=lambda p: (-p[2], -p[0], -p[1])):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            want.append((a, b))
    assert got == sorted(want)
    assert align.greedy(df.where("a < 0"), ["a"], ["b"], [F.col("total")]).count() == 0


def _book(spark):
    ids = [(f"mr:01{d:02d}-{n.lower()}", 1, d, f"Romae sancti {n[:-2]}i Episcopi et Confessoris, qui claruit miraculis {n}") for d in range(1, 5) for n in NAMES[3 * d - 3 : 3 * d]]
    entries = [("e", 1, d, i, f"Romae sancti {n[:-2]}i Episcopi et Confessoris, qui claruit miraculis {n}.") for d in range(1, 5) for i, n in enumerate(NAMES[3 * d - 3 : 3 * d])]
    moved = [("e", 1, 1, 3, entries[-1][4]), ("e", 1, 2, 3, "Octava sancti Hyginii et Theodosii.")]
    return (
        spark.createDataFrame([e for e in entries[:-1]] + moved, "edition string, month int, day int, idx int, text string"),
        spark.createDataFrame(ids, "id string, month int, day int, text string"),
    )


def test_same_day_then_cross_day(spark):
    entries, ids = _book(spark)
    assigned = align.match_same_day(entries, ids, [])
    got = {(r["day"], r["idx"]): r["id"] for r in assigned.collect()}
    assert all(got[d, i] == f"mr:01{d:02d}-{NAMES[3 * d - 3 + i].lower()}" for d in range(1, 5) for i in range(3) if (d, i) != (4, 2))
    cross = rows(align.match_cross_day(entries, ids, assigned, []), "day", "idx", "id", "method")
    assert cross == [(1, 3, "mr:0104-theodosius", "cross-day")]
    left, unclaimed = align.residuals(entries, ids, assigned)
    assert rows(left, "day", "idx") == [(1, 3), (2, 3)] and rows(unclaimed, "id") == [("mr:0104-theodosius",)]


def test_in_turn_an_id_taken_is_gone(spark):
    """Each entry sees what the ones before it have left: an id taken makes the next one's margin wide enough."""
    pairs = [(1, 0, "a", 2.0), (1, 1, "a", 2.0), (1, 1, "b", 1.9), (1, 2, "c", 1.0), (1, 2, "d", 0.9), (2, 0, "b", 1.0), (2, 0, "e", 0.9)]
    df = spark.createDataFrame([("e", 1, d, i, id_, t) for d, i, id_, t in pairs], "edition string, month int, day int, idx int, id string, total double")
    assert rows(align.match_in_turn(df, 0.3, "m"), "day", "idx", "id") == [(1, 0, "a"), (1, 1, "b"), (2, 0, "e")]


def test_overrides(spark):
    assigned = spark.createDataFrame([("e", 1, 1, 0, "x", 1.0, "same-day"), ("e", 1, 1, 1, "y", 0.5, "same-day"), ("e", 1, 1, 2, "z", 2.0, "same-day")], "edition string, month int, day int, idx int, id string, score double, method string")
    over = spark.createDataFrame([("e", 1, 1, 3, 1, "assign", "x"), ("e", 1, 1, 4, 2, "assign", "x"), ("e", 1, 1, 2, 3, "drop", None)], "edition string, month int, day int, idx int, ord int, action string, id string")
    assert rows(align.apply_overrides(assigned, over).fillna("-", ["id", "method", "action"]), "idx", "id", "method", "action") == [(1, "y", "same-day", "-"), (2, "-", "-", "drop"), (4, "x", "override", "assign")]
    assert rows(align.low_scores(assigned), "id") == [("y",)]


def test_mined_lemmas(spark):
    ids = spark.createDataFrame([("mr:0101-macarius",), ("mr:0102-macaria",), ("mr:0103-macarius-et-socii",)], "id string")
    texts = spark.createDataFrame([("mr:0101-macarius", "Sancti Macarii"), ("mr:0102-macaria", "Macarii alia"), ("mr:0103-macarius-et-socii", "ss Macarii")], "id string, text string")
    assert rows(align.mine_lemmas(ids, texts), "form", "lemma") == [("macarii", "macarius")]


def test_the_last_of_a_day_and_the_nearest(spark):
    """A day's last pair needs no shared word; an unmatched entry's nearest ids are those of all pairs."""
    entries, ids = _book(spark)
    assigned = align.match_same_day(entries, ids, [])
    got = rows(align.match_elimination(entries.where("not (day = 4 and idx > 1)"), ids.where("not (day = 4 and id like '%hyginus')"), assigned.where("day = 4 and idx < 1"), []), "day", "idx", "id")
    assert got == [(4, 1, "mr:0104-theodosius")]
    odd = spark.createDataFrame([("e", 1, 1, 9, "Zzz qqq"), ("e", 1, 2, 9, "Xxx sancti Macarii Episcopi")], entries.schema)
    forced = spark.createDataFrame([("e", 1, 1, 9, "mr:0101-basilius")], "edition string, month int, day int, idx int, id string")
    e, i = align.entry_features(entries.unionByName(odd), []), align.id_features(ids, [])
    r = align.pair_scores(forced, e, i, "caps").first()
    assert (r["s_stem"], r["jac"]) == (0.0, 0.0) and r["s_text"] == difflib.SequenceMatcher(None, "zzz qqq", "romae sancti basilii episcopi et confessoris  qui claruit miraculis basilius").ratio()
    every = entries.unionByName(odd).join(ids.select("id", "month", "day"), ["month", "day"]).select(*align.ENTRY, "id")
    scores = align.pair_scores(every, e, i, "caps")
    want = rows(align.near_misses(scores, odd), *align.ENTRY, "id", "rank")
    assert rows(align.nearest(entries.unionByName(odd), ids, odd, []), *align.ENTRY, "id", "rank") == want and len(want) == 6


def test_forced_by_words_is_forced_by_pairs(spark):
    """Counted by sets of words it is the same as with all pairs; the registered query tells the score of what it gives."""
    from lectern.plans.reading_queries import QUERIES

    draw = random.Random(5)
    word = lambda: sorted(draw.sample("abc", 2))
    entries = spark.createDataFrame([(e, 1, d, i, word()) for e in "xyz" for d in range(1, 13) for i in range(1, draw.randint(2, 5))], "edition string, month int, day int, idx int, words array<string>")
    ids = spark.createDataFrame([(f"{d}-{n}", 1, d, word()) for d in range(1, 13) for n in range(draw.randint(1, 4))], "id string, month int, day int, words array<string>")
    matched = entries.where("idx % 2 = 0").join(ids.select("month", "day", "words").distinct(), ["month", "day", "words"], "left_semi")
    pairs = matched.join(ids, ["month", "day", "words"]).select(*align.ENTRY, "id")
    # an entry without ids of its words isn't matched in either
    want = rows(align.forced_pairs(entries, ids, pairs), *align.ENTRY, "id")
    assert rows(align.forced_by_words(entries.join(matched.select(*align.ENTRY, F.lit(True).alias("m")), align.ENTRY, "left").withColumn("matched", F.col("m").isNotNull()), ids), *align.ENTRY, "id") == want and want
    got = QUERIES["q_m5_elimination"](spark, "/root/testdata/sf0.001")
    assert got.columns == [*align.ENTRY, "id", "score"] and got.count() == 89


def test_strong_pairs_miss_none(spark):
    """The rarest stems pair the same as all of them."""
    draw = random.Random(11)
    words = ["".join(draw.choices("abcde", k=6)) for _ in range(14)]
    ids = spark.createDataFrame([(f"mr:0101-{k}", draw.sample(words, draw.randint(1, 6))) for k in range(60)], "id string, stems array<string>")
    entries = spark.createDataFrame([("e", 1, 1, k, draw.sample(words, draw.randint(1, 8))) for k in range(40)], "edition string, month int, day int, idx int, zone array<string>")
    rates = lambda df: {tuple(r): s for *r, s in ((*x[:-1], round(x[-1], 9)) for x in (tuple(r) for r in df.select(*align.ENTRY, "id", "s_stem").collect())) if s >= 0.75}
    got = rates(align.strong_pairs(entries, ids, "zone", 0.75))
    assert got == rates(align.stem_scores(entries, ids, "zone", [])) and len(got) > 50


def test_labels_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(f"{k:04d}", f"{k + 1:04d}") for k in range(n)] + [("x", "y")], "a string, b string").repartition(3)
    assert {r["id"]: r["label"] for r in align.linked(edges).collect()} == {f"{k:04d}": "0000" for k in range(n + 1)} | {"x": "x", "y": "x"}


def test_names_as_nominatives(spark):
    told = {"fidei": "fides", "victoris": "victor", "magnetis": "magnes", "leonis": "leo", "titi": "titus", "iuliae": "iulia", "clementis": "clemens", "macarii": "macarius", "vi": "vi", "anna": "anna"}
    df = spark.createDataFrame([(k, "mined" if k == "anna" else None) for k in told], "t string, m string")
    got = {r["t"]: r["n"] for r in df.select("t", C.lemmatized_name(F.col("t"), F.col("m")).alias("n")).collect()}
    assert got == told | {"anna": "mined"}


def test_leading_pairs(spark):
    """Entries and ids of few signatures: the first k pairs of each entry, and a choice from as many as there are rivals, against all pairs."""
    draw = random.Random(8)
    sig = lambda: draw.sample("abcd", 2)
    entries = spark.createDataFrame([(e, 1, d, i, sig()) for e in "ef" for d in (1, 2) for i in range(1, 6)], "edition string, month int, day int, idx int, sig array<string>")
    ids = spark.createDataFrame([(f"i{k:02}", 1, draw.randint(1, 2), sig()) for k in range(30)], "id string, month int, day int, id_sig array<string>")
    every = align.word_pairs(entries, ids, ["month", "day"])
    w = Window.partitionBy(*align.ENTRY).orderBy(F.col("jac").desc(), F.col("id").desc())
    ranked = every.withColumn("rank", F.row_number().over(w))
    for k in (1, 3):
        assert rows(align.leading_pairs(entries, ids, ["month", "day"], k), *align.ENTRY, "id", "jac", "rank") == rows(ranked.where(f"rank <= {k}"), *align.ENTRY, "id", "jac", "rank")
    few = align.leading_pairs(entries, ids, ["month", "day"], rivals=["edition", "month", "day"])
    chosen = lambda df: rows(align_late.match_day(df.withColumnRenamed("jac", "total")), *align.ENTRY, "id", "score")
    assert chosen(few) == chosen(every) and few.count() < every.count()


def test_same_month_pairs_of_all_words(spark):
    entries = spark.createDataFrame([("e", 1, 1, 1, ["a", "b"]), ("e", 1, 2, 1, ["c", "b"]), ("e", 2, 1, 1, [])], "edition string, month int, day int, idx int, sig array<string>")
    ids = spark.createDataFrame([("x", 1, 1, ["b", "a"]), ("y", 1, 3, ["b", "a"]), ("z", 1, 3, ["b", "c"]), ("w", 1, 4, ["b", "a"]), ("v", 2, 2, [])], "id string, month int, day int, id_sig array<string>")
    claimed = spark.createDataFrame([("e", "w")], "edition string, id string")
    got = align.same_month_pairs(entries, ids, claimed, whole=True)
    assert rows(got, "day", "id", "cand_day", "jac") == [(1, "y", 3, 1.0), (2, "z", 3, 1.0)] == rows(align.same_month_pairs(entries, ids, claimed).where("jac = 1"), "day", "id", "cand_day", "jac")


def test_a_text_is_scored_once_a_day(spark, monkeypatch):
    """However many editions print a text on a day, its pairs are made once; each edition has its own choice."""
    made, scored = [], align.scored_pairs
    monkeypatch.setattr(align, "scored_pairs", lambda *a: made.append(scored(*a)) or made[-1])
    entries = spark.createDataFrame([(f"e{n}", 1, 1, i, "Romae sancti Macarii Confessoris.") for n in range(3) for i in (1, 2)], "edition string, month int, day int, idx int, text string")
    ids = spark.createDataFrame([("mr:0101-macarius", 1, 1, "Romae sancti Macarii Confessoris."), ("mr:0101-macariana", 1, 1, "Antiochiae sanctae Macarianae.")], "id string, month int, day int, text string")
    got = sorted((r["edition"], r["idx"], r["id"]) for r in align.match_same_day(entries, ids, []).collect())
    assert got == [(f"e{n}", i, x) for n in range(3) for i, x in ((1, "mr:0101-macariana"), (2, "mr:0101-macarius"))] and made[0].count() == 2


def test_text_leaders_are_the_best_of_all_pairs(spark):
    """Each line's first pairs without comparing all texts, against all of them compared; long texts, ties, empty ones and bounds."""
    draw = random.Random(4)
    text = lambda n: "".join(draw.choice("abcde ") for _ in range(draw.randint(0, n)))
    for longest in (12, 64, 90):
        left, right = [text(longest) for _ in range(20)] + ["", "abc"], [text(longest) for _ in range(20)] + ["", "abc"]
        most = align.most_shared(left, right)
        for i, a in enumerate(left):
            for j, b in enumerate(right):
                assert most[i, j] >= sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())
    for longest in (12, 90):
        lines = [(1, d, 10 * d + i, draw.choice("xyz"), text(longest), draw.randint(1, 5)) for d in (1, 2) for i in range(10)]
        ids = [(1, d, f"i{d}{i:02d}", draw.choice("pqr"), draw.choice([text(longest), "abc abc"])) for d in (1, 2) for i in range(30)]
        pairs = [(1, d, a, b, draw.choice([0.8, 1.2, 1.5]), draw.choice([0.0, 0.4]), draw.choice([0.0, 0.3])) for d in (1, 2) for a in "xy" for b in "pqr" if (a, b) != ("y", "q")]
        want = set()
        for _, d, line, mine, t, n in lines:
            rated = []
            for _, day, a, b, before, after, least in pairs:
                for _, e, i, theirs, other in ids:
                    s = difflib.SequenceMatcher(None, t, other).ratio() if t and other else 0.0
                    if d == day == e and a == mine and b == theirs and s >= least:
                        rated.append(((before + 1.3 * s) + after, i))
            want |= {(line, i, total, r) for r, (total, i) in enumerate(sorted(rated, reverse=True)[:n], 1)}
        got = align.text_leaders(
            spark.createDataFrame(lines, "month int, day int, line long, profile string, text string, n int").repartition(3), spark.createDataFrame(ids, "month int, day int, id string, id_profile string, id_text string"),
            spark.createDataFrame(pairs, "month int, day int, profile string, id_profile string, before double, after double, least double"), 1.3)
        assert {(r["line"], r["id"], r["total"], r["r"]) for r in got.collect()} == want


def test_same_day_pairs_go_by_profiles(spark, monkeypatch):
    """Texts and ids that share the beginning of their name are few pairs of profiles, however many they are."""
    name = lambda i: "macari" + "".join("bcdfglmnprst"[i // 12**k % 12] + "aeiou"[k] for k in range(3))
    entries = spark.createDataFrame([("e", 1, 1, i, f"Romae sancti {name(i).capitalize()} Confessoris.") for i in range(300)], "edition string, month int, day int, idx int, text string")
    ids = spark.createDataFrame([(f"mr:0101-{name(i)}", 1, 1, f"Romae beati {name(i).capitalize()} Confessoris.") for i in range(300)], "id string, month int, day int, text string")
    made, scored = [], align.scored_pairs
    monkeypatch.setattr(align, "scored_pairs", lambda *a: made.append(scored(*a)) or made[-1])
    got = align.match_same_day(entries, ids, ["romae", "confessoris"])
    assert {(r["idx"], r["id"]) for r in got.collect()} == {(i, f"mr:0101-{name(i)}") for i in range(300)} and made[0].count() == 1


def test_overrides_of_what_none_overrides(spark):
    """overridden() is apply_overrides() without looking for the overridden entries among all."""
    key = "edition string, month int, day int, idx int, "
    assigned = spark.createDataFrame([("e", 1, 1, i, f"x{i}", 1.0, "same-day") for i in range(8)], key + "id string, score double, method string")
    over = spark.createDataFrame([("e", 1, 1, 1, 1, "assign", "x5"), ("e", 1, 1, 2, 2, "drop", None), ("e", 1, 1, 3, 3, "assign", "x5")], key + "ord int, action string, id string")
    rest = assigned.join(over.select(*align.ENTRY), align.ENTRY, "left_anti")
    told = lambda df: rows(df.fillna("-", ["id", "method", "action"]), "idx", "id", "method", "action")
    assert told(align.overridden(rest, over)) == told(align.apply_overrides(assigned, over)) and len(told(align.overridden(rest, over))) == 6


def test_signatures_choose_as_entries_do(spark):
    """The choice over lines of one signature is greedy() over every entry's pairs, without a row for each."""
    draw = random.Random(6)
    told = [(e, 1, d, i, draw.sample("abc", 2)) for e in "xy" for d in (1, 11) for i in range(1, 6)]
    entries = spark.createDataFrame(told, "edition string, month int, day int, idx int, sig array<string>")
    ids = spark.createDataFrame([(f"i{d:02d}{n}", 1, d, draw.sample("abcd", 2)) for d in (1, 11) for n in range(9)], "id string, month int, day int, id_sig array<string>")
    on = ["month", "day"]
    want = align_late.match_day(align.leading_pairs(entries, ids, on, rivals=["edition", *on]).withColumnRenamed("jac", "total"))
    best = align.leading_ids(entries.select(*on, "sig").distinct(), ids, on, ids.select(*on).distinct().withColumn("_most", F.lit(5))).withColumnRenamed("jac", "total")
    lines = spark.createDataFrame([(r["month"], r["day"], r["sig"], n) for n, r in enumerate(best.select(*on, "sig").distinct().collect())], "month int, day int, sig array<string>, line long")
    numbered, pairs = entries.join(lines, [*on, "sig"]).select(*align.ENTRY, "line"), best.join(lines, [*on, "sig"]).select("line", "id", "total")
    got = align.greedy_lines(numbered, pairs, ["edition", "id"], align_late.day_order(), ["edition", *on])
    assert rows(got, *align.ENTRY, "id", "total") == rows(want.withColumnRenamed("score", "total"), *align.ENTRY, "id", "total")


def test_same_month_pairs_are_spread_over_tasks(spark):
    """Pairs of all words are made in many tasks, though the rows that make them are few bytes."""
    sides = [(f"i{n}", 1, n % 5, [f"w{n % 12}", f"v{n % 12}"]) for n in range(240)]
    ids = spark.createDataFrame(sides, "id string, month int, day int, id_sig array<string>")
    entries = ids.select(F.col("id").alias("edition"), "month", "day", F.lit(1).alias("idx"), F.col("id_sig").alias("sig"))
    got = align.same_month_pairs(entries, ids, ids.select(F.lit("").alias("edition"), "id").where("false"), whole=True)
    assert got.count() == 12 * 20 * 16 and got.select(F.spark_partition_id().alias("p")).distinct().count() > 1
