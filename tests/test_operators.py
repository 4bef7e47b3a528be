from pyspark.sql import functions as F

from lectern.functions import canonical as C
from lectern.functions.requests import parse_requests
from lectern.operators.resolve import resolve

EDITIONS = [
    ("old_1584", "editio_typica", "la", "universal", 1584),
    ("old_1749", "editio_typica_recognita", "la", "universal", 1749),
    ("mid_1914_en", "translatio", "en", "universal", 1914),
    ("new_2004", "editio_typica_altera", "la", "universal", 2004),
    ("new_2004_it", "editio_vernacula", "it-IT", "IT", 2004),
    ("new_2004_en", "translatio", "en", "universal", 2004),
]
HELD = ["old_1749", "mid_1914_en", "new_2004", "new_2004_it"]


def answers(spark, contexts, editions=EDITIONS, held=HELD):
    req = spark.createDataFrame([(i, *c) for i, c in enumerate(contexts)], "i int, nation string, year int, locale string")
    ed = spark.createDataFrame(editions, "id string, nature string, language string, scope string, year int")
    out = resolve(req, ed, spark.createDataFrame([(h,) for h in held], "id string"))
    return [r["resolved_edition"] or r["resolve_error"] for r in out.orderBy("i").collect()]


def test_resolver_known_answers(spark):
    got = answers(spark, [
        (None, None, None), ("IT", None, None), ("IT", None, "la"), (None, 1970, None), (None, 2004, None), (None, 1600, None),
        (None, 1500, None), ("FR", None, None), ("IT", 1970, None), (None, 1900, "en"),
    ])
    assert got == ["new_2004", "new_2004_it", "new_2004", "old_1749", "new_2004", "edition-unavailable", "pre-first-edition", "new_2004", "old_1749", "old_1749"]


def test_resolver_translations_and_scopes(spark):
    assert answers(spark, [(None, None, "en")], held=[*HELD, "new_2004_en"]) == ["new_2004_en"]
    more = [*EDITIONS, ("late_2010_en", "translatio", "en", "universal", 2010)]
    assert answers(spark, [(None, None, None), (None, None, "en")], more, [*HELD, "late_2010_en"]) == ["new_2004", "late_2010_en"]
    foreign = [*EDITIONS, ("late_2012_de", "editio_typica", "la", "DE", 2012)]
    assert answers(spark, [("IT", None, "la")], foreign, [*HELD, "late_2012_de"]) == ["new_2004"]
    assert answers(spark, [("XX", None, None)], [("t", "translatio", "en", "XX", 1900)], []) == ["no-edition"]


def test_request_paths(spark):
    good = {"01/01": (None, None, None, 1, 1, None), "nation/IT/1970/02/29/x-y": ("IT", None, 1970, 2, 29, "x-y"), "edition/old_1749//12": (None, "old_1749", None, 12, None, None)}
    bad = ["", "13", "1/1", "02/30", "nation/it/01", "nation/IT", "edition/a-b/01", "edition/mr/1970/01", "01/01/x/y", "01/01/Bad", "0999/01/01", "01/1١"]
    rows = parse_requests(spark.createDataFrame([(p,) for p in [*good, *bad]], "path string")).collect()
    for r in rows:
        if r["path"] in good:
            assert (r["nation"], r["edition"], r["year"], r["month"], r["day"], r["slug"]) == good[r["path"]] and r["error"] is None
        else:
            assert r["error"] == "malformed-path", r["path"]


def test_ids_and_text(spark):
    row = spark.range(1).select(
        C.is_canonical(F.lit("mr:0101-a\n")).alias("a"), C.anchor_month(F.lit("mr:0229-oswaldus")).alias("b"), C.slug_of(F.lit("x")).alias("c"),
        C.fold_slug(F.lit("Œdípus, Jésus!")).alias("d"), C.deaccented(F.lit("Æéß")).alias("e"), C.folded(F.lit("Jéan-æ")).alias("f"),
        C.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))).alias("g"), C.pick_locale(F.lit(None).cast("string"), F.lit("it-IT;q=1,en")).alias("h"),
    ).first()
    assert tuple(row) == (False, 2, None, "edipus-jesus", "Aeeß", "iean e", 0.5, "it-IT")
