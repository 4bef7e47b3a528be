"""Which edition is in force: a scoped as-of lookup with fallback tiers, for many requests at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.canonical import primary_subtag
from lectern.storage import kept

#: Editions are a registry kept by hand; beyond this many series the joins aren't broadcast by hint.
MOST_BROADCAST = 20_000
EVERYWHERE = "universal"


def edition_series(editions: DataFrame) -> DataFrame:
    """(scope, class, year, best): for every scope its editions of a language, its originals, and its Latin originals, the best of each year.

    An edition lies in three series at most. Of those up to a year the newest counts, originals before translations, then
    the larger id: the greatest struct `best` of a series that isn't after the year.
    """
    trans, lang = F.col("nature") == "translatio", primary_subtag(F.col("language"))
    classes = F.array_compact(F.array(F.concat(F.lit("lang:"), lang), F.when(~trans, "original"), F.when(~trans & (lang == "la"), "latin-original")))
    told = editions.select("scope", F.explode(classes).alias("class"), "year", F.struct("year", (~trans).alias("original"), "id").alias("e"))
    return told.groupBy("scope", "class", "year").agg(F.max("e").alias("best"))


def as_of(asked: DataFrame, series: DataFrame) -> DataFrame:
    """(scope, class, year, id) of distinct asked rows (scope, class, year): the series' best up to the year, of all years without one.

    Asked years and the series' own are merged in order, so that a series is as long as the calendar at most.
    """
    at = F.coalesce(F.col("year").cast("int"), F.lit(2**31 - 1))
    none = F.lit(None).cast(series.schema["best"].dataType)
    both = series.select("scope", "class", "year", F.col("year").cast("int").alias("at"), "best", F.lit(0).alias("asked")).unionByName(
        asked.where("scope is not null and class is not null").distinct().select("scope", "class", "year", at.alias("at"), none.alias("best"), F.lit(1).alias("asked"))
    )
    upto = Window.partitionBy("scope", "class").orderBy("at", "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("best", F.max("best").over(upto)).where("asked = 1 and best is not null").select("scope", "class", "year", F.col("best.id").alias("id"))


def resolve(requests: DataFrame, editions: DataFrame, available: DataFrame) -> DataFrame:
    """`requests` with resolved_edition and resolve_error.

    requests: nation, year, locale (any may be null). editions: id, nature, language, scope, year. available: id.
    Distinct contexts are resolved once and joined back. Tiers of a context's editions, the first that is not empty
    counts (judged before the year): those of the nation, or of no nation if it has none, in the locale's language; the
    universal ones in it; the universal Latin ones. Without a locale translations are out. Where the year leaves none, a
    second look goes over the universal editions. The newest wins, originals before translations, then the larger id.

    A tier is one series of edition_series(); which two a context looks into follows from which of them are there. What
    they have up to a year is worked out once for every year asked for (as_of()), so that a context meets five rows at
    most and never the editions of a series.
    """
    keys = ["nation", "year", "locale"]
    every = edition_series(editions)
    series = every.select("scope", "class").distinct()
    few = series.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    near = lambda df: F.broadcast(df) if few else df
    ctx = requests.select(*keys).distinct().withColumn("lang", F.concat(F.lit("lang:"), primary_subtag(F.col("locale"))))
    named = lambda scope, kind, out: near(series.select(F.col("scope").alias(scope), F.col("class").alias(kind), F.lit(True).alias(out)))
    own_scope = near(editions.select(F.col("scope").alias("nation"), F.lit(True).alias("has_own")).distinct())
    d = ctx.withColumn("everywhere", F.lit(EVERYWHERE)).join(own_scope, "nation", "left")
    d = d.join(named("nation", "lang", "own_same"), ["nation", "lang"], "left").join(named("everywhere", "lang", "uni_same"), ["everywhere", "lang"], "left")
    is_true = lambda c: F.coalesce(F.col(c), F.lit(False))
    located = F.col("lang").isNotNull()
    wide = F.when(is_true("uni_same"), F.col("lang")).otherwise("lang:la")
    own = F.when(located, is_true("own_same")).otherwise(is_true("has_own"))
    d = d.select(
        *keys, F.when(own, F.col("nation")).otherwise(EVERYWHERE).alias("scope1"), F.when(~located, "original").when(own, F.col("lang")).otherwise(wide).alias("class1"),
        F.lit(EVERYWHERE).alias("scope2"), F.when(F.col("nation").isNotNull(), F.when(located, wide).otherwise("original")).when(located, "latin-original").alias("class2"),
    )
    d = kept(d)
    asked = d.select(F.col("scope1").alias("scope"), F.col("class1").alias("class"), "year").unionByName(d.where("year is not null").select(F.col("scope2").alias("scope"), F.col("class2").alias("class"), "year"))
    found = kept(as_of(asked, every).withColumn("year", F.coalesce("year", F.lit(2**31 - 1))))
    found = F.broadcast(found) if found.count() <= MOST_BROADCAST else found
    d = d.withColumn("at", F.coalesce("year", F.lit(2**31 - 1)))
    for n in (1, 2):
        d = d.join(found.toDF(f"scope{n}", f"class{n}", "at", f"id{n}"), [f"scope{n}", f"class{n}", "at"], "left")
    second = F.when(F.col("year").isNotNull(), F.col("id2"))
    won = d.select(*[F.col(k).alias(f"_{k}") for k in keys], F.coalesce("id1", second).alias("won"))

    def same(k: str) -> Column:
        return F.col(k).eqNullSafe(F.col(f"_{k}"))

    out = requests.join(won, same("nation") & same("year") & same("locale"), "left")
    out = out.join(available.select(F.col("id").alias("_av")).distinct(), F.col("won") == F.col("_av"), "left")
    error = F.when(F.col("won").isNull(), F.when(F.col("year").isNull(), "no-edition").otherwise("pre-first-edition")).when(F.col("_av").isNull(), "edition-unavailable")
    return out.select(*requests.columns, F.when(error.isNull(), F.col("won")).alias("resolved_edition"), error.alias("resolve_error"))
