"""The read path: a resolved request joined to what its edition prints, and records of one id in all editions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.canonical import mmdd, slug_of


def resolve_explicit(requests: DataFrame, editions: DataFrame, available: DataFrame) -> DataFrame:
    """Requests that name an `edition`: it comes before resolved_edition and resolve_error, which they may have.

    An edition that isn't registered, or has no texts, gives an error. A request without one keeps what it has.
    """
    d = requests
    for c in ("resolved_edition", "resolve_error"):
        d = d if c in d.columns else d.withColumn(c, F.lit(None).cast("string"))
    known = editions.select(F.col("id").alias("edition")).distinct().withColumn("_known", F.lit(True))
    held = available.select(F.col("id").alias("edition")).distinct().withColumn("_held", F.lit(True))
    asked = F.col("edition").isNotNull()
    error = F.when(F.col("_known").isNull(), "unknown-edition").when(F.col("_held").isNull(), "edition-unavailable")
    joined = d.join(known, "edition", "left").join(held, "edition", "left").withColumn("_error", error)
    answer = F.when(asked, F.when(F.col("_error").isNull(), F.col("edition"))).otherwise(F.col("resolved_edition"))
    error = F.when(asked, F.col("_error")).otherwise(F.col("resolve_error"))
    return joined.withColumns({"resolved_edition": answer, "resolve_error": error}).drop("_known", "_held", "_error")


def read_content(requests: DataFrame, elogia: DataFrame, days: DataFrame) -> DataFrame:
    """(request, day, pos, id, text, error): what each request (request, edition, month, day, slug) finds.

    Without a day the whole month, nothing if it has no days; with one that day, or unknown-day; with a slug the first
    entry of it on that day, or unknown-eulogy. A day without entries gives one row without one. A miss is one row.
    """
    known = days.select("edition", "month", "day").distinct().withColumn("there", F.lit(True))
    whole = requests.where("day is null").select("request", "edition", "month").join(known, ["edition", "month"]).withColumn("slug", F.lit(None).cast("string"))
    dated = requests.where("day is not null").select("request", "edition", "month", "day", "slug").join(known, ["edition", "month", "day"], "left")
    asked = whole.unionByName(dated)

    # entries are read once, and meet the requests as they are laid out by day
    own = slug_of(F.col("id"))
    nth = F.row_number().over(Window.partitionBy("edition", "month", "day", own).orderBy("pos"))
    printed = elogia.select(*[F.col(c).alias(f"e_{c}") for c in ("edition", "month", "day")], "pos", "id", "text", own.alias("e_slug"), nth.alias("nth"))
    on_day = [F.col(c) == F.col(f"e_{c}") for c in ("edition", "month", "day")]
    meant = F.when(F.col("slug").isNull(), F.col("there")).otherwise((F.col("slug") == F.col("e_slug")) & (F.col("nth") == 1))
    error = F.when(F.col("there").isNull(), "unknown-day").when(F.col("slug").isNotNull() & F.col("id").isNull(), "unknown-eulogy")
    return asked.join(printed, [*on_day, meant], "left").select("request", "day", "pos", "id", "text", error.alias("error"))


def filter_editions(rows: DataFrame, wanted: Column, edition: str = "edition") -> DataFrame:
    """The rows whose edition is in a comma list; all rows where the list is null or empty."""
    return rows.where(wanted.isNull() | (wanted == "") | F.array_contains(F.split(wanted, ","), F.col(edition)))


def with_subjects(catalog: DataFrame, subjects: DataFrame, locale: str) -> DataFrame:
    """The catalog with each id's subject in one locale, told by its primary subtag; null where that has none."""
    one = subjects.where(F.col("locale") == locale.split("-")[0].lower()).select("id", "subject")
    return catalog.join(one, "id", "left")


def id_records(ids: DataFrame, subjects: DataFrame, placements: DataFrame) -> DataFrame:
    """One record an id: anchor day, deprecated, map of subjects by locale, map of placements by edition.

    placements: (id, edition) and what is told of it, one row for each pair. Ids without either have empty maps.
    """
    told = [c for c in placements.columns if c not in ("id", "edition")]
    by_edition = placements.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("edition", F.struct(*told).alias("place"))))).alias("editions"))
    by_locale = subjects.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("locale", "subject")))).alias("subjects"))
    record = ids.select("id", mmdd(F.col("month"), F.col("day")).alias("anchor_day"), "deprecated").join(by_locale, "id", "left").join(by_edition, "id", "left")
    empty = lambda c, like: F.coalesce(F.col(c), F.create_map().cast(like.schema[c].dataType)).alias(c)
    return record.select("id", "anchor_day", "deprecated", empty("subjects", by_locale), empty("editions", by_edition))
