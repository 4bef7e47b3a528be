"""Placement of entries: order, index of first placements, presence, and records across editions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.canonical import mmdd, right_stripped
from lectern.storage import ranked


def with_registry(elogia: DataFrame, ids: DataFrame) -> DataFrame:
    """Entries with the registry's flags, false where the id is unknown."""
    flags = ids.select("id", "asterisk", "unnumbered")
    return elogia.join(flags, "id", "left").withColumn("asterisk", F.coalesce("asterisk", F.lit(False))).withColumn("unnumbered", F.coalesce("unnumbered", F.lit(False)))


def registry_order(ids: DataFrame) -> DataFrame:
    """Current ids with their rank within their day: unnumbered first, null entries last, then by id."""
    w = Window.partitionBy("month", "day").orderBy(~F.col("unnumbered"), F.col("entry").asc_nulls_last(), "id")
    return ids.where("not deprecated").withColumn("rank", F.row_number().over(w))


def catalog_order(ids: DataFrame) -> DataFrame:
    """All ids with their rank by (month, day, entry with nulls last, id), over range partitions."""
    order = [F.col("month"), F.col("day"), F.col("entry").asc_nulls_last(), F.col("id")]
    return ranked(ids, order)


def edition_order(editions: DataFrame) -> DataFrame:
    """Editions with their rank by (year, id)."""
    return ranked(editions, [F.col("year"), F.col("id")])


def printed_position(elogia: DataFrame, by: list[Column]) -> DataFrame:
    return elogia.withColumn("pos", F.row_number().over(Window.partitionBy("edition", "month", "day").orderBy(*by)))


def first_placements(elogia: DataFrame) -> DataFrame:
    """One row per (edition, id): the first place it is printed, its anchor's month before the others.

    A minimum of a struct: one shuffle with partial aggregation, no sort of an id's placements.
    """
    place = F.struct((F.col("month") != F.col("anchor_month")).alias("away"), "month", "day", "pos")
    return elogia.groupBy("edition", "id").agg(F.min(place).alias("p"), F.count("*").alias("times")).select("edition", "id", "p.month", "p.day", "p.pos", "times")


def with_presence(ids: DataFrame, placements: DataFrame, edition: str) -> DataFrame:
    """The catalog with whether one edition prints each id, on which day (MM-DD) and as which entry of it."""
    one = placements.where(F.col("edition") == edition).select("id", F.col("month").alias("p_month"), F.col("day").alias("p_day"), F.col("pos").alias("p_entry"))
    return ids.join(one, "id", "left").withColumns({"present": F.col("p_month").isNotNull(), "day_printed": mmdd(F.col("p_month"), F.col("p_day"))})


def across_editions(placements: DataFrame) -> DataFrame:
    """One row per id: its editions and where they print it, as sorted text."""
    at = F.concat_ws(":", "edition", F.format_string("%02d-%02d", "month", "day"))
    return placements.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(at)), ",").alias("places"), F.count("*").alias("n_editions"))


def edition_summary(editions: DataFrame, elogia: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Editions with days and entries printed, available and aligned.

    days: (edition, unaligned), one row a day; aligned means that no day's entries are a list without ids, and is null
    where the edition has no texts. Without `days` the last two columns are left out.
    """
    stats = elogia.groupBy("edition").agg(F.count_distinct("month", "day").alias("days"), F.count("*").alias("entries"))
    out = editions.join(stats.withColumnRenamed("edition", "id"), "id", "left")
    if days is None:
        return out
    aligned = days.groupBy(F.col("edition").alias("id")).agg(F.bool_and(~F.col("unaligned")).alias("aligned"))
    return out.join(aligned, "id", "left").withColumn("available", F.col("aligned").isNotNull())


def assemble_days(elogia: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """One row per (edition, month, day): its entries in printed order; with `days`, titulus and conclusio, and empty days too."""
    entry = F.struct("pos", "id", "text")
    told = elogia.groupBy("edition", "month", "day").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    if days is None:
        return told
    none = F.array().cast(told.schema["entries"].dataType)
    return days.select("edition", "month", "day", "titulus", "conclusio").join(told, ["edition", "month", "day"], "left").withColumn("entries", F.coalesce("entries", none))


def assemble_months(day_docs: DataFrame) -> DataFrame:
    """One row per (edition, month): a map from DD to the day's content, by day."""
    content = F.struct(*[c for c in day_docs.columns if c not in ("edition", "month", "day")])
    days = F.array_sort(F.collect_list(F.struct(F.format_string("%02d", "day").alias("dd"), content.alias("content"))))
    return day_docs.groupBy("edition", "month").agg(F.map_from_entries(days).alias("days"))


def merge_collisions(elogia: DataFrame) -> DataFrame:
    """Equal ids on a day become one entry at the first position, texts joined in printed order, white space at their ends cut but for the last."""
    merged = elogia.groupBy("edition", "month", "day", "id").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("parts"))
    texts = F.transform("parts", lambda x, i: F.when(i < F.size("parts") - 1, right_stripped(x["text"])).otherwise(x["text"]))
    return merged.select("edition", "month", "day", "id", "pos", F.array_join(texts, " ").alias("text"))


def duplicate_ids(elogia: DataFrame) -> DataFrame:
    return elogia.groupBy("edition", "id").agg(F.count("*").alias("times")).where("times > 1")
