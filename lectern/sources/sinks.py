"""Sinks of an edition corpus: entries as tables and as month documents, sidecars, and scaffolds of new editions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_elogia(elogia: DataFrame, path: str) -> None:
    """The entries as Parquet, a folder for each edition and month, which a read of one of them is held to."""
    elogia.repartition("edition", "month").sortWithinPartitions("edition", "month", "day", "pos").write.mode("overwrite").partitionBy("edition", "month").parquet(path)


def _text(value: Column) -> Column:
    """A string as JSON, with its quotes."""
    return F.btrim(F.to_json(F.array(value)), F.lit("[]"))


def month_documents(elogia: DataFrame, days: DataFrame) -> DataFrame:
    """(edition, month, raw): JSON documents by day; entries in printed order, as a list where a day's have no ids.

    Written by hand of JSON strings, since the order of keys is data and a struct has fixed ones.
    """
    member = F.when(F.col("id").isNull(), _text(F.col("text"))).otherwise(F.concat(_text(F.col("id")), F.lit(": "), _text(F.col("text"))))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", member.alias("m")))), lambda x: x["m"]), ", ")
    entries = elogia.groupBy("edition", "month", "day").agg(body.alias("e"), F.bool_or(F.col("id").isNull()).alias("listed"))
    told = days.join(entries, ["edition", "month", "day"], "left")
    wrapped = F.when(F.coalesce("listed", "unaligned", F.lit(False)), F.concat(F.lit("["), F.coalesce("e", F.lit("")), F.lit("]"))).otherwise(F.concat(F.lit("{"), F.coalesce("e", F.lit("")), F.lit("}")))
    day = F.concat(F.lit('"'), F.col("day").cast("string"), F.lit('": {"titulus": '), _text(F.col("titulus")), F.lit(', "elogia": '), wrapped, F.lit(', "conclusio": '), _text(F.col("conclusio")), F.lit("}"))
    months = told.groupBy("edition", "month").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("day", day.alias("d")))), lambda x: x["d"]), ", ").alias("d"))
    return months.select("edition", "month", F.concat(F.lit("{"), "d", F.lit("}")).alias("raw"))


def write_months(documents: DataFrame, path: str) -> None:
    """Documents as text files, in one folder for each edition and month."""
    documents.select("edition", "month", F.col("raw").alias("value")).write.mode("overwrite").partitionBy("edition", "month").text(path)


def sidecars(assigned: DataFrame) -> DataFrame:
    """(edition, raw): the alignment of every edition as JSON, ids in order."""
    one = F.concat(_text(F.col("id")), F.lit(': {"method": '), _text(F.col("method")), F.lit(', "score": '), F.coalesce(F.col("score").cast("string"), F.lit("null")), F.lit("}"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", one.alias("m")))), lambda x: x["m"]), ", ")
    return assigned.groupBy("edition").agg(F.concat(F.lit('{"ids": {'), body, F.lit("}}")).alias("raw"))


def scaffold_editions(asked: DataFrame, editions: DataFrame, present: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metadata, months, errors) of editions (id, shape, note) to begin: metadata and twelve empty months each.

    An edition that isn't registered gives unknown-edition, one that has metadata already gives already-exists.
    """
    known = editions.select("id").distinct().withColumn("_known", F.lit(True))
    there = present.select(F.col("edition").alias("id")).distinct().withColumn("_there", F.lit(True))
    d = asked.join(known, "id", "left").join(there, "id", "left").withColumn("error", F.when(F.col("_known").isNull(), "unknown-edition").when(F.col("_there"), "already-exists"))
    good = d.where("error is null")
    fields = F.map_filter(F.create_map(F.lit("shape"), F.col("shape"), F.lit("note"), F.when(F.col("note") != "", F.col("note"))), lambda k, v: v.isNotNull())
    months = good.select(F.col("id").alias("edition"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"), F.lit("{}").alias("raw"))
    return good.select(F.col("id").alias("edition"), fields.alias("meta")), months, d.where("error is not null").select("id", "error")
