"""Edits applied to editions: checks, overlays of drafts, and a log of edits folded into the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.canonical import is_canonical, stripped


def overlay(published: DataFrame, draft: DataFrame, draft_months: DataFrame) -> DataFrame:
    """The draft's rows, and the published ones of the months (edition, month) that the draft lacks."""
    kept = published.join(draft_months.select("edition", "month").distinct(), ["edition", "month"], "left_anti")
    return kept.select(*published.columns).unionByName(draft.select(*published.columns))


def violations(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(edition, month, id, rule), one row per broken rule of rows (edition, month, id, text).

    bad-id: not canonical, else unknown-id: not registered, else wrong-month: anchored to another; empty-text: no text,
    or white space of any kind only.
    """
    known = ids.select("id", F.col("month").alias("anchor")).withColumn("known", F.lit(True))
    joined = texts.join(known, "id", "left")
    rules = F.array_compact(F.array(
        F.when(~is_canonical(F.col("id")), "bad-id").when(F.col("known").isNull(), "unknown-id").when(F.col("anchor") != F.col("month"), "wrong-month"),
        F.when(F.coalesce(stripped(F.col("text")), F.lit("")) == "", "empty-text"),
    ))
    return joined.select("edition", "month", "id", F.explode(rules).alias("rule"))


def fold_edits(edits: DataFrame) -> DataFrame:
    """The last edit by seq of each (branch if there is one, edition, id): one row with op, text and seq."""
    key = [c for c in ("branch", "edition", "id") if c in edits.columns]
    last = F.max(F.struct("seq", "op", "text")).alias("e")
    return edits.groupBy(*key).agg(last).select(*key, "e.op", "e.text", "e.seq")


def apply_edits(elogia: DataFrame, edits: DataFrame) -> DataFrame:
    """Entries (edition, month, day, pos, id, text, anchor_month) with each id's last edit applied at its first placement.

    delete takes that entry out, any other op sets its text. Other placements of the id stay as they are.
    """
    last = fold_edits(edits).select("edition", "id", "op", F.col("text").alias("_text"))
    place = Window.partitionBy("edition", "id").orderBy(F.col("month") != F.col("anchor_month"), "month", "day", "pos")
    # entries and edits are dealt by edition and id once, for the join and for the first place
    joined = elogia.withColumn("_nth", F.row_number().over(place)).join(last, ["edition", "id"], "left")
    meets = F.col("op").isNotNull() & (F.col("_nth") == 1)
    return joined.where(~meets | (F.col("op") != "delete")).withColumn("text", F.when(meets, F.col("_text")).otherwise(F.col("text"))).select(*elogia.columns)


def month_hashes(elogia: DataFrame) -> DataFrame:
    """(edition, month, current_hash): sha256 of the month's entries in order."""
    entry = F.concat_ws("\n", F.format_string("%02d-%04d", "day", "pos"), "id", "text")
    return elogia.groupBy("edition", "month").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), "\n"), 256).alias("current_hash"))


def check_expected(edits: DataFrame, elogia: DataFrame) -> DataFrame:
    """(seq, edition, month, current_hash, state) of every edit (seq, edition, month, expected_hash).

    state is conflict where an expected hash isn't the month's, else ok: the edit applies.
    """
    wrong = F.col("expected_hash").isNotNull() & ~F.col("expected_hash").eqNullSafe(F.col("current_hash"))
    return edits.join(month_hashes(elogia), ["edition", "month"], "left").select("seq", "edition", "month", "current_hash", F.when(wrong, "conflict").otherwise("ok").alias("state"))


def conflicts(edits: DataFrame, elogia: DataFrame) -> DataFrame:
    """(seq, edition, month, current_hash) of edits (seq, edition, month, expected_hash) whose hash isn't the month's."""
    return check_expected(edits, elogia).where("state = 'conflict'").drop("state")


def is_permutation(order: str, ids: str):
    """Whether two arrays hold the same elements, each as often."""
    return F.array_sort(order) == F.array_sort(ids)


def with_margin(pairs: DataFrame, key: list[str], score: str, ties: list[str], gap: float) -> DataFrame:
    """Of each key's pairs the best, if it leads the second by `gap` or is alone; ties go to the larger of `ties`."""
    w = Window.partitionBy(*key).orderBy(F.col(score).desc(), *[F.col(t).desc() for t in ties])
    ranked = pairs.withColumn("_n", F.row_number().over(w)).withColumn("_next", F.lead(score).over(w))
    return ranked.where((F.col("_n") == 1) & (F.col("_next").isNull() | (F.col(score) - F.col("_next") >= gap))).drop("_n", "_next")


def diff_manifest(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, state): missing, extra or changed files, of two tables (path, sha256)."""
    r, a = recorded.select("path", F.col("sha256").alias("r")), actual.select("path", F.col("sha256").alias("a"))
    state = F.when(F.col("a").isNull(), "missing").when(F.col("r").isNull(), "extra").when(F.col("r") != F.col("a"), "changed")
    return r.join(a, "path", "full").select("path", state.alias("state")).where("state is not null")


def dangling_links(editions: DataFrame, links: list[str]) -> DataFrame:
    """(id, field, value): links of editions to ids that aren't registered, and dates of promulgation without a year in front."""
    told = editions.select("id", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in links])).alias("l")).select("id", "l.*").where("value is not null")
    lost = told.join(editions.select(F.col("id").alias("value")).distinct(), "value", "left_anti").select("id", "field", "value")
    undated = editions.where(~F.col("promulgated").rlike(r"\A[0-9]{4}")).select("id", F.lit("promulgated").alias("field"), F.col("promulgated").alias("value"))
    return lost.unionByName(undated)
