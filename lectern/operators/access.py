"""Grants folded from a log, and texts masked for readers without one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RELATIONS = ["admin", "editor", "reader"]


def fold_grants(log: DataFrame) -> DataFrame:
    """The grants that stand: of each (user, relation, body) the last event by seq counts, of equal ones a revoke.

    Unknown relations, and users or bodies that are null or empty, are left out.
    """
    sound = log.where(F.col("relation").isin(RELATIONS) & (F.length(F.col("user").cast("string")) > 0) & (F.length(F.col("body").cast("string")) > 0))
    last = sound.groupBy("user", "relation", "body").agg(F.max_by("op", F.struct("seq", "op")).alias("op"))
    return last.where("op = 'grant'").drop("op")


def held(grants: DataFrame, right: str) -> DataFrame:
    """(user, edition) of those who hold a right: texts are read by every relation, edits made by editors and admins."""
    may = {"can_read_texts": RELATIONS, "can_edit": ["admin", "editor"], "can_admin": ["admin"]}[right]
    return grants.where(F.col("relation").isin(may)).select("user", F.col("body").alias("edition")).distinct()


def may_edit(rows: DataFrame, grants: DataFrame, roles: DataFrame, wanted: tuple[str, ...] = ("admin", "editor")) -> DataFrame:
    """Rows (user, edition, ...) of users that have one of the roles and may edit the edition."""
    gate = roles.where(F.col("role").isin(*wanted)).select("user").distinct()
    return rows.join(gate, "user", "left_semi").join(held(grants, "can_edit"), ["user", "edition"], "left_semi")


def refused_grants(asked: DataFrame, grants: DataFrame) -> DataFrame:
    """(seq, error) of grant edits (seq, caller, user, relation, body) that may not be made; the first error counts."""
    admins = held(grants, "can_admin").select(F.col("user").alias("caller"), F.col("edition").alias("body"), F.lit(True).alias("_admin"))
    d = asked.join(admins, ["caller", "body"], "left")
    sound = lambda c: F.coalesce(F.length(F.col(c).cast("string")) > 0, F.lit(False))
    error = F.when(~sound("user") | ~sound("body"), "invalid-payload").when(~F.coalesce(F.col("relation").isin(RELATIONS), F.lit(False)), "unknown-relation").when(F.col("_admin").isNull(), "forbidden")
    return d.select("seq", error.alias("error")).where("error is not null")


def mask_texts(rows: DataFrame, restricted: DataFrame, grants: DataFrame) -> DataFrame:
    """Rows (user, edition, text, ...) with text null where the edition is restricted and the user may not read its texts."""
    readers = held(grants, "can_read_texts").withColumn("_held", F.lit(True))
    closed = restricted.select("edition").distinct().withColumn("_closed", F.lit(True))
    joined = rows.join(closed, "edition", "left").join(readers, ["user", "edition"], "left")
    masked = F.col("_closed").isNotNull() & F.col("_held").isNull()
    return joined.withColumn("text", F.when(~masked, F.col("text"))).withColumn("access", F.when(masked, "masked").when(F.col("_closed"), "granted").otherwise("public")).drop("_held", "_closed")
