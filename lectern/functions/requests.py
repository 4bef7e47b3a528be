"""Batch parsing of request paths `[nation/XX|edition/ID] [YYYY] MM [DD [slug]]`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.canonical import DAYS


def parse_requests(df: DataFrame, path_col: str = "path") -> DataFrame:
    """`df` with nation, edition, year, month, day, slug and error (null, or malformed-path).

    Empty segments are dropped. All fields are null where there is an error.
    """
    seg = F.filter(F.split(F.coalesce(F.col(path_col), F.lit("")), "/"), lambda s: s != "")
    d = df.withColumn("_s", seg)
    head = F.get("_s", F.lit(0))
    scoped = head.isin("nation", "edition")
    d = d.withColumn("_kind", F.when(scoped, head)).withColumn("_name", F.when(scoped, F.get("_s", F.lit(1))))
    d = d.withColumn("_r", F.when(scoped, F.slice("_s", 3, 100)).otherwise(F.col("_s")))
    dated = F.coalesce(F.get("_r", F.lit(0)).rlike(r"\A[1-9][0-9]{3}\z"), F.lit(False))
    d = d.withColumn("_year", F.when(dated, F.get("_r", F.lit(0)).cast("int"))).withColumn("_r", F.when(dated, F.slice("_r", 2, 100)).otherwise(F.col("_r")))
    part = lambda i: F.get("_r", F.lit(i))
    month = F.when(part(0).rlike(r"\A(0[1-9]|1[0-2])\z"), part(0).cast("int"))
    day = F.when(part(1).rlike(r"\A[0-9]{2}\z"), part(1).cast("int"))
    most = F.get(F.array(*[F.lit(n) for n in DAYS]), month - 1)
    name_bad = (F.col("_kind") == "nation") & ~F.coalesce(F.col("_name").rlike(r"\A[A-Z]{2}\z"), F.lit(False)) | (F.col("_kind") == "edition") & ~F.coalesce(F.col("_name").rlike(r"\A[a-zA-Z0-9_]+\z"), F.lit(False))
    bad = (
        F.coalesce(name_bad, F.lit(False)) | month.isNull() | (F.size("_r") > 3)
        | ((F.size("_r") >= 2) & ~F.coalesce(day.between(1, most), F.lit(False)))
        | ((F.size("_r") == 3) & ~F.coalesce(part(2).rlike(r"\A[a-z0-9-]+\z"), F.lit(False)))
        | (F.col("_kind").eqNullSafe("edition") & F.col("_year").isNotNull())
    )
    d = d.withColumn("_bad", F.coalesce(bad, F.lit(True)))
    ok = lambda c: F.when(~F.col("_bad"), c)
    return d.select(
        *df.columns,
        ok(F.when(F.col("_kind") == "nation", F.col("_name"))).alias("nation"),
        ok(F.when(F.col("_kind") == "edition", F.col("_name"))).alias("edition"),
        ok(F.col("_year")).alias("year"), ok(month).alias("month"), ok(day).alias("day"), ok(part(2)).alias("slug"),
        F.when(F.col("_bad"), "malformed-path").alias("error"),
    )
