"""Sources of an edition corpus: registries, subjects and month files in JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.arrays import let, runs

ID = "id string, month int, day int, entry int, asterisk boolean, country string, unnumbered boolean"
DEPRECATED = "id string, month int, day int, entry int, country string, attested_in string"
EDITION = "id string, book string, nature string, language string, scope string, promulgated string, decree string, predecessor string, successor string, translation_of string, note string"
#: So many members of a JSON object are held against one another.
FEW = 64
MONTH_FILE = r"([^/]+)/(0[1-9]|1[0-2])\.json$"


def _entries(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    schema = T.StructType().add("entries", T.ArrayType(T.StructType.fromDDL(ddl)))
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("entries").alias("e")).select("e.*")


def _last(rows: DataFrame) -> DataFrame:
    """The last row of each id, in the order of the file; a JSON document is read by one task, which numbers its rows."""
    whole = F.struct(*rows.columns)
    return rows.withColumn("_n", F.monotonically_increasing_id()).groupBy(F.col("id").alias("_id")).agg(F.max_by(whole, "_n").alias("r")).select("r.*")


def read_ids(spark: SparkSession, current: str, deprecated: str | None = None) -> DataFrame:
    """The id registry, one row an id, the last where it is repeated. A deprecated id takes the place of a current one; missing flags are false."""
    ids = _last(_entries(spark, current, ID)).withColumns({"deprecated": F.lit(False), "attested_in": F.lit(None).cast("string")})
    if deprecated:
        old = _last(spark.read.schema(DEPRECATED).json(deprecated, multiLine=True))
        old = old.withColumns({"asterisk": F.lit(False), "unnumbered": F.lit(False), "deprecated": F.lit(True)})
        ids = ids.join(old.select("id"), "id", "left_anti").unionByName(old)
    return ids.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("asterisk", "unnumbered")})


def read_editions(spark: SparkSession, path: str, book: str) -> DataFrame:
    """The editions of one book, with the year of their promulgation."""
    found = _entries(spark, path, EDITION).where(F.col("book") == book)
    return found.withColumn("year", F.substring("promulgated", 1, 4).try_cast("int"))


def members(raw: Column) -> Column:
    """(key, raw value) of a JSON object in its order; a repeated key has its first place and its last value."""
    def once(s: Column) -> Column:
        same = runs(s, lambda x, i: x["key"] != F.get(s, i - 1)["key"])
        told = F.transform(same, lambda r: F.struct(F.get(r, F.lit(0))["at"].alias("at"), F.get(r, F.lit(0))["key"].alias("key"), F.element_at(r, -1)["value"].alias("value")))
        return F.transform(F.array_sort(told), lambda m: F.struct(m["key"].alias("key"), m["value"].alias("value")))

    def told(m: Column) -> Column:
        # few keys that all differ stay as they are; to tell so of many takes longer than to sort them
        plain = F.when(F.size(m) <= FEW, F.size(F.array_distinct(F.transform(m, lambda e: e["key"]))) == F.size(m)).otherwise(False)
        placed = F.array_sort(F.transform(m, lambda e, i: F.struct(e["key"].alias("key"), i.alias("at"), e["value"].alias("value"))))
        return F.when(plain, m).otherwise(let(placed, once))

    return let(F.map_entries(F.from_json(raw, "map<string,string>")), told)


def read_subjects(spark: SparkSession, path: str) -> DataFrame:
    """(locale, id, subject) of one file a locale, named by it."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("locale"), "value")
    return files.select("locale", F.explode(members(F.col("value"))).alias("m")).select("locale", F.col("m.key").alias("id"), F.col("m.value").alias("subject"))


def read_month_files(spark: SparkSession, bases: list[str]) -> DataFrame:
    """(edition, month, raw) of every month file; of several bases that hold an edition the first one counts."""
    found = None
    for rank, base in enumerate(bases):
        files = spark.read.text(f"{base.rstrip('/')}/*/[01][0-9].json", wholetext=True)
        path = F.col("_metadata.file_path")
        one = files.select(F.regexp_extract(path, MONTH_FILE, 1).alias("edition"), F.regexp_extract(path, MONTH_FILE, 2).try_cast("int").alias("month"), F.col("value").alias("raw"), F.lit(rank).alias("rank")).where("month is not null")
        found = one if found is None else found.unionByName(one)
    best = F.min("rank").over(Window.partitionBy("edition"))
    return found.withColumn("best", best).where("rank = best").drop("rank", "best")


def edition_shapes(months: DataFrame) -> DataFrame:
    """(edition, shape): flat or days, by the first key of the first month that isn't empty; days where all are."""
    first = F.get(F.json_object_keys("raw"), F.lit(0))
    shapes = months.withColumn("key", first).groupBy("edition").agg(F.min_by("key", F.when(F.col("key").isNotNull(), F.col("month"))).alias("key"))
    return shapes.select("edition", F.when(F.col("key").startswith("mr:"), "flat").otherwise("days").alias("shape"))


def _of_shape(months: DataFrame, shape: str) -> DataFrame:
    """The month files of the editions of a shape, as edition_shapes() tells it. Documents are read once."""
    key = F.get(F.json_object_keys("raw"), F.lit(0))
    first = F.min_by("_key", F.when(F.col("_key").isNotNull(), F.col("month"))).over(Window.partitionBy("edition"))
    told = months.where("edition is not null").withColumn("_key", key).withColumn("_first", first)
    return told.where(F.when(F.col("_first").startswith("mr:"), "flat").otherwise("days") == shape).drop("_key", "_first")


def parse_days(months: DataFrame) -> DataFrame:
    """(edition, month, day, titulus, conclusio, unaligned, elogia) of the month files laid out by day."""
    day = _of_shape(months, "days").select("edition", "month", F.explode(members(F.col("raw"))).alias("m")).select("edition", "month", F.col("m.key").try_cast("int").alias("day"), F.from_json("m.value", "titulus string, elogia string, conclusio string").alias("d"))
    return day.select("edition", "month", "day", "d.titulus", "d.conclusio", F.col("d.elogia").startswith("[").alias("unaligned"), "d.elogia")


def parse_elogia(days: DataFrame) -> DataFrame:
    """(edition, month, day, pos, id, text): the entries of parse_days() in printed order, without ids where they are a list."""
    listed = F.transform(F.from_json("elogia", "array<string>"), lambda t: F.struct(F.lit(None).cast("string").alias("key"), t.alias("value")))
    entries = F.when(F.col("unaligned"), listed).otherwise(members(F.col("elogia")))
    return days.select("edition", "month", "day", F.posexplode(entries).alias("p", "e")).select("edition", "month", "day", (F.col("p") + 1).alias("pos"), F.col("e.key").alias("id"), F.col("e.value").alias("text"))


def parse_flat(months: DataFrame, ids: DataFrame) -> DataFrame:
    """(edition, month, day, pos, id, text) of the flat month files: current ids of that month, in the registry's order."""
    texts = _of_shape(months, "flat").select("edition", "month", F.explode(members(F.col("raw"))).alias("m")).select("edition", "month", F.col("m.key").alias("id"), F.col("m.value").alias("text"))
    placed = texts.join(ids.where("not deprecated").select("id", "month", "day", "entry", "unnumbered"), ["id", "month"])
    order = Window.partitionBy("edition", "month", "day").orderBy(~F.col("unnumbered"), F.col("entry").asc_nulls_last(), "id")
    return placed.select("edition", "month", "day", F.row_number().over(order).alias("pos"), "id", "text")


def edition_alignment(days: DataFrame) -> DataFrame:
    """(edition, aligned): whether no day of parse_days() has its entries as a list without ids."""
    return days.groupBy("edition").agg(F.bool_and(~F.coalesce("unaligned", F.lit(False))).alias("aligned"))


def read_edition_meta(spark: SparkSession, bases: list[str]) -> DataFrame:
    """(edition, shape, note) of the editions' own metadata files; of several bases the first one counts."""
    found = None
    for rank, base in enumerate(bases):
        files = spark.read.text(f"{base.rstrip('/')}/*/edition.json", wholetext=True)
        meta = F.from_json("value", "shape string, note string")
        one = files.select(F.regexp_extract("_metadata.file_path", r"([^/]+)/edition\.json$", 1).alias("edition"), F.struct(F.lit(-rank).alias("r"), meta.alias("m")).alias("e"))
        found = one if found is None else found.unionByName(one)
    return found.groupBy("edition").agg(F.max_by("e", "e.r").alias("e")).select("edition", "e.m.shape", "e.m.note")


def shapes_by_precedence(meta: DataFrame, months: DataFrame) -> DataFrame:
    """(edition, shape): what the metadata says if that is a shape, else the January file's, else by day."""
    january = edition_shapes(months.where("month = 1")).withColumnRenamed("shape", "january")
    said = meta.select("edition", F.when(F.col("shape").isin("day-structured", "days"), "days").when(F.col("shape") == "flat", "flat").alias("said"))
    every = meta.select("edition").unionByName(months.select("edition")).distinct()
    return every.join(said, "edition", "left").join(january, "edition", "left").select("edition", F.coalesce("said", "january", F.lit("days")).alias("shape"))


def read_page_text(spark: SparkSession, path: str) -> DataFrame:
    """(book, page, text), one row a file `book/page.txt`, the page its number."""
    files = spark.read.text(f"{path.rstrip('/')}/*/*.txt", wholetext=True)
    at = lambda g: F.regexp_extract("_metadata.file_path", r"([^/]+)/([0-9]+)\.txt$", g)
    return files.select(at(1).alias("book"), at(2).try_cast("int").alias("page"), F.col("value").alias("text")).where("page is not null")


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """(month, day, idx, ord, action, id, slug, subject_la): a tagged union, in the order of the file.

    A value is MERGE_PREV, CONCLUSIO or DROP, an id to assign, or an object with an id to coin.
    """
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "assignments string").alias("v")).select(F.posexplode(members(F.col("v.assignments"))).alias("ord", "m"))
    value, at = F.col("m.value"), F.split("m.key", "-")
    coined = value.startswith("{")
    action = F.when(coined, "coin").when(value == "MERGE_PREV", "merge").when(value == "CONCLUSIO", "conclusio").when(value == "DROP", "drop").otherwise("assign")
    number = lambda i: F.get(at, F.lit(i)).try_cast("int")
    return raw.select(
        number(0).alias("month"), number(1).alias("day"), number(2).alias("idx"), "ord", action.alias("action"), F.when(action == "assign", value).alias("id"),
        F.when(coined, F.get_json_object(value, "$.coin")).alias("slug"), F.when(coined, F.get_json_object(value, "$.subject_la")).alias("subject_la"),
    )


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """(edition, id, method, score) of the sidecars of several editions, `edition/alignment.json`."""
    files = spark.read.text(f"{path.rstrip('/')}/*/alignment.json", wholetext=True)
    each = files.select(F.regexp_extract("_metadata.file_path", r"([^/]+)/alignment\.json$", 1).alias("edition"), F.explode(members(F.from_json("value", "ids string")["ids"])).alias("m"))
    return each.select("edition", F.col("m.key").alias("id"), F.from_json("m.value", "method string, score double").alias("v")).select("edition", "id", "v.*")


def read_errata(spark: SparkSession, path: str) -> DataFrame:
    """(edition, id, source, correction, note) of the errata of several editions, `edition/errata.json`, a list or a list under `errata`."""
    schema = "array<struct<id:string,source:string,correction:string,note:string>>"
    files = spark.read.text(f"{path.rstrip('/')}/*/errata.json", wholetext=True)
    listed = F.when(F.trim("value").startswith("["), F.from_json("value", schema)).otherwise(F.from_json("value", f"struct<errata:{schema}>")["errata"])
    return files.select(F.regexp_extract("_metadata.file_path", r"([^/]+)/errata\.json$", 1).alias("edition"), F.explode(listed).alias("e")).select("edition", "e.*")


def hash_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256) of all files under a folder, the path from there on."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    own = F.regexp_replace("path", r"^[a-z0-9]+:/+", "/")
    return files.select(F.substring(own, len(root.rstrip("/")) + 2, 1 << 20).alias("path"), F.sha2("content", 256).alias("sha256"))


#: Format of a release manifest, and the repositories that one must account for.
MANIFEST_FORMAT = 1
REQUIRED = ["texts", "ids", "editions"]
MANIFEST = "bundle_format int, api_version string, api_commit string, data map<string,string>, python_requires string, files map<string,string>"


def missing_repositories(data: Column, required: list[str] = REQUIRED) -> Column:
    """Those of the required repositories that a manifest's data (a map) doesn't name."""
    return F.array_except(F.array(*[F.lit(r) for r in required]), F.coalesce(F.map_keys(data), F.array().cast("array<string>")))


def read_manifests(spark: SparkSession, path: str, required: list[str] = REQUIRED, known: int = MANIFEST_FORMAT) -> DataFrame:
    """(file, usable, reason, manifest): manifests that are malformed, of another format or incomplete count as absent."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", MANIFEST, {"mode": "PERMISSIVE"}).alias("m"), F.try_parse_json("value").alias("v"))
    fields = ["bundle_format", "api_version", "api_commit", "data", "python_requires", "files"]
    lacking = F.exists(F.array(*[F.col(f"m.{c}").isNull() for c in fields]), lambda x: x)
    reason = F.when(F.col("v").isNull(), "malformed").when(F.coalesce(lacking, F.lit(True)), "incomplete").when(F.col("m.bundle_format") != known, "unknown-format").when(F.size(missing_repositories(F.col("m.data"), required)) > 0, "missing-repository")
    return files.select("file", reason.isNull().alias("usable"), reason.alias("reason"), F.when(reason.isNull(), F.col("m")).alias("manifest"))
