"""Gates before a sink: write, audit what was written, and publish it by a pointer, or refuse it with the rows at fault."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators.align import ENTRY
from lectern.storage import kept

VIOLATION = "rule string, edition string, month int, day int, idx int, id string"


def _generations(spark: SparkSession, path: str, what: str) -> list[int]:
    """The numbers of the generations that are staged or published under `path`, ascending."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001 - Spark has no other way to a file system
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(int(n.rpartition("-")[2]) for n in names if n.startswith(what + "-"))


def _at(path: str, what: str, number: int) -> str:
    return f"{path.rstrip('/')}/{what}-{number:010d}"


def publish(tables: dict[str, DataFrame], path: str, audit: Callable[[dict[str, DataFrame]], DataFrame]) -> DataFrame:
    """The violations (VIOLATION) that `audit` finds in the tables as they were written; without any they are published.

    A generation is written beside the older ones. The audit reads what was written, not what was to be. A refused
    generation stays where it is, with its violations, and nobody's reads see it; a published one is named by a file of its
    own, written last and never overwritten. A writer that is lost midway leaves a generation that no pointer names.
    """
    spark = next(iter(tables.values())).sparkSession
    number = max(_generations(spark, path, "generation"), default=0) + 1
    for name, df in tables.items():
        df.write.parquet(f"{_at(path, 'generation', number)}/{name}")
    written = {name: spark.read.schema(df.schema).parquet(f"{_at(path, 'generation', number)}/{name}") for name, df in tables.items()}
    found = kept(audit(written))
    if found.isEmpty():
        spark.range(1).select(F.lit(number).cast("long").alias("generation")).write.parquet(_at(path, "published", number))
    else:
        found.write.parquet(f"{_at(path, 'generation', number)}/_violations")
    return found


def published(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of the generation published last."""
    numbers = _generations(spark, path, "published")
    if not numbers:
        raise LookupError(f"nothing is published under {path}")
    return spark.read.parquet(f"{_at(path, 'generation', numbers[-1])}/{table}")


def _rule(df: DataFrame, rule: str) -> DataFrame:
    there = {f.split()[0]: f.split()[1] for f in VIOLATION.split(", ")}
    return df.select(F.lit(rule).alias("rule"), *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in there.items() if c != "rule"])


def alignment_violations(entries: DataFrame, assigned: DataFrame, coined: DataFrame, existing: DataFrame, older: DataFrame | None = None) -> DataFrame:
    """(VIOLATION) of an alignment that is to be written.

    entries: (entry key, id), as they were read; assigned and coined: (entry key, id), what matches and overrides, and what
    coining gave them; existing: (id), all ids that are there. aligned-input: the entry has an id already. unaligned-older:
    an entry of the older edition (entry key, id) has none. unmatched: no id was given. given-twice: two of an edition's
    entries, or one entry twice. coined-exists and coined-twice: a coined id that is there, or was coined for another entry.
    """
    tagged = lambda df, of: df.select(*ENTRY, "id", F.lit(of).alias("_of"))
    rows = tagged(entries, "entry").unionByName(tagged(assigned, "assigned")).unionByName(tagged(coined, "coined"))
    rows = rows.withColumn("_n", F.count(F.when(F.col("_of") != "entry", 1)).over(Window.partitionBy(*ENTRY)))
    mine = F.col("_of") == "coined"
    # laid out by id once, for all that is told of it
    given = rows.where("_of <> 'entry'").withColumn("_coined", F.count(F.when(mine, 1)).over(Window.partitionBy("id")))
    given = given.withColumns({"_same": F.count("*").over(Window.partitionBy("edition", "id")), "_nth": F.row_number().over(Window.partitionBy("id", *ENTRY).orderBy("_of"))})
    given = given.join(existing.select("id").distinct().withColumn("_held", F.lit(True)), "id", "left")
    twice = ((F.col("_n") > 1) | (F.col("_same") > 1)) & (F.col("_nth") == 1)
    broken = [F.when(twice, "given-twice"), F.when(mine & F.col("_held").isNotNull(), "coined-exists"), F.when(mine & (F.col("_coined") > 1), "coined-twice")]
    told = lambda df, rules, id_=F.col("id"): df.withColumn("rule", F.explode(F.array_compact(F.array(*rules)))).withColumn("id", id_).select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in VIOLATION.split(", ")])
    left = [F.when(F.col("id").isNotNull(), "aligned-input"), F.when(F.col("_n") == 0, "unmatched")]
    rules = [told(rows.where("_of = 'entry'"), left, F.when(F.col("rule") == "aligned-input", F.col("id"))), told(given, broken)]
    if older is not None:
        rules.append(_rule(older.where("id is null"), "unaligned-older"))
    return reduce(DataFrame.unionByName, rules)
