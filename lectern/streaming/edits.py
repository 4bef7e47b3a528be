"""The edit log as a stream: each micro-batch is folded onto the branches that it edits, by the fold of the batch code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.edits import EDIT_FIELDS, apply_log
from lectern.storage import kept

LOG = ", ".join(f"{c} {t}" for c, t in ({"branch": "string", "seq": "bigint", "edition": "string", "month": "int", "op": "string"} | EDIT_FIELDS).items())
KEY = ["branch", "edition"]
#: What a generation of the state holds.
TABLES = {
    "days": "branch string, edition string, month int, day int, titulus string, conclusio string",
    "entries": "branch string, edition string, month int, day int, pos int, id string, text string",
    "errors": "branch string, edition string, seq bigint, error string",
}
#: After so many batches a generation holds the whole state, and not only what its batch has edited.
COMPACT = 16


def _at(path: str, table: str, number: int | str) -> str:
    return f"{path.rstrip('/')}/{table}-{number if isinstance(number, str) else format(number, '010d')}"


def _read(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """All generations of a table with the number of each row's own; none before the first is written."""
    number = F.regexp_extract("_metadata.file_path", f"{table}-([0-9]+)/", 1).cast("long").alias("number")
    try:
        return spark.read.schema(schema).parquet(_at(path, table, "*")).select("*", number)
    except Exception as e:  # noqa: BLE001 - nothing is there before the first batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{schema}, number bigint")


def _whole(spark: SparkSession, path: str, before: int) -> list[int]:
    """The generations below `before` that hold the whole state, ascending, after 0."""
    found = _read(spark, path, "whole", "whole bigint").where(F.col("whole") < before).select("whole").distinct().collect()
    return [0, *sorted(r["whole"] for r in found)]


def _live(spark: SparkSession, path: str, table: str, before: int) -> DataFrame:
    """A table of the state as batches below `before` have left it: of each branch and edition its last generation."""
    there = _read(spark, path, table, TABLES[table]).where((F.col("number") < before) & (F.col("number") >= _whole(spark, path, before)[-1]))
    if table == "errors":
        return there.drop("number")
    last = _read(spark, path, "days", TABLES["days"]).where(F.col("number") < before).groupBy(*KEY).agg(F.max("number").alias("number"))
    return there.join(last, [*KEY, "number"], "left_semi").drop("number")


def _forget(spark: SparkSession, path: str, below: int) -> None:
    """Take the generations below a number away."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001 - Spark has no other way to a file system
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    for status in fs.listStatus(root):
        table, _, number = status.getPath().getName().rpartition("-")
        if table in TABLES and number.isdigit() and int(number) < below:
            fs.delete(status.getPath(), True)


def log_stream(log: DataFrame, days: DataFrame, elogia: DataFrame, path: str, checkpoint: str, compact: int = COMPACT) -> StreamingQuery:
    """Apply all edits of a log (of schema LOG) that are there to the state under `path`, and stop.

    A branch begins with the published days (edition, month, day, titulus, conclusio) and entries (edition, month, day,
    pos, id, text) of an edition when it first edits it. The log is appended to: a later batch holds later edits only. A
    batch writes the branches' editions that it edits, as one generation; every `compact` batches a generation holds the
    whole state and is then named so by a file of its own, which never is overwritten. Generations below the whole one
    before it are taken away, so that who reads the last but one still can. A batch that is run again reads what lies
    below it and overwrites what it wrote: the state comes out the same after a lost driver.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark, number = batch.sparkSession, number + 1
        new = kept(batch.select(*[c.split()[0] for c in LOG.split(", ")]))
        keys = kept(new.select(*KEY).distinct())
        state = {t: kept(_live(spark, path, t, number)) for t in ("days", "entries")}
        fresh = keys.join(state["days"].select(*KEY).distinct(), KEY, "left_anti")
        begun = {t: state[t].join(keys, KEY, "left_semi").unionByName(df.join(F.broadcast(fresh) if fresh.count() <= 2000 else fresh, "edition").select(*state[t].columns)) for t, df in (("days", days), ("entries", elogia))}
        out = dict(zip(TABLES, apply_log(begun["days"], begun["entries"], new), strict=True))
        whole = number % compact == 0
        if whole:
            out |= {t: out[t].unionByName(state[t].join(keys, KEY, "left_anti")) for t in state} | {"errors": out["errors"].unionByName(_live(spark, path, "errors", number))}
        for t in reversed(TABLES):
            out[t].select(*state[t].columns if t in state else ["branch", "edition", "seq", "error"]).write.mode("overwrite").parquet(_at(path, t, number))
        if whole:
            spark.range(1).select(F.lit(number).cast("long").alias("whole")).write.mode("overwrite").parquet(_at(path, "whole", number))
            _forget(spark, path, _whole(spark, path, number)[-1])

    return log.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def branch_state(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The days, the entries or the errors as the last batch has left them."""
    return _live(spark, path, table, 1 << 62)
