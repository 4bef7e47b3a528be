"""Small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.arrays import let  # noqa: F401 - handed on to the operators
from lectern.storage import kept as materialize
from lectern.storage import stored  # noqa: F401 - handed on to the operators

#: The white space of every contract: space, tab, line feed, vertical tab, form feed, carriage return.
WS = r"[\x20\x09-\x0D]"
NOT_WS = r"[^\x20\x09-\x0D]"
#: A narrow table of so many rows may be broadcast.
MOST_BROADCAST = 2_000


def text_of(col: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the maximal runs of characters that are not white space."""
    return F.filter(F.split(text, WS + "+"), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """The text with A-Z lower-cased and all else as it is. lower() does it for an ASCII text at a fraction of the time."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Each element of an array combined with all before it, by doubling: n log n steps for n elements.

    combine(element, earlier) is associative and takes a null `earlier` for none.
    """
    back = lambda k: F.call_function("shiftleft", F.lit(1), k)
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))
    return F.aggregate(steps, values, lambda acc, k: F.transform(acc, lambda x, i: combine(x, F.get(acc, i - back(k)))))


def constant_doubles(values: list[float]) -> Column:
    """A short array of doubles (a model of fixed size) as one folded literal."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def constant_longs(values: list[int]) -> Column:
    return F.split(F.lit(",".join(str(int(v)) for v in values)), ",").cast("array<bigint>")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that `df` lacks, whatever its letters' case."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def renamed(df: DataFrame, *stems: str) -> list[str]:
    """One free_name() for each stem."""
    return [free_name(df, stem) for stem in stems]


def own_columns(df: DataFrame) -> list[Column]:
    """All columns of `df` by name, dots in a name included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def joined(rows: DataFrame, table: DataFrame, on: list[str], weight: str, most: int = 1000) -> DataFrame:
    """The inner join of `rows` with a table of one row a key, whose column `weight` counts the rows that have the key.

    A table of at most MOST_BROADCAST rows is broadcast. Of a larger one the keys that hold a thousandth of all rows (and
    a thousand at least) are, which are `most` at most: their rows stay where they lie, and only the rows of the other
    keys are shuffled.
    """
    size = table.agg(F.count("*").alias("keys"), F.sum(weight).alias("rows")).first()
    if size["keys"] <= MOST_BROADCAST:
        return rows.join(F.broadcast(table), on)
    heavy = table.where(F.col(weight) >= max(1000, -(-size["rows"] // most)))
    if heavy.isEmpty():
        return rows.join(table, on)
    heavy = F.broadcast(heavy)
    return rows.join(heavy, on).unionByName(rows.join(heavy.select(*on), on, "left_anti").join(table, on))


def small(table: DataFrame) -> DataFrame:
    """`table`, to be broadcast if it has at most MOST_BROADCAST rows."""
    return F.broadcast(table) if table.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else table


def met(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """The inner join of `rows` with a written table, which is broadcast by its rows, never by the bytes of its files."""
    few = small(table)
    return rows.join(table.hint("merge") if few is table else few, on)


def ordered(rows: DataFrame, by: list[str], before: dict[str, str] | None = None, rank: str = "rank") -> DataFrame:
    """`rows` with their rank from 0 in the order of `by`, which tells all of them apart, and sums over the rows before.

    before: names of the sums, and the columns that they add up. Rows are sorted over range partitions and written with
    their place in them; what passes through the driver is one count a partition. Ranks, and sums of whole numbers, don't
    depend on how rows are partitioned.
    """
    before, at = before or {}, free_name(rows, "_at")
    placed = materialize(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(at), 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), *[F.sum(c).alias(out) for out, c in before.items()]).orderBy("part").collect()
    told, upto = [0] * (1 + max((r["part"] for r in sizes), default=0)), {out: 0 for out in before}
    sums, n = {out: [0.0] * len(told) for out in before}, 0
    for r in sizes:
        told[r["part"]], n = n, n + r["n"]
        for out in before:
            sums[out][r["part"]], upto[out] = upto[out], upto[out] + (r[out] or 0)
    ranks = (F.get(constant_longs(told), part.cast("int")) + F.col(at).bitwiseAND((1 << 33) - 1)).alias(rank)
    if not before:
        return placed.select(*rows.columns, ranks)
    within = Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    added = [(F.get(constant_doubles(sums[out]), part.cast("int")) + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(out) for out, c in before.items()]
    return placed.select(*rows.columns, ranks, *added)


def bloom_positions(key: Column, bits: int, seed: int, hashes: int = 5) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed * 64 + j), key), F.lit(bits)) for j in range(hashes)]


def bloom_words(keys: DataFrame, words: int, seed: int = 0, hashes: int = 5) -> list[int]:
    """A Bloom filter of a one-column frame in so many 64-bit words; no more than these reach the driver."""
    at = keys.toDF("key").select(F.explode(F.array(*bloom_positions(F.col("key"), 64 * words, seed, hashes))).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    found = {r["word"]: r["bits"] for r in at.groupBy(F.floor(F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).collect()}
    return [found.get(i, 0) for i in range(words)]


def bloom_holds(key: Column, words: list[int], seed: int = 0, hashes: int = 5) -> Column:
    bits, every = constant_longs(words), F.lit(True)
    for at in bloom_positions(key, 64 * len(words), seed, hashes):
        every = every & (F.getbit(F.get(bits, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1)
    return every


@contextmanager
def small_batches(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """Within, Arrow batches hold few rows, so that a batch of long texts stays small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
