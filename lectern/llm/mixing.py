"""Mixing sources to target weights by entropy balancing.

Each document d of source s gets a rate r = min(cap, exp(lambda_s * x)), x its size over the mean size: of all rates in
[0, cap] whose words add up to the source's target, these have the least relative entropy to taking every document once.
The multipliers lambda solve the convex dual; it is solved by Newton steps kept inside a bracket, each step one
aggregation. As a rate depends on source and size alone, the steps run over counts of (source, size). Rates become whole
copies by systematic rounding along the sizes, so that what one document loses a neighbour of like size gains.

A table of one row a source is joined to the documents without dealing these by source: sources of many documents are
broadcast, at most a thousand of them. Ranks and running sums over sources run over range partitions of the sources.

Sums that decide anything are sums of decimals or integers, which do not depend on the order of rows: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import NOT_WS, free_name, joined, materialize, ordered, own_columns, renamed, small, stored, text_of

WEIGHTS = [5, 2, 1]
SHARE = 1.5
CAP = 2
STEPS = 60
UNIT = 1 << 20
WAYS = 256


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(NOT_WS + "+")).cast("long")


def source_targets(sizes: DataFrame, weights: list[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source: s (its rank by code point, null last), source, source_size, docs (their number), target.

    The targets share `share` times all sizes by the weights, dealt out in turn; a target stops at `cap` times its
    source's size, and the excess is reshared by weight until none is above. In closed form: sources in ascending order
    of (cap * size / weight) stop until the rest's equal level of words a weight is no higher than the next one's.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    by = ordered(by.withColumn("void", F.col("source").isNull()), ["void", "source"], rank="s")
    by = by.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("s") % len(weights)).cast("int")))
    by = by.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("stop", F.col("most") / F.col("weight"))
    by = materialize(ordered(by, ["stop", "s"], {"before": "most", "lighter": "weight"}))
    total = by.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    by = by.withColumn("level", (F.lit(float(total["size"] or 0) * share) - F.col("before")) / (F.lit(float(total["weight"] or 1)) - F.col("lighter")))
    first = by.where("stop >= level").agg(F.min(F.struct("stop", "s", "level")).alias("at")).first()["at"]
    even = F.lit(None).cast("double") if first is None else F.lit(first["level"])
    return by.select("s", "source", "source_size", "docs", F.coalesce(F.least("most", even * F.col("weight")), "most").alias("target"))


def _rate(multiplier: Column, size: Column, mean: float, cap: float) -> Column:
    return F.when(multiplier.isNull(), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(multiplier * size / F.lit(mean))))


def solve(sizes: DataFrame, targets: DataFrame, cap: float = CAP, steps: int = STEPS, tolerance: float = 1e-7) -> tuple[DataFrame, float]:
    """(s, multiplier) for every source with words, and the mean size. A multiplier of null means: all rates at the cap.

    Between two steps only one row a source is kept.
    """
    counts = materialize(sizes.where("size > 0").groupBy("s", "size").agg(F.count("*").alias("n")))
    mean = counts.agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean")).first()["mean"] or 1.0
    least = counts.groupBy("s").agg((F.min("size") / F.lit(mean)).alias("x"))
    few = counts.groupBy("s").agg(F.count("*").alias("cells"))
    state = targets.where("source_size > 0").join(least, "s").join(few, "s").select(
        "cells",
        "s",
        F.col("target").cast("double").alias("target"),
        F.when(F.col("target") < F.col("source_size") * F.lit(float(cap)) * (1 - 1e-12), F.lit(0.0)).alias("multiplier"),
        F.least(F.lit(0.0), F.log(F.col("target") / F.col("source_size")) / F.col("x")).alias("lo"),
        (F.log(F.lit(float(cap))) / F.col("x")).alias("hi"),
    )
    state = materialize(state)
    exact = lambda c: F.sum(F.round(c, 6).cast("decimal(38,6)")).cast("double")
    for _ in range(steps):
        rate = _rate(F.col("multiplier"), F.col("size"), mean, cap)
        words = F.col("n") * F.col("size") * rate
        slope = F.when(rate < cap, words * F.col("size") / F.lit(mean)).otherwise(F.lit(0.0))
        now = joined(counts, state, ["s"], "cells").where("multiplier is not null").groupBy("s").agg(exact(words).alias("words"), exact(slope).alias("slope"))
        off = F.col("words") - F.col("target")
        lo, hi = F.when(off < 0, F.col("multiplier")).otherwise(F.col("lo")), F.when(off > 0, F.col("multiplier")).otherwise(F.col("hi"))
        newton = F.col("multiplier") - off / F.when(F.col("slope") > 0, F.col("slope"))
        inside = newton.between(F.col("lo2"), F.col("hi2"))
        done = F.abs(off) <= F.lit(tolerance) * F.col("target")
        moved = state.join(now, "s", "left").withColumn("lo2", lo).withColumn("hi2", hi)
        step = F.when(done, F.col("multiplier")).when(inside, newton).otherwise((F.col("lo2") + F.col("hi2")) / 2)
        state = materialize(
            moved.select("s", "cells", "target", F.when(F.col("multiplier").isNotNull() & F.col("words").isNotNull(), step).otherwise(F.col("multiplier")).alias("multiplier"), F.coalesce("lo2", "lo").alias("lo"), F.coalesce("hi2", "hi").alias("hi"), (done | F.col("words").isNull()).alias("done"))
        )
        if state.where("not done").isEmpty():
            break
        state = state.drop("done")
    return state.select("s", F.round("multiplier", 9).alias("multiplier")), mean


def _rounded(rated: DataFrame) -> DataFrame:
    """Copies from rates: the whole part, and one more where the running sum of the parts passes a whole number.

    Rows run by size. The running sum has two levels, so that a source of any size is split: sums of (size class, hash)
    cells, at most some ten thousands a source, and rows within a cell.
    """
    cell = ["s", "c1", "c2"]
    parts = rated.withColumn("whole", F.floor("rate").cast("long")).withColumn("part", F.round((F.col("rate") - F.floor("rate")) * UNIT).cast("long"))
    parts = parts.withColumn("c1", F.floor(F.log2(F.col("size") + 1) * 8).cast("int")).withColumn("c2", F.pmod(F.xxhash64("id", "th"), F.lit(WAYS)).cast("int"))
    sums = parts.groupBy(*cell).agg(F.sum("part").alias("sum"))
    before = sums.withColumn("before", F.sum("sum").over(Window.partitionBy("s").orderBy("c1", "c2")) - F.col("sum")).drop("sum")
    upto = F.col("before") + F.sum("part").over(Window.partitionBy(*cell).orderBy("size", "id", "th", "rid").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + UNIT // 2
    stepped = parts.join(before, cell).withColumn("upto", upto)
    more = F.floor(F.col("upto") / UNIT) - F.floor((F.col("upto") - F.col("part")) / UNIT)
    return stepped.select("rid", "id", "th", "s", "size", (F.col("whole") + more).cast("long").alias("copies"))


def _settled(rows: DataFrame, targets: DataFrame, cap: int, rounds: int) -> DataFrame:
    """(rid, by): a few single copies more or less, of the largest rows that fit what a source is still off its target.

    The rows are only read: a round looks for one row a source, and what is kept between rounds is one row a source.
    """
    off = rows.groupBy("s").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.count("*").alias("docs")).join(targets.select("s", "target"), "s")
    off = materialize(off.select("s", "docs", (F.col("target") - F.col("taken")).alias("off")))
    at = F.struct("size", "id", "th", "rid")
    off, changes = off.withColumn("last", F.lit(None).cast(rows.select(at.alias("at")).schema["at"].dataType)), None
    for _ in range(rounds):
        # what one round took the next leaves alone: sizes go down, and of equal ones the id
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("off")) & (F.col("last").isNull() | (at < F.col("last")))
        fits = fits & F.when(F.col("off") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0)
        pick = joined(rows, off, ["s"], "docs").where(fits).groupBy("s").agg(F.max(at).alias("top"))
        off = materialize(off.join(pick, "s", "left").select("s", "docs", (F.col("off") - F.coalesce(F.signum("off") * F.col("top.size"), F.lit(0.0))).alias("off"), F.coalesce("top", "last").alias("last"), "top.rid", F.signum("off").cast("long").alias("by")))
        found = off.where("rid is not null").select("rid", "by")
        changes = found if changes is None else changes.unionByName(found)
        off = off.select("s", "docs", "off", "last")
    return off.select(F.lit(0).cast("long").alias("rid"), F.lit(0).cast("long").alias("by")).limit(0) if changes is None else changes


def _mixed(rows: DataFrame, weights: list[float], share: float, cap: int, rounds: int) -> DataFrame:
    """rid, id, size, source, source_size, target, copies of rows (rid, id, th, source, size)."""
    targets = materialize(source_targets(rows, weights, share, cap))
    void = free_name(rows, "_void")
    keyed = lambda df: df.withColumns({void: F.col("source").isNull(), "source": F.coalesce("source", F.lit(""))})
    sizes = materialize(joined(keyed(rows), keyed(targets.select("source", "s", "docs")), [void, "source"], "docs").select("rid", "id", "th", "s", "size"))
    multipliers, mean = solve(sizes, targets, cap)
    known = materialize(targets.select("s", "docs").join(multipliers.withColumn("known", F.lit(True)), "s", "left"))
    rate = F.when(F.col("known") & (F.col("size") > 0), _rate(F.col("multiplier"), F.col("size"), mean, cap)).otherwise(F.lit(1.0))
    drawn = materialize(_rounded(joined(sizes, known, ["s"], "docs").select("rid", "id", "th", "s", "size", rate.alias("rate"))))
    told = joined(drawn, targets, ["s"], "docs").join(small(_settled(drawn, targets, cap, rounds)), "rid", "left")
    return told.select("rid", "id", "size", "source", "source_size", "target", (F.col("copies") + F.coalesce("by", F.lit(0))).alias("copies"))


def _read(docs: DataFrame, rid: Column, text_col: str, id_col: str, source_col: str) -> DataFrame:
    text = text_of(text_col)
    return materialize(docs.select(rid.alias("rid"), F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.col(source_col).alias("source"), word_count(text).alias("size")))


def mix(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weights: list[float] = WEIGHTS, share: float = SHARE, cap: int = CAP, rounds: int = 4) -> DataFrame:
    """doc_id, size, source, source_size, target, copies of every row of `docs`.

    size is the number of words (null text: 0); a row without words is taken once, which adds none. A null source comes
    last in the order of sources. Repeated rows are documents of their own. An empty table gives no rows. Columns other
    than id, text and source are not read.
    """
    rows = _read(docs, F.monotonically_increasing_id(), text_col, id_col, source_col)
    return _mixed(rows, weights, share, cap, rounds).select(F.col("id").alias("doc_id"), "size", "source", "source_size", "target", "copies")


def mixing_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row; null, empty, repeated and very long texts as mix() has them."""
    return mix(docs, **options).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def drawn_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weights: list[float] = WEIGHTS, share: float = SHARE, cap: int = CAP, rounds: int = 4) -> DataFrame:
    """The rows of `docs`, each as often as mix() draws it, with all their columns, whatever these are called.

    The rows are written once with a number each, by which a draw finds its row: rows without an id, of one id, or
    repeated whole, are drawn each by itself. A null text counts as empty and is taken once. An empty table stays empty.
    """
    mark, n, one = renamed(docs, "_rid", "_copies", "_copy")
    kept = stored(docs.withColumn(mark, F.monotonically_increasing_id()))
    drawn = _mixed(_read(kept, F.col(mark), text_col, id_col, source_col), weights, share, cap, rounds).select(F.col("rid").alias(mark), F.col("copies").alias(n)).where(F.col(n) > 0)
    return kept.join(drawn, mark).withColumn(one, F.explode(F.array_repeat(F.lit(0), F.col(n).cast("int")))).select(*own_columns(docs))
