"""Quality rules: counts over the whole text, and a hashed n-gram log-likelihood ratio of a trusted target to the corpus.

Words and pairs of adjacent words are hashed to a fixed number of buckets. Two multinomials are counted, one over the
whole corpus and one over its trusted documents; a document's score is the mean log ratio of the two over its n-grams.
A threshold on the score, fitted on a bounded sample of labels, decides on every document. Only DataFrame expressions;
texts are read twice, those of labelled documents once more, and never shuffled; what is shuffled is one count a bucket
and task, and the labelled documents' scores.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import NOT_WS, constant_doubles, free_name, let, own_columns, stored, text_of, words_of

BUCKETS = 8192
WINDOW = 8
#: Documents of a lower mean log ratio are rejected, where labels of a class are missing and no threshold can be fitted.
THRESHOLD = -0.15
#: Cells of the scores that a threshold is fitted on, for each 1.
CELLS = 10_000


def _grams(words: Column) -> Column:
    """Hash of every word, then of every pair of adjacent words."""

    def both(h: Column) -> Column:
        n = F.greatest(F.size(h) - 1, F.lit(0))
        return F.concat(h, F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(2), n), lambda a, b: F.xxhash64(a, b)))

    return let(F.transform(words, lambda w: F.xxhash64(w)), both)


def _repeated_words(words: Column) -> Column:
    """Number of words that lie in a window of 8 words found twice or more in the text."""

    def of_windows(wins: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            same = lambda i, j: F.get(s, i)["h"].eqNullSafe(F.get(s, j)["h"])
            starts = F.sort_array(F.transform(F.filter(F.transform(s, lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["p"])), lambda p: p.isNotNull()), lambda p: p))
            return let(starts, lambda p: F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")))["n"])

        placed = F.sort_array(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(wins)) == F.size(wins), F.lit(0)).otherwise(let(placed, of_sorted))

    def of_hashes(h: Column) -> Column:
        wins = F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, F.lit(WINDOW))))
        return let(wins, of_windows)

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)).cast("long")


def _sample(ids: DataFrame, id_col: str, limit: int) -> DataFrame:
    """At most `limit` distinct ids that aren't null, those of least hash, as _id."""
    return ids.select(F.col(id_col).alias("_id")).where("_id is not null").distinct().orderBy(F.xxhash64("_id"), "_id").limit(limit)


def _counted(docs: DataFrame, trusted: DataFrame, text_col: str, id_col: str, limit: int, buckets: int) -> tuple[list[int], list[int]]:
    """How many n-grams of the corpus, and of its trusted documents, fall in each bucket."""
    ids = F.broadcast(_sample(trusted, id_col, limit))
    marked = docs.select(F.col(id_col).alias("_doc"), text_of(text_col).alias("_text")).join(ids, F.col("_doc") == F.col("_id"), "left")
    each = marked.select(F.col("_id").isNotNull().cast("long").alias("t"), F.explode(_grams(words_of(F.col("_text")))).alias("g")).select("t", F.pmod("g", F.lit(buckets)).alias("b"))
    rows = each.groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("target")).collect()
    counts = {r["b"]: (r["raw"], r["target"]) for r in rows}
    return tuple([counts.get(b, (0, 0))[i] for b in range(buckets)] for i in (0, 1))


def _ratios(raw: list[int], target: list[int]) -> list[float]:
    """Log ratio of every bucket, target to raw, each with half a count added; all 0 with no target."""
    part = lambda counts, n, b: (counts[b] + 0.5) / (n + 0.5 * len(counts))
    n_raw, n_target = sum(raw), sum(target)
    return [math.log(part(target, n_target, b) / part(raw, n_raw, b)) if n_target else 0.0 for b in range(len(raw))]


def train(docs: DataFrame, trusted: DataFrame, text_col: str = "text", id_col: str = "doc_id", limit: int = 20_000, buckets: int = BUCKETS) -> list[float]:
    """Log ratio of every bucket, trusted target to corpus, each with half a count added.

    trusted: ids of trusted documents. At most `limit` of them are used, those of least hash, so that their list can be
    broadcast; the corpus is all of `docs`. With no trusted document all ratios are 0. What reaches the driver is two
    counts a bucket.
    """
    return _ratios(*_counted(docs, trusted, text_col, id_col, limit, buckets))


def _held_out_score(words: Column, own: Column, raw: list[int], target: list[int]) -> Column:
    """Mean log ratio of a text's n-grams, by counts of the target that lack the text itself where `own` is 1."""
    buckets, n_raw, n_target = len(raw), sum(raw), sum(target)
    raws, targets = constant_doubles([math.log((x + 0.5) / (n_raw + 0.5 * buckets)) for x in raw]), constant_doubles(target)

    def of_sorted(b: Column) -> Column:
        n = F.size(b)
        term = lambda x, c: c * (F.log((F.get(targets, x) - own * c + 0.5) / (n_target - own * n + 0.5 * buckets)) - F.get(raws, x))
        run = lambda x, c, s: F.struct(x.alias("b"), c.alias("c"), s.alias("s"))
        step = lambda a, x: F.when(a["b"] == x, run(x, a["c"] + 1, a["s"])).otherwise(run(x, F.lit(1), F.when(a["c"] > 0, a["s"] + term(a["b"], a["c"])).otherwise(a["s"])))
        return F.aggregate(b, run(F.lit(-1), F.lit(0), F.lit(0.0)), step, lambda a: (a["s"] + term(a["b"], a["c"])) / n)

    return let(F.array_sort(F.transform(_grams(words), lambda g: F.pmod(g, F.lit(buckets)).cast("int"))), of_sorted)


def _parting(cells: dict[int, tuple[int, int]]) -> int:
    """The cell from which on scores are kept, so that fewest of the good (first count) and junk ones are judged wrongly.

    Of several that are as good it is the middle of the lowest gap.
    """
    at = sorted(cells)
    wrong = found = sum(junk for _, junk in cells.values())
    best = at[0]
    for c, after in zip(at, [*at[1:], at[-1] + 1], strict=True):
        wrong += cells[c][0] - cells[c][1]
        if wrong < found:
            found, best = wrong, (c + 1 + after) // 2
    return best


def fit(docs: DataFrame, trusted: DataFrame, junk: DataFrame | None, text_col: str = "text", id_col: str = "doc_id", limit: int = 20_000, buckets: int = BUCKETS) -> tuple[list[float], float]:
    """The ratios of train(), and the threshold on the score that best parts trusted documents from junk.

    junk: ids of documents labelled as junk. The sample is at most `limit` ids of either label, those of least hash, and
    of their rows those that pass the base rules. A trusted text is scored as if it had not been trained on, like the
    texts without a label that the threshold is for. Scores are held in cells of 1 / CELLS; the threshold is an edge of
    a cell, for which fewest sampled rows are judged wrongly. Where a label has no such row it is THRESHOLD. What reaches
    the driver is two counts a cell.
    """
    raw, target = _counted(docs, trusted, text_col, id_col, limit, buckets)
    model = _ratios(raw, target)
    if junk is None or not any(target):
        return model, THRESHOLD
    ids = F.broadcast(_sample(trusted, id_col, limit).withColumn("_own", F.lit(1)).unionByName(_sample(junk, id_col, limit).withColumn("_own", F.lit(0))))
    # the sample's texts are written first: else the rules would be worked out on every text before the join
    sample = stored(docs.select(F.col(id_col).alias("_doc"), text_of(text_col).alias("_text")).join(ids, F.col("_doc") == F.col("_id")).select("_own", "_text"))
    labelled = sample.select("_own", words_of(F.col("_text")).alias("_words"))
    scored = labelled.where(~_base_failed(F.size("_words"), _repeated_words(F.col("_words")))).select("_own", F.floor(_held_out_score(F.col("_words"), F.col("_own"), raw, target) * CELLS).alias("cell"))
    rows = scored.groupBy("cell").agg(F.sum("_own").alias("good"), F.sum(1 - F.col("_own")).alias("junk")).collect()
    cells = {r["cell"]: (r["good"], r["junk"]) for r in rows}
    if not all(sum(c[i] for c in cells.values()) for i in (0, 1)):
        return model, THRESHOLD
    return model, _parting(cells) / CELLS


def _base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def quality_columns(text: Column, model: list[float], threshold: float = THRESHOLD) -> Column:
    """One struct: the five counts, base_failed, score and kept of a text that isn't null."""

    def of_words(w: Column) -> Column:
        n = F.size(w).cast("long")
        weights, buckets = constant_doubles(model), len(model)
        score = let(_grams(w), lambda g: F.when(F.size(g) > 0, F.aggregate(g, F.lit(0.0), lambda acc, x: acc + F.get(weights, F.pmod(x, F.lit(buckets)).cast("int"))) / F.size(g)))
        lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(NOT_WS))
        counts = F.struct(
            n.alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            _repeated_words(w).alias("n_repeat_words"),
            F.coalesce(score, F.lit(0.0)).alias("score"),
        )

        def judged(c: Column) -> Column:
            failed = _base_failed(c["n_words"], c["n_repeat_words"])
            named = [c[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            return F.struct(*named, failed.alias("base_failed"), (~failed & (c["score"] >= threshold)).alias("kept"), c["score"].alias("score"))

        return let(counts, judged)

    return let(words_of(text), of_words)


def _learned(docs: DataFrame, trusted: DataFrame, text_col: str, id_col: str, threshold: float | None, limit: int, junk: DataFrame | None) -> tuple[list[float], float]:
    if threshold is not None:
        return train(docs, trusted, text_col, id_col, limit), threshold
    return fit(docs, trusted, junk, text_col, id_col, limit)


def judge(docs: DataFrame, trusted: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float | None = None, limit: int = 20_000, junk: DataFrame | None = None) -> DataFrame:
    """doc_id, the counts, base_failed, kept and score of every row.

    threshold: what a score must reach; without it the one that fit() finds with `junk`. A null text counts as empty: no
    words, so it fails. Repeated rows get the same verdict each. An empty table gives no rows. Columns other than id and
    text are not read. A very long text is judged whole, in its own row.
    """
    model, least = _learned(docs, trusted, text_col, id_col, threshold, limit, junk)
    judged = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_text")).select("doc_id", quality_columns(F.col("_text"), model, least).alias("q"))
    return judged.select("doc_id", "q.*")


def keep_good(docs: DataFrame, trusted: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float | None = None, limit: int = 20_000, junk: DataFrame | None = None) -> DataFrame:
    """The rows of `docs` that are kept, with all their columns, whatever these are called.

    A null or empty text has no words and goes. Repeated rows stay or go together; an empty table stays empty.
    """
    (model, least), mark = _learned(docs, trusted, text_col, id_col, threshold, limit, junk), free_name(docs, "_quality")
    return docs.withColumn(mark, quality_columns(text_of(text_col), model, least)).where(F.col(mark)["kept"]).select(*own_columns(docs))
