"""Exact deduplication by deterministic block naming.

A normalised text is cut into blocks of a fixed number of bytes. The distinct blocks of the corpus are sorted by a
128-bit key of their content and numbered without gaps; the dictionary of blocks proves that no two of them share a key
(should two ever, the keys are drawn again with another salt), so that a number names one block and no other. Then
adjacent names are paired, the distinct pairs are sorted and numbered in turn, and so on until every document has one
name. Two documents have the same number of blocks and the same name exactly if their texts are equal. Names are ranks in
a sorted order: they don't depend on how the rows are partitioned.

What moves: the text of the distinct blocks is shuffled once, combined before the shuffle, so that a block of very many
copies is one row a task. All else is keys and integers. Occurrences of a block that very many documents hold find its
name by a broadcast of such blocks, at most a thousand. Every level keeps only documents that still have two names or
more: a text of n blocks takes log2(n) levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import joined, materialize, ordered, own_columns, renamed, text_of

BLOCK_BYTES = 4096


def normalized(text: Column) -> Column:
    """Every run of white space as one space. Single spaces, by far the most, are left alone without a match."""
    return F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _raw(text_col: str) -> Column:
    return normalized(text_of(text_col)).cast("binary")


def _blocks(raw: Column, size: int) -> Column:
    last = F.greatest(F.ceil(F.octet_length(raw) / F.lit(size)), F.lit(1)).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * size + 1, F.lit(size)))


def _key(block: Column, salt: int) -> Column:
    return F.struct(F.xxhash64(block).alias("k1"), F.xxhash64(F.lit(salt), block).alias("k2"))


def _folded(occurrences: DataFrame, names: DataFrame, on: list[str]) -> DataFrame:
    """(rid, n_blocks, names in order) from one row per occurrence, and the names with their number of occurrences `n`."""
    found = joined(occurrences, names, on, "n").groupBy("rid", "n_blocks").agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("s"))
    return materialize(found.select("rid", "n_blocks", F.transform("s", lambda x: x["name"]).alias("names")))


def block_identities(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of `docs`: rid, id, text_sha256, n_blocks, name.

    Rows have the same (n_blocks, name) exactly if their normalised texts are equal. A null text counts as empty, an
    empty text is one empty block. `rid` numbers the rows, so that repeated rows and null or repeated ids stay apart. An
    empty table gives no rows.
    """
    for salt in range(1, 9):
        raw = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), _raw(text_col).alias("raw"))
        base = materialize(
            raw.select("rid", "id", F.sha2("raw", 256).alias("text_sha256"), F.transform(_blocks(F.col("raw"), block_bytes), lambda b: _key(b, salt)).alias("keys"))
        )
        distinct = docs.select(_raw(text_col).alias("raw")).select(F.explode(_blocks(F.col("raw"), block_bytes)).alias("block")).groupBy("block").agg(F.count("*").alias("n"))
        keyed = materialize(distinct.select(_key(F.col("block"), salt).alias("key"), "n").select("key.*", "n"))
        if keyed.groupBy("k1", "k2").agg(F.count("*").alias("blocks")).where("blocks > 1").isEmpty():
            break
    else:
        raise RuntimeError("no collision-free routing key found")
    occurrences = base.select("rid", F.size("keys").alias("n_blocks"), F.posexplode("keys").alias("pos", "key")).select("rid", "n_blocks", "pos", F.col("key.k1").alias("k1"), F.col("key.k2").alias("k2"))
    state = _folded(occurrences, ordered(keyed, ["k1", "k2"], rank="name"), ["k1", "k2"])
    done = []
    longest = state.agg(F.max("n_blocks")).first()[0] or 0
    while True:
        done.append(state.where(F.size("names") == 1).select("rid", "n_blocks", F.get("names", F.lit(0)).alias("name")))
        if longest <= 1:
            break
        longest = (longest + 1) // 2
        half = ((F.size("names") - 1) / 2).cast("int")
        pair = F.transform(F.sequence(F.lit(0), half), lambda i: F.struct(F.get("names", i * 2).alias("l"), F.coalesce(F.get("names", i * 2 + 1), F.lit(-1)).alias("r")))
        pairs = state.where(F.size("names") > 1).select("rid", "n_blocks", F.posexplode(pair).alias("pos", "p")).select("rid", "n_blocks", "pos", "p.l", "p.r")
        names = ordered(pairs.groupBy("l", "r").agg(F.count("*").alias("n")), ["l", "r"], rank="name")
        state = _folded(pairs, names, ["l", "r"])
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return base.select("rid", "id", "text_sha256").join(found, "rid")


def exact_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest id stays; null ids come last; of repeated rows with one id one stays. An
    empty table gives no rows. Columns of `docs` other than id and text are not read. A very long text is cut into more
    blocks, its names halve in number with every level.
    """
    rows = block_identities(docs, text_col, id_col, block_bytes)
    first = F.min(F.struct(F.col("id").isNull().alias("void"), F.col("id").alias("id"), F.col("rid").alias("rid")))
    groups = materialize(rows.groupBy("n_blocks", "name").agg(first.alias("first"), F.count("*").alias("group_size")))
    return joined(rows, groups, ["n_blocks", "name"], "group_size").select(
        F.col("id").alias("doc_id"), F.col("first.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("first.rid")).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs` that stay, with all their columns, whatever these are called.

    Of equal texts the row of the smallest id stays, null ids last; a null text counts as empty. A row is found again by
    its id and its text's digest; where several rows have the same of both, one of them stays. An empty table stays empty.
    """
    sha, many, own, digest = renamed(docs, "_sha", "_many", "_id", "_digest")
    found = exact_duplicates(docs, text_col, id_col)
    stay = materialize(found.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), (F.count("*") > 1).alias("many")).where("kept"))
    stay = stay.select(F.col("doc_id").alias(own), F.col("text_sha256").alias(digest), F.col("many").alias(many))
    marked = docs.withColumn(sha, F.sha2(_raw(text_col), 256))
    both = marked.join(stay, (F.col(sha) == F.col(digest)) & F.col(id_col).eqNullSafe(F.col(own)))
    if stay.where(F.col(many)).isEmpty():
        return both.select(*own_columns(docs))
    once, more = both.where(~F.col(many)), both.where(F.col(many))
    return once.unionByName(more.dropDuplicates([id_col, sha])).select(*own_columns(docs))
