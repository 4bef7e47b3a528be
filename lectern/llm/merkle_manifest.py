"""Merkle manifest of a table: content-addressed records, proofs by descent from the root.

Every row is a leaf; the leaves of a language in the order of their ids form a binary tree, the roots of these trees form
one more. The manifest stores a tree in strata of HEIGHT levels: a record has the digest of a node, and the digests below
it, level by level, down to the bottom of the stratum, 2 ** HEIGHT at most. A record is found by its digest and by nothing
else, so that equal nodes are one record (`area`, the high digits of a node's rank, only keeps one record from being asked
for by very many nodes at once; a node below may be stored once an area).

Leaf requests descend from the root. Their ranks' digits choose a child at every level; the siblings that are not chosen
are collected on the way down, and the path is reversed at the end. Requests of one node go down together: a stratum is
one join of the nodes asked for with their records, of as many rows as there are such nodes, until the last stratum hands
each request its own path. Nothing is gathered but 2 ** HEIGHT digests under one node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import joined, materialize, ordered, stored

#: Levels of a stratum, and the nodes of one area (as bits of a node's number).
HEIGHT, AREA = 8, 6
#: Fixed value of the contract: the columns that a leaf is made of.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
TOP = "top"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the strings, put together."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_of(fields: list[Column]) -> Column:
    """A leaf's digest: for each value "-" if null, else its bytes' number, a colon and the value."""

    def told(value: Column) -> Column:
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return digest(*[told(f.cast("string")) for f in fields])


def leaves_of(docs: DataFrame, changed: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, tree, leaf, changed_leaf, rank, n): each row's leaf with its rank from 0 among the n of its tree.

    tree is the language, told apart from null and in its order. Ids ascend, null first; rows of one id are ordered by
    their leaf, so that equal rows only can change places. changed: columns as a tamperer would leave them; changed_leaf
    is null where they make no other leaf. Each row is one leaf, repeated or not.
    """
    own, differs = {c: F.col(c) for c in FIELDS}, F.lit(False)
    for c, value in (changed or {}).items():
        differs = differs | ~value.eqNullSafe(F.col(c))
    other = F.when(differs, leaf_of(list((own | (changed or {})).values())))
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    rows = materialize(docs.select("doc_id", tree.alias("tree"), leaf_of(list(own.values())).alias("leaf"), other.alias("changed_leaf")))
    placed = ordered(rows.withColumn("row", F.monotonically_increasing_id()), ["tree", "doc_id", "leaf", "row"], rank="place").drop("row")
    trees = materialize(placed.groupBy("tree").agg(F.min("place").alias("begin"), F.count("*").alias("n")))
    return joined(placed, trees, ["tree"], "n").select("doc_id", "tree", "leaf", "changed_leaf", (F.col("place") - F.col("begin")).alias("rank"), "n")


def _above(nodes: Column) -> Column:
    """One level up: each two digests, or a last lone one, become their digest."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda i: F.sha2(F.concat(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))).cast("binary"), 256))


def _levels(nodes: Column, height: Column) -> Column:
    """The nodes and the levels above them, `height` of these (HEIGHT at most)."""

    def grow(levels: Column, k: Column) -> Column:
        return F.when(k > height, levels).otherwise(F.concat(levels, F.array(_above(F.element_at(levels, -1)))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(HEIGHT)), F.array(nodes), grow)


def build(nodes: DataFrame) -> list[DataFrame]:
    """The records of trees (tree, rank, n, node), one written table a stratum, the leaves' own first.

    A record is (tree, no, area, node, levels): the no-th node of its stratum's top. A tree of one node, and one that is
    done below, goes up unchanged.
    """
    strata = []
    while True:
        height = F.least(F.ceil(F.log2(F.col("n")) - 1e-12), F.lit(HEIGHT)).cast("int")
        groups = nodes.groupBy("tree", "n", F.shiftright("rank", HEIGHT).alias("no")).agg(F.sort_array(F.collect_list(F.struct(F.col("rank"), F.col("node")))).alias("s"))
        levels = groups.select("tree", "n", "no", _levels(F.transform("s", lambda x: x["node"]), height).alias("levels"))
        strata.append(stored(levels.select("tree", "n", "no", F.shiftright("no", AREA).alias("area"), F.element_at("levels", -1)[0].alias("node"), "levels")))
        nodes = strata[-1].select("tree", F.col("no").alias("rank"), F.shiftright(F.col("n") + ((1 << HEIGHT) - 1), HEIGHT).alias("n"), "node")
        if nodes.where("n > 1").isEmpty():
            return strata


def _path(levels: Column, at: Column) -> Column:
    """The unselected children on the way from a record's top to its at-th bottom node, downwards.

    "<" marks a sibling to the left, ">" one to the right; "" stands for a node without one.
    """

    def step(k: Column) -> Column:
        own = F.call_function("shiftright", at, k)
        sibling = F.when(own % 2 == 1, own - 1).otherwise(own + 1)
        return F.coalesce(F.concat(F.when(own % 2 == 1, "<").otherwise(">"), F.get(F.get(levels, k), sibling)), F.lit(""))

    down = F.when(F.size(levels) > 1, F.sequence(F.size(levels) - 2, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.transform(down, step)


def descend(strata: list[DataFrame], begin: DataFrame, requests: DataFrame) -> DataFrame:
    """`requests` with the path of each, from its leaf up to the top.

    begin: (tree, node, above, ...), the trees' roots and the path that leads down to each; further columns are handed
    on to the requests of the tree. requests: (tree, rank, ...), at most one for a leaf; a leaf that no record holds gets
    no row.
    """
    more = [c for c in begin.columns if c not in ("tree", "node", "above")]
    own = [c for c in requests.columns if c not in ("tree", "rank")]
    asked = requests.groupBy("tree", F.shiftright("rank", HEIGHT).alias("no")).agg(F.collect_list(F.struct(F.col("rank").bitwiseAND((1 << HEIGHT) - 1).cast("int").alias("at"), "rank", *own)).alias("asked"))
    asked = stored(asked)
    state = begin.withColumn("no", F.lit(0).cast("long"))
    for s in range(len(strata) - 1, -1, -1):
        records = strata[s].groupBy("node", "area").agg(F.first("levels").alias("levels"))
        met = state.withColumn("area", F.shiftright("no", AREA)).join(records, ["node", "area"])
        if s:
            wanted = asked.select("tree", F.shiftright("no", HEIGHT * (s - 1)).alias("next"), F.shiftright("no", HEIGHT * s).alias("no")).distinct()
            at = F.col("next").bitwiseAND((1 << HEIGHT) - 1).cast("int")
            down = met.join(wanted, ["tree", "no"])
            state = stored(down.select("tree", F.get(F.get("levels", F.lit(0)), at).alias("node"), F.concat("above", _path(F.col("levels"), at)).alias("above"), F.col("next").alias("no"), *more))
        else:
            found = met.join(asked, ["tree", "no"]).select(
                "tree", *more, F.explode(F.transform("asked", lambda r: F.struct(r.alias("r"), F.reverse(F.concat("above", _path(F.col("levels"), r["at"]))).alias("path")))).alias("f")
            )
            return found.select("tree", *more, F.col("f.r.rank").alias("rank"), *[F.col("f.r")[c].alias(c) for c in own], "f.path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with a path's siblings."""
    side = lambda s, mark: F.when(s.startswith(mark), F.substring(s, 2, 64)).otherwise("")
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(side(s, "<"), acc, side(s, ">")).cast("binary"), 256))


def siblings_digest(path: Column) -> Column:
    """The digest of a path's siblings, those that are there."""
    return digest(F.array_join(F.transform(path, lambda s: F.substring(s, 2, 64)), ""))


def prove(leaves: DataFrame) -> DataFrame:
    """`leaves` (tree, rank, n, leaf, ...) with subroot, root and path, the siblings from the leaf up to the root."""
    strata = build(leaves.select("tree", "rank", "n", F.col("leaf").alias("node")))
    subroots = stored(ordered(strata[-1].where("no = 0").select(F.col("tree").alias("own"), "node"), ["own"], rank="rank").select(F.lit(TOP).alias("tree"), "*"))
    upper = build(subroots.withColumn("n", F.lit(subroots.count()).cast("long")))
    top = upper[-1].where("no = 0").select("tree", "node")
    root = top.first()
    begin = descend(upper, top.withColumn("above", F.array().cast("array<string>")), subroots.select("tree", "rank", "own", F.col("node").alias("subroot")))
    begin = stored(begin.select(F.col("own").alias("tree"), F.col("subroot").alias("node"), F.reverse("path").alias("above"), "subroot"))
    return descend(strata, begin, leaves.drop("n")).withColumn("root", F.lit(root["node"] if root else None).cast("string"))


def manifest_report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    Rows whose id's CRC-32 is divisible by 7 (a null id has none) are tampered with: one is added to n_chars, a null
    stays. folded_root comes from the leaf as it then is and the original siblings. A null column is "-" in the leaf;
    repeated rows are leaves of their own, next to each other; an empty table gives no rows. Columns beyond FIELDS are
    not read. A leaf takes one pass over its text, of any length.
    """
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    leaves = leaves_of(docs, {"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    found = prove(stored(leaves))
    got = found.withColumn("folded_root", folded(F.coalesce("changed_leaf", "leaf"), F.col("path")))
    return got.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
