"""URL filters: host and path rules, and exact host membership by a cascade of Bloom filters.

Level 1 encodes the listed keys; level 2 encodes the keys of the corpus that level 1 takes for listed though they aren't;
level 3 those listed keys that level 2 would lose again, and so on until a level has no false positive left among the
keys it is tested on. Since the levels are built over every key that the corpus has, the answer for each of these keys is
exact, and no list of keys is joined to the corpus.

Keys are dealt to blocks by hash, each with a cascade of its own of bounded size. Levels that fit into an expression are
constants of it; larger ones are a table of one row a block, in which a page finds its block's bits by the block's number.
Where that table is too large for a broadcast, every distinct key of the corpus finds its block, once, and brings the answer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bloom_positions, bloom_words, constant_longs, free_name, materialize, own_columns, renamed

# Fixed values of the contract: rules as (host, path, verdict).
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
#: Host labels that put a host on the list of the registered query.
LISTED_LABELS = ["spam-farm", "cheap-pills", "casino-win"]

BITS_PER_KEY = 12
#: Largest sum of the levels' bytes that is put into an expression, and that is broadcast as a table of blocks.
MAX_BYTES, MAX_BROADCAST = 4 << 20, 64 << 20
#: Listed keys of a block, on average: its cascade is some 50 KB.
BLOCK_KEYS = 1 << 15
BLOCK_SEED = 1 << 20


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null. A rule fits its host and all subdomains."""
    found = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if found is None else found


def _holds(key: Column, words: Column, n_words: int, seed: int) -> Column:
    """Whether the Bloom filter in an array of so many 64-bit words has the key."""
    every = F.lit(True)
    for at in bloom_positions(key, 64 * n_words, seed):
        every = every & (F.getbit(F.get(words, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1)
    return every


def _answer(key: Column, levels: list[Column], sizes: list[int]) -> Column:
    """Whether the key is listed, by the levels' words and their numbers of words. Null keys are not."""
    answer = F.lit(len(levels) % 2 == 1)
    for level in reversed(range(len(levels))):
        answer = F.when(~_holds(key, levels[level], sizes[level], level), F.lit(level % 2 == 1)).otherwise(answer)
    return F.coalesce(key.isNotNull() & answer, F.lit(False))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(BLOCK_SEED), key), F.lit(blocks)).cast("int")


class Cascade:
    """Levels of a Bloom filter cascade, in constants or in a table of blocks; exact for every key that it was built over."""

    def __init__(self, sizes: list[int], constants: list[list[int]] | None = None, table: DataFrame | None = None, blocks: int = 1, most: int = MAX_BROADCAST):
        self.sizes, self.constants, self.table, self.blocks, self.most = sizes, constants, table, blocks, most

    def mark(self, rows: DataFrame, key: str, out: str) -> DataFrame:
        """`rows` with a boolean column `out`: whether the key is listed."""
        if self.table is None:
            return rows.withColumn(out, _answer(F.col(key), [constant_longs(w) for w in self.constants], self.sizes))
        if 8 * self.blocks * sum(self.sizes) <= self.most:
            return self._answered(rows, key, out, F.broadcast)
        # each distinct key finds its block once; the keys of very many rows bring their answer by a broadcast, so that no
        # key's rows meet in one task, and no row carries a block's bits
        many, own, told = renamed(rows, "_many", "_key", "_told")
        keys = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(own)).agg(F.count("*").alias(many))
        answers = materialize(self._answered(keys, own, told, lambda t: t).select(own, many, told))
        heavy = F.broadcast(answers.where(F.col(many) >= max(1000, -(-rows.count() // 1000))).select(own, told))
        same = F.col(key) == F.col(own)
        often = rows.join(heavy, same).select(*own_columns(rows), F.col(told).alias(out))
        rest = rows.join(heavy, same, "left_anti").join(answers.select(own, told), same, "left")
        return often.unionByName(rest.select(*own_columns(rows), F.coalesce(told, F.lit(False)).alias(out)))

    def _answered(self, rows: DataFrame, key: str, out: str, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
        at = free_name(rows, "_block")
        names = [free_name(rows, f"_level{i}") for i in range(len(self.sizes))]
        joined = rows.withColumn(at, F.coalesce(_block(F.col(key), self.blocks), F.lit(0))).join(near(self.table.toDF(at, *names)), at, "left")
        return joined.withColumn(out, _answer(F.col(key), [F.col(n) for n in names], self.sizes)).drop(at, *names)


def _level(keys: DataFrame, blocks: int, words: int, seed: int) -> DataFrame:
    """(block, words): a Bloom filter of the keys of every block, in so many 64-bit words."""
    at = keys.select("block", F.explode(F.array(*bloom_positions(F.col("key"), 64 * words, seed))).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    found = at.groupBy("block", F.floor(F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    told = found.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("w"))
    every = keys.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block")).join(told, "block", "left")
    # laid out by the difference of neighbours, so that a word is written once
    gaps = F.transform("w", lambda x, i: F.concat(F.array_repeat(F.lit(0).cast("long"), x["word"] - F.coalesce(F.get("w", i - 1)["word"], F.lit(-1)) - 1), F.array(x["bits"])))
    full = F.flatten(F.coalesce(gaps, F.array().cast("array<array<bigint>>")))
    return every.select("block", F.concat(full, F.array_repeat(F.lit(0).cast("long"), F.lit(words) - F.size(full))).alias("words"))


def build_cascade(listed: DataFrame, universe: DataFrame, bits_per_key: int = BITS_PER_KEY, max_bytes: int = MAX_BYTES, block_keys: int = BLOCK_KEYS, most_broadcast: int = MAX_BROADCAST) -> Cascade:
    """The cascade for one-column frames of listed keys and of all keys of the corpus.

    Null keys are left out, repeated keys count once, an empty list gives a cascade without levels. Where level 1 fits
    into half of max_bytes, what reaches the driver is one word for 64 bits. Else nothing does but counts.
    """
    one = lambda df, mark: df.toDF("key").select(F.col("key").cast("string"), F.lit(mark).alias("listed")).where("key is not null")
    both = one(universe, False).unionByName(one(listed, True)).groupBy("key").agg(F.max("listed").alias("listed"))
    keys = materialize(both)
    n = keys.where("listed").count()
    blocks = 1 if n * bits_per_key // 8 <= max_bytes // 2 else -(-n // block_keys)
    keys = keys.withColumn("block", _block(F.col("key"), blocks))
    encode, test, sizes, constants, table = keys.where("listed"), keys.where("not listed"), [], [], None
    while (most := encode.groupBy("block").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0):
        level, words = len(sizes), most * bits_per_key // 64 + 1
        sizes.append(words)
        if blocks == 1:
            constants.append(bloom_words(encode.select("key"), words, seed=level))
            hit = test.where(_holds(F.col("key"), constant_longs(constants[-1]), words, level))
        else:
            bits = materialize(_level(encode, blocks, words, level))
            table = bits.withColumnRenamed("words", "level0") if table is None else table.join(bits.withColumnRenamed("words", f"level{level}"), "block")
            hit = test.join(bits, "block").where(_holds(F.col("key"), F.col("words"), words, level)).drop("words")
        encode, test = materialize(hit), encode
    return Cascade(sizes, constants if table is None else None, table if table is None else materialize(table), blocks, most_broadcast)


def with_listed(rows: DataFrame, key: str, listed: DataFrame, out: str, **options) -> DataFrame:
    """`rows` with a boolean column `out`: whether the row's key is in the one-column frame `listed`."""
    return build_cascade(listed, rows.select(key), **options).mark(rows, key, out)


def listed_hosts(pages: DataFrame, url_col: str = "url", labels: list[str] = LISTED_LABELS) -> DataFrame:
    """The distinct hosts of the pages that have one of the labels: the list of the registered query. A null url has an empty host, which has none."""
    return pages.select(host_of(F.col(url_col)).alias("host")).where(F.arrays_overlap(F.split("host", r"\."), F.array(*[F.lit(x) for x in labels]))).distinct()


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES, url_col: str = "url", id_col: str = "page_id", **options) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of `pages`.

    The rule's verdict holds; without a rule a listed host is blocked and any other allowed. A null url, or one without
    ://, has an empty host and path and is allowed. Repeated rows get the same verdict each; an empty table gives none.
    """
    split = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    judged = with_listed(split, "host", listed, "_on_list", **options).withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    return judged.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), F.when(F.col("_on_list"), "block").otherwise("allow")).alias("verdict"))
