"""Merkle manifest, license scan and phrase mining against plain models, on awkward rows and on very long texts."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lectern.llm import chat_format, collocations, exact_dedup, jaccard_join, licenses, line_dedup, merkle_manifest, mixing, piece_sampling, quality_rules, secret_scan

MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including'
NAMES = "tree leaf rank n path no area node rid at name key words lookups hits".split()


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    return df.select("*", *[F.lit(k).alias(n) for k, n in enumerate(NAMES) if n != "n"])


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def siblings(levels, at):
    return [(level[(at >> k) ^ 1] if (at >> k) ^ 1 < len(level) else None, (at >> k) & 1) for k, level in enumerate(levels[:-1])]


def plain_manifest(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for rows_ in groups.values():
        rows_.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {lang: tree([leaf(r) for r in groups[lang]]) for lang in langs}
    top = tree([trees[lang][-1][0] for lang in langs])
    for k, lang in enumerate(langs):
        for at, row in enumerate(groups[lang]):
            path = siblings(trees[lang], at) + siblings(top, k)
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None
            folded = leaf((*row[:3], row[3] + 1, row[4])) if hit else leaf(row)
            for s, right in path:
                folded = H(folded) if s is None else H(s, folded) if right else H(folded, s)
            yield (row[0], leaf(row), trees[lang][-1][0], top[-1][0], H(*[s for s, _ in path if s]), folded, folded == top[-1][0])


@pytest.mark.parametrize("many", [0, 1, 2, 3, 700])
def test_manifest(spark, many):
    rows = [(i, "s", "en", i * 7 % 5 if i % 4 else None, f"text {i}") for i in range(many)]
    if many > 2:
        rows += [(5, "s", None, 3, "no lang"), (5, "s", None, 3, "no lang"), (None, None, None, None, None), (None, None, None, None, None), (9, "s", "", 1, ""), (9, "t", "", 1, "Été\n"), (77, None, "zz", None, None), (2, "again", "en", 4, "same id")]
    got = merkle_manifest.manifest_report(frame(spark, rows)).collect()
    told = lambda xs: sorted(map(str, xs))
    assert told(tuple(r) for r in got) == told(plain_manifest(rows))


def test_a_part_of_the_leaves_is_proved(spark):
    leaves = merkle_manifest.leaves_of(frame(spark, [(i, "s", "en" if i % 3 else "de", 1, f"t{i}") for i in range(900)]))
    strata = merkle_manifest.build(leaves.select("tree", "rank", "n", F.col("leaf").alias("node")))
    roots = strata[-1].where("no = 0").select("tree", "node", F.array().cast("array<string>").alias("above"), F.col("node").alias("root"))
    got = merkle_manifest.descend(strata, roots, leaves.where("rank % 50 = 7").select("tree", "rank", "leaf"))
    assert got.count() == 18 and got.where(merkle_manifest.folded(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w]


def plain_scores(texts):
    """{template: (score, held)} of each text: every place is tried, and every word of the index."""
    vocabulary = {w for t in [t for _, t, _ in licenses.TEMPLATES] + [p for _, p in licenses.PHRASES] for w in words(t)}
    n = Counter(w for t in texts for w in set(words(t)))
    idf = {w: math.log(1 + (len(texts) + 1) / (n[w] + 1)) for w in vocabulary}
    for text in texts:
        found, own = {}, words(text)
        for label, t, keys in licenses.TEMPLATES:
            index = sorted(enumerate(words(t)), key=lambda x: (-idf[x[1]], x[1], x[0]))[: licenses.INDEXED]
            total, best, held = sum(idf[w] for _, w in index), 0.0, False
            for begin in range(-len(words(t)), len(own)):
                score = sum(idf[w] for at, w in index if 0 <= begin + at < len(own) and own[begin + at] == w) / total
                if score >= licenses.LEAST:
                    lo = max(0, begin - licenses.SLACK)
                    held |= all(f" {k} " in f" {' '.join(own[lo : lo + len(words(t)) + 2 * licenses.SLACK])} " for k in keys)
                    best = max(best, score)
            if best:
                found[label, t] = (round(best, 9), held)
        yield found


def test_licenses(spark):
    texts = [
        "under the MIT License, under-the-mit-license", "Licensed under the Apache License, Version 2.0. Or CC BY-NC", MIT, MIT.replace("free of charge", "for a fee"), MIT.replace("copy", "text").replace("person", "body"), None, "", " \n",
        "This work is licensed under the GNU General Public License, version 3.", "This work is licensed under the GNU Lesser Public License, version 3.", "license " * 50, "été undеr the mit license Kelvin cc by nc", "apache license version 2",
        "x " * 30 + licenses.TEMPLATES[2][1] + " y" * 30, licenses.TEMPLATES[0][1] + " " + licenses.TEMPLATES[0][1],
    ]
    df = frame(spark, [(i, None, None, None, t) for i, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in licenses.license_report(df).collect()}
    for i, (text, found) in enumerate(zip(texts, plain_scores(texts))):
        own, r = words(text), got[i]
        places = {label: [k for k in range(len(own)) if own[k : k + len(p.split())] == p.split()] for label, p in licenses.PHRASES}
        every = sorted(k for v in places.values() for k in v)
        base = sorted(label for label, v in places.items() if v)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(own), len(every), min(every, default=None), max(every, default=None), ",".join(base)), text
        assert r["labels"] == ",".join(sorted({*base, *(label for (label, _), (_, held) in found.items() if held)})), text
        assert r["score"] == (1.0 if every else pytest.approx(max((s for s, _ in found.values()), default=0.0))), text
    assert got[2]["labels"] == "mit" and got[3]["labels"] == "" and got[8]["labels"] == "gpl-3" and licenses.license_report(df.where("doc_id < 0")).count() == 0


def plain_phrases(rows, least, top):
    counts = defaultdict(Counter)
    for _, _, lang, _, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if c.isascii() else c for c in text or "")):
            ws = tuple(w for w in re.split(r"[ \t]+", piece) if w)
            counts[lang or "und"].update(ws[i : i + k] for k in range(1, 5) for i in range(len(ws) - k + 1))
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        found = []
        for p, a in cand.items():
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if 100 * inside[p] < 80 * a:
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            yield (lang, rank, p.decode(), -a, left, right, sum(n for q, n in f.items() if len(q) == 1), -s)


@pytest.mark.parametrize("most_keys", [collocations.MOST_KEYS, 0])
def test_phrases(spark, most_keys):
    rows = [(1, None, "en", 1, "A b c, d a b c.\tA  b\x0bc d e\n!!\n;, a b c"), (2, None, "en", 1, "a b c d " * 6 + "x\xa0y x\xa0y Été été"), (3, None, None, 1, "p p p p p p q\r\nq . q"), (4, None, "und", 1, "p p P q q q"), (5, None, "de", 1, None), (6, None, "fr", 1, " . \n"), (2, None, "en", 1, "z z z")]
    got = [tuple(r) for r in collocations.collocations(frame(spark, rows), top=5, least=3, most_keys=most_keys).collect()]
    want = list(plain_phrases(rows, 3, 5))
    assert sorted(got) == sorted(want) and len(want) > 5
    assert collocations.collocations(frame(spark, rows[:0])).count() == 0 and collocations.collocations(frame(spark, rows[:1]), least=1000).count() == 0


def test_very_long_texts(spark):
    """A text of some 5 MB with 200,000 lines, matches and words that recur goes through in seconds, and nothing in it is lost."""
    token = lambda i: hashlib.md5(str(i).encode()).hexdigest()[:24]
    long = "\n".join(f"{token(i)} under the mit license" for i in range(100_000)) + "\n" + "\n".join(f"line {i} of many more" for i in range(100_000))
    rows = [(1, "s", "en", 1, long), (2, "s", "en", 1, long), (3, "s", "en", 1, "x")]
    df = frame(spark, rows).cache()
    took = {}

    def timed(name, rows):
        began = time.time()
        out = rows.collect()
        took[name] = time.time() - began
        return out

    spans = {r["doc_id"]: r for r in timed("op2", secret_scan.secrets_report(df))}
    assert spans[1]["n_hex"] == sum(re.fullmatch("[0-9a-f]{24}", token(i)) is not None for i in range(100_000)) == spans[2]["n_hex"]
    assert {r["doc_id"]: r["n_dropped"] for r in timed("op3", line_dedup.line_report(df))} == {1: 0, 2: 200_000, 3: 0}
    assert all(r["verified"] for r in timed("op11", merkle_manifest.manifest_report(df)) if zlib.crc32(str(r["doc_id"]).encode()) % 7)
    assert {r["n_base"] for r in timed("op12", licenses.license_report(df))} == {100_000, 0}
    assert {r["phrase"]: r["a"] for r in timed("op13", collocations.collocations(df))}["under the mit license"] == 200_000
    assert {r["doc_id"]: r["kept"] for r in timed("op1", exact_dedup.exact_duplicates(df))} == {1: True, 2: False, 3: True}
    assert {r["doc_id"]: r["n_words"] for r in timed("op5", quality_rules.judge(df, df.where("doc_id = 3").select("doc_id")))} == {1: 1_000_000, 2: 1_000_000, 3: 1}
    assert {r["doc_id"]: r["component_id"] for r in timed("op7", jaccard_join.component_report(df))} == {1: 1, 2: 1, 3: 3}
    assert all(r["lossless"] for r in timed("op8", piece_sampling.pieces_report(df)))
    assert {r["size"] for r in timed("op9", mixing.mixing_report(df))} == {1_000_000, 1}
    turns = df.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), "text")
    assert {r["loss_chars"] for r in timed("op10", chat_format.chat_report(turns))} == {len(long), 1}
    assert max(took.values()) < 120, took


def test_phrases_pass_the_driver_packed(spark, monkeypatch):
    """The driver gets packed keys, no row of a key, and no join broadcasts a table by the bytes of its files."""
    from pyspark.sql import DataFrame

    keys = spark.createDataFrame([(i * 7919 % 1000 - 500,) for i in range(1000)], "key long").repartition(5)
    monkeypatch.setattr(DataFrame, "toPandas", None)
    assert collocations._sorted_keys(keys).tolist() == sorted(range(-500, 500)) and collocations._sorted_keys(keys.limit(0)).tolist() == []
    rows = [(i, None, "en", 1, "a b c d " * 6) for i in range(3)]
    monkeypatch.setattr("lectern.llm.common.MOST_BROADCAST", 0)
    found, _ = collocations.frequent_phrases(frame(spark, rows), least=3)
    plan = collocations._covers(found, 2)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
