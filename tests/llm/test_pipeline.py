"""The pipeline, stage by stage, against brute force on the given documents and some awkward rows."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import piece_sampling
from tests.oracle import SF

WS = r"[\x20\x09-\x0D]"
PROSE = " ".join(f"word{i % 37} of{i % 11} line{i}" for i in range(2000))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = words(w)
    return {tuple(w)} - {()} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """[documents, rows after the first stage, ...], each stage written and read again."""
    folder = tmp_path_factory.mktemp("corpus")
    given = spark.read.parquet(f"{SF}/documents.parquet")
    more = [(-1, None, "s1"), (-2, "", None), (-3, PROSE, None), (-4, PROSE.replace(" ", "\t ", 40), "s1"), (-5, PROSE + " end", "s1"), (None, PROSE + " tail of a row without id", "s1"), (-6, "a b", "s1")]
    extra = spark.createDataFrame(more, "doc_id long, text string, source string")
    docs = given.unionByName(extra.withColumn("doc_id", F.col("doc_id").cast(given.schema["doc_id"].dataType)), allowMissingColumns=True)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    found = [spark.read.parquet(f"{folder}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, found[-1], str(folder)).write.parquet(f"{folder}/stage{k}")
        found.append(spark.read.parquet(f"{folder}/stage{k}"))
    return str(folder), found


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_quality_drops_what_fails(steps):
    before, after = (Counter(pairs(df)) for df in steps[1][:2])
    assert not after - before and after
    for _, text in after:
        assert len(words(text)) >= 20
    assert all((i, t) not in after for i, t in before if len(words(t)) < 20)


def test_exact_keeps_the_smallest_id_of_each_text(steps):
    before, after = (pairs(df) for df in steps[1][1:3])
    least = {}
    for i, t in before:
        key = re.sub(WS + "+", " ", t or "")
        least[key] = min((x for x in (i, least.get(key)) if x is not None), default=None)
    assert Counter((re.sub(WS + "+", " ", t or ""), i) for i, t in after) == Counter(least.items())


def test_near_keeps_one_of_each_component(steps):
    before, after = (pairs(df) for df in steps[1][2:4])
    sets = [shingles(t) for _, t in before]
    label = list(range(len(before)))

    def root(a):
        while label[a] != a:
            a = label[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                label[root(a)] = root(b)
    components = {}
    for k, row in enumerate(before):
        components.setdefault(root(k), []).append(row)
    left = Counter(after)
    assert sum(left.values()) == len(components) < len(before)
    assert all(sum(left[r] for r in set(group)) == 1 for group in components.values())


def test_mix_meets_the_targets(steps):
    before, after = ([(r["doc_id"], r["text"], r["source"]) for r in df.select("doc_id", "text", "source").collect()] for df in steps[1][3:5])
    assert set(after) <= set(before) and max(Counter(after).values()) <= 2
    total = sum(len(words(t)) for _, t, _ in before)
    assert abs(sum(len(words(t)) for _, t, _ in after) - 1.5 * total) <= 0.02 * 1.5 * total


def test_pieces_spell_the_texts(steps):
    before, after = steps[1][4:6]
    assert [c for c in before.columns if c != "text"] + ["pieces"] == after.columns
    back = piece_sampling.decode_pieces(after).select("doc_id", "text")
    assert Counter(pairs(back)) == Counter((i, t or "") for i, t in pairs(before))


def test_run_is_the_stages_in_turn(spark, steps):
    folder, found = steps
    told = lambda df: Counter((r["doc_id"], hashlib.sha256(str(r["pieces"]).encode()).hexdigest()) for r in df.select("doc_id", "pieces").collect())
    assert told(corpus_pipeline.run(spark, folder)) == told(found[-1])
