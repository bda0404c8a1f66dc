"""Toxicity: segments against brute force, planted passages found, clean texts left alone, odd tables."""

import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.llm import queries, toxicity


def brute_segments(scores):
    """All maximal segments by their definition: the best one, then those of what is left of it and right of it."""
    best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    a = -best[2]
    b = a - best[1]
    return brute_segments(scores[:a]) + [(best[0], a, b)] + [(s, x + b, y + b) for s, x, y in brute_segments(scores[b:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-6, 6), max_size=14))
def test_segments_against_brute_force(scores):
    got = toxicity.segments(np.array(scores, float))
    assert [s for s, _, _ in got] == [s for s, _, _ in brute_segments(scores)]
    assert all(sum(scores[a:b]) == s for s, a, b in got)


def test_segments_of_a_long_text_are_linear():
    scores = np.where(np.arange(1_000_000) % 2 == 0, 1.0, -1.001)
    assert len(toxicity.segments(scores)) == 500_000
    assert len(toxicity.segments(np.tile([1.0, -0.5], 500_000))) == 1


def test_decay():
    # A coin of +1 and -1: lambda is the log of the odds.
    assert math.isclose(toxicity.decay(np.array([1.0, -1.0]), np.array([1.0, 3.0])), math.log(3), rel_tol=1e-6)


CLEAN, BAD = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("ana", "oru", "ile", "emo")], ["zorgax", "vrutok", "zorgmin"]


def text(rng, bad):
    words = [rng.choice(CLEAN) for _ in range(rng.randint(30, 120))]
    if bad:
        at = rng.randrange(len(words))
        words[at:at] = [rng.choice(BAD) for _ in range(3)]
    return " ".join(words)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(7)
    rows = [(k, text(rng, k % 5 == 0)) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(1500)], "doc_id long, toxic int")
    return docs.repartition(5), labels


def test_planted_passages(spark, tables):
    docs, labels = tables
    model = toxicity.learn(docs, labels)
    got = {r.doc_id: r for r in toxicity.classify(docs, model).collect()}
    held = [k for k in got if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all((got[k].score >= 0.3) == (k % 5 == 0) for k in held)
    found = toxicity.passages(docs, model).collect()
    own = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in found} == {k for k in own if k % 5 == 0}
    for r in found:
        assert own[r.doc_id][r.start : r.end] == r.text and r.expected <= 0.01
    # A form that no document had is known by its parts.
    unseen = toxicity.classify(spark.createDataFrame([(1, "bana zorgaxmin zorgax ile"), (2, "bana dana fana")], "doc_id long, text string"), model).collect()
    assert unseen[0].score > 0.3 > unseen[1].score


def test_held_out_labels_and_ids_change_nothing(tables):
    docs, labels = tables
    flipped = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id"), 4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.learn(docs, labels) == toxicity.learn(docs, flipped)


def test_odd_rows_and_missing_labels(spark, tables):
    docs, labels = tables
    odd = [(9001, None), (9002, ""), (9003, " \t"), (9004, "zorgax vrutok zorgmin " * 60_000), (9005, "😀 !? ＡＢ"), (None, "bana"), (9006, "bana"), (9006, "bana")]
    more = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("score", F.lit("x")).withColumn("toxic", F.lit(1))
    told = labels.unionByName(spark.createDataFrame([(None, 1), (9001, 1), (9002, None), (77777, 1), (9006, 0), (9006, 1)], labels.schema))
    rows = toxicity.classify(more, toxicity.learn(more, told)).collect()
    assert len(rows) == more.count()
    by = {r.doc_id: r for r in rows}
    assert by[9001].score == by[9002].score == by[9003].score < 0.3 < by[9004].score
    assert all(0 <= r.score <= 1 for r in rows)
    assert [r.score for r in rows if r.doc_id == 9006] == [by[None].score] * 2
    none = toxicity.learn(docs, labels.where("false"))
    assert {r.score for r in toxicity.classify(docs, none).collect()} == {0.0}
    one = toxicity.learn(docs, labels.where("toxic = 1"))
    assert {r.score for r in toxicity.classify(docs, one).collect()} == {1.0}
    assert toxicity.classify(docs.where("false"), none).count() == 0
    assert toxicity.learn(docs.where("false"), labels).share == 0.0


def test_query(spark, sf):
    rows = queries.op11_toxicity(spark, sf)
    assert dict(rows.dtypes) | {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"} == dict(rows.dtypes)
    got = rows.collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for r in got)


def test_held_out_accuracy(spark):
    """On the labelled documents of the larger table that taught nothing."""
    found = queries.op11_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    rows = found.select("toxic", "predicted").collect()
    right = sum(r.toxic == r.predicted for r in rows)
    assert right / len(rows) > 0.95
