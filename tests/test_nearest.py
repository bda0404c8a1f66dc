"""Nearest vectors: odd values, ties and blocks of queries, all against one brute force."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.functions import vectors as vector_functions
from gleaner.operators import semantic
from gleaner.sources.scratch import written


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(rng.integers(-3, 4, (900, 6)))]  # many ties
    odd = {10: [float("nan")] * 6, 11: [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0], 12: [0.0] * 5 + [float("nan")], 13: None, 14: [1.0, None, 2.0, 0.0, 0.0, 0.0], 15: [], 16: [3.0, 3.0], 17: [float("-inf")] * 6}
    return [(k, odd.get(k, v) if k in odd else v) for k, v in rows]


def brute(vectors, asked, limit):
    def padded(v):
        return np.array([x or 0.0 for x in v] + [0.0] * (6 - len(v)))

    out = {}
    for q, w in asked:
        if w is None:
            continue
        with np.errstate(invalid="ignore"):
            sims = [(float(padded(v) @ padded(w)), k) for k, v in vectors if v is not None]
        best = sorted(((-s, k) for s, k in sims if np.isfinite(s)))[:limit]
        out |= {(q, k + 1): (c, -s) for k, (s, c) in enumerate(best)}
    return out


@pytest.mark.parametrize("limit", [1, 10, 2000])
@pytest.mark.parametrize(("sent", "tile"), [(1 << 22, 1 << 22), (60, 1 << 22), (1 << 22, 100), (40, 1)])
def test_both_paths_against_brute_force(spark, monkeypatch, vectors, limit, sent, tile):
    monkeypatch.setattr(semantic, "SENT", sent)
    monkeypatch.setattr(semantic, "TILE", tile)
    if tile < 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        asked = [(k, v) for k, v in vectors[:30]]
        stored = spark.createDataFrame(vectors, "chunk_id long, embedding array<double>").repartition(3)
        queries = spark.createDataFrame(asked, "query_id long, vector array<double>")
        plan = semantic.nearest(stored, queries, limit)
        got = {(r.query_id, r["rank"]): (r.chunk_id, r.similarity) for r in plan.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(vectors, asked, limit)
    assert "CartesianProduct" not in plan._jdf.queryExecution().toString()


def test_one_nan_takes_no_place(spark):
    rows = spark.range(1000).select(F.col("id").alias("chunk_id"), F.when(F.col("id") == 5, F.array(F.lit(float("nan")), F.lit(0.0))).otherwise(F.array(F.col("id") / 1000, F.lit(1.0))).alias("embedding"))
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [r.chunk_id for r in semantic.nearest(rows, asked, 10).orderBy("rank").collect()] == list(range(999, 989, -1))
    assert semantic.nearest(rows, asked.where("false"), 10).count() == 0
    assert semantic.nearest(rows.where("false"), asked, 10).count() == 0


def test_models_do_not_mix(spark):
    rows = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [1.0, 0.0]), (3, "a", [1.0])], "chunk_id long, model string, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [r.chunk_id for r in semantic.nearest(rows, asked, 10, "a", 2).collect()] == [1]


def test_an_embedding_is_computed_once(spark):
    """a filter on an embedding that is not stored computed it twice, in one more worker a task."""
    texts = spark.createDataFrame([(k, None if k == 3 else f"garden budget {k}") for k in range(20)], "chunk_id long, text string")
    stored = texts.select("chunk_id", vector_functions.hash_embedding(F.col("text")).alias("embedding"))
    asked = spark.createDataFrame([(1, [1.0] * 64)], "query_id long, vector array<double>")
    for dimensions, want in ((None, 19), (64, 19), (63, 0)):
        plan = semantic.nearest(stored, asked, 50, dimensions=dimensions)
        physical = plan._jdf.queryExecution().executedPlan().toString()
        assert physical.count("ArrowEvalPython") == 1
        assert plan.count() == want


def test_few_hits_shuffle_no_texts(spark, tmp_path):
    """all texts were shuffled to meet the hits. The texts' table is over the limit of a broadcast, the hits' is not."""
    spark.range(3000).selectExpr("id AS chunk_id", "id AS document_id", "CAST(null AS int) AS page_number", "concat('garden ', id, repeat(uuid(), 200)) AS text").write.parquet(f"{tmp_path}/chunks")
    chunks = spark.read.parquet(f"{tmp_path}/chunks")
    ids = chunks.select("document_id", F.col("document_id").alias("file_id"))
    files = ids.select("file_id", F.lit("/").alias("path"), F.lit("text").alias("kind"))
    stored = chunks.select("chunk_id", vector_functions.hash_embedding(F.substring("text", 1, 10)).alias("embedding"))
    asked = spark.createDataFrame([(1, "garden 7")], "query_id long, query string").select("query_id", vector_functions.hash_embedding(F.col("query")).alias("vector"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "512k")
    try:
        found = semantic.search(stored, chunks, ids, files, asked, keep=written)
        lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
        at = next(k for k, line in enumerate(lines) if "FileScan parquet" in line and "text#" in line)
        depth = lambda line: re.search(r"[A-Za-z]", line).start()
        above = next(line for line in reversed(lines[:at]) if depth(line) < depth(lines[at]) and "Join" in line)
        between = [line for line in lines[lines.index(above) : at] if "Exchange hashpartitioning(chunk_id" in line]
        assert "BroadcastHashJoin" in above and not between
        assert found.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_worker_keeps_few_words(monkeypatch):
    """a worker kept a million words, so its memory grew with the texts."""
    monkeypatch.setattr(vector_functions, "MOST_KNOWN", 10)
    monkeypatch.setattr(vector_functions, "_KNOWN", vector_functions.Buckets())
    texts = [" ".join(f"Word{k * j}s of é éé ab" for j in range(40)) for k in range(5)] + [None, "", "of"]
    got = vector_functions.hash_vectors(pa.array(texts)).to_pylist()
    assert len(vector_functions._KNOWN) <= 10
    for text, vector in zip(texts, got):
        if text is None:
            assert vector is None
            continue
        counts = np.zeros(64)
        for w in text.split():
            if len(w.encode()) > 2:
                h = 0xCBF29CE484222325
                for byte in w.lower().removesuffix("s").encode():
                    h = (h ^ byte) * 0x100000001B3 % (1 << 64)
                counts[h % 64] += 1
        assert np.allclose(vector, counts / max(1, np.linalg.norm(counts)))
