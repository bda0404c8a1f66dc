"""How good a search is: threshold sweeps and counters of its answers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import vectors
from gleaner.operators.semantic import TILE, matrix, query_blocks


def threshold_sweep(scored: DataFrame, low: int = 45, high: int = 75) -> DataFrame:
    """``scored`` (similarity, relevant boolean) to precision, found_share and F1 at each threshold in hundredths.

    One pass: rows are counted by the highest threshold they reach, then summed from above."""
    step = F.greatest(F.lit(low - 1), F.least(F.lit(high), F.floor(F.round(F.col("similarity") * 100, 9)).cast("int")))
    reached = scored.groupBy(step.alias("step")).agg(F.count_if("relevant").alias("right"), F.count_if(~F.col("relevant")).alias("off"))
    steps = scored.sparkSession.range(low - 1, high + 1).select(F.col("id").cast("int").alias("step"))
    above = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = steps.join(reached, "step", "left").fillna(0).withColumn("found", F.sum("right").over(above)).withColumn("wrong", F.sum("off").over(above))
    rows = rows.withColumn("total", F.max("found").over(Window.partitionBy())).where(F.col("step") >= low)
    precision, found_share = F.col("found") / F.greatest(F.col("found") + F.col("wrong"), F.lit(1)), F.col("found") / F.greatest(F.col("total"), F.lit(1))
    rows = rows.withColumn("precision", precision).withColumn("found_share", found_share)
    return rows.select((F.col("step") / 100.0).alias("threshold"), "found", "wrong", "precision", "found_share", (2 * F.col("precision") * F.col("found_share") / F.greatest(F.col("precision") + F.col("found_share"), F.lit(1.1920929e-07))).alias("f1"))


def answer_quality(scored: DataFrame) -> DataFrame:
    """``scored`` (query_id, doc_id, similarity, relevant): right and wrong answers under the match rule, queries whose
    best is right, and answers to queries that have none."""
    by = Window.partitionBy("query_id")
    rows = scored.withColumn("best", F.max("similarity").over(by)).withColumn("any", F.max(F.col("relevant").cast("int")).over(by)).withColumn("nth", F.row_number().over(by.orderBy(F.desc("similarity"), "doc_id")))
    hit = vectors.is_match(F.col("similarity"), F.col("best"))
    return rows.agg(F.count_if(hit & F.col("relevant")).alias("found"), F.count_if(hit & ~F.col("relevant")).alias("wrong"), F.count_if((F.col("nth") == 1) & F.col("relevant")).alias("top_right"), F.count_if(hit & (F.col("any") == 0)).alias("unrelated"))


#: How near a match must be, and how near to the best.
NEAR, BEHIND = np.float32(0.55), np.float32(0.06)


def _tiles(stored: DataFrame, queries: DataFrame, columns: str, start, each, end) -> DataFrame | None:
    """``stored`` (id, label, embedding) against ``queries`` (query_id, label, vector, and more), a tile at a time:
    ``each(state, k, ids, sims, right)`` for a batch and the queries from the k-th, then the rows of ``end(state)`` of
    each task. A pair is right if its labels agree; a row is no pair with the query of its own id. Pairs stay in tasks."""
    rows = None
    for block in query_blocks(queries):
        wanted = matrix(block["vector"].combine_chunks())
        own, labels = block["query_id"].to_numpy(), block["label"].to_numpy()

        def run(batches: Iterator[pa.RecordBatch], block=block, wanted=wanted, own=own, labels=labels) -> Iterator[pa.RecordBatch]:
            state = start(block)
            for batch in batches:
                ids, told = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
                held = matrix(batch.column(2), wanted.shape[1])
                width = max(1, TILE // max(1, len(ids)))
                for k in range(0, len(own), width):
                    sims = held @ wanted[k : k + width].T
                    sims[~np.isfinite(sims) | (ids[:, None] == own[None, k : k + width])] = -np.inf
                    each(state, k, ids, sims, told[:, None] == labels[None, k : k + width])
            yield from end(state)

        part = stored.where("id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").select(F.col("id").cast("long"), F.col("label").cast("long"), "embedding").mapInArrow(run, columns)
        rows = part if rows is None else rows.unionByName(part)
    return rows


def histogram(stored: DataFrame, queries: DataFrame, low: int = 45, high: int = 75) -> DataFrame:
    """(step, right, wrong): pairs by the highest threshold, in hundredths, that their similarity reaches."""
    size = high - low + 2

    def each(counts, k, ids, sims, right):
        step = np.clip(np.floor(np.round(np.maximum(sims, -9.0) * 100, 9)), low - 1, high).astype(np.int64) - low + 1
        real = sims > -np.inf
        counts[0] += np.bincount(step[real & right], minlength=size)
        counts[1] += np.bincount(step[real & ~right], minlength=size)

    def end(counts):
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(low - 1, high + 1), pa.int32()), pa.array(counts[0]), pa.array(counts[1])], ["step", "right", "wrong"])

    rows = _tiles(stored, queries, "step int, right long, wrong long", lambda _: np.zeros((2, size), np.int64), each, end)
    return rows.groupBy("step").agg(F.sum("right").alias("right"), F.sum("wrong").alias("wrong"))


def sweep(counts: DataFrame, low: int = 45, high: int = 75) -> DataFrame:
    """``histogram`` to precision, found_share and F1 at each threshold."""
    steps = counts.sparkSession.range(low - 1, high + 1).select(F.col("id").cast("int").alias("step"))
    above = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # 32 rows
    rows = steps.join(counts, "step", "left").fillna(0).withColumn("found", F.sum("right").over(above)).withColumn("off", F.sum("wrong").over(above))
    rows = rows.withColumn("total", F.max("found").over(Window.partitionBy())).where(F.col("step") >= low)
    precision, share = F.col("found") / F.greatest(F.col("found") + F.col("off"), F.lit(1)), F.col("found") / F.greatest(F.col("total"), F.lit(1))
    f1 = 2 * precision * share / F.greatest(precision + share, F.lit(1.1920929e-07))
    return rows.select((F.col("step") / 100.0).alias("threshold"), "found", F.col("off").alias("wrong"), precision.alias("precision"), share.alias("found_share"), f1.alias("f1"))


def bests(stored: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, best, top_right, has_right) of each query with any pair: its best similarity, whether the best row (of
    equal ones the least id) is right, and whether there is a right one at all."""

    def start(block):
        n = block.num_rows
        return [block["query_id"].to_numpy(), np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max), np.zeros(n, bool), np.zeros(n, bool)]

    def each(state, k, ids, sims, right):
        _, best, first, top, some = state
        some[k : k + sims.shape[1]] |= (right & (sims > -np.inf)).any(axis=0)
        for q in range(sims.shape[1]):
            high = sims[:, q].max(initial=-np.inf)
            if high > -np.inf and high >= best[k + q]:
                at = np.flatnonzero(sims[:, q] == high)
                at = at[np.argmin(ids[at])]
                if high > best[k + q] or ids[at] < first[k + q]:
                    best[k + q], first[k + q], top[k + q] = high, ids[at], right[at, q]

    def end(state):
        ids, best, first, top, some = state
        found = best > -np.inf
        yield pa.RecordBatch.from_arrays([pa.array(x[found]) for x in (ids, best, first, top, some)], ["query_id", "best", "first", "top", "some"])

    rows = _tiles(stored, queries, "query_id long, best double, first long, top boolean, some boolean", start, each, end)
    return rows.groupBy("query_id").agg(F.max("best").alias("best"), F.max(F.struct("best", -F.col("first"), "top")).alias("t"), F.bool_or("some").alias("has_right")).select("query_id", "best", F.col("t.top").alias("top_right"), "has_right")


def quality(stored: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: right and wrong answers under the match rule, queries whose best is right, answers to queries that have
    no right one. Two passes over the tiles: each query's best first, then what is near enough to it."""
    best = bests(stored, queries)

    def start(block):
        return [block["best"].to_numpy().astype(np.float32), block["has_right"].to_numpy(), np.zeros(3, np.int64)]

    def each(state, k, ids, sims, right):
        best, has_right, counts = state
        width = sims.shape[1]
        single = sims.astype(np.float32)
        hit = (single >= NEAR) & (single >= best[None, k : k + width] - BEHIND)
        counts += [int((hit & right).sum()), int((hit & ~right).sum()), int((hit & ~has_right[None, k : k + width]).sum())]

    def end(state):
        yield pa.RecordBatch.from_arrays([pa.array([int(c)]) for c in state[2]], ["found", "wrong", "unrelated"])

    hits = _tiles(stored, queries.join(best, "query_id"), "found long, wrong long, unrelated long", start, each, end)
    top = best.agg(F.count_if("top_right").alias("top_right"))
    return hits.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("found", "wrong", "unrelated"))).join(F.broadcast(top)).select("found", "wrong", "top_right", "unrelated")
