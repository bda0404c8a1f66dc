"""Exact top-k inner-product search by tiled matrix products.

Vectors become integers, floor(256 * x), and are packed, a few thousand to a block, as little-endian
integers of 2, 4 or 8 bytes (whatever holds them). A tile is a block of queries times a block of
candidates: one matrix product, from which each query keeps its k best by partial selection, ties to
the smaller id. Top lists merge as a tree: blocks of ``FAN`` tiles first, then of those, and so on;
each merge keeps k of a query, so no task sees more than ``FAN * k`` rows of one.

The tiles are the one place where every query meets every candidate, which the search asks for; it
happens a block at a time: tile numbers are paired, blocks are joined to them by number. Products
are exact while they stay below 2**53, and are taken in 32-bit floats only if the block's bounds
prove sums below 2**24.

Nulls: a vector that is null, or holds a null or a non-finite component, and one with a null id, take
no part. Components that a shorter vector lacks count as 0. A candidate is left out of the search of
its own id; rows that repeat an id are all left out, and count each as a candidate elsewhere. Fewer
candidates than k: all. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, materialize

QUERY_BLOCK, CANDIDATE_BLOCK, FAN = 2048, 16384, 32
PACKED = "block long, n int, dim int, width int, top double, ids binary, data binary"


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector as array<bigint-valued double>) of the rows that take part."""
    x = vectors[vector_col].cast("array<double>")
    sound = vectors[id_col].isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(sound).select(vectors[id_col].cast("long").alias("id"), x.alias("vector"))


def packed(vectors: DataFrame, per_block: int, blocks: int, scale: float) -> DataFrame:
    """Blocks of at most ``per_block`` vectors, numbered by task and turn."""

    def block(number: int, ids: list[np.ndarray], rows: list[np.ndarray]) -> pa.RecordBatch:
        dim = max(map(len, rows))
        data = np.zeros((len(rows), dim))
        for k, r in enumerate(rows):
            data[k, : len(r)] = np.floor(scale * r)
        top = float(np.abs(data).max(initial=0.0))
        kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8"
        values = [[number], [len(rows)], [dim], [data.astype(kind).itemsize], [top], [np.array(ids, "<i8").tobytes()], [data.astype(kind).tobytes()]]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], ["block", "n", "dim", "width", "top", "ids", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, rows = TaskContext.get().partitionId() << 32, [], []
        for batch in batches:
            lists = column(batch, "vector")
            flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
            for k, i in enumerate(column(batch, "id").to_pylist()):
                ids.append(i)
                rows.append(flat[at[k] : at[k + 1]])
                if len(rows) == per_block:
                    yield block(number, ids, rows)
                    number, ids, rows = number + 1, [], []
        if rows:
            yield block(number, ids, rows)

    return vectors.repartition(max(1, blocks)).mapInArrow(run, PACKED)


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    kind = {2: "<i2", 4: "<i4", 8: "<f8"}[row["width"]]
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["data"], kind).reshape(row["n"], row["dim"])


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id; -inf takes no part."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, tied = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        if len(tied) > k - len(above):
            tied = tied[np.argpartition(ids[tied], k - len(above) - 1)[: k - len(above)]] if k > len(above) else tied[:0]
        at = np.concatenate((above, tied))
    else:
        at = np.arange(len(scores))
    return at[scores[at] > -np.inf]


def tile(q: dict, c: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, candidate ids, scores): k rows a query at most."""
    (q_ids, left), (c_ids, right) = unpacked(q), unpacked(c)
    dim = min(left.shape[1], right.shape[1])
    kind = np.float32 if q["top"] * c["top"] * dim < 1 << 24 else np.float64
    scores = left[:, :dim].astype(kind) @ right[:, :dim].astype(kind).T
    order = np.argsort(c_ids, kind="stable")
    scores, c_ids = scores[:, order], c_ids[order]
    lo, hi = np.searchsorted(c_ids, q_ids), np.searchsorted(c_ids, q_ids, "right")
    out = [[], [], []]
    for r, qid in enumerate(q_ids):
        line = scores[r]
        line[lo[r] : hi[r]] = -np.inf
        at = best(line, c_ids, k)
        out[0].append(np.full(len(at), qid))
        out[1].append(c_ids[at])
        out[2].append(line[at])
    return tuple(np.concatenate(x) for x in out)


def search(queries: DataFrame, candidates: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK, fan: int = FAN) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (long)."""
    spark = queries.sparkSession
    asked, offered = valid(queries, id_col, vector_col), valid(candidates, id_col, vector_col)
    n_asked, n_offered = asked.count(), offered.count()
    left = materialize(packed(asked, query_block, -(-n_asked // query_block), scale), "queries")
    right = materialize(packed(offered, candidate_block, -(-n_offered // candidate_block), scale), "candidates")
    number = F.row_number().over(Window.orderBy("block")) - 1
    rows, cols = left.select("block").withColumn("row", number), right.select("block").withColumn("col", number)
    n_cols, n_rows = cols.count(), rows.count()
    # Tile numbers only: every row of blocks with every column of blocks.
    tiles = rows.select(F.col("block").alias("q_block"), "row", F.explode(F.sequence(F.lit(0), F.lit(max(0, n_cols - 1)))).alias("col")).join(cols.select(F.col("block").alias("c_block"), "col"), "col")
    ask, offer = F.struct(*[left[c] for c in left.columns]).alias("q"), F.struct(*[right[c] for c in right.columns]).alias("c")
    pairs = tiles.join(left.select(ask), F.col("q_block") == F.col("q.block")).join(right.select(offer), F.col("c_block") == F.col("c.block")).select("col", "q", "c")
    pairs = pairs.repartition(max(1, min(n_rows * n_cols, 4 * spark.sparkContext.defaultParallelism if n_rows * n_cols < 1000 else n_rows * n_cols)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(at, 1).to_pylist()[0] for at in range(batch.num_rows)):
                q_ids, c_ids, scores = tile(row["q"], row["c"], k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q_ids), row["col"], np.int32)), pa.array(q_ids, pa.int64()), pa.array(c_ids, pa.int64()), pa.array(scores.astype(np.int64))], ["part", "query_id", "vec_id", "score"])

    lists = pairs.mapInArrow(run, "part int, query_id long, vec_id long, score long")
    order = (F.desc("score"), F.asc("vec_id"))
    while n_cols > 1:
        lists = lists.withColumn("part", F.floor(F.col("part") / fan).cast("int"))
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order))).where(F.col("rank") <= k).drop("rank")
        n_cols = -(-n_cols // fan)
    ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def every_nth(id_col: Column, n: int) -> Column:
    return F.pmod(id_col, F.lit(n)) == 0
