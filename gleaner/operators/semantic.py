"""Search by meaning: brute-force nearest passages, thresholds, the best passage of each file."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import vectors

CANDIDATES = 200


#: Numbers of the queries that are sent to every task at once; more go in several blocks.
SENT = 1 << 22
#: Similarities that a task holds at once.
TILE = 1 << 22


def sound(batch: pa.RecordBatch, dimensions: int | None) -> pa.RecordBatch:
    """Without null vectors and, if ``dimensions`` is given, without those of another length. Spark would compute an
    embedding once more for such a filter."""
    lists = batch.column(1)
    kept = lists.is_valid() if dimensions is None else pc.fill_null(pc.equal(pc.list_value_length(lists), dimensions), False)
    return batch.filter(kept)


def matrix(lists: pa.ListArray, dim: int | None = None) -> np.ndarray:
    """Rows of doubles, of the longest's length (or ``dim``); what is missing or null is 0."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    dim = int(sizes.max(initial=0)) if dim is None else dim
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    at = np.concatenate(([0], np.cumsum(sizes)))
    for k in range(len(sizes)):
        n = min(dim, sizes[k])
        out[k, :n] = flat[at[k] : at[k] + n]
    return out


def tile_top(stored: DataFrame, asked: tuple[np.ndarray, np.ndarray], limit: int, digits: int | None, dimensions: int | None = None) -> DataFrame:
    """(query_id, chunk_id, similarity): the best of each task, ``limit`` a query. Stored vectors times queries is a matrix
    product, a tile of at most ``TILE`` similarities (or one row of them) at a time; what is not a finite number is no
    similarity. Of a tile only those stay that reach the query's ``limit``-th best, of the tile and of those before."""
    ids, wanted = asked

    def ranked(x: np.ndarray) -> np.ndarray:
        return x if digits is None else np.round(x, digits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
        least = np.full(len(ids), -np.inf)  # what a query's next candidate has to reach
        for batch in (sound(b, dimensions) for b in batches):
            chunks, rows = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1), wanted.shape[1])
            width = max(1, TILE // max(1, len(chunks)))
            for start in range(0, len(ids), width):
                with np.errstate(invalid="ignore", over="ignore"):
                    tile = rows @ wanted[start : start + width].T
                tile[~np.isfinite(tile)] = -np.inf
                key = ranked(tile)
                floor = least[start : start + width]
                if len(chunks) > limit:
                    floor = np.maximum(floor, np.partition(key, len(chunks) - limit, axis=0)[len(chunks) - limit])
                at, q = np.nonzero((key >= floor) & (tile > -np.inf))
                order = np.argsort(q, kind="stable")
                at, q = at[order], q[order]
                for k, a in zip(*np.unique(q, return_index=True)):
                    own = at[a : a + np.searchsorted(q[a:], k, side="right")]
                    sims, found = np.concatenate((best[start + k][0], tile[own, k])), np.concatenate((best[start + k][1], chunks[own]))
                    first = np.lexsort((found, -ranked(sims)))[:limit]
                    best[start + k] = sims[first], found[first]
                    if len(first) == limit:
                        least[start + k] = ranked(sims[first])[-1]
        sizes = [len(x) for x, _ in best]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), pa.array(np.concatenate([c for _, c in best])), pa.array(np.concatenate([s for s, _ in best]))], ["query_id", "chunk_id", "similarity"])

    return stored.mapInArrow(run, "query_id long, chunk_id long, similarity double")


def query_blocks(queries: DataFrame) -> Iterator[pa.Table]:
    """The queries that have an id and a vector, as tables of about ``SENT`` numbers, dealt by a hash of the id; at least
    one table, if an empty one."""
    given = queries.where("vector IS NOT NULL AND query_id IS NOT NULL").withColumn("query_id", F.col("query_id").cast("long"))
    numbers = given.agg(F.sum(F.size("vector").cast("long"))).first()[0] or 0
    blocks, any_yet = -(-numbers // SENT) or 1, False
    for k in range(blocks):
        block = (given if blocks == 1 else given.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)).toArrow()
        if block.num_rows or not any_yet and k == blocks - 1:
            any_yet = True
            yield block


def nearest(embeddings: DataFrame, queries: DataFrame, limit: int = CANDIDATES, model: str | None = None, dimensions: int | None = None, digits: int | None = None) -> DataFrame:
    """The ``limit`` nearest passages of each query, with rank; ties (at ``digits`` decimals, if given) to the lower id.
    A vector that is null, or whose similarity is not a finite number, takes no part.

    Queries go to every task as a matrix of about ``SENT`` numbers, and tasks send their best only; more queries go in
    blocks by a hash of their id, each a pass over the vectors."""
    stored = embeddings if model is None else embeddings.where(F.col("model") == model)
    stored = stored.where("chunk_id IS NOT NULL").select(F.col("chunk_id").cast("long").alias("chunk_id"), "embedding")
    parts = [tile_top(stored, (asked["query_id"].to_numpy(), matrix(asked["vector"].combine_chunks())), limit, digits, dimensions) for asked in query_blocks(queries.select("query_id", "vector"))]
    rows = functools.reduce(DataFrame.unionByName, parts).withColumn("query_id", F.col("query_id").cast(queries.schema["query_id"].dataType))
    key = F.col("similarity") if digits is None else F.round("similarity", digits)
    order = Window.partitionBy("query_id").orderBy(F.desc(key), "chunk_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def matches(near: DataFrame) -> DataFrame:
    """Hits near enough in themselves and to the query's best."""
    best = F.max("similarity").over(Window.partitionBy("query_id"))
    return near.withColumn("best", best).where(vectors.is_match(F.col("similarity"), F.col("best"))).drop("best")


def search(embeddings: DataFrame, chunks: DataFrame, documents: DataFrame, files: DataFrame, queries: DataFrame, model: str | None = None, dimensions: int | None = None, digits: int | None = None, keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> DataFrame:
    """(query_id, file_id, path, kind, chunk_id, page_number, text, similarity, score): of each file its nearest passage that
    matches. ``keep`` may write down the hits, so that Spark knows how few they are and shuffles no texts to meet them."""
    hits = keep(matches(nearest(embeddings, queries, CANDIDATES, model, dimensions, digits)), "near")
    rows = hits.join(chunks.select("chunk_id", "document_id", "page_number", "text"), "chunk_id").join(documents.select("document_id", "file_id"), "document_id")
    first = Window.partitionBy("query_id", "file_id").orderBy(F.desc("similarity"), "chunk_id")
    best = rows.withColumn("nth", F.row_number().over(first)).where("nth = 1").join(files.select("file_id", "path", "kind"), "file_id")
    return best.select("query_id", "file_id", "path", "kind", "chunk_id", "page_number", "text", "similarity", vectors.semantic_score(F.col("similarity")).alias("score"))


def missing(chunks: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Passages without a vector of this model."""
    return chunks.join(embeddings.where(F.col("model") == model).select("chunk_id"), "chunk_id", "left_anti")


def embedded(chunks: DataFrame, embedder: vectors.Embedder) -> DataFrame:
    """(chunk_id, model, dimensions, embedding) of the passages; a vector of another length fails the job."""
    new = chunks.select("chunk_id", F.lit(embedder.model).alias("model"), F.lit(embedder.dimensions).alias("dimensions"), embedder.embed(F.col("text")).cast("array<float>").alias("embedding"))
    sound = F.when(F.size("embedding") == F.col("dimensions"), F.col("embedding")).otherwise(F.raise_error(F.lit("the embedder returned a vector of another length")))
    return new.withColumn("embedding", sound)


def embed_missing(chunks: DataFrame, embeddings: DataFrame, embedder: vectors.Embedder) -> DataFrame:
    """The table of vectors after embedding what lacks one: one vector a passage, whatever model it had before."""
    new = embedded(missing(chunks, embeddings, embedder.model), embedder)
    return embeddings.where(F.col("model") == embedder.model).join(chunks.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", "model", "dimensions", "embedding").unionByName(new)
