"""Top passages by BM25 without scoring every posting: postings in blocks that know their largest possible share.

Passages are dealt into ranges of about ``SIZE`` by a hash of their id; a block holds a term's postings in one range, as
deltas of ids, counts and lengths, and beside them the largest count and the least length. These two bound what any of
its passages can get from the term, whatever the corpus' mean length. A search reads the bounds alone first: the sum of
its terms' bounds in a range is what a passage there can score at most. The most promising ranges of each query are
scored, their ``limit``-th best passage (or file) is the threshold, and of all other ranges only those are read whose
bound reaches it. Results are those of the full score; a common word's blocks are read only where rarer ones are too.

Blocks of one term are at most ``SIZE`` postings or so, so no word is a hot key, and all stages are equi-joins and
aggregations by (term, range) or (query, range)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators import keyword
from gleaner.sources.scratch import written

SIZE = 128


def range_bits(passages: int, size: int = SIZE) -> int:
    return max(0, math.ceil(math.log2(max(1, passages / size))))


def range_of(chunk_id: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(chunk_id), 64 - bits) if bits else F.lit(0).cast("long")


def blocks(posting: DataFrame, stats: DataFrame, bits: int) -> DataFrame:
    """(term, range, n, max_tf, min_dl, first, gaps, tfs, dls) of postings (term, chunk_id, tf) and lengths (chunk_id, dl)."""
    rows = posting.select("term", "chunk_id", "tf").join(stats.select("chunk_id", "dl"), "chunk_id")
    return packed(rows.withColumn("range", range_of(F.col("chunk_id"), bits)))


def blocks_of(chunks: DataFrame, stats: DataFrame, terms: DataFrame, stemmed: bool = True) -> DataFrame:
    """The blocks of the asked terms (a phrase's words joined by a blank) from passages without postings: texts are dealt
    by range once, and a range's blocks are made where its texts are."""
    passages = stats.count()
    dealt = chunks.select("chunk_id", "text", range_of(F.col("chunk_id"), range_bits(passages)).alias("range"))
    dealt = dealt.repartition(tasks_for(passages, terms), "range")
    return packed(keyword.term_counts(dealt, terms, stemmed, ("range", "chunk_id")))


def tasks_for(passages: int, terms: DataFrame) -> int:
    return keyword.tasks_for(terms.sparkSession, passages * terms.select("query_id").distinct().count())


def packed(rows: DataFrame) -> DataFrame:
    """Blocks of rows (range, term, chunk_id, tf, dl)."""
    held = rows.groupBy("term", "range").agg(F.sort_array(F.collect_list(F.struct("chunk_id", "tf", "dl"))).alias("p"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))
    gaps = F.transform("p", lambda x, i: F.when(i == 0, F.lit(0).cast("long")).otherwise(x.chunk_id - F.get("p", i - 1).chunk_id))
    return held.select("term", "range", F.size("p").alias("n"), "max_tf", "min_dl", F.get("p", 0).chunk_id.alias("first"), gaps.alias("gaps"), F.transform("p", lambda x: x.tf).alias("tfs"), F.transform("p", lambda x: x.dl).alias("dls"))


def postings_of(block: DataFrame, *keep: str) -> DataFrame:
    """The postings of blocks again: ``keep``, chunk_id, tf, dl."""
    # Ids are sums of gaps: one pass over the array.
    ids = F.aggregate("gaps", F.array().cast("array<long>"), lambda done, gap: F.array_append(done, F.coalesce(F.try_element_at(done, F.lit(-1)), F.col("first")) + gap))
    rows = block.select(*keep, F.explode(F.arrays_zip(ids.alias("id"), F.col("tfs").alias("tf"), F.col("dls").alias("dl"))).alias("x"))
    return rows.select(*keep, F.col("x.id").alias("chunk_id"), F.col("x.tf").alias("tf"), F.col("x.dl").alias("dl"))


def top(block: DataFrame, stats: DataFrame, terms: DataFrame, limit: int, groups: DataFrame | None = None, seeds: int | None = None, slack: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """Scores of at least each query's ``limit`` best passages, (query_id, chunk_id, bm25, mask) as of ``keyword.scores``;
    and (query_id, blocks, blocks_read). With ``groups`` (chunk_id, group) the ``limit`` best are groups by their best
    passage. ``terms``: query_id, term_pos, words; a phrase's blocks go by its words joined by a space. Passages whose
    score is within ``slack`` of the threshold are kept, so that ties can be broken after rounding."""
    spark = block.sparkSession
    seeds = max(1, limit // 16) if seeds is None else seeds
    asked = terms.select("query_id", F.array_join("words", " ").alias("term"), F.expr("shiftleft(1L, term_pos)").alias("bit"))
    n, avgdl = stats.agg(F.count("*"), F.coalesce(F.avg("dl"), F.lit(1.0))).first()
    # Only the bounds: the arrays are not read.
    bounds = block.join(asked.select("term").distinct(), "term", "left_semi").select("term", "range", "n", "max_tf", "min_dl")
    weight = bounds.groupBy("term").agg(F.sum("n").alias("df")).select("term", keyword.idf(F.lit(n), F.col("df")).alias("weight"))
    score = lambda tf, dl: -keyword.bm25(tf, dl, F.lit(avgdl), F.col("weight"))
    own = written(asked.join(weight, "term"), "asked")
    held = written(bounds.join(own, "term").groupBy("query_id", "range").agg(F.sum(score(F.col("max_tf"), F.col("min_dl"))).alias("bound"), F.count("*").alias("blocks")), "bounds")
    tasks = tasks_for(n, terms)

    def scored(chosen: DataFrame) -> DataFrame:
        """Full scores of the passages of (query_id, range). Blocks and their queries are dealt by range, together, in as
        many tasks as the pairs of a query and a passage need; these pairs are added up there and never shuffled (a join by
        term and range would deal by both). A block is decoded once, whatever the number of queries that ask for it."""
        pairs = chosen.select("query_id", "range").join(own, "query_id")
        held = block.join(own.select("term").distinct(), "term", "left_semi").join(chosen.select("range").distinct(), "range", "left_semi")
        held = held.select("range", "term", F.struct("first", "gaps", "tfs", "dls").alias("block"), F.lit(None).cast(pairs.select(F.struct("query_id", "bit", "weight").alias("x")).schema["x"].dataType).alias("asks"))
        asks = pairs.select("range", "term", F.lit(None).cast(held.schema["block"].dataType).alias("block"), F.struct("query_id", "bit", "weight").alias("asks"))
        met = held.union(asks).repartition(tasks, "range").groupBy("range", "term").agg(F.any_value("block", True).alias("block"), F.collect_list("asks").alias("queries"))
        read = postings_of(met.where("block IS NOT NULL AND size(queries) > 0").select("range", "queries", "block.*"), "range", "queries")
        read = read.select("range", "chunk_id", "tf", "dl", F.inline("queries"))
        each = read.select("query_id", "range", "chunk_id", "bit", score(F.col("tf"), F.col("dl")).alias("part"))
        return each.groupBy("query_id", "range", "chunk_id").agg((-F.sum("part")).alias("bm25"), F.bit_or("bit").alias("mask")).drop("range")

    best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "range")
    first = written(held.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= seeds).drop("nth"), "seeds")
    begun = written(scored(first), "begun")
    ranked = begun if groups is None else begun.join(groups, "chunk_id").groupBy("query_id", "group").agg(F.min("bm25").alias("bm25"))
    least = Window.partitionBy("query_id").orderBy("bm25")
    threshold = ranked.withColumn("nth", F.row_number().over(least)).where(F.col("nth") == limit).select("query_id", (-F.col("bm25")).alias("threshold"))
    rest = held.join(first.select("query_id", "range"), ["query_id", "range"], "left_anti").join(threshold, "query_id", "left")
    rest = written(rest.where(F.col("threshold").isNull() | (F.col("bound") >= F.col("threshold") - slack)), "rest")
    # Of the later ranges only what reaches the threshold; a row a query is few.
    later = scored(rest).join(written(rest.groupBy("query_id").agg(F.max("threshold").alias("threshold")), "thresholds"), "query_id")
    hits = begun.unionByName(later.where(F.col("threshold").isNull() | (-F.col("bm25") >= F.col("threshold") - slack)).drop("threshold"))
    read = first.select("query_id", "blocks").unionByName(rest.select("query_id", "blocks")).groupBy("query_id").agg(F.sum("blocks").alias("blocks_read"))
    return hits, held.groupBy("query_id").agg(F.sum("blocks").alias("blocks")).join(read, "query_id")
