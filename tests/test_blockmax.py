"""Block-max search gives the hits of the full score and reads few blocks of common words."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import blockmax, keyword


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    rows = []
    for k in range(6000):
        words = ["the"] * rng.randint(1, 5) + [rng.choice("abcdefgh") * 3 for _ in range(rng.randint(5, 60))]
        if k % 500 == 0:
            words += ["harbour"] * rng.randint(1, 3)
        if k % 40 == 0:
            words += ["quay"]
        rng.shuffle(words)
        rows.append((k * 7 - 9000, " ".join(words)))
    chunks = spark.createDataFrame(rows, "chunk_id long, text string").repartition(4)
    posting, stats = keyword.postings(chunks, stemmed=False).cache(), keyword.chunk_stats(chunks, stemmed=False).cache()
    return posting, stats


def asked(spark):
    rows = [(1, "the harbour"), (2, "the quay aaa"), (3, "the"), (4, "harbour quay"), (5, "absent"), (6, "bbb ccc the")]
    return keyword.term_rows(spark.createDataFrame(rows, "query_id int, query string"), stemmed=False)


def best(rows, limit):
    out = {}
    for r in rows.collect():
        out.setdefault(r.query_id, []).append((round(r.bm25, 6), r.chunk_id, r.mask))
    return {q: sorted(v)[:limit] for q, v in out.items()}


def test_blocks_hold_the_postings(spark, corpus):
    posting, stats = corpus
    block = blockmax.blocks(posting, stats, 5)
    got = blockmax.postings_of(block, "term")
    want = posting.select("term", "chunk_id", "tf").join(stats, "chunk_id").select("term", "chunk_id", "tf", "dl")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert block.where("n <> size(gaps) OR max_tf <> array_max(tfs) OR min_dl <> array_min(dls) OR exists(slice(gaps, 2, 1000000), g -> g <= 0)").isEmpty()
    assert blockmax.range_bits(6000) == 6 and blockmax.range_bits(5) == 0


@pytest.mark.parametrize("limit", [1, 10, 200, 10_000])
def test_hits_are_those_of_the_full_score(spark, corpus, limit):
    posting, stats = corpus
    terms = asked(spark)
    block = blockmax.blocks(posting, stats, blockmax.range_bits(6000)).cache()
    hits, work = blockmax.top(block, stats, terms, limit)
    assert best(hits, limit) == best(keyword.scores(posting, stats, terms), limit)
    read = {r.query_id: r.blocks_read / r.blocks for r in work.collect()}
    if limit == 1:
        assert read[1] < 0.4 and read[4] < 0.7  # twelve passages have the rare word: most blocks of "the" stay closed
    if limit == 10_000:
        assert set(read.values()) == {1.0}


def test_best_files(spark, corpus):
    posting, stats = corpus
    terms = asked(spark)
    groups = stats.select("chunk_id", F.pmod("chunk_id", F.lit(900)).alias("group"))
    hits, _ = blockmax.top(blockmax.blocks(posting, stats, 6), stats, terms, 20, groups)

    def files(rows):
        return best(rows.join(groups, "chunk_id").groupBy("query_id", F.col("group").alias("chunk_id")).agg(F.min("bm25").alias("bm25"), F.lit(0).alias("mask")), 20)

    assert files(hits) == files(keyword.scores(posting, stats, terms))


def test_nothing_asked_or_stored(spark, corpus):
    posting, stats = corpus
    block = blockmax.blocks(posting, stats, 3)
    assert blockmax.top(block, stats, asked(spark).where("false"), 10)[0].count() == 0
    assert blockmax.top(block.where("false"), stats.where("false"), asked(spark), 10)[0].count() == 0
