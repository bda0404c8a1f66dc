"""Scores from texts without an index: those of the postings, and no pair of a query and a passage is shuffled."""

import pyarrow as pa
import pytest

from gleaner.functions import snippets, stemming
from gleaner.operators import blockmax, keyword
from gleaner.plans.queries import QUERIES

ROWS = [(1, 1, "the harbour, the quay the quay"), (2, 1, "quay harbour"), (3, 2, "Harbours the the the"), (4, 3, ""), (5, 3, None), (6, 4, "in-the quay. Ferry")]
ASKED = [(1, "the harbour"), (2, "the-quay ferry"), (3, "the-the the"), (4, "absent"), (5, "the-quay-the harbours")]


def tables(spark):
    chunks = spark.createDataFrame(ROWS, "chunk_id long, document_id long, text string")
    return chunks, spark.createDataFrame(ASKED, "query_id int, query string")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("stemmed", [False, True])
def test_scan_scores_as_the_postings_do(spark, stemmed):
    chunks, asked = tables(spark)
    terms = keyword.term_rows(asked, stemmed)
    got = {(r.query_id, r.chunk_id): (round(r.bm25, 9), r.mask) for r in keyword.scan(chunks, terms, stemmed, ("document_id", "chunk_id")).collect()}
    want = keyword.scores(keyword.postings(chunks, stemmed), keyword.chunk_stats(chunks, stemmed), terms)
    assert got == {(r.query_id, r.chunk_id): (round(r.bm25, 9), r.mask) for r in want.collect()} and len(got) > 5
    assert keyword.scan(chunks.where("false"), terms, stemmed).count() == 0 and keyword.scan(chunks, terms.where("false"), stemmed).count() == 0


@pytest.mark.parametrize("name", ["keyword_stemmed", "passage_search", "hybrid_unstemmed", "hybrid_results"])
def test_pairs_are_added_up_where_the_passages_are(spark, sf, name):
    plan = plan_of(QUERIES[name](spark, sf))
    assert "hashpartitioning(query_id#" in plan or name == "passage_search"  # only a query's best move
    assert not any("chunk_id" in line and "hashpartitioning(query_id" in line for line in plan.splitlines())
    assert not any("document_id" in line and "hashpartitioning(query_id" in line for line in plan.splitlines())


def test_phrases_need_no_positions(spark, sf):
    assert "collect_list(position" not in plan_of(QUERIES["phrase_match"](spark, sf))
    chunks, asked = tables(spark)
    rows = keyword.term_counts(chunks, keyword.term_rows(asked, False), False).where("term = 'the the'").collect()
    assert [(r.chunk_id, r.dl, r.tf) for r in rows] == [(3, 4, 2)]


def test_block_max_moves_no_pairs(spark):
    chunks, asked = tables(spark)
    terms, stats = keyword.term_rows(asked, False), keyword.chunk_stats(chunks, False)
    block = blockmax.blocks_of(chunks, stats, terms, False)
    hits, _ = blockmax.top(block, stats, terms, 2)
    assert "hashpartitioning(query_id" not in plan_of(hits) and "hashpartitioning(range" in plan_of(hits)
    want = keyword.scores(keyword.postings(chunks, False), stats, terms)
    best = lambda rows: {q: sorted((round(r.bm25, 9), r.chunk_id) for r in rows if r.query_id == q)[:2] for q in range(1, 6)}
    assert best(hits.collect()) == best(want.collect())


def test_words_and_snippets_a_slice_at_a_time(monkeypatch):
    lists = pa.array([["Gardens".lower(), "planning"], None, [], ["ferries"] * 3] * 700, pa.list_(pa.string()))
    found = stemming.stem_lists(lists.slice(2, 2000))
    assert found.to_pylist() == [None if x is None else [stemming.stem(w) for w in x] for x in lists.slice(2, 2000).to_pylist()]
    assert stemming.MOST_KNOWN <= 1 << 17 and stemming.SLICE <= 1024 and snippets.SLICE <= 1024


@pytest.mark.parametrize("sizes", [[], [1], [2], [3], [1, 2], [1, 3]])
def test_runs_of_words_are_joined_in_compiled_code(spark, sizes):
    """runs were joined by an interpreted function of each word."""
    texts = [["a", "b", "b", "c"], ["a"], [], None, ["x"] * 5]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, tokens array<string>")
    found = keyword.exploded_runs(rows, sizes)
    assert "lambdafunction" not in plan_of(found)
    want = sorted((k, " ".join(t[at : at + n])) for k, t in enumerate(texts) if t for n in sizes for at in range(len(t) - n + 1))
    assert sorted((r.id, r.term) for r in found.where("term IS NOT NULL").collect()) == want
