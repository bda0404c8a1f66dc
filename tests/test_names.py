"""Name search: queries fan out within tasks, and the strict prefilter is that of every pair."""

import pytest
from pyspark.sql import functions as F

from gleaner.operators import names
from gleaner.plans.queries import QUERIES


@pytest.mark.parametrize("name", ["name_match", "name_prefilter_strict"])
def test_pairs_of_a_query_and_a_file_are_not_shuffled_or_sorted(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan and "Window" not in plan


def test_strict_prefilter_looks_at_every_term(spark):
    rows = [(1, "/a/ÑANDÚ notes.txt", "text", "ÑANDÚ notes.txt"), (2, "/a/img-4.png", "image", "img-4.png"), (3, "/a/ñandú.txt", "text", "ñandú.txt")]
    files = spark.createDataFrame(rows, "file_id long, path string, kind string, filename string")
    titles = spark.createDataFrame([(2, "Stations")], "file_id long, title string")
    asked = spark.createDataFrame([(1, "ñandú"), (2, "ñandú tes"), (3, "img-4"), (4, "img-4 tion"), (5, "")], "query_id int, query string")

    def found(strict, limit=200):
        return sorted((r.query_id, r.file_id, *r.matched_terms) for r in names.search(files, titles, asked, strict, limit).collect())

    assert found(False) == [(1, 1, "ñandú"), (1, 3, "ñandú"), (2, 1, "ñandú"), (2, 3, "ñandú"), (3, 2, "img 4"), (4, 2, "img 4")]
    # Upper case beyond ASCII is not found as plain text; another term's letters inside a word let a file pass.
    assert found(True) == [(1, 3, "ñandú"), (2, 1, "ñandú"), (2, 3, "ñandú"), (4, 2, "img 4")]
    assert found(False, 1) == [(1, 1, "ñandú"), (2, 1, "ñandú"), (3, 2, "img 4"), (4, 2, "img 4")]
    every = names.matching(names.with_names(files, titles), asked)
    assert sorted((r.query_id, r.file_id, r.n) for r in every.select("query_id", "file_id", F.bit_count("mask").alias("n")).collect()) == [(a, b, 1) for a, b, _ in found(False)]
