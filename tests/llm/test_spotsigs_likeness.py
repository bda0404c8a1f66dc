"""Likeness is exact whatever the sizes."""

import pytest

from gleaner.llm import spotsigs


def test_likeness_of_very_unlike_sizes_is_exact(spark):
    short = "the garden budget"
    rows = [(1, short), (2, short + " " + " ".join(f"the a{k} b{k}" for k in range(60)))]
    got = {r.doc_id: r for r in spotsigs.edited_comparison(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].near_next == got[2].near_next == pytest.approx(1 / 61)
