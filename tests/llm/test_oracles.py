"""The queries that SQL can say, beside it, on small tables and on odd ones."""

import pytest
from oracle import compare

from gleaner.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, sf, name):
    compare(spark, sf, queries.queries()[name], queries.oracle_sql()[name])


def test_repair_of_odd_conversations(spark, tmp_path):
    rows = [(k, t, "suaxS"[(k * 7 + t * 3) % 5] + "ser"[: (k + t) % 4], f"turn {t % 3}" + ".?! "[(k + t) % 4]) for k in range(60) for t in range(k % 11)]
    rows += [(None, None, None, None), (None, 3, "user", "x."), (100, None, "user", "a."), (100, None, "assistant", "b."), (101, 5, "", "c.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    part = next((tmp_path / "conversations.parquet").glob("*.parquet"))
    one = tmp_path / "one"
    one.mkdir()
    part.rename(one / "conversations.parquet")
    compare(spark, str(one), queries.op12_repair, queries.REPAIR_SQL)
