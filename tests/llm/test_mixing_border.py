"""The border of a mix is filled until nothing fits, and the mix holds what its plan says, row by row."""

from collections import Counter, defaultdict

from gleaner.llm import mixing


def test_border_is_filled_until_nothing_fits(spark):
    rows = [(k, "w " * 100, "a") for k in range(50)] + [(99, "w " * 5001, "a")] + [(100 + k, "w " * 100, "b") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for seed in range(5):
        room, left_out = {}, defaultdict(list)
        for r in mixing.mix(docs, shards=2, seed=seed).collect():
            room[r.source] = room.get(r.source, r.target) - r.taken
            if r.copies == int(r.target / r.source_size):
                left_out[r.source].append(r["size"])
        assert all(size > room[s] for s, sizes in left_out.items() for size in sizes), (seed, room)


def test_mixed_rows_are_the_plan_where_ids_repeat(spark):
    rows = [(7, f"w{k} " * (k % 5 + 1), "a", k) for k in range(120)] + [(8, "x y", "b", 0)] * 30 + [(None, "n", None, 1)] * 9 + [(9, "long " * 700, "c", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row int").repartition(3)
    plan = mixing.mix(docs, shards=4, block_bits=3).collect()
    got = mixing.mixed(docs, shards=4, block_bits=3).collect()
    assert len(plan) == len(rows) and len(got) == sum(r.copies for r in plan)
    assert Counter((r.doc_id, r.source, len(r.text.split())) for r in got) == sum((Counter({(r.doc_id, r.source, r["size"]): r.copies}) for r in plan), Counter())
    copies = Counter(map(tuple, got))
    assert set(copies) <= set(rows) and all(n <= 3 * rows.count(r) for r, n in copies.items())
    assert Counter(map(tuple, mixing.mixed(docs.repartition(5), shards=4, block_bits=3).collect())) == copies
    assert mixing.mixed(docs.where("false")).collect() == []
