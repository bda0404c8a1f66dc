"""Near-dedup by exact Jaccard similarity against brute force."""

import random

import corpus_pipeline
from gleaner.llm import jaccard


def plain_set(text, width=5):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def brute_labels(sets):
    label = list(range(len(sets)))

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b) - 1e-9:
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(sets))]


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"v{rng.randrange(999)}"
    return " ".join(words)


def corpus():
    rng = random.Random(8)
    shared = [f"s{k}" for k in range(30)]
    texts = [None, "", "one", "One", "one two"]
    for g in range(8):
        base = [f"w{g}x{rng.randrange(400)}" for _ in range(120)] + shared
        texts += [edited(rng, base, rng.randrange(7)) for _ in range(9)]
    rng.shuffle(texts)
    return texts


def test_components_are_those_of_brute_force(spark):
    texts = corpus()
    rows = [(k, t) for k, t in enumerate(texts)]
    labels = brute_labels([plain_set(t) for t in texts])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in jaccard.keep_one(docs).collect()} == set(labels)
    assert len(set(labels)) < len(texts) - 10
    crowded = jaccard.components(docs, crowd=3, sample=10)
    assert len({r.root for r in crowded.collect()}) == len(set(labels))


def test_stage_finds_near_copies_beyond_three_bits(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.text is not None and any(c.isalpha() for c in r.text))
    labels = brute_labels([plain_set(t) for _, t in rows])
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs.where(docs.doc_id.isin([k for k, _ in rows])), sf).collect()}
    assert kept == {rows[k][0] for k in set(labels)}
    # 1 and 177 have similarity 0.83 and SimHashes of 11 differing bits.
    assert {1, 6} <= kept and not {145, 177} & kept


def test_ids_do_not_decide(spark):
    rows = [(1, "a b c d e f"), (1, "quite another text of other words"), (None, "x y z"), (None, "X y z"), (4, "x y z"), (None, "alone")]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([rows[0], rows[1], rows[4], rows[5]], key=str)
    assert jaccard.keep_one(spark.createDataFrame([], "doc_id long, text string")).collect() == []
