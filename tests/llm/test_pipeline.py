"""The pipeline's rows against plain Python, stage by stage, over every document; and its stages on odd rows."""

import hashlib
from collections import Counter

import public_tokenizers
from test_jaccard import brute_labels, plain_set
from tokenizers import Tokenizer

import corpus_pipeline
from gleaner.llm import mixing, queries
from gleaner.llm.common import partitions


def kept_by_brute_force(rows):
    """Of each group of texts whose five-word shingle sets are linked at similarity 0.8 the one of the least id."""
    lettered = sorted((k, t) for k, t in rows if t is not None and any(c.isalpha() for c in t))
    labels = brute_labels([plain_set(t) for _, t in lettered])
    return dict(lettered[k] for k in set(labels))


def test_stages_and_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = kept_by_brute_force([(r.doc_id, r.text) for r in docs.collect()])
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "mix", "bpe"]
    a = stages["language_id"](spark, docs, sf)
    b = stages["near_dedup"](spark, a, sf)
    assert a.columns == b.columns == docs.columns
    assert {r.doc_id: r.text for r in b.collect()} == kept
    c = stages["mix"](spark, b, sf)
    assert c.columns == docs.columns
    copies = Counter(r.doc_id for r in c.collect())
    assert set(copies) <= set(kept) and max(copies.values()) <= 3
    assert copies == Counter({r.doc_id: r.copies for r in mixing.mix(b, shards=partitions(spark)).collect() if r.copies})
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for k, n in copies.items():
        ids = tokenizer.encode(kept[k], add_special_tokens=False).ids
        want[k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(kept[k].encode()).hexdigest()] += n
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf).collect())) == want


def test_stages_on_odd_rows(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp long, shards string"
    rows = [(None, "the cat of it", "en", "s", 1, 1, "a"), (1, None, None, None, None, None, None), (2, "the dog and cats", None, None, 2, 2, "b"), (2, "the dog and cats", None, None, 2, 2, "b"), (3, "", "en", "s", 0, 0, ""), (4, "the dog and cats", "fr", "t", 2, 3, "c")]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        count = 0
        for _, stage in corpus_pipeline.STAGES[:3]:
            docs = stage(spark, docs, sf)
            assert docs.columns == [f.split()[0] for f in schema.split(", ")]
            count += docs.count()
        assert stage is not None and corpus_pipeline.STAGES[3][1](spark, docs, sf).count() == docs.count()


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 14)]
    assert set(queries.oracle_sql()) <= set(queries.queries())
