"""Each opN query, as it is registered, against brute force over whole tables with odd rows and columns."""

import hashlib
import math
import os
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_filter_audit import brute as brute_audit
from test_kneser_ney import brute as brute_model
from test_repair import brute as brute_repair
from test_selection_operators import brute_targets, brute_top, size
from test_selection_operators import plain_set as plain_chains
from test_simhash import brute as brute_components
from test_simhash import plain_fingerprint
from test_text_operators import chat_expected, library, sha
from test_warc import expected as expected_captures

import __spark_entry__
from gleaner.llm import queries

TABLES = ("documents", "pages", "conversations", "embeddings", "labels")
ODD_DOCS = [(9001, None, None, None), (9002, "", "en", "src"), (9003, " \t\n", None, "src"), (9004, "one", "en", None), (9005, "long words here " * 9000, "en", "src"), (9006, "12 !? 😀", "fr", "é"), (9007, "one", "en", None)]


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """The tables of the smallest scale with odd rows, and in each a column whose name meets the outputs'."""
    at = str(tmp_path_factory.mktemp("tables"))
    read = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in TABLES}
    odd = {
        "documents": spark.createDataFrame([(*r, None) for r in ODD_DOCS], "doc_id long, text string, lang string, source string, n_chars long"),
        "pages": spark.createDataFrame([(9001, None, None), (9002, "http://x/", ""), (9003, "http://x/", "z" * 1000), (9004, "http://x/", "z" * 1000), (9005, "u", "é" * 99999)], "page_id long, url string, html string"),
        "conversations": spark.createDataFrame([(9001, 0, "user", None), (9001, 1, "assistant", "<|end|>\\"), (9002, 3, "assistant", "b"), (9002, 1, "user", "a")], "conv_id long, turn long, role string, text string"),
        "labels": spark.createDataFrame([(9001, 1, 1), (9001, 0, None), (9005, 1, 1), (9007, 1, 0), (None, 1, 1), (77777, 1, 1)], "doc_id long, quality int, toxic int"),
        "embeddings": spark.createDataFrame([(9000, None, 1), (9050, [float("nan")] * 4, 1)], "vec_id long, embedding array<float>, label int"),
    }
    for t in TABLES:
        read[t].unionByName(odd[t]).withColumn("score", F.lit("x")).withColumn("payload_digest", F.lit(1)).repartition(3).write.parquet(f"{at}/{t}.parquet")
    return at


@pytest.fixture(scope="module")
def docs(spark, folder):
    return [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def rows_of(spark, folder, name, columns):
    """The query's first columns and their types are those of its contract; its rows, by their first column."""
    found = __spark_entry__.queries()[name](spark, folder)
    types = dict(found.dtypes)
    assert {k: types[k] for k in columns} == columns
    return found.select(*columns).collect()


def by_id(rows):
    out = {r[0]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_op1(spark, folder, docs):
    got = by_id(rows_of(spark, folder, "op1_simhash", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}))
    prints = {k: plain_fingerprint(t) for k, t, *_ in docs}
    label, least = brute_components(prints.values(), 3), {}
    for k, f in sorted(prints.items()):
        least.setdefault(label[f], k)
    assert got == {k: (f"{f:016x}", least[label[f]]) for k, f in prints.items()}


def test_op2(spark, folder, docs):
    tokenizer, start, want = library(public_tokenizers.path("word_bpe_49k.json")), 0, {}
    for k, t, *_ in sorted(docs, key=lambda r: r[0]):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want[k] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert by_id(rows_of(spark, folder, "op2_token_records", {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"})) == want


def test_op3(spark, folder):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    got = rows_of(spark, folder, "op3_warc", {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"})
    assert sorted(map(tuple, got), key=str) == expected_captures(pages)
    assert {r.page_id: r.refers_to for r in got}[9003] == 9004


def test_op4(spark, folder):
    turns = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in sorted(spark.read.parquet(f"{folder}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    columns = {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"}
    got = by_id(rows_of(spark, folder, "op4_chat_format", columns))
    assert {k: r[:4] for k, r in got.items()} == {k: chat_expected(ts) for k, ts in turns.items()}
    assert all(r[4] >= sum(len(x) + len(t) for x, t in turns[k]) for k, r in got.items())


def test_op5(spark, folder):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = rows_of(spark, folder, "op5_exact_top_k", {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"})
    assert sorted(map(tuple, got)) == brute_top(vectors, 5, 50)


def test_op6(spark, folder, docs):
    got = by_id(rows_of(spark, folder, "op6_language_id", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}))
    learned = {lang for k, _, lang, _ in docs if lang is not None and zlib.crc32(str(k).encode()) % 5}
    lettered = {k for k, t, *_ in docs if t is not None and any(c.isalpha() for c in t)}
    assert got.keys() == {r[0] for r in docs}
    for k, (held, pred, score) in got.items():
        assert held == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= score <= 1
        assert pred in learned if k in lettered else pred == "und"
    held = [(k, lang) for k, _, lang, _ in docs if got[k][0] and k in lettered and lang is not None]
    assert sum(got[k][1] == lang for k, lang in held) >= 0.95 * len(held) > 0


def test_op7(spark, folder, docs):
    columns = {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"}
    got = by_id(rows_of(spark, folder, "op7_kneser_ney", columns))
    pairs = [(k, t) for k, t, *_ in docs]
    want = {k: rest for k, *rest in brute_model(pairs, 10)}
    total = sum(want[k][0] for k in want if zlib.crc32(str(k).encode()) % 10)
    assert got.keys() == want.keys()
    for k, (n, known, base, score) in want.items():
        assert got[k][:4] == (zlib.crc32(str(k).encode()) % 10 == 0, n, known, total)
        assert math.isclose(got[k][4], base, rel_tol=1e-6) and math.isclose(got[k][5], score, rel_tol=1e-4, abs_tol=1e-4)


def test_op8(spark, folder, docs):
    tokenizer, want = library(public_tokenizers.path("byte_bpe_50k.json")), {}
    for k, t, *_ in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want[k] = (len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))
    assert by_id(rows_of(spark, folder, "op8_bpe", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"})) == want


def test_op9(spark, folder, docs):
    columns = {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}
    got = by_id(rows_of(spark, folder, "op9_spotsigs", columns))
    ordered, prints = sorted((k, t or "") for k, t, *_ in docs), {}
    assert got.keys() == {k for k, _ in ordered}
    for k, (i, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        edited = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        n, digest, own, changed, near_edited, near_next = got[i]
        a, b, c = plain_chains(text), plain_chains(edited), plain_chains(following)
        assert (n, digest) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert math.isclose(near_edited, len(a & b) / len(a | b), abs_tol=1e-12) and math.isclose(near_next, len(a & c) / len(a | c), abs_tol=1e-12)
        assert prints.setdefault(frozenset(a), own) == own and prints.setdefault(frozenset(b), changed) == changed


def test_op10(spark, folder, docs):
    columns = {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}
    got = by_id(rows_of(spark, folder, "op10_mixing", columns))
    want, total = brute_targets([(s, t) for _, t, _, s in docs])
    taken = Counter()
    for k, t, _, s in docs:
        n, whole, target, words = got[k]
        assert (n, whole) == (size(t), total[s]) and math.isclose(target, want[s], rel_tol=1e-6, abs_tol=1e-6)
        assert 0 <= words <= 3 * n and (words % n == 0 if n else words == 0)
        taken[s] += words
    # Documents are taken whole, so a source may fall short, by less than the shortest one it leaves out.
    for s in want:
        out = [got[k][0] for k, _, _, x in docs if x == s and got[k][0] and got[k][3] == int(want[s] / total[s]) * got[k][0] < 3 * got[k][0]]
        assert -1e-6 <= want[s] - taken[s] <= max(0.02 * want[s], min(out, default=0))
    assert by_id(rows_of(spark, folder, "op10_mixing", columns)) == got


def test_op11(spark, folder, docs):
    got = by_id(rows_of(spark, folder, "op11_toxicity", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}))
    assert got.keys() == {k for k, *_ in docs}
    for k, (held_out, score, predicted) in got.items():
        assert held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= score <= 1 and predicted == int(score >= 0.3)
    assert got[9004][1] == got[9007][1] and got[9001][1] == got[9002][1]


def test_op12(spark, folder):
    columns = {"conv_id": "bigint", "gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint", "cost": "bigint", "audit": "string", "repaired_sha256": "string"}
    groups = {}
    for r in spark.read.parquet(f"{folder}/conversations.parquet").collect():
        groups.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    assert by_id(rows_of(spark, folder, "op12_repair", columns)) == {k: brute_repair((k, v)) for k, v in groups.items()}


def test_op13(spark, folder, docs):
    columns = {"part": "string", "filter_order": "string", "step": "int", "kept": "bigint", "removed": "bigint", "redundant": "bigint", "unique_fails": "bigint", "good_lost": "bigint", "toxic_lost": "bigint", "shapley": "bigint"}
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    got = {tuple(r)[:3]: tuple(r)[3:] for r in rows_of(spark, folder, "op13_filter_audit", columns)}
    assert got == brute_audit([(k, t, s) for k, t, _, s in docs], labels)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, sf, tmp_path, name):
    for t in TABLES:
        spark.read.parquet(f"{sf}/{t}.parquet").where("false").write.parquet(os.path.join(tmp_path, f"{t}.parquet"))
    rows = queries.queries()[name](spark, str(tmp_path)).collect()
    assert [r[0] for r in rows] == ([-7] if name == "op4_chat_format" else [])
