import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.functions import chunking, snippets, stemming, text, vectors


def column(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


TERMS = [
    ("Find the budget for the garden", ["budget", "garden"]),
    ("NGN 2,500,000", ["ngn", "2 500 000"]),
    ("the", ["the"]),
    ("?!", []),
    ("e-mail E-MAIL email", ["e mail", "email"]),
    ("  ", []),
    (" ".join(f"w{k}" for k in range(30)), [f"w{k}" for k in range(16)]),
]


@pytest.mark.parametrize("query,expected", TERMS)
def test_query_terms(spark, query, expected):
    assert text.terms_of(query) == expected
    assert column(spark, query, text.query_terms) == expected


def test_typed_forms_last_spelling_wins(spark):
    query = "“Budget” (e-Mail) BUDGET, ?!"
    assert text.typed_of(query) == {"budget": "BUDGET", "e mail": "e-Mail"}
    assert column(spark, query, text.typed_forms) == {"budget": "BUDGET", "e mail": "e-Mail"}


def test_name_terms(spark):
    rows = [(["budgets", "2024 05", "cat"], "Budget-2024-05 concat.pdf")]
    got = spark.createDataFrame(rows, "t array<string>, n string").select(text.name_terms(F.col("t"), F.col("n")).alias("y")).first().y
    assert got == ["budgets", "2024 05"]


def test_shorten(spark):
    assert column(spark, "a \n b", text.shorten) == "a b"
    assert column(spark, "x" * 400, text.shorten) == "x" * 300 + "…"
    long = ("word " * 80).strip()
    assert column(spark, long, text.shorten) == ("word " * 59).strip() + "…" or column(spark, long, text.shorten).endswith("word…")


def test_labels_sizes_kinds(spark):
    rows = spark.createDataFrame([(0,), (1023,), (1024,), (2_400_000,), (5 << 40,)], "x long").select(text.format_bytes(F.col("x")).alias("y")).collect()
    assert [r.y for r in rows] == ["0 B", "1023 B", "1.0 KB", "2.3 MB", "5.0 TB"]
    kinds = {"/a/B.PDF": "pdf", "n.txt": "text", "n.MD": "markdown", "a.markdown": "markdown", "x.docx": "docx", "p.JPeG": "image", "song.mp3": None, ".pdf": None, "noext": None}
    for path, kind in kinds.items():
        assert column(spark, path, text.file_kind) == kind
    assert column(spark, "# \n# Real", text.markdown_title) is None
    assert column(spark, "intro\n# The title \nx", text.markdown_title) == "The title"


def test_porter_and_tokens_agree_with_fts5():
    try:
        db = sqlite3.connect(":memory:")
        db.execute("create virtual table t using fts5(x, tokenize='porter unicode61 remove_diacritics 2')")
        db.execute("create virtual table v using fts5vocab(t, instance)")
    except sqlite3.OperationalError:
        pytest.skip("no fts5")
    words = "caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll generalizations oscillators École naïve àárọ̀ ½ x² budgets flies fly sixty yes y ion nation".split()
    for w in words:
        db.execute("delete from t")
        db.execute("insert into t values (?)", (w,))
        expected = [r[0] for r in db.execute("select term from v order by offset")]
        assert stemming.stem_tokens(w) == expected, w


PIECES = st.sampled_from([*"ab. \n?!é😀x", "word ", "Sentence. ", "x" * 400, "\n\n"])
PAGES = st.lists(st.lists(PIECES, max_size=300).map("".join), max_size=3)


@settings(max_examples=60, deadline=None)
@given(PAGES, st.integers(1, 4))
def test_chunk_invariants(pages, times):
    pages = [(k + 1, p * times) for k, p in enumerate(pages)]
    whole, chunks = chunking.chunk_pages(pages)
    assert whole == "\n\n".join(p for _, p in pages)
    for k, (index, piece, page, start, end) in enumerate(chunks):
        assert index == k and whole[start:end] == piece and piece == piece.strip() and len(piece.encode()) <= 1000
        assert piece in pages[page - 1][1]
    kept = {i for _, _, _, s, e in chunks for i in range(s, e)}
    assert all(whole[i].isspace() for i in range(len(whole)) if i not in kept)


def test_chunk_examples():
    _, chunks = chunking.chunk_pages([(None, "This sentence is about forty characters. " * 80)])
    assert len(chunks) > 2 and all(c[1].endswith(".") for c in chunks)
    assert all(b[3] < a[4] for a, b in zip(chunks, chunks[1:]))
    assert chunking.chunk_pages([(1, " \n")])[1] == []
    assert [len(c[1]) for c in chunking.chunk_pages([(1, "x" * 5000)])[1]][0] == 1000


def test_chunks_in_spark(spark):
    docs = spark.createDataFrame([(1, [(1, "a b"), (2, ""), (3, "c")]), (2, [])], "document_id long, pages array<struct<number:int,text:string>>")
    got = [tuple(r) for r in chunking.chunks_of(docs).collect()]
    assert got == [(1, 0, "a b", 1, 0, 3), (1, 1, "c", 3, 7, 8)]


def test_snippets_and_highlights():
    assert snippets.snippet("The total budget is NGN 2,500,000 for all.", [["budget"], ["2", "500", "000"]]) == [
        {"text": "The total ", "highlight": False}, {"text": "budget", "highlight": True}, {"text": " is NGN ", "highlight": False}, {"text": "2,500,000", "highlight": True}, {"text": " for all.", "highlight": False}]
    words = [f"w{k}" for k in range(100)]
    words[50] = "budgets"
    parts = snippets.snippet(" ".join(words), [["budget"]])
    assert parts[0]["text"].startswith("…") and parts[-1]["text"].endswith("…") and parts[1] == {"text": "budgets", "highlight": True}
    assert sum(len(p["text"].split()) for p in parts) == 24
    assert snippets.highlight_words("Garden party gardens", ["garden", "garden party"]) == [{"text": "Garden party", "highlight": True}, {"text": " ", "highlight": False}, {"text": "gardens", "highlight": True}]
    assert snippets.highlight_words("(a+b) c", ["a+b"])[1] == {"text": "a+b", "highlight": True}
    assert snippets.parse_marked("x \ue000y\ue001\nz") == [{"text": "x ", "highlight": False}, {"text": "y", "highlight": True}, {"text": " z", "highlight": False}]


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0, 9.0]), ([0.0, 0.0], [1.0])], "a array<double>, b array<double>")
    got = rows.select(vectors.dot(F.col("a"), F.col("b")).alias("d"), vectors.normalized(F.col("a")).alias("n")).collect()
    assert (got[0].d, got[0].n, got[1].n) == (3.0, [0.6, 0.8], [0.0, 0.0])
    blob = spark.createDataFrame([(bytearray(b"\x00\x00\x80?\x01"),)], "b binary").select(vectors.from_bytes(F.col("b")).alias("v")).first().v
    assert blob == [1.0]


def fnv(word):
    h = 0xCBF29CE484222325
    for b in word.encode():
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return h % 64


def test_hash_embedding(spark):
    got = column(spark, "Garden budgets garden of École", vectors.hash_embedding)
    counts = [0.0] * 64
    for w in ("garden", "budget", "garden", "école"):
        counts[fnv(w)] += 1
    norm = sum(c * c for c in counts) ** 0.5
    assert got == pytest.approx([c / norm for c in counts])


def test_models_are_looked_for_in_order(tmp_path, monkeypatch):
    first, second = tmp_path / "a", tmp_path / "b"
    for folder, held in ((first, ("model.onnx",)), (second, ("model.onnx", "tokenizer.json"))):
        (folder / "m").mkdir(parents=True)
        for f in held:
            (folder / "m" / f).write_text("")
    want = ("model.onnx", "tokenizer.json")
    assert vectors.find_model("m", want, [str(first), str(second)]) == (str(second / "m"), None)
    assert vectors.find_model("m", want, [str(first)]) == (None, f"missing tokenizer.json in {first / 'm'}")
    assert vectors.find_model("other", want, [str(first)])[1].startswith("no model other")
    monkeypatch.setenv(vectors.MODELS_VARIABLE, str(second))
    assert vectors.model_folders()[0] == str(second)
    ready, reason = vectors.OnnxEmbedder().available()
    assert not ready and "no model bge-small-en-v1.5" in reason
