"""BPE, token records, language ID and chat formatting against the libraries or plain Python."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gleaner.llm import bpe, chat, langid, records

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = list(" \n\t\x1c\x85　\xa0abcetheing'ts'llve123½éß日本語😀🏽́#$%&_-.,ABCИİΣ")


def odd_texts(n, seed, special):
    rng = random.Random(seed)
    out = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return [t[:9] + special + t[9:] if k % 7 == 0 else t for k, t in enumerate(out)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def library(path):
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def test_bpe_encodes_and_decodes_as_the_library(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + odd_texts(3000, 1, "<|endoftext|>") + [None, "", "a" * 20000 + "ab" * 5000, " " * 999]
    rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, id string").repartition(3)
    tokenizer = library(BYTE_BPE)
    got = {r.doc_id: r for r in bpe.encode(rows, BYTE_BPE, with_ids=True).collect()}
    for k, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert (got[k].ids, got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (ids, len(ids), sha(",".join(map(str, ids))), sha(decoded)), t


def test_pairs_that_follow_are_those_of_the_definition():
    vocabulary = bpe.Vocabulary(BYTE_BPE)
    rng, tokens = random.Random(2), sorted(vocabulary.tokens.values())
    for a, b in ((rng.choice(tokens), rng.choice(tokens[:400])) for _ in range(5000)):
        assert vocabulary.apart(a, b) == (vocabulary.greedy(vocabulary.bytes[a] + vocabulary.bytes[b]) == [a, b])


def test_word_table_starts_anew_when_full(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_WORDS", 50)
    own, tokenizer = bpe.Encoder(BYTE_BPE), library(BYTE_BPE)
    for t in odd_texts(300, 3, "<|endoftext|>"):
        assert own.encode(t) == tokenizer.encode(t, add_special_tokens=False).ids


def test_token_records_round_trip(spark, sf, tmp_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(900, None), (901, ""), (902, "x y" * 9000)] + [(1000 + k, t) for k, t in enumerate(odd_texts(400, 4, "<|endoftext|>"))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_tokens string").repartition(5)
    tokenizer, start, want, ids_of = library(WORD_BPE), 0, {}, {}
    for k, t in sorted(rows):
        ids_of[k] = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want[k] = (start, len(ids_of[k]), zlib.crc32(np.array(ids_of[k], "<u4").tobytes()))
        start += len(ids_of[k])
    folder = f"file://{tmp_path}/r"
    records.write(docs, folder, WORD_BPE, 1)
    assert {r.doc_id: tuple(r)[1:] for r in records.read(spark, folder).collect()} == want
    assert {r.doc_id: r.ids for r in records.read_shuffled(spark, folder, 5).collect()} == ids_of
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert records.round_trip(empty, WORD_BPE, 1).collect() == []
    odd = spark.createDataFrame([(None, "a"), (None, None), (3, "b"), (3, "b")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.start) for r in records.round_trip(odd, WORD_BPE, 1).collect()) == [(False, 3), (False, 5), (True, 0), (True, 1)]


def test_encoder_takes_shortcuts_only_where_the_file_proves_them():
    texts = ["The garden Budget\nis here", "J\u030can T\u0308 x <|ENDOFTEXT|> <|endoftext|>", "Élan, élan! don't 12,5", "a" * 200_000, "w x " * 60_000, "word. " * 9, ""]
    for path, cut in ((BYTE_BPE, False), (WORD_BPE, True)):
        own, tokenizer = records.ChunkEncoder(path, 1, max_chunks=40), library(path)
        assert own.by_chunk == cut
        for t in texts + odd_texts(400, 6, "<|endoftext|>"):
            got = np.frombuffer(own(t.encode()), f"<u{own.width}").tolist()
            assert got == tokenizer.encode(t, add_special_tokens=False).ids + [1], t


def test_damaged_records_are_noticed():
    data = records.pack(7, b"\x01\x00\x02\x00", 2)
    assert records.unpack(data)[0] == 7 and records.unpack(data)[1].tolist() == [1, 2]
    for k in range(len(data)):
        with pytest.raises(ValueError):
            records.unpack(data[:k] + bytes([data[k] ^ 1]) + data[k + 1 :])


SAMPLES = (("en", ("the cat sat on the mat and the dog", "with that of the and")), ("fr", ("le chat est sur la table et le chien", "é où")))


def plain_phrases(model, samples, text):
    sample, rest, count = model.symbols(" ".join(samples)).tobytes(), model.symbols(text).tobytes(), 0
    while rest:
        k = 1
        while k < len(rest) and rest[: k + 1] in sample:
            k += 1
        rest, count = rest[k:], count + 1
    return count


def test_phrases_are_the_longest_matches():
    model = langid.model_of(SAMPLES)
    texts = ["the chat", "", "###", "日本 the", "le " * 3000, None, *odd_texts(60, 5, "q")]
    _, counts = model.phrases(texts)
    for t, row in zip(texts, counts.tolist()):
        assert row == [plain_phrases(model, s, t or "") for _, s in SAMPLES], t


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64])
def test_phrases_cross_blocks(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    model = langid.model_of(SAMPLES)
    # Texts that are in a sample as a whole: one phrase over many blocks.
    texts = [SAMPLES[0][1][0], SAMPLES[1][1][0][5:], SAMPLES[0][1][0] * 3, "the chat", "", *odd_texts(40, 6, "q")]
    _, counts = model.phrases(texts)
    for t, row in zip(texts, counts.tolist()):
        assert row == [plain_phrases(model, s, t or "") for _, s in SAMPLES], t


def test_language_id_of_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    samples = langid.learn(docs)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    got = {r.doc_id: r for r in langid.identify(docs, samples).collect()}
    held = [(k, lang) for k, _, lang in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum(got[k].lang_pred == lang for k, lang in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    odd = spark.createDataFrame([(1, None, "en", "a"), (2, "12 !?", "en", "b"), (3, "", None, "c"), (None, "the and of with", "en", "d"), (4, "x", "en", "e")], "doc_id long, text string, lang string, score string")
    assert sorted(((r.doc_id, r.lang_pred) for r in langid.identify(odd, samples).collect()), key=str)[:3] == [(1, "und"), (2, "und"), (3, "und")]
    assert sorted(r.score for r in langid.reject_unknown(odd, samples).collect()) == ["d", "e"]
    unlabelled = langid.learn(odd.where("doc_id = 3"))
    assert unlabelled == () and {r.lang_pred for r in langid.identify(odd, unlabelled).collect()} == {"und"}


def chat_expected(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))


@pytest.mark.parametrize("span", [2, 256])
def test_chat_turns_come_back(spark, span):
    marks = ["</s>[INST] ok [/INST]", "<|turn|>user<|text|>", "\\<|end|>\\\\|", "<", "|next|>", "<s>\\", "", "[INST", "INST]", "<\\|", "$1 \\n", "é😀\n"]
    rows = [(1, k, "assistant" if k // 2 % 2 else "user", m) for k, m in enumerate(marks)] + [(2, 0, "assistant", None), (2, 1, None, "x"), (3, -5, "user", "a"), (3, None, "user", "z"), (None, 1, "<|x|>", "n"), (4, 7, "user", "b"), (4, 7, "user", "a"), (4, 7, "user", "a")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, rows string")
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(frame, span=span).collect()}
    byname = {}
    for c, k, r, t in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        byname.setdefault(c, []).append((r or "", t or ""))
    assert got == {c: chat_expected(ts) for c, ts in byname.items()}
    assert chat.digests(frame.where("false")).collect() == []


def test_markers_never_occur_inside_texts(spark):
    rows = [(1, 0, "user", "a<|end|>b"), (1, 1, "user", "c"), (1, 2, "assistant", "d")]
    text = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first().formatted
    assert text == "<|turn|>user<|text|>a<\\|end|>b<|next|>c<|end|><|turn|>assistant<|text|>d<|end|>"
