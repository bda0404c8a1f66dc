"""Byte-level BPE by prefix-sharing tries.

A text's pre-tokens are looked up in a per-worker table of words already encoded. Words that are
new form, as bytes, a trie. A depth-first walk gives each node (a prefix of one or more words) its
*last token*: the one token ``t`` that ends the prefix such that ``t`` follows the
last token of the prefix before ``t`` in a valid encoding. A BPE encoding is valid exactly if each
pair of neighbours is, so the state of a shared prefix is computed once, whatever the number of
words below it, and a word's ids are read back along its last tokens.

Nulls: a null text counts as empty (no ids). Very long texts and words of any length are walked
iteratively; nothing is cut. Repeated rows give repeated results, a null id is returned as it is, and
an empty table gives an empty result; extra columns are not read.
The map has no shuffle, and its memory is bounded by one Arrow batch, the word table
(``MAX_WORDS``) and the vocabulary.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import column, sole

#: The byte-level alphabet's printable ranges, and the pre-token pattern of the vocabulary.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The code points that are Unicode White_Space.
SPACE = "\t-\r \x85\xa0  -     　"

#: Words that a worker keeps encoded; beyond it the table starts anew.
MAX_WORDS = 500_000
#: Pairs of tokens whose order a worker remembers as valid or not.
MAX_PAIRS = 300_000

_RUN = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_PIECE = regex.compile(PRETOKEN.replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]").replace(rf"[^[{SPACE}]", f"[^{SPACE}"))


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself, or the next free code point from 256."""
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        raw = lambda token: bytes(alphabet[c] for c in token)
        self.bytes = {i: raw(t) for t, i in model["vocab"].items() if all(c in alphabet for c in t)}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.single = {b: model["vocab"][c] for c, b in alphabet.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((model["vocab"][a], model["vocab"][b]), (rank, model["vocab"][a + b]))
        #: Rank and parts of the merge that makes a token.
        self.halves: dict[int, tuple[int, int, int]] = {}
        for (a, b), (rank, t) in self.merges.items():
            if t not in self.halves or rank < self.halves[t][0]:
                self.halves[t] = (rank, a, b)
        made = {t for _, t in self.merges.values()} | set(self.single.values())
        self.tokens = {self.bytes[t]: t for t in made if t not in self.special.values() and self.greedy(self.bytes[t]) == [t]}
        self.longest = max(map(len, self.tokens))
        self._follows: dict[tuple[int, int], bool] = {}
        #: Bytes of tokens backwards, as a trie: a node is (token or None, children by byte).
        self.backwards: list = [None, {}]
        for word, token in self.tokens.items():
            node = self.backwards
            for b in reversed(word):
                node = node[1].setdefault(b, [None, {}])
            node[0] = token

    def greedy(self, word: bytes) -> list[int]:
        """Lowest-rank merges first: the definition, for words as short as two tokens."""
        ids = [self.single[b] for b in word]
        while len(ids) > 1:
            best = min(((m[0], k, m[1]) for k in range(len(ids) - 1) if (m := self.merges.get((ids[k], ids[k + 1])))), default=None)
            if best is None:
                break
            rank, _, merged = best
            out, k = [], 0
            while k < len(ids):
                if k + 1 < len(ids) and self.merges.get((ids[k], ids[k + 1]), (-1,))[0] == rank:
                    out.append(merged)
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def follows(self, a: int, b: int) -> bool:
        """Whether ``a`` then ``b`` is the encoding of their bytes."""
        found = self._follows.get((a, b))
        if found is None:
            if len(self._follows) > MAX_PAIRS:
                self._follows.clear()
            found = self._follows[a, b] = self.apart(a, b)
        return found

    def apart(self, a: int, b: int) -> bool:
        """Undoes the merges of both tokens, latest first, and asks at each step whether the two
        that meet at the border would have merged before that; of equal ranks the left one is first."""
        limit, merges, halves = len(self.merges), self.merges, self.halves
        while True:
            meet = merges.get((a, b))
            if meet is not None and meet[0] < limit:
                return False
            ra, rb = halves[a][0] if a in halves else -1, halves[b][0] if b in halves else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, halves[a][2]
            else:
                limit, b = rb + 1, halves[b][1]


def encode_trie(vocabulary: Vocabulary, words: list[bytes]) -> dict[bytes, list[int]]:
    """The ids of each distinct word. Sorted words are their trie's nodes in depth-first order: the
    walk backs up to the prefix shared with the word before and goes down from its state, so only
    the path to the current node is held."""
    backwards, follows = vocabulary.backwards, vocabulary._follows.get
    ask, out = vocabulary.follows, {}
    last, before = [-1], [0]
    previous = b""
    for word in sorted(words):
        shared, most = 0, min(len(word), len(previous))
        while shared < most and word[shared] == previous[shared]:
            shared += 1
        del last[shared + 1 :], before[shared + 1 :]
        for depth in range(shared + 1, len(word) + 1):
            step, k = backwards, depth
            while k:
                step = step[1].get(word[k - 1])
                if step is None:
                    raise ValueError(f"no encoding of {word[:depth]!r}")
                k -= 1
                token = step[0]
                if token is not None:
                    if not k:
                        break
                    valid = follows((last[k], token))
                    if valid or valid is None and ask(last[k], token):
                        break
            last.append(token)
            before.append(k)
        ids, k = [], len(word)
        while k:
            ids.append(last[k])
            k = before[k]
        ids.reverse()
        out[word], previous = ids, word
    return out


class Encoder:
    """Texts to ids and back, sharing work between words."""

    def __init__(self, path: str, max_words: int | None = None):
        self.vocabulary, self.max_words = Vocabulary(path), max_words or MAX_WORDS
        self.table: dict[str, tuple[str, int, bytes]] = {}
        self.words: dict[str, tuple[str, int, bytes]] = {}
        pieces = "|".join(re.escape(t) for t in self.vocabulary.special)
        self.special = re.compile(f"({pieces})") if pieces else None

    def runs(self, text: str) -> list[str]:
        """Special tokens, and runs of characters that pre-tokens don't cross."""
        if self.special is None or not any(t in text for t in self.vocabulary.special):
            return _RUN.findall(text)
        out = []
        for k, part in enumerate(self.special.split(text)):
            out += [part] if k % 2 else _RUN.findall(part)
        return out

    def learn(self, runs: set[str]) -> None:
        """Encodes, in one trie, the words of the runs that the tables lack."""
        new = [r for r in runs if r not in self.table]
        if len(self.table) + len(new) > self.max_words:
            self.table.clear()
            new = list(runs)
        special, known = self.vocabulary.special, self.words
        split = [_PIECE.findall(r) if r not in special else () for r in new]
        words = {w for ws in split for w in ws if w not in known}
        if len(known) + len(words) > self.max_words:
            known.clear()
            words = {w for ws in split for w in ws}
        raw, plain = {w.encode("utf-8", "surrogatepass"): w for w in words}, self.vocabulary.bytes
        for word, ids in encode_trie(self.vocabulary, list(raw)).items():
            known[raw[word]] = (",".join(map(str, ids)), len(ids), b"".join([plain[i] for i in ids]))
        for r, ws in zip(new, split):
            if len(ws) == 1:
                self.table[r] = known[r]
            elif ws:
                found = [known[w] for w in ws]
                self.table[r] = (",".join([x[0] for x in found]), sum([x[1] for x in found]), b"".join([x[2] for x in found]))
            else:
                self.table[r] = (str(special[r]), 1, plain[special[r]])

    def encode(self, text: str) -> list[int]:
        runs = self.runs(text)
        self.learn(set(runs))
        return [int(i) for r in runs for i in self.table[r][0].split(",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.vocabulary.bytes[i] for i in ids).decode("utf-8", "replace")


def encoder(path: str, max_words: int) -> Encoder:
    return sole(("bpe", path, max_words), lambda: Encoder(path, max_words))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, max_words: int = MAX_WORDS) -> DataFrame:
    """Per row: the id column, n_tokens, ids_sha256 (of the decimal ids joined by commas) and
    decoded_sha256 (of the text decoded from the ids); ``with_ids`` adds ids and decoded.
    ``max_words`` bounds a worker's table, and with it its memory; results do not depend on it."""
    fields = [docs.schema[id_col], *("n_tokens long, ids_sha256 string, decoded_sha256 string".split(", "))]
    ddl = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(fields[1:]) + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, max_words)
        for big in batches:
            for at in range(0, big.num_rows, 500):
                batch = big.slice(at, 500)
                each = [own.runs(t or "") for t in column(batch, "text").to_pylist()]
                # Each piece's runs fit the table at once; one with more distinct runs than the table holds is encoded by itself.
                own.learn(set().union(*each))
                table, out = own.table, [[], [], [], [], []]
                for runs in each:
                    found = [table[r] for r in runs]
                    ids, plain = ",".join([x[0] for x in found]), b"".join([x[2] for x in found])
                    out[0].append(sum([x[1] for x in found]))
                    out[1].append(hashlib.sha256(ids.encode()).hexdigest())
                    decoded = plain.decode("utf-8", "replace")
                    out[2].append(hashlib.sha256(decoded.encode()).hexdigest())
                    if with_ids:
                        out[3].append([int(i) for i in ids.split(",")] if ids else [])
                        out[4].append(decoded)
                arrays = [column(batch, "id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
                if with_ids:
                    arrays += [pa.array(out[3], pa.list_(pa.int32())), pa.array(out[4], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(arrays)])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, ddl)
