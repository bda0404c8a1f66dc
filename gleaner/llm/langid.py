"""Language identification by cross-parsing entropy.

Per language a sample of labelled text becomes a suffix automaton. A text is cross-parsed against
each: the longest prefix of what is left that occurs in the sample is one phrase, and so on. The cost
of a language is phrases * log2(sample length) / symbols, the bits a symbol of naming where each
phrase occurs; the lowest cost wins, ties to the smaller label.

Symbols: lower-cased letters, each run of other characters one separator. The most frequent letters
of the samples have symbols of their own, all others share a few.

Whole texts are parsed, in blocks of ``BLOCK`` symbols that advance together, one table lookup a symbol and
language, so a very long text is many blocks of even length. Then phrases are stitched over the blocks'
borders, so counts are those of one parse from first to last symbol. The map has no shuffle.

Training rows: ``docs_per_language`` rows of each label with the smallest hash of their id, of each
up to ``chars_per_doc`` code points from the middle of the text: a bounded sample, which alone goes
to the driver. Nulls: a null text or one without a letter is ``und`` with score 0; rows with a null
label or id are never learned from. Without any label every text is ``und``. Equal texts get equal
results, repeated rows repeated ones, and an empty table an empty one; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, sole

UNKNOWN = "und"
BLOCK, LETTERS, SHARED = 1024, 96, 8
#: Symbols that one step of the parser takes in at most, unless a single text has more.
STEP = 1_500_000


class Automaton:
    """The suffix automaton of a sequence of symbols, as one dense table: (state, symbol) to the next
    state, or to where the root goes with the bit ``RESTART`` set if the phrase ends."""

    RESTART = np.int32(1 << 30)

    def __init__(self, symbols: np.ndarray, alphabet: int):
        go: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols.tolist():
            now, p = len(go), last
            go.append({})
            length.append(length[last] + 1)
            link.append(0)
            while p >= 0 and c not in go[p]:
                go[p][c] = now
                p = link[p]
            if p >= 0:
                q = go[p][c]
                if length[q] == length[p] + 1:
                    link[now] = q
                else:
                    copy = len(go)
                    go.append(dict(go[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and go[p].get(c) == q:
                        go[p][c] = copy
                        p = link[p]
                    link[q] = link[now] = copy
            last = now
        # States are stored times the alphabet, so that a step is one addition and one lookup.
        # The last row stands before a phrase: any symbol starts one, and one that the sample lacks is a phrase by itself.
        self.before = np.int32(len(go) * alphabet)
        root = np.full(alphabet, self.before, np.int32)
        for c, to in go[0].items():
            root[c] = to * alphabet
        table = np.tile(root | self.RESTART, (len(go), 1))
        for state, out in enumerate(go):
            for c, to in out.items():
                table[state, c] = to * alphabet
        self.table, self.bits = np.concatenate((table.ravel(), root | self.RESTART)), float(np.log2(len(symbols) + 2))


class Model:
    """``samples``: language to sample texts."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        seen = Counter(c for texts in samples.values() for t in texts for c in t.lower() if c.isalpha())
        own = {c: k for k, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:LETTERS])}
        self.alphabet = 1 + len(own) + SHARED
        self.symbol = np.zeros(0x110000, np.uint8)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()[0]
                self.symbol[cp] = 1 + own[low] if low in own else 1 + len(own) + ord(low) % SHARED
        self.automata = [Automaton(self.symbols(" ".join(samples[x])), self.alphabet) for x in self.languages]

    def symbols(self, text: str) -> np.ndarray:
        found = self.symbol[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        if len(found):
            gap = found == 0
            found = found[np.concatenate(([True], ~(gap[1:] & gap[:-1])))]
        return found

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of each text, and phrases by text and language."""
        each = [self.symbols(t or "") for t in texts]
        sizes = np.array([len(x) for x in each], np.int64)
        counts = np.zeros((len(texts), len(self.languages)), np.int64)
        symbols = np.concatenate(each) if each else np.zeros(0, np.uint8)
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = (np.cumsum(sizes) - sizes)[owner] + k * BLOCK
        width = np.minimum(BLOCK, sizes[owner] - k * BLOCK)
        order = np.argsort(-width, kind="stable")
        owner, start, width = owner[order], start[order], width[order]
        active = np.searchsorted(-width, -np.arange(BLOCK), side="left")  # blocks wider than each step
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        follows = np.flatnonzero(k > 0)  # blocks that go on from the one before
        before, after = place[follows - 1], place[follows]
        for lang, automaton in enumerate(self.automata):
            state = np.full(len(owner), automaton.before, np.int32)
            begins = np.zeros((int(width[0]) if len(width) else 0, len(owner)), bool)  # whether a phrase begins, by step and block
            for step in range(len(begins)):
                n = active[step]
                to = automaton.table.take(state[:n] + symbols[start[:n] + step])
                begins[step, :n] = to >> 30
                state[:n] = to & (Automaton.RESTART - 1)
            phrases = begins.sum(axis=0) + self.stitched(automaton, symbols, start, width, begins, state, before, after)
            counts[:, lang] = np.bincount(owner, phrases, len(texts)).astype(np.int64)
        return sizes, counts

    @staticmethod
    def stitched(automaton: Automaton, symbols: np.ndarray, start: np.ndarray, width: np.ndarray, begins: np.ndarray, ends: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """By block, how many phrases more (or fewer) it has if the open phrase of the block before goes on in it, so that no
        phrase ends with a block. A phrase that goes on is followed until it ends where one of the block's own phrases
        begins: from there on, both are the same. A block that it crosses as a whole hands its own end on to the next."""
        more, final, due = np.zeros(len(start), np.int64), ends.copy(), np.arange(len(before))
        nth = np.full(len(start), -1)
        nth[before] = np.arange(len(before))  # the pair whose first block this is
        while len(due):
            block, state = after[due], final[before[due]]
            extra, open_, to_end = np.zeros(len(due), np.int64), np.arange(len(due)), ends[block].copy()
            for step in range(len(begins)):
                over = width[block[open_]] <= step
                to_end[open_[over]] = state[open_[over]]
                open_ = open_[~over]
                if not len(open_):
                    break
                now = block[open_]
                to = automaton.table.take(state[open_] + symbols[start[now] + step])
                state[open_] = to & (Automaton.RESTART - 1)
                went, own = (to >> 30).astype(bool), begins[step, now]
                same = went & own
                extra[open_] += np.where(same, 0, went.astype(np.int64) - own)
                open_ = open_[~same]
            to_end[open_] = state[open_]
            more[block] = extra
            changed = block[to_end != final[block]]
            final[block] = to_end
            due = nth[changed]
            due = due[due >= 0]
        return more

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        sizes, counts = self.phrases(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        cost = counts * np.array([a.bits for a in self.automata])[None, :]
        best = cost.argmin(axis=1)
        lowest = cost[np.arange(len(texts)), best]
        rest = cost.astype(float)
        rest[np.arange(len(texts)), best] = np.inf
        second = rest.min(axis=1) if len(self.languages) > 1 else np.zeros(len(texts))
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(np.isfinite(second) & (second > 0), 1 - lowest / second, 1.0 if len(self.languages) == 1 else 0.0)
        named, scores = [], []
        for k, t in enumerate(texts):
            lettered = sizes[k] > 1 or sizes[k] == 1 and any(c.isalpha() for c in t)
            named.append(self.languages[best[k]] if lettered else UNKNOWN)
            scores.append(float(min(1.0, max(0.0, score[k]))) if lettered else 0.0)
        return named, scores


def model_of(samples: tuple[tuple[str, tuple[str, ...]], ...]) -> Model:
    return sole(("langid", samples), lambda: Model({lang: list(texts) for lang, texts in samples}))


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, mod ``folds``."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, docs_per_language: int = 64, chars_per_doc: int = 512) -> tuple:
    """The samples, as a hashable model key; fold 0 is held out. Two passes: ids and labels choose the
    rows (top-k by window, pruned before the shuffle), then the chosen rows' texts alone are fetched."""
    labelled = docs.where(docs[lang_col].isNotNull() & docs[id_col].isNotNull() & docs[text_col].isNotNull() & (fold(docs[id_col], folds) != 0))
    ids = labelled.select(labelled[id_col].alias("id"), labelled[lang_col].alias("lang"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("id").cast("string")), "id")
    chosen = ids.withColumn("__nth", F.row_number().over(first)).where(F.col("__nth") <= docs_per_language).select("id").distinct()
    size = F.length("text")
    cut = F.substring(F.col("text"), F.greatest(F.lit(1), F.floor((size - chars_per_doc) / 2) + 1).cast("int"), F.lit(chars_per_doc))
    rows = labelled.select(labelled[id_col].alias("id"), labelled[lang_col].alias("lang"), labelled[text_col].alias("text")).join(F.broadcast(chosen), "id", "left_semi")
    samples: dict[str, set[str]] = {}
    for row in rows.select("lang", cut.alias("text")).distinct().collect():
        samples.setdefault(row.lang, set()).add(row.text)
    return tuple((lang, tuple(sorted(samples[lang]))) for lang in sorted(samples))


def identify(docs: DataFrame, samples: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, lang_pred, score (0 to 1: by how much the second-best language costs more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(samples)
        for batch in batches:
            texts, named, scores, part, size = column(batch, "text").to_pylist(), [], [], [], 0
            for k, t in enumerate(texts):
                part.append(t)
                size += len(t or "")
                if size > STEP or k + 1 == len(texts):
                    a, b = model.predict(part)
                    named, scores, part, size = named + a, scores + b, [], 0
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(named, pa.string()), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"])

    ddl = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double"
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, ddl)


def reject_unknown(docs: DataFrame, samples: tuple, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a language; whole rows, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(samples)
        for big in batches:
            for at in range(0, big.num_rows, 500):
                batch = big.slice(at, 500)
                named, _ = model.predict(column(batch, text_col).to_pylist())
                yield batch.filter(pa.array([x != UNKNOWN for x in named], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
