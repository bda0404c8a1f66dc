"""Toxicity by maximum-scoring segments of token log-odds.

Tokens are words (runs of letters and digits, lower-cased). A word's weight is its log-odds between toxic and
clean documents under a Dirichlet prior of ``PRIOR`` documents of pooled text, less ``CAUTION`` standard errors, and 0
if its likelihood ratio is below ``CHANCE``, so that chance is not learned. A word that the sample has in fewer than ``KNOWN`` documents and that earned no weight takes
the mean weight of its character grams of ``GRAM``, its ends marked. Every word costs ``STEP`` besides, so a passage has
to earn its length.

A linear scan finds all maximal segments of a text: each is worth more than any extension or part of it. In clean text
their scores S follow an extreme-value law, expected(S) = K * words * exp(-lambda * S): lambda solves
sum p(s) exp(lambda s) = 1 over the word scores of clean text, K is fitted to the best segments of clean documents. A
segment that chance makes at most ``expected`` times in such a text is a toxic passage. A document's evidence is the
least chance of its r best segments together (their sum statistic), over all r; a logistic curve of it is the score.

Training rows: of each label about ``per_class`` documents, those with the least hashes of their id, a bounded sample; of
these a quarter sets lambda, K and the curve and teaches no words. Word counts are made in Spark; the driver gets ``features``
weights and one row a calibrating document. The curve is fitted to the shares of labels in the whole table.

Nulls: a null text is an empty one, without evidence, with the curve's lowest score; rows with a null id or label, and
labels of no document, teach nothing. A document with several labels is toxic if one of them says so. Of rows that share
an id the greatest text is learned from. Equal texts get equal scores, repeated rows repeated ones. Without labels of
both kinds every score is the share of toxic ones (0 without any). An empty table gives an empty result; other columns
are not read. Very long texts are scanned whole, one at a time: a number a word is held, nothing else.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, materialize

WORD = re.compile(r"[^\W_]+")
PRIOR, CAUTION, CHANCE, STEP, GRAM, KNOWN = 100.0, 1.0, 15.0, 0.25, 5, 20
#: Words that a worker remembers the weight of.
REMEMBERED = 500_000


def grams(word: str) -> set[str]:
    marked = f"^{word}$"
    return {marked[k : k + GRAM] for k in range(max(1, len(marked) - GRAM + 1))}


class Weights(dict):
    """Word as written to its score in a text; looked up once, then remembered."""

    def __init__(self, words: dict[str, float], parts: dict[str, float]):
        super().__init__()
        self.words, self.parts = words, parts

    def __missing__(self, written: str) -> float:
        word = written.lower()
        weight = self.words.get(word)
        if weight is None:
            found = grams(word)
            weight = sum(self.parts.get(g, 0.0) for g in found) / len(found)
        if len(self) >= REMEMBERED:
            self.clear()
        self[written] = weight - STEP
        return weight - STEP


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments, in order: (score, first, end). Linear in the words that score above 0."""
    total = np.cumsum(scores)
    first, end, low, high, link = [], [], [], [], []
    for k in np.flatnonzero(scores > 0).tolist():
        a, lo, hi = k, float(total[k] - scores[k]), float(total[k])
        while True:
            j = len(low) - 1
            while j >= 0 and low[j] >= lo:
                j = link[j]
            if j < 0 or high[j] >= hi:
                break
            # The segment j begins lower and ends lower: it and all between join the new one.
            a, lo = first[j], low[j]
            for held in (first, end, low, high, link):
                del held[j:]
        first.append(a)
        end.append(k + 1)
        low.append(lo)
        high.append(hi)
        link.append(j)
    return [(high[k] - low[k], first[k], end[k]) for k in range(len(low))]


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    parts: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0  # lambda
    scale: float = 1.0  # K
    offset: float = 0.0
    slope: float = 0.0
    share: float | None = None  # the score of every text, if there is nothing to tell labels apart by

    def expected(self, score: float, words: int) -> float:
        """How many segments of this score or more clean text of so many words has."""
        return self.scale * words * math.exp(-self.rate * score)

    def evidence(self, scores: list[float], words: int) -> float:
        """-ln of the chance of the best segments together."""
        sums, best = 0.0, 0.0
        for r, s in enumerate(sorted(scores, reverse=True), 1):
            x = self.rate * s - math.log(self.scale * words)
            if x <= 0:
                break
            sums += x
            # r segments with normalised scores that sum to t: t^(r-1) e^-t / (r! (r-1)!), and a factor 2^r for the choice of r.
            bits = sums - (r - 1) * math.log(sums) + math.lgamma(r + 1) + math.lgamma(r) - (r - 1) * math.log(2)
            best = max(best, bits)
        return best

    def score(self, evidence: float) -> float:
        if self.share is not None:
            return self.share
        z = self.offset + self.slope * math.log1p(evidence)
        return 1 / (1 + math.exp(-z)) if z > -500 else 0.0


def scan(text: str | None, weights: Weights) -> tuple[list[str], list[tuple[float, int, int]]]:
    words = WORD.findall(text or "")
    if not words:
        return words, []
    return words, segments(np.fromiter(map(weights.__getitem__, words), np.float64, len(words)))


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, mod ``folds``."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds))


def log_odds(toxic: Column, clean: Column, n_toxic: float, n_clean: float) -> Column:
    """The cautious end of the log-odds of a feature that so many of the documents have; 0 if chance explains it."""
    both = toxic + clean
    pooled = both / (n_toxic + n_clean)
    raw = F.log((toxic + PRIOR * pooled) / (n_toxic + PRIOR)) - F.log((clean + PRIOR * pooled) / (n_clean + PRIOR))
    # Twice the log-likelihood ratio of two Poisson rates against one, which small counts do not mislead.
    part = lambda seen, n: F.when(seen > 0, seen * F.log(seen / (pooled * n))).otherwise(0.0)
    sure = F.abs(raw) - CAUTION * F.sqrt(1 / (toxic + 1) + 1 / (clean + 1))
    return F.when((2 * (part(toxic, n_toxic) + part(clean, n_clean)) >= CHANCE) & (sure > 0), F.signum(raw) * sure).otherwise(0.0)


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, folds: int, held: int, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(toxic, teaches, text) of the training sample, written down; and how many documents have each label."""
    told = labels.where(labels["doc_id"].isNotNull() & labels["toxic"].isin(0, 1) & (fold(labels["doc_id"], folds) != held))
    told = told.groupBy(labels["doc_id"].alias("id")).agg(F.max("toxic").alias("toxic"))
    named = docs.where(docs[text_col].isNotNull() & docs[id_col].isNotNull()).select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    told = materialize(told.join(named.select("id"), "id", "left_semi"), "labels")
    shares = {r.toxic: r["count"] for r in told.groupBy("toxic").count().collect()}
    # Of each label the rows whose hash lies below its share of all hashes: about ``per_class`` of them, found without a shuffle.
    mixed = F.shiftrightunsigned(F.xxhash64(F.col("id").cast("string")), 1)
    below = [min(2**63 - 1, per_class * 2**63 // shares.get(y, 1)) for y in (0, 1)]
    chosen = told.where(mixed <= F.when(F.col("toxic") == 1, below[1]).otherwise(below[0])).select("id", "toxic", (F.pmod(mixed, F.lit(4)) != 0).alias("teaches"))
    # Two labels of about ``per_class`` ids each, whatever the size of the tables.
    texts = named.join(F.broadcast(chosen), "id").groupBy("id").agg(F.max(F.struct("text", "toxic", "teaches")).alias("x"))
    # Of texts that share the least hash of their five-word shingles one counts: what copies repeat is not evidence.
    words = F.filter(F.split(F.lower("x.text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    shingle = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 4, F.lit(1))), lambda k: F.xxhash64(F.slice("w", k, 5)))
    once = texts.withColumn("w", words).groupBy(F.array_min(shingle).alias("near")).agg(F.max(F.struct("x.toxic", "x.teaches", "x.text")).alias("x"))
    return materialize(once.select("x.toxic", "x.teaches", "x.text"), "sample"), shares


def learn_weights(taught: DataFrame, features: int) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of words and of character grams; a feature counts once a document."""

    def counted(features_of) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
                for toxic, text in zip(column(batch, "toxic").to_pylist(), column(batch, "text").to_pylist()):
                    counts[toxic].update(features_of({w.lower() for w in WORD.findall(text)}))
                every = sorted(counts[0].keys() | counts[1].keys())
                yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([counts[1][x] for x in every], pa.int64()), pa.array([counts[0][x] for x in every], pa.int64())], ["feature", "toxic", "clean"])

        rows = taught.select("toxic", "text").mapInArrow(run, "feature string, toxic long, clean long")
        return rows.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))

    n = {r.toxic: r["count"] for r in taught.groupBy("toxic").count().collect()}

    def strongest(rows: DataFrame) -> dict[str, float]:
        seen = F.col("toxic") + F.col("clean")
        kept = rows.select("feature", log_odds(F.col("toxic"), F.col("clean"), n[1], n[0]).alias("weight"), seen.alias("seen")).where(f"weight <> 0 OR seen >= {KNOWN}")
        return {r.feature: r.weight for r in kept.orderBy(F.desc(F.abs("weight")), F.desc("seen"), "feature").limit(features).collect()}

    return strongest(counted(set)), strongest(counted(lambda words: {g for w in words for g in grams(w)}))


def decay(values: np.ndarray, counts: np.ndarray) -> float:
    """lambda of the scores of clean words: the positive root of sum p exp(lambda s) = 1."""
    share = counts / counts.sum()
    low, high = 1e-9, 1.0
    grows = lambda x: float((share * np.exp(x * values)).sum()) > 1
    while not grows(high) and high < 1e6:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if grows(middle) else (middle, high)
    return high


def curve(evidence: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Offset and slope of the logistic curve over ln(1 + evidence), by Newton's method with a light ridge."""
    x = np.stack((np.ones(len(evidence)), np.log1p(evidence)), 1)
    at = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        slope = x.T @ (weight * (toxic - p)) - 1e-3 * at
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        move = np.linalg.solve(bend, slope)
        at = at + np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-9:
            break
    return float(at[0]), float(max(at[1], 0.0))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held: int = 2, per_class: int = 4000, features: int = 50_000) -> Model:
    """``labels``: doc_id, toxic. Rows of fold ``held`` teach nothing."""
    rows, shares = sample(docs, labels, id_col, text_col, folds, held, per_class)
    every = {(r.toxic, r.teaches): r["count"] for r in rows.groupBy("toxic", "teaches").count().collect()}
    if any((y, t) not in every for y in (0, 1) for t in (True, False)):
        return Model(share=shares.get(1, 0) / max(1, sum(shares.values())))
    model = Model(*learn_weights(rows.where("teaches"), features))
    words, parts = model.words, model.parts

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(words, parts)
        for batch in batches:
            out = []
            for text in column(batch, "text").to_pylist():
                found, best = scan(text, weights)
                score, count = np.unique(np.round([weights[w] for w in found], 2), return_counts=True)
                out.append((len(found), [s for s, _, _ in best], score.tolist(), count.tolist()))
            cols = [pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([column(batch, "toxic"), *cols], ["toxic", "n", "best", "score", "count"])

    seen = [r for r in rows.where("NOT teaches").select("toxic", "text").mapInArrow(measure, "toxic int, n long, best array<double>, score array<double>, count array<long>").collect() if r.n]
    clean = [r for r in seen if r.toxic == 0]
    if not clean or len(clean) == len(seen):
        return Model(share=shares.get(1, 0) / sum(shares.values()))
    histogram = Counter({max([STEP, *model.words.values()]): 1})  # the highest weight once, so that some word scores above 0
    for r in clean:
        histogram.update(dict(zip(r.score, r["count"])))
    model.rate = decay(np.array(list(histogram)), np.array(list(histogram.values()), float))
    model.scale = len(clean) / sum(r.n * math.exp(-model.rate * max(r.best, default=0.0)) for r in clean)
    toxic = np.array([r.toxic for r in seen], float)
    weight = np.where(toxic == 1, shares[1] / toxic.sum(), shares[0] / (1 - toxic).sum())
    model.offset, model.slope = curve(np.array([model.evidence(r.best, r.n) for r in seen]), toxic, weight * len(seen) / sum(shares.values()))
    return model


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", expected: float = 0.01) -> DataFrame:
    """Per row: the id, score (0 to 1), evidence, passages (how many are significant). One pass, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most ``features`` words and grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        weights = Weights(known.words, known.parts)
        for batch in batches:
            scores, evidence, passages = [], [], []
            for text in column(batch, "text"):
                words, found = scan(text.as_py(), weights)
                evidence.append(known.evidence([s for s, _, _ in found], len(words)) if found else 0.0)
                scores.append(known.score(evidence[-1]))
                passages.append(sum(known.expected(s, len(words)) <= expected for s, _, _ in found))
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(scores, pa.float64()), pa.array(evidence, pa.float64()), pa.array(passages, pa.int64())], [id_col, "score", "evidence", "passages"])

    ddl = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double, evidence double, passages long"
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, ddl)


def passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", expected: float = 0.01) -> DataFrame:
    """The toxic passages: id, start and end (code points of the text), score, expected, text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        weights = Weights(known.words, known.parts)
        for batch in batches:
            rows, owner = [], []
            for k, text in enumerate(column(batch, "text")):
                text = text.as_py()
                words, found = scan(text, weights)
                found = [x for x in found if known.expected(x[0], len(words)) <= expected]
                if found:
                    spans = [m.span() for m in WORD.finditer(text)]
                    for score, a, b in found:
                        start, end = spans[a][0], spans[b - 1][1]
                        rows.append((start, end, score, known.expected(score, len(words)), text[start:end]))
                        owner.append(k)
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string())
            cols = [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 5, types)]
            yield pa.RecordBatch.from_arrays([column(batch, "id").take(pa.array(owner, pa.int64())), *cols], [id_col, "start", "end", "score", "expected", "text"])

    ddl = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, start long, `end` long, score double, expected double, text string"
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, ddl)
