"""Interpolated modified Kneser-Ney bigrams, counted in Spark, read by workers from mapped files.

Tokens: the ASCII-lower-cased words of a text (separated by ASCII white space), then one end. A word
is known by its XXH64. Training makes three kinds of files of sorted arrays in the shared folder, each
cut into buckets by the leading bits of its hashes, so sizes are even whatever words are frequent:

words   hash u64, count u64; a word's rank is its place over all buckets
stats   by rank: distinct words before it; distinct words after it seen once, twice, more often
pairs   hash u64 of the two ranks (an invertible mix of the packed pair, so no two pairs collide), count u8,
        and where that is 255 the true count in a list beside it

A task counts its own pairs first and ships them, a bucket at a time, as one block of differences of
sorted hashes; a bucket's blocks are merged by one task. So the shuffle holds a few bytes a distinct
pair and task, and no word's pairs meet in one task. File names are drawn anew by each attempt and count
only when the table of them, which Spark commits, has them.

p(w|v) = max(c(vw) - D(c(vw)), 0) / c(v) + g(v) p(w),  p(w) = max(b(w) - D'(b(w)), 0) / B + g' / (V + 1)

with b the number of distinct words before w, B their sum, V the distinct tokens, and the three
discounts of each level from its own counts of counts (0.5, 1, 1.5 where these are too few to tell).
The order is two: on text like this nearly every trigram is new, and their files would outgrow the disk.

Nulls: a null text is the end alone; a row with a null id is scored, held out, never learned from. With
nothing learned every token has the uniform share. Repeated rows count each; extra columns are not read.
The packed pair holds ranks below 2**32; more distinct words raise an error, not a wrong score.
"""

from __future__ import annotations

import functools
import mmap
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, materialize, partitions, scratch, texts

#: Names of the start (a context only) and of the end; no word holds a space.
START, END = b"  ", b" "
#: Tokens and words that a task counts before it ships them.
FLUSH_TOKENS, FLUSH_WORDS = 6_000_000, 1_500_000
#: Hashes in a bucket, about.
BUCKET = 2_000_000
SCORE_TOKENS = 1_500_000

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """An invertible mix of 64 bits (the finalizer of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def unmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31)) ^ (x >> U(62))) * U(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = (x ^ (x >> U(27)) ^ (x >> U(54))) * U(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> U(30)) ^ (x >> U(60))


def dense(keys: np.ndarray, *values: np.ndarray) -> bytes:
    """Sorted keys and their values, as differences, bytes of one rank together, compressed."""
    planes = [np.diff(keys, prepend=U(0)).view(np.uint8).reshape(-1, 8).T.copy()]
    planes += [v.astype("<u4").view(np.uint8).reshape(-1, 4).T.copy() for v in values]
    return zstandard.ZstdCompressor(level=1).compress(np.uint32(len(keys)).tobytes() + b"".join(p.tobytes() for p in planes))


def undense(data: bytes, values: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n, at = int(raw[:4].view(np.uint32)[0]), 4
    out = [np.cumsum(raw[at : at + 8 * n].reshape(8, n).T.copy().view("<u8").ravel(), dtype=np.uint64)]
    for k in range(values):
        lo = at + 8 * n + 4 * n * k
        out.append(raw[lo : lo + 4 * n].reshape(4, n).T.copy().view("<u4").ravel())
    return out


class Ids(dict):
    """Words to numbers, in order of appearance."""

    def __init__(self):
        super().__init__({START: 0, END: 1})

    def __missing__(self, word):
        k = self[word] = len(self)
        return k

    def tokens(self, text: bytes | None) -> np.ndarray:
        """Start, words, end."""
        words = (text or b"").lower().split()
        out = np.empty(len(words) + 2, np.int64)
        out[0], out[-1] = 0, 1
        out[1:-1] = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return out

    def hashes(self) -> np.ndarray:
        digest = xxhash.xxh64_intdigest
        return np.fromiter((digest(w) for w in self), np.uint64, len(self))


def put(folder: str, name: str, *arrays: np.ndarray) -> str:
    name = f"{name}-{uuid.uuid4().hex}"
    files, base = pafs.FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)
    with files.open_output_stream(f"{base}/{name}") as f:
        for a in arrays:
            f.write(a.tobytes())
    return name


def mapped(folder: str, name: str) -> np.ndarray:
    """The bytes of a file, mapped. One in a store that can't be mapped is first copied to a nameless local file."""
    files, base = pafs.FileSystem.from_uri(folder)
    path = f"{base}/{name}"
    if isinstance(files, pafs.LocalFileSystem):
        with open(path, "rb") as f:
            return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), np.uint8)
    with tempfile.TemporaryFile() as local, files.open_input_stream(path) as f:
        while block := f.read(8 << 20):
            local.write(block)
        local.flush()
        return np.frombuffer(mmap.mmap(local.fileno(), 0, access=mmap.ACCESS_READ), np.uint8)


class Table:
    """Sorted hashes in buckets by their leading bits. ``parts``: bucket to (file name, size)."""

    def __init__(self, folder: str, bits: int, parts: dict[int, tuple[str, int]]):
        self.folder, self.bits, self.parts, self.open = folder, bits, parts, {}

    def bucket(self, number: int) -> tuple[np.ndarray, int]:
        if number not in self.open:
            self.open[number] = mapped(self.folder, self.parts[number][0])
        return self.open[number], self.parts[number][1]

    def find(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(bucket, its bytes, positions in ``keys`` that it holds, their places in it). ``keys``: sorted."""
        if not len(keys):
            return
        of = (keys >> U(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        for number in np.unique(of).tolist():
            if number in self.parts:
                lo, hi = np.searchsorted(of, [number, number + 1])
                data, n = self.bucket(number)
                held = data[: 8 * n].view(np.uint64)
                at = np.searchsorted(held, keys[lo:hi])
                found = held[np.minimum(at, n - 1)] == keys[lo:hi]
                yield number, data, lo + np.flatnonzero(found), at[found]


def bits_for(rows: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, rows) / BUCKET))))


def trained(id_col: Column, folds: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds)) != 0, F.lit(False))


def count_words(docs: DataFrame) -> DataFrame:
    """(h long, n long): counts of words by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, size = Ids(), [], 0

        def flush():
            n = np.bincount(np.concatenate(parts), minlength=len(ids))
            keep = n > 0
            keep[0] = False
            return pa.RecordBatch.from_arrays([pa.array(ids.hashes()[keep].view(np.int64)), pa.array(n[keep])], ["h", "n"])

        for batch in batches:
            for text in texts(batch):
                parts.append(ids.tokens(text))
                size += len(parts[-1])
                if size > FLUSH_TOKENS or len(ids) > FLUSH_WORDS:
                    yield flush()
                    ids, parts, size = Ids(), [], 0
        if parts:
            yield flush()

    return docs.select("text").mapInArrow(run, "h long, n long")


FILES = "kind string, bucket long, name string, n long, totals array<long>, data binary"


def files_row(kind: str, bucket: int, name: str | None, n: int, totals=(), data: bytes | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([bucket], pa.int64()), pa.array([name], pa.string()), pa.array([n], pa.int64()), pa.array([[int(x) for x in totals]], pa.list_(pa.int64())), pa.array([data], pa.binary())], ["kind", "bucket", "name", "n", "totals", "data"])


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each bucket, of input sorted by it."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != now and rows:
                yield now, rows
                rows = []
            now = row["bucket"]
            rows.append(row)
    if rows:
        yield now, rows


def write_words(counts: DataFrame, folder: str, bits: int) -> DataFrame:
    bucket = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(column(b, "bucket").to_numpy(), column(b, "h").to_numpy().view(np.uint64), column(b, "n").to_numpy()) for b in batches if b.num_rows]
        if parts:
            of, h, n = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h)
            of, h, n = of[order], h[order], n[order]
            for number in np.unique(of).tolist():
                own = of == number
                name = put(folder, "words", h[own], n[own].astype("<u8"))
                yield files_row("words", number, name, int(own.sum()), [n[own].sum()])

    return counts.withColumn("bucket", bucket).repartition(min(partitions(counts.sparkSession), 1 << bits), "bucket").mapInArrow(run, FILES)


class Words:
    """The words' files and, once made, their stats. Plain data: sent to the workers with the code."""

    def __init__(self, folder: str, bits: int, rows: list):
        self.folder, self.bits = folder, bits
        self.parts = {r.bucket: (r.name, r.n) for r in rows}
        self.tokens, self.size = sum(r.totals[0] for r in rows), sum(r.n for r in rows)
        self.numbers = sorted(self.parts)
        self.bases = np.concatenate(([0], np.cumsum([self.parts[b][1] for b in self.numbers]))).astype(np.int64)

    def table(self) -> Table:
        return Table(self.folder, self.bits, self.parts)


def lookup(words: Words, table: Table, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank (-1: unknown) and count of each word."""
    order = np.argsort(hashes)
    rank, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
    base = dict(zip(words.numbers, words.bases.tolist()))
    for number, data, positions, places in table.find(hashes[order]):
        n = table.parts[number][1]
        rank[order[positions]] = base[number] + places
        count[order[positions]] = data[8 * n : 16 * n].view("<u8")[places]
    return rank, count


@functools.lru_cache(maxsize=4)
def opened(folder: str, bits: int, parts: tuple) -> Table:
    return Table(folder, bits, dict(parts))


def open_words(words: Words) -> Table:
    return opened(words.folder, words.bits, tuple(words.parts.items()))


def count_pairs(docs: DataFrame, words: Words, bits: int) -> DataFrame:
    """(bucket long, data binary): each task's sorted distinct pairs, a bucket a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, size = Ids(), [], 0

        def flush():
            rank, _ = lookup(words, open_words(words), ids.hashes())
            rank[0] = words.size
            pair = np.concatenate([(p[:-1] << 32) | p[1:] for p in parts])
            pair, n = np.unique(pair, return_counts=True)
            key = mix((rank[pair >> 32].astype(U) << U(32)) | rank[pair & 0xFFFFFFFF].astype(U))
            order = np.argsort(key)
            key, n = key[order], n[order]
            of = (key >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
            start = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            for lo, hi in zip(start.tolist(), [*start[1:].tolist(), len(key)]):
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([int(of[lo])], pa.int64()), "data": pa.array([dense(key[lo:hi], n[lo:hi])], pa.binary())})

        for batch in batches:
            for text in texts(batch):
                parts.append(ids.tokens(text))
                size += len(parts[-1])
                if size > FLUSH_TOKENS or len(ids) > FLUSH_WORDS:
                    yield from flush()
                    ids, parts, size = Ids(), [], 0
        if parts:
            yield from flush()

    return docs.select("text").mapInArrow(run, "bucket long, data binary")


def merged(blocks: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Keys, and sums of the values of equal keys."""
    keys = np.concatenate([b[0] for b in blocks])
    order = np.argsort(keys)
    keys = keys[order]
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return [keys[start], *(np.add.reduceat(np.concatenate([b[k] for b in blocks])[order].astype(np.int64), start) for k in range(1, len(blocks[0])))]


def write_pairs(blocks: DataFrame, words: Words, folder: str, bits: int) -> DataFrame:
    """Merges each bucket, writes its file, and hands on what its pairs add to the words' stats."""

    def stats(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        pair = unmix(key)
        first, second = (pair >> U(32)).astype(np.int64), (pair & U(0xFFFFFFFF)).astype(np.int64)
        ranks, at = np.unique(np.concatenate((first, second)), return_inverse=True)
        left, right = at[: len(first)], at[len(first) :]
        columns = [np.bincount(right, minlength=len(ranks))] + [np.bincount(left[keep], minlength=len(ranks)) for keep in (n == 1, n == 2, n > 2)]
        of = np.clip(np.searchsorted(words.bases, ranks, "right") - 1, 0, len(words.numbers) - 1)
        for k in np.unique(of).tolist():
            own = of == k
            yield files_row("part", words.numbers[k], None, int(own.sum()), (), dense(ranks[own].astype(U), *(c[own] for c in columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in by_bucket(batches):
            key, n = merged([undense(r["data"], 1) for r in rows])
            large = n >= 255
            name = put(folder, "pairs", key, n[large].astype("<u8"), np.minimum(n, 255).astype(np.uint8))
            yield files_row("pairs", number, name, len(key), [large.sum(), *((n == k).sum() for k in (1, 2, 3, 4))])
            yield from stats(key, n)

    return blocks.repartition(min(partitions(blocks.sparkSession), 1 << bits), "bucket").sortWithinPartitions("bucket").mapInArrow(run, FILES)


def write_stats(parts: DataFrame, words: Words, folder: str) -> DataFrame:
    base = dict(zip(words.numbers, words.bases.tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in by_bucket(batches):
            # One more than the words of the last bucket: the start, a context only.
            out = np.zeros((4, words.parts[number][1] + 1), np.int64)
            for r in rows:
                ranks, *columns = undense(r["data"], 4)
                for k, c in enumerate(columns):
                    out[k, ranks.astype(np.int64) - base[number]] += c
            name = put(folder, "stats", out.astype("<u4"))
            yield files_row("stats", number, name, out.shape[1], [out[0].sum(), *((out[0] == k).sum() for k in (1, 2, 3, 4))])

    return parts.repartition(max(1, min(partitions(parts.sparkSession), len(words.numbers))), "bucket").sortWithinPartitions("bucket").mapInArrow(run, FILES)


def discounts(counts: np.ndarray) -> np.ndarray:
    """D(0..3+) from how many occur once, twice, three and four times."""
    n1, n2, n3, n4 = (float(x) for x in counts)
    if not (n1 and n2 and n3 and n4):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    return np.clip([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0.0, [0.0, 1.0, 2.0, 3.0])


class Model:
    """File names and sums; a worker opens the files when it first needs them."""

    def __init__(self, folder: str, words: Words, pair_bits: int, pairs: list, stats: list):
        self.folder, self.words, self.bits = folder, words, pair_bits
        self.pairs = {r.bucket: (r.name, r.n) for r in pairs}
        self.large = {r.bucket: r.totals[0] for r in pairs}
        self.stats = {r.bucket: (r.name, r.n) for r in stats}
        self.pair_discount = discounts(np.sum([r.totals[1:] for r in pairs], axis=0) if pairs else np.zeros(4))
        sums = np.sum([r.totals for r in stats], axis=0) if stats else np.zeros(5)
        self.before, self.word_discount = float(sums[0]), discounts(sums[1:])
        self.word_counts = [float(x) for x in sums[1:4]]

    @functools.cached_property
    def files(self):
        return open_words(self.words), opened(self.folder, self.bits, tuple(self.pairs.items())), opened(self.folder, 0, tuple(self.stats.items()))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "files"}

    def spread(self) -> float:
        """g' / (V + 1)."""
        if not self.before:
            return 1.0 / (self.words.size + 1)
        once, twice = self.word_counts[:2]
        more = self.words.size - once - twice
        return float(self.word_discount[1] * once + self.word_discount[2] * twice + self.word_discount[3] * more) / self.before / (self.words.size + 1)

    def score(self, docs: list[np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base score and score of each text; ``docs`` number into ``hashes``."""
        words, pairs, stats = self.files
        rank, count = lookup(self.words, words, hashes)
        rank[0], count[0] = -1, 0
        base = np.log10((count + 0.1) / (self.words.tokens + 0.1 * (self.words.size + 1)))
        own = np.zeros((4, len(hashes)), np.int64)
        context = rank.copy()
        context[0] = self.words.size if self.words.size else -1
        total = count.copy()
        total[0] = count[1]
        of = np.clip(np.searchsorted(self.words.bases, context, "right") - 1, 0, None)
        for k in np.unique(of[context >= 0]).tolist() if len(self.words.numbers) else ():
            k = min(k, len(self.words.numbers) - 1)
            number = self.words.numbers[k]
            data, n = stats.bucket(number)
            here = (context >= 0) & (np.minimum(of, len(self.words.numbers) - 1) == k)
            own[:, here] = data.view("<u4").reshape(4, n)[:, context[here] - self.words.bases[k]]
        before = np.where(rank >= 0, own[0], 0)
        low = np.maximum(before - self.word_discount[np.minimum(before, 3)], 0) / max(self.before, 1.0) + self.spread()
        with np.errstate(divide="ignore", invalid="ignore"):
            back = np.where(total > 0, (self.pair_discount[1:] @ own[1:]) / total, 1.0)
        size = np.array([len(d) - 1 for d in docs])
        pair = np.concatenate([(d[:-1] << 32) | d[1:] for d in docs])
        pair, at = np.unique(pair, return_inverse=True)
        v, w = pair >> 32, pair & 0xFFFFFFFF
        seen = np.zeros(len(pair), np.int64)
        real = np.flatnonzero((context[v] >= 0) & (rank[w] >= 0))
        key = mix((context[v[real]].astype(U) << U(32)) | rank[w[real]].astype(U))
        order = np.argsort(key)
        for number, data, positions, places in pairs.find(key[order]):
            n, large = pairs.parts[number][1], self.large[number]
            small = data[8 * n + 8 * large :]
            got = small[places].astype(np.int64)
            if large:
                big = np.flatnonzero(small == 255)
                much = got == 255
                got[much] = data[8 * n : 8 * n + 8 * large].view("<u8")[np.searchsorted(big, places[much])]
            seen[real[order[positions]]] = got
        with np.errstate(divide="ignore", invalid="ignore"):
            high = np.where(total[v] > 0, np.maximum(seen - self.pair_discount[np.minimum(seen, 3)], 0) / total[v], 0.0)
        score = np.log10(high + back[v] * low[w])
        start = np.cumsum(size) - size
        per = lambda x: np.add.reduceat(x[at], start)
        return size, per((count[w] > 0).astype(np.int64)), per(base[w]), per(score)


def train(docs: DataFrame, folds: int = 10, id_col: str = "doc_id", text_col: str = "text") -> Model:
    spark = docs.sparkSession
    folder = scratch(spark, "ngrams")
    rows = docs.where(trained(docs[id_col], folds)).select(docs[text_col].alias("text"))
    counts = materialize(count_words(rows).groupBy("h").agg(F.sum("n").alias("n")), "word-counts")
    bits = bits_for(counts.count())
    words = Words(folder, bits, materialize(write_words(counts, folder, bits), "word-files").drop("data").collect())
    if words.size >= 1 << 32:
        raise ValueError("more distinct words than a packed pair holds")
    pair_bits = bits_for(words.tokens) + 1
    made = materialize(write_pairs(count_pairs(rows, words, pair_bits), words, folder, pair_bits), "pair-files")
    stats = materialize(write_stats(made.where("kind = 'part'"), words, folder), "stat-files")
    return Model(folder, words, pair_bits, made.where("kind = 'pairs'").drop("data").collect(), stats.drop("data").collect())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, base_score, score (log10 probabilities)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts, size, first = Ids(), [], 0, 0
            for k, text in enumerate(texts(batch)):
                parts.append(ids.tokens(text))
                size += len(parts[-1])
                if size > SCORE_TOKENS or k + 1 == batch.num_rows:
                    found = model.score(parts, ids.hashes())
                    yield pa.RecordBatch.from_arrays([column(batch, "id").slice(first, len(parts)), *map(pa.array, found)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])
                    ids, parts, size, first = Ids(), [], 0, k + 1

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
