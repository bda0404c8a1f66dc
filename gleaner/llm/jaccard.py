"""Near-duplicates by the Jaccard similarity of shingle sets, ``threshold`` or more, starting from SimHash links.

Sets: the ASCII-lower-cased words of a text, shingles of ``width`` words (fewer words: the whole sequence; no
word: the empty set), each hashed by XXH64; equal sets are one set. Results are exact up to hash collisions.

First the trie join (``simhash.links``) gives pairs of sets whose SimHashes differ in few bits; those that are
similar are links. A SimHash of 64 bits can't find all: at similarity 0.8 it differs in 10 bits on average, in up
to 15 or so, and a trie join with such a budget compares a fixed share of all pairs. So then the rest is found
by a prefix join: in any one order of all shingles, two sets of a similarity of ``threshold`` share one of the
first ``n - ceil(threshold * n) + 1`` shingles of each. The order puts shingles last that are common in a sample
of ``sample`` texts, so few sets meet at one shingle; the order decides the cost only, never the result. Sets
that meet, lie in different components so far, and whose sizes and parity sketches allow the threshold, are
compared element by element; both bounds are exact.

Where more than ``crowd`` sets meet at a shingle, each is first compared with the ``LEADERS`` first of all it
meets in such crowds, and then only with sets that still lie in a different component. Those comparisons are made
on the sketches, a tile of a crowd a task, and only pairs that may be similar leave it. Components are those of
all links, by ``simhash.connected_components``.

Nulls: a null text has the empty set. A component keeps one row, that of the least id (nulls last, ties by
hash of the text), so neither a shared nor a missing id drops or keeps a row by itself; of rows with one id and
text one counts. Texts are read whole; a very long one is one array of hashes. An empty table gives an empty
one; other columns are kept, whatever their names (but ``__key``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import column, join_hot, materialize, one_of_each, partitions, remove, row_key, scratch, texts

#: Sets that one in a crowd is compared with first; sets of a crowd that are compared in one task; most common shingles
#: that are known to a worker; rows of a merged batch; bits of a sketch; rows of a task of the prefix join; most keys
#: that are broadcast.
LEADERS, TILE, COMMON, BATCH, SKETCH, PER_TASK, FEW = 3, 4096, 200_000, 1 << 18, 1024, 4_000_000, 1_000_000


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in simhash.shingles(text, width)), np.uint64)


def set_id(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), 7)


def _longs(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def prefix_length(n: int, threshold: float) -> int:
    return n - math.ceil(threshold * n - 1e-9) + 1 if n else 0


def common_shingles(rows: DataFrame, width: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, of the shingles that at least three texts of a sample have, with their numbers of texts."""
    every = max(1, rows.count() // sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in texts(batch):
                yield pa.RecordBatch.from_arrays([_longs(np.unique(shingle_hashes(text, width)))], ["sig"])

    some = rows.where(F.pmod(F.col("key"), F.lit(every)) == 0).select("text").mapInArrow(run, "sig long")
    found = some.groupBy("sig").agg(F.count("*").alias("n")).where("n >= 3").orderBy(F.desc("n"), "sig").limit(COMMON).collect()
    sig, n = np.array([r.sig for r in found], np.int64).view(np.uint64), np.array([r.n for r in found], np.int64)
    order = np.argsort(sig)
    return sig[order], n[order]


def signed(rows: DataFrame, width: int, threshold: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, id, set, n, fp, sketch, long, prefix) per row. ``fp``: the SimHash. ``sketch``: SKETCH bits, each the parity
    of the shingles that fall on it; ``long``: the same, of two to four bits a shingle. A set's prefix goes with the first row of it in a task only: copies meet once a task."""
    known, often = common

    def prefix(found: np.ndarray) -> np.ndarray:
        rank = np.zeros(len(found), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, found), len(known) - 1)
            rank = np.where(known[at] == found, often[at], 0)
        return found[np.argsort(rank, kind="stable")[: prefix_length(len(found), threshold)]]

    def sketch(found: np.ndarray, bits: int) -> bytes:
        odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        return np.packbits(odd.astype(bool)).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for text in texts(batch):
                hashes = shingle_hashes(text, width)
                found = np.unique(hashes)
                own = set_id(found)
                first = own not in seen
                seen.add(own)
                for o, v in zip(out, (own, len(found), simhash.majority(hashes), sketch(found, SKETCH) if first else None, sketch(found, max(SKETCH, 1 << (2 * len(found)).bit_length())) if first else None, prefix(found).view(np.int64) if first else None)):
                    o.append(v)
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([column(batch, "key"), column(batch, "id"), _longs(out[0]), pa.array(out[1], kinds[0]), _longs(out[2]), pa.array(out[3], kinds[1]), pa.array(out[4], kinds[1]), pa.array(out[5], kinds[2])], ["key", "id", "set", "n", "fp", "sketch", "long", "prefix"])

    return rows.mapInArrow(run, f"key long, id {rows.schema['id'].dataType.simpleString()}, set long, n long, fp long, sketch binary, long binary, prefix array<long>")


def _groups(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Per sig of two sets or more: the sig, its distinct sets, ascending, and the other columns."""
    parts = [[_values(column(b, x)) for x in ("sig", "set", *names)] for b in batches if b.num_rows]
    if not parts:
        return
    cols = [np.concatenate(x) for x in zip(*parts)]
    order = np.lexsort((cols[1], cols[0]))
    cols = [x[order] for x in cols]
    once = np.concatenate(([True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])))
    cols = [x[once] for x in cols]
    start = np.flatnonzero(np.concatenate(([True], cols[0][1:] != cols[0][:-1])))
    end = np.append(start[1:], len(cols[0]))
    for s, e in zip(start[end - start > 1], end[end - start > 1]):
        yield cols[0][s], *(x[s:e] for x in cols[1:])


def _values(values: pa.Array) -> np.ndarray:
    if pa.types.is_binary(values.type):
        return np.frombuffer(b"".join(values.to_pylist()), np.uint64).reshape(len(values), -1)
    return values.to_numpy()


def _merged(rows: Iterator[list[np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns of longs as a few large batches."""
    held, size = [], 0
    for cols in rows:
        held.append(cols)
        size += len(cols[0])
        if size >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)


def meetings(prints: DataFrame) -> DataFrame:
    """(sig, set, met, lead): the prefixes of all sets, with how many sets meet and the first of them; without shingles
    at which a set is alone."""
    total = prints.agg(F.sum(F.size("prefix").cast("long"))).first()[0] or 0

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _merged(([np.full(len(owner), sig, np.int64), owner, np.full(len(owner), len(owner)), np.full(len(owner), owner[0])] for sig, owner in _groups(batches)), ["sig", "set", "met", "lead"])

    dealt = prints.where("prefix IS NOT NULL").select(F.explode("prefix").alias("sig"), "set")
    return dealt.repartition(max(partitions(prints.sparkSession), -(-total // PER_TASK)), "sig").mapInArrow(met, "sig long, set long, met long, lead long")


def _fitting(n: np.ndarray, i: int, threshold: float) -> np.ndarray:
    """Which of the later sets' sizes allow the threshold with the ``i``-th."""
    return np.minimum(n[i], n[i + 1 :]) >= threshold * np.maximum(n[i], n[i + 1 :]) - 1e-9


def _allowed(x: np.ndarray, y: np.ndarray, total: np.ndarray, threshold: float) -> np.ndarray:
    """Whether two sketches allow the threshold: they differ in no more bits than the sets, of ``total`` elements, in elements."""
    return (1 + threshold) * np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64) <= (1 - threshold) * total + 1e-6


def _fold(sketch: np.ndarray, size: int) -> np.ndarray:
    """A sketch as one of fewer bits: what falls on one bit then is what fell on two."""
    while len(sketch) > size:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def first_pairs(met: DataFrame, threshold: float, crowd: int) -> DataFrame:
    """(a, b), a < b: sets that meet and whose sizes allow the threshold; of a crowd pairs with ``LEADERS`` sets."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for _, owner, n in _groups(batches, "n"):
            crowded = len(owner) > crowd
            for i in range(min(len(owner), LEADERS) if crowded else len(owner)):
                other = owner[i + 1 :][_fitting(n, i, threshold)]
                if len(other):
                    yield [np.full(len(other), owner[i]), other, np.full(len(other), crowded, np.int64)]

    dealt = met.select("sig", "set", "n").repartition(max(partitions(met.sparkSession), -(-met.count() // PER_TASK)), "sig")
    rows = dealt.mapInArrow(lambda batches: _merged(found(batches), ["a", "b", "crowded"]), "a long, b long, crowded long").distinct()
    # Of the leaders that a set has in all its crowds, the first.
    first = F.row_number().over(Window.partitionBy("b", "crowded").orderBy("a"))
    return rows.withColumn("nth", first).where(f"crowded = 0 OR nth <= {LEADERS}").select("a", "b").distinct()


def other_pairs(met: DataFrame, sketches: DataFrame, threshold: float, crowd: int) -> DataFrame:
    """(a, b), a < b: sets of one crowd that lie in different components (column ``root``) and whose sizes and sketches
    allow the threshold. The crowds that have one first set are one group, so each pair leaves it once; a group is cut
    into blocks of about ``TILE`` sets, and each two of them are a tile of their own."""
    rows = materialize(met.where(F.col("met") > crowd).select("lead", "set", "n", "root").distinct(), "crowds")
    groups = rows.groupBy("lead").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / TILE).alias("blocks")).where("low <> high").select("lead", "blocks")
    rows = rows.join(groups, "lead").withColumn("block", F.pmod(F.xxhash64("set"), "blocks"))
    rows = rows.join(few(sketches, rows.select("set").distinct(), "set").dropDuplicates(["set"]), "set")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select(F.xxhash64("lead", F.least("block", "other"), F.greatest("block", "other")).alias("sig"), "set", "n", "root", "sketch", "block", (F.col("block") == F.col("other")).cast("long").alias("alone"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for _, owner, n, root, sketch, block, alone in _groups(batches, "n", "root", "sketch", "block", "alone"):
            for i in range(len(owner)):
                ok = _fitting(n, i, threshold) & (root[i + 1 :] != root[i]) & ((block[i + 1 :] != block[i]) | (alone[i] == 1))
                other = i + 1 + np.flatnonzero(ok)
                other = other[_allowed(sketch[i], sketch[other], n[i] + n[other], threshold)]
                if len(other):
                    yield [np.full(len(other), owner[i]), owner[other]]

    dealt = rows.repartition(max(partitions(met.sparkSession), -(-rows.count() // (PER_TASK // 16))), "sig")
    return dealt.mapInArrow(lambda batches: _merged(found(batches), ["a", "b"]), "a long, b long").distinct()


def similar(found: DataFrame, rows: DataFrame, sketches: DataFrame, width: int, threshold: float, folder: str) -> DataFrame:
    """(src, dst): the pairs (a, b) of sets that are similar. First what sketches allow, short ones and then long ones;
    then the sets themselves, made from the texts of those alone that are asked for."""
    found = materialize(found, "pairs", folder)
    some = materialize(few(sketches.drop("long"), found.select(F.explode(F.array("a", "b")).alias("set")).distinct(), "set").dropDuplicates(["set"]), "asked", folder)
    both = found.join(some.select(F.col("set").alias("a"), "n", F.col("sketch").alias("x")), "a").join(some.select(F.col("set").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y")), "b")

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y, total = (_values(column(batch, c)) for c in ("x", "y", "total"))
                yield batch.select(["a", "b", "total"]).filter(pa.array(_allowed(x, y, total, threshold)))

    def still(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                each = zip(*([np.frombuffer(v, np.uint64) for v in column(batch, c).to_pylist()] for c in ("x", "y")), column(batch, "total").to_pylist())
                ok = [bool(_allowed(_fold(x, len(y)), _fold(y, len(x)), total, threshold)) for x, y, total in each]
                yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = materialize(both.select("a", "b", (F.col("n") + F.col("m")).alias("total"), "x", "y").mapInArrow(allowed, "a long, b long, total long"), "possible", folder)
    longs = materialize(few(sketches.select("set", "long"), left.select(F.explode(F.array("a", "b")).alias("set")).distinct(), "set").dropDuplicates(["set"]), "long-sketches", folder)
    both = left.join(longs.toDF("a", "x"), "a").join(longs.toDF("b", "y"), "b")
    left = materialize(both.select("a", "b", "total", "x", "y").mapInArrow(still, "a long, b long"), "possible", folder)
    wanted = left.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    keys = some.join(wanted, "set", "left_semi").select("key").distinct()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, width)) for t in texts(batch)]
            # Half of each hash is enough to tell two sets' elements apart, and half as much is moved.
            yield pa.RecordBatch.from_arrays([_longs([set_id(s) for s in sets]), pa.array([(s >> np.uint64(32)).astype(np.uint32).view(np.int32) for s in sets], pa.list_(pa.int32()))], ["set", "of"])

    sets = materialize(few(rows, keys, "key").select("text").mapInArrow(whole, "set long, of array<int>"), "sets", folder).dropDuplicates(["set"])
    both = left.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").withColumn("common", F.size(F.array_intersect("x", "y")))
    links = both.where(F.col("common") >= F.lit(threshold) * (F.size("x") + F.size("y") - F.col("common")) - 1e-9)
    return materialize(links.select(F.col("a").alias("src"), F.col("b").alias("dst")), "links", folder)


def few(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key is wanted: by broadcast if ``FEW`` keys at most are, else by a shuffle."""
    wanted = materialize(wanted, "wanted")
    return rows.join(F.broadcast(wanted) if wanted.count() <= FEW else wanted, key, "left_semi")


def simhash_pairs(sets: DataFrame) -> DataFrame:
    """(a, b): sets whose SimHashes are linked in the trie join, by one set of each SimHash; and the sets of one SimHash."""
    prints = materialize(sets.groupBy("fp").agg(F.min("set").alias("first"), F.count("*").alias("n")), "simhashes")
    same = join_hot(sets.select("set", "fp"), prints, "fp", sets.count()).where("set <> first").select(F.col("first").alias("a"), F.col("set").alias("b"))
    found = materialize(simhash.links(prints.select("fp"), real=True), "simhash-links")
    named = found.join(prints.select(F.col("fp").alias("src"), F.col("first").alias("a")), "src").join(prints.select(F.col("fp").alias("dst"), F.col("first").alias("b")), "dst")
    return same.unionByName(named.select("a", "b"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, crowd: int = 16, sample: int = 20_000, folder: str | None = None) -> DataFrame:
    """(key, id, root) per row: ``key`` is the hash of id and text, ``root`` the least set of its component."""
    folder = folder or scratch(docs.sparkSession, "jaccard")
    rows = docs.select(row_key(docs, id_col, text_col).alias("key"), docs[id_col].alias("id"), docs[text_col].alias("text"))
    prints = materialize(signed(rows, width, threshold, common_shingles(rows, width, sample)), "prints", folder)
    firsts = prints.where("sketch IS NOT NULL")
    sets = materialize(prints.groupBy("set").agg(F.min("fp").alias("fp"), F.min("n").alias("n"), F.count("*").alias("copies")), "distinct-sets", folder)
    sketches = firsts.select("set", "n", "sketch", "long", "key")
    met = meetings(firsts)
    met = materialize(met, "meetings", folder)
    met = materialize(met.join(few(sets.select("set", "n"), met.select("set").distinct(), "set"), "set"), "met", folder)
    compare = lambda found: similar(found, rows, sketches, width, threshold, folder)
    edges = compare(simhash_pairs(sets).unionByName(first_pairs(met, threshold, crowd)).distinct())
    roots = materialize(simhash.connected_components(edges, folder).toDF("set", "found"), "roots", folder)
    of = lambda x, found: x.join(found, "set", "left").withColumn("root", F.coalesce("found", "set")).drop("found")
    more = compare(other_pairs(of(met, roots), sketches.select("set", "sketch"), threshold, crowd))
    edges = more.unionByName(roots.select(F.col("set").alias("src"), F.col("found").alias("dst")))
    roots = materialize(simhash.connected_components(edges, folder).toDF("set", "found"), "roots", folder)
    return join_hot(prints.select("key", "id", "set"), of(sets.select("set", F.col("copies").alias("n")), roots), "set", prints.count()).select("key", "id", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """One document of each component, whole rows: the one of the least id."""
    folder = scratch(docs.sparkSession, "jaccard")
    kept = one_of_each(docs, components(docs, id_col, text_col, width, threshold, folder=folder), id_col, text_col)
    remove(docs.sparkSession, folder)
    return kept
