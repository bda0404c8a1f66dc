"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints: the ASCII-lower-cased words of a text (separated by ASCII white space), shingles of
``width`` words with repeats (fewer words: the whole sequence), XXH64 with seed 42 of each; a bit is
1 if it is set in more than half of the hashes. No word: fingerprint zero, linked like any other.

Links, at ``budget`` = 3 or fewer differing bits of 64: fingerprints are grouped first, so exact
copies cost one row. Two of them that link agree in at least one of four 16-bit blocks, so each is
put, rotated, into four tries whose first 16 levels pair a node with itself only. A trie is a sorted
array, a node a range of it. The join walks down node pairs together, a level at a time, adds a bit
for each pair of unlike children, and drops a pair once it exceeds the budget, or once both nodes lie
in one and the same component. A task returns a spanning forest of what it linked, never all pairs.

A block value shared by more than ``hot`` fingerprints is dealt to many tasks as the node pairs eight
levels further down: each fingerprint goes to the 93 pairs of its node within the budget, whatever
the group's size. Components then form by alternating large-star and small-star steps, each written
to the shared folder.

Nulls: a null text has no word. A null id takes part in links, and a component's id is the smallest
non-null id in it (null if there is none). Rows with one id each get a result; an empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, join_hot, materialize, one_of_each, partitions, row_key, texts

BITS, BLOCKS, SPLIT_BITS = 64, 4, 8
#: Node pairs, and pairs of fingerprints, looked at in one step: bounds the memory of a task.
STEP, LEAF = 1 << 18, 48
#: Fingerprints that a task of the join holds, about.
PER_TASK = 2_000_000


def shingles(text: bytes | None, width: int) -> Iterator[bytes]:
    words = (text or b"").lower().split()
    if not words:
        return iter(())
    if len(words) <= width:
        return iter((b" ".join(words),))
    return map(b" ".join, zip(*(words[k:] for k in range(width))))


def majority(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, width: int = 3) -> int:
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(s, 42) for s in shingles(text, width)), np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, keyed: bool = False) -> DataFrame:
    """(doc_id long, fp long): one row per row of ``docs``, as 64 bits in a signed long; ``keyed`` adds ``key``, the
    hash of id and text."""
    more = ["key"] if keyed else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, width) for t in texts(batch)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(found.view(np.int64)), *(column(batch, c) for c in more)], ["doc_id", "fp", *more])

    own = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), *(row_key(docs, id_col, text_col).alias(c) for c in more))
    return own.mapInArrow(run, "doc_id long, fp long" + ", key long" * keyed)


def _pairs(lo1, hi1, lo2, hi2) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of a row of the first range with one of the second."""
    n2 = hi2 - lo2
    counts = (hi1 - lo1) * n2
    which = np.repeat(np.arange(len(counts)), counts)
    k = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return lo1[which] + k // n2[which], lo2[which] + k % n2[which]


class _Forest:
    """Components of positions 0..n-1; the label is the least position."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self._changes()

    def _changes(self):
        self.changes = np.concatenate(([0], np.cumsum(self.label[1:] != self.label[:-1]))) if len(self.label) else self.label

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        """Joins what the pairs link, and notes of the pairs those that did it: a spanning forest of real links."""
        a, b = self.label[i], self.label[j]
        if not (a != b).any():
            return
        parent = np.arange(len(self.label))
        while len(a):
            high, low = np.maximum(a, b), np.minimum(a, b)
            order = np.lexsort((low, high))
            first = order[np.concatenate(([True], high[order][1:] != high[order][:-1]))]
            first = first[high[first] != low[first]]
            self.pairs.append((i[first], j[first]))
            parent[high[first]] = low[first]
            while not np.array_equal(up := parent[parent], parent):
                parent = up
            a, b = parent[a], parent[b]
            apart = a != b
            a, b, i, j = a[apart], b[apart], i[apart], j[apart]
        self.label = parent[self.label]
        self._changes()

    def joined(self, lo1, hi1, lo2, hi2) -> np.ndarray:
        """Whether both ranges lie in one component."""
        c = self.changes
        return (c[hi1 - 1] == c[lo1]) & (c[hi2 - 1] == c[lo2]) & (self.label[lo1] == self.label[lo2])


def trie_join(values: np.ndarray, seeds: tuple[np.ndarray, ...], first_bit: int, budget: int) -> _Forest:
    """The components of ``values`` linked at up to ``budget`` differing bits: labels (least positions), and the pairs of a spanning forest.

    ``values``: uint64, sorted within each seed's ranges. ``seeds``: arrays lo1, hi1, lo2, hi2,
    differing bits so far, of node pairs; a node is paired with itself if its ranges are the same.
    ``first_bit``: the level, from the top, at which the nodes part."""
    forest = _Forest(len(values))
    todo = [(first_bit, seeds)]
    while todo:
        bit, (lo1, hi1, lo2, hi2, diff) = todo.pop()
        keep = (hi1 > lo1) & (hi2 > lo2) & (diff <= budget) & ~((lo1 == lo2) & (hi1 - lo1 == 1))
        lo1, hi1, lo2, hi2, diff = (x[keep] for x in (lo1, hi1, lo2, hi2, diff))
        if len(lo1):
            keep = ~forest.joined(lo1, hi1, lo2, hi2)
            lo1, hi1, lo2, hi2, diff = (x[keep] for x in (lo1, hi1, lo2, hi2, diff))
        if not len(lo1):
            continue
        if len(lo1) > STEP:
            half = len(lo1) // 2
            todo += [(bit, tuple(x[half:] for x in (lo1, hi1, lo2, hi2, diff))), (bit, tuple(x[:half] for x in (lo1, hi1, lo2, hi2, diff)))]
            continue
        leaf = (hi1 - lo1) * (hi2 - lo2) <= LEAF if bit < BITS else np.ones(len(lo1), bool)
        if bit >= BITS:  # equal below here: one pair of a range stands for all
            i, j = lo1, lo2
        else:
            i, j = _pairs(lo1[leaf], hi1[leaf], lo2[leaf], hi2[leaf])
        near = np.bitwise_count(values[i] ^ values[j]) <= budget
        forest.link(i[near], j[near])
        lo1, hi1, lo2, hi2, diff = (x[~leaf] for x in (lo1, hi1, lo2, hi2, diff))
        if not len(lo1):
            continue
        ones = np.concatenate(([0], np.cumsum((values >> np.uint64(BITS - 1 - bit)) & np.uint64(1), dtype=np.int64)))
        mid1, mid2 = hi1 - (ones[hi1] - ones[lo1]), hi2 - (ones[hi2] - ones[lo2])
        own = lo1 == lo2
        other = ~own
        same = ((lo1, mid1, lo2, mid2, diff), (mid1, hi1, mid2, hi2, diff))
        cross = [(lo1, mid1, mid2, hi2, diff + 1), (mid1[other], hi1[other], lo2[other], mid2[other], diff[other] + 1)]
        stack = lambda groups: tuple(np.concatenate(x) for x in zip(*groups))
        todo += [(bit + 1, stack(cross)), (bit + 1, stack(same))]
    return forest


def _rotations(fp) -> list:
    step = BITS // BLOCKS
    return [fp if not k else F.shiftleft(fp, k * step).bitwiseOR(F.shiftrightunsigned(fp, BITS - k * step)) for k in range(BLOCKS)]


def links(groups: DataFrame, budget: int = 3, hot: int = 100_000, real: bool = False) -> DataFrame:
    """(src long, dst long): a forest a task whose components are those of all links between the distinct values
    of column ``fp`` of ``groups``. ``real``: its edges are links themselves; else stars, quicker to merge."""
    if not 0 <= budget < BLOCKS:
        raise ValueError("four blocks find links of up to three bits")
    spark, step = groups.sparkSession, BITS // BLOCKS
    turned = groups.select(F.posexplode(F.array(*_rotations(F.col("fp")))).alias("block", "rot")).withColumn("prefix", F.shiftrightunsigned("rot", BITS - step))
    # At most 4 * 65536 rows, whatever the input: safe to broadcast.
    sizes = turned.groupBy("block", "prefix").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > hot).select("block", "prefix", F.lit(True).alias("large"))
    near = [x for x in range(1 << SPLIT_BITS) if x.bit_count() <= budget]
    node = F.shiftrightunsigned("rot", BITS - step - SPLIT_BITS).bitwiseAND(F.lit((1 << SPLIT_BITS) - 1))
    code = lambda x: F.least("node", F.col("node").bitwiseXOR(x)) * (1 << SPLIT_BITS) + F.greatest("node", F.col("node").bitwiseXOR(x)) + 1
    # A task's arrays hold some ``PER_TASK`` fingerprints, whatever the number of shuffle partitions.
    rows = sizes.agg(F.sum(F.when(F.col("n") > hot, F.col("n") * len(near)).otherwise(F.col("n")))).first()[0] or 0
    # Node pair 0: the whole prefix; else one of the pairs below a large one.
    dealt = (
        turned.join(F.broadcast(large), ["block", "prefix"], "left")
        .withColumn("node", node)
        .select("rot", "block", "prefix", F.explode(F.when(F.col("large"), F.transform(F.array(*[F.lit(x).cast("long") for x in near]), code)).otherwise(F.array(F.lit(0).cast("long")))).alias("pair"))
        .select("rot", (F.shiftleft(F.col("pair"), 18) + F.col("prefix") * BLOCKS + F.col("block")).alias("key"))
        .repartition(max(partitions(spark), -(-rows // PER_TASK)), "key")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(column(b, "key").to_numpy(), column(b, "rot").to_numpy()) for b in batches if b.num_rows]
        if not parts:
            return
        key, rot = (np.concatenate(x) for x in zip(*parts))
        rot = rot.view(np.uint64)
        order = np.lexsort((rot, key))
        key, rot = key[order], rot[order]
        pair = key >> 18
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        end = np.append(start[1:], len(key))
        whole = pair[start] == 0
        zeros = np.zeros(len(start), np.int64)
        forests = [trie_join(rot, tuple(x[whole] for x in (start, end, start, end, zeros)), step, budget)]
        # Below a large prefix: the pair of a node with itself, or of two nodes.
        a, b = (pair[start] - 1) >> SPLIT_BITS, (pair[start] - 1) & ((1 << SPLIT_BITS) - 1)
        if not whole.all():
            own = (rot >> np.uint64(BITS - step - SPLIT_BITS)) & np.uint64((1 << SPLIT_BITS) - 1)
            mid = np.array([s + np.searchsorted(own[s:e], np.uint64(y)) if x != y else e for s, e, x, y in zip(start, end, a, np.maximum(b, 0))], np.int64)
            split = ~whole & (a != b)
            alone = ~whole & (a == b)
            seeds = tuple(np.concatenate(x) for x in zip((start[alone], end[alone], start[alone], end[alone], zeros[alone]), (start[split], mid[split], mid[split], end[split], np.bitwise_count((a ^ b)[split]).astype(np.int64))))
            forests.append(trie_join(rot, seeds, step + SPLIT_BITS, budget))
        back = (key & (BLOCKS - 1)).astype(np.uint64) * np.uint64(step)
        fp = np.where(back > 0, (rot >> back) | (rot << ((np.uint64(BITS) - back) & np.uint64(63))), rot).view(np.int64)
        if real:
            linked = [(np.zeros(0, np.int64),) * 2, *(x for f in forests for x in f.pairs)]
            i, j = (np.concatenate(x) for x in zip(*linked))
        else:
            label = forests[0].label if whole.all() else np.where(np.repeat(whole, end - start), forests[0].label, forests[1].label)
            i = np.flatnonzero(label != np.arange(len(label)))
            j = label[i]
        found = np.unique(np.sort(np.stack((fp[i], fp[j])), axis=0), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(found[1]), pa.array(found[0])], ["src", "dst"])

    return dealt.mapInArrow(run, "src long, dst long")


def connected_components(edges: DataFrame, folder: str | None = None) -> DataFrame:
    """(node, root): each node of ``edges`` (src, dst longs) with the least node it reaches; roots too.

    Each large-star step joins every node's larger neighbours to its least one, each small-star step
    its smaller ones and itself; minima are pre-aggregated, and both steps are plain equi-joins of two
    longs a row, whose skewed partitions Spark splits."""
    edges = materialize(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges", folder)
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
        large = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src <> dst").distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(low, "src").select(F.when(F.col("dst") == F.col("low"), F.col("src")).otherwise(F.col("dst")).alias("src"), F.col("low").alias("dst")).where("src <> dst").distinct()
        edges = materialize(small, "edges", folder)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = edges.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct()
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(roots)


def _components(prints: DataFrame, budget: int, hot: int) -> DataFrame:
    """``prints`` (doc_id, fp, ..) with component_id, the smallest id reachable over links, and root, a fingerprint."""
    groups = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "groups")
    members = materialize(groups.select("fp", "least").join(connected_components(links(groups, budget, hot)).withColumnRenamed("node", "fp"), "fp"), "members")
    ids = members.groupBy("root").agg(F.min("least").alias("low"), F.count("*").alias("n"))
    named = join_hot(members, ids, "root", members.count()).select("fp", "root", "low")
    component = F.when(F.col("root").isNotNull(), F.col("low")).otherwise(F.col("least")).alias("component_id")
    named = groups.join(named, "fp", "left").select("fp", "n", component, F.coalesce("root", "fp").alias("root"))
    return join_hot(prints, named, "fp", prints.count())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 3, hot: int = 100_000) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id, the smallest id reachable over links."""
    prints = materialize(fingerprints(docs, id_col, text_col, width), "fingerprints")
    return _components(prints, budget, hot).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 3, hot: int = 100_000) -> DataFrame:
    """One document of each component, whole rows: the one of the least id."""
    prints = materialize(fingerprints(docs, id_col, text_col, width, keyed=True), "fingerprints")
    found = _components(prints, budget, hot).select("key", F.col("doc_id").alias("id"), "root")
    return one_of_each(docs, found, id_col, text_col)
