import random
import re

import numpy as np
import pytest
import xxhash

from gleaner.llm import simhash


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    runs = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(values, budget):
    """Component label of each distinct value: the least value reachable."""
    values = sorted(set(values))
    label = {v: v for v in values}

    def find(v):
        while label[v] != v:
            v = label[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= budget:
                ra, rb = find(a), find(b)
                label[max(ra, rb)] = min(ra, rb)
    return {v: find(v) for v in values}


def cluster(seed, centres=6, each=60):
    rng = random.Random(seed)
    out = []
    for _ in range(centres):
        at = rng.getrandbits(64)
        for _ in range(each):
            out.append(at)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                at ^= 1 << b
    return out + [rng.getrandbits(64) for _ in range(300)] + [0, 1, 7, 15, (1 << 64) - 1]


@pytest.mark.parametrize("hot", [100_000, 20])
def test_links_form_the_components_of_brute_force(spark, hot):
    values = cluster(hot)
    signed = [int(np.uint64(v).astype(np.int64)) for v in set(values)]
    groups = spark.createDataFrame([(v,) for v in signed], "fp long")
    members = {r.node: r.root for r in simhash.connected_components(simhash.links(groups, 3, hot)).collect()}
    expected = brute(values, 3)
    got, want = {}, {}
    for v, s in ((v, int(np.uint64(v).astype(np.int64))) for v in set(values)):
        got.setdefault(members.get(s, s), set()).add(v)
        want.setdefault(expected[v], set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_dense_trie_is_joined_exactly():
    rng = np.random.default_rng(5)
    values = np.zeros(4000, np.uint64)
    for b in rng.integers(0, 64, (3, 4000)):
        values ^= np.uint64(1) << b.astype(np.uint64)
    values = np.unique(values)
    one = lambda x: np.array([x], np.int64)
    label = simhash.trie_join(values, (one(0), one(len(values)), one(0), one(len(values)), one(0)), 0, 3).label
    expected = brute([int(v) for v in values], 3)
    assert len(set(label)) == len(set(expected.values()))


def test_rows_match_brute_force_with_nulls_and_repeats(spark):
    texts = ["A b c d e f", "a  b\tc D e f", "a b c d e g", None, "", "x", "one two", "É b c", "w " * 3000, None, "\x1c x"]
    rows = [(k * 3, t, "clash") for k, t in enumerate(texts)] + [(0, texts[0], "clash"), (None, "q r s t", None)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    prints = {}
    for k, t, _ in rows:
        prints.setdefault(plain_fingerprint(t), []).append(k)
    root = brute(prints, 3)
    low = {}
    for v, ids in prints.items():
        low.setdefault(root[v], []).extend(i for i in ids if i is not None)
    expected = sorted(((k, f"{plain_fingerprint(t):016x}", min(low[root[plain_fingerprint(t)]], default=None)) for k, t, _ in rows), key=str)
    assert sorted(map(tuple, got), key=str) == expected


def test_empty_table_and_keep_one(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).collect() == []
    rows = [(5, "a b c d"), (2, "a b c d"), (2, "a b c d"), (9, "other words are here"), (None, "n"), (None, None)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(2, "a b c d"), (9, "other words are here"), (None, "n"), (None, None)], key=str)
    # A shared id drops nothing: only the copy of a text that another row has.
    rows = [(1, "p q r s t"), (2, "p q r s t"), (2, "u v w x y"), (2, "k l m n o"), (None, "z a z b"), (None, "z a z b")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[2], rows[3], rows[4]], key=str)
