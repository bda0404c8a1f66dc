import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gleaner.llm import kneser_ney as kn


def tokens(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), None]


def brute(rows, folds):
    """Scores by the formulas alone, with dictionaries."""
    learned = [tokens(t) for k, t in rows if k is not None and zlib.crc32(str(k).encode()) % folds]
    c, pairs = Counter(), Counter()
    for ts in learned:
        c.update(ts)
        pairs.update(zip(["<s>", *ts], ts))
    n, v = sum(c.values()), len(c)
    before = Counter(w for _, w in pairs)
    after = {}
    for (a, _), k in pairs.items():
        after.setdefault(a, Counter())[min(k, 3)] += 1
    d = kn.discounts([sum(x == k for x in pairs.values()) for k in (1, 2, 3, 4)])
    e = kn.discounts([sum(x == k for x in before.values()) for k in (1, 2, 3, 4)])
    total = sum(before.values())
    spread = sum(e[min(x, 3)] for x in before.values()) / total / (v + 1) if total else 1 / (v + 1)
    size = {**c, "<s>": c[None]}
    out = []
    for k, t in rows:
        ts = tokens(t)
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in ts)
        s = 0.0
        for a, b in zip(["<s>", *ts], ts):
            low = max(before[b] - e[min(before[b], 3)], 0) / max(total, 1) + spread
            if size.get(a):
                s += math.log10(max(pairs[a, b] - d[min(pairs[a, b], 3)], 0) / size[a] + sum(d[i] * x for i, x in after[a].items()) / size[a] * low)
            else:
                s += math.log10(low)
        out.append((k, len(ts), sum(c[x] > 0 for x in ts), base, s))
    return out


def check(spark, rows, folds=10):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, h string").repartition(3)
    got = {}
    for r in kn.score(docs, kn.train(docs, folds)).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    want = {}
    for r in brute(rows, folds):
        want.setdefault(r[0], []).append(r[1:])
    assert got.keys() == want.keys()
    for k in want:
        for a, b in zip(sorted(got[k]), sorted(want[k])):
            assert a[:2] == b[:2]
            assert a[2:] == pytest.approx(b[2:], rel=1e-9)


def test_scores_match_the_formulas(spark, sf, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(spark, rows)
    # Several buckets, and several blocks a task.
    monkeypatch.setattr(kn, "BUCKET", 5000)
    monkeypatch.setattr(kn, "FLUSH_TOKENS", 2000)
    check(spark, rows)


def test_nulls_repeats_and_large_counts(spark):
    rows = [(1, "a b"), (2, None), (3, ""), (None, "a z"), (4, "A B c"), (4, "A B c"), (5, "the of " * 700), (6, "É é"), (12, "q")]
    check(spark, rows)


def test_nothing_to_learn(spark):
    check(spark, [(None, "a b"), (None, None)])
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert kn.score(docs, kn.train(docs)).collect() == []


def test_mix_is_a_bijection_and_blocks_round_trip():
    x = np.random.default_rng(1).integers(0, 1 << 63, 5000, np.uint64)
    assert (kn.unmix(kn.mix(x)) == x).all()
    keys = np.unique(x)
    n = np.arange(len(keys))
    a, b = kn.undense(kn.dense(keys, n), 1)
    assert (a == keys).all() and (b == n).all()
