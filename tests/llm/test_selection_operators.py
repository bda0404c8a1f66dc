"""Top-k, mixing, SpotSigs and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gleaner.llm import mixing, spotsigs, topk


def brute_top(rows, k, n):
    ok = [(i, [float(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % n == 0:
            scored = sorted((-int(sum(x * y for x, y in zip(a, b))), i) for i, b in ok if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run_top(spark, rows, k, n, **sizes):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return sorted(map(tuple, topk.search(frame.where(topk.every_nth(F.col("vec_id"), n)), frame, k, **sizes).collect()))


def test_top_k_with_ties_nulls_and_small_tiles(spark):
    rng = random.Random(3)
    rows = [(k, [rng.choice([0.0, 0.5, -0.25, 1.0]) for _ in range(4)]) for k in range(120)]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan")] * 4), (203, [float("inf")] * 4), (None, [1.0] * 4), (204, [1.0]), (205, [])]
    want = brute_top(rows, 5, 10)
    assert run_top(spark, rows, 5, 10) == want
    assert run_top(spark, rows, 5, 10, query_block=3, candidate_block=7, fan=2) == want
    assert run_top(spark, rows[:3], 5, 1) == brute_top(rows[:3], 5, 1)
    assert run_top(spark, [], 5, 1) == []


def test_top_k_of_repeated_ids(spark):
    rows = [(1, [1.0]), (1, [2.0]), (2, [1.0])]
    got = run_top(spark, rows, 5, 2)
    assert got == [(2, 1, 1, 131072), (2, 2, 1, 65536)]


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(rows):
    total = Counter()
    for s, t in rows:
        total[s] += size(t)
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    out, left, free = {}, float(sum(total.values())), set(names)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * total[s] + 1e-9]
        if not over:
            return out | share, total
        for s in over:
            out[s] = 3.0 * total[s]
            left -= out[s]
            free.discard(s)
    return out, total


def test_mix_reaches_targets_and_repeats(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "a", "a", "b", "Z", "é", None])) for k in range(900)] + [(901, None, "a"), (902, "w " * 5000, "a"), (903, "x", "tiny"), (904, None, "empty"), (None, "n n", "b")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int").repartition(3)
    got = mixing.mix(docs, shards=5).collect()
    want, total = brute_targets([(r[2], r[1]) for r in rows])
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r["size"] == size(next(x[1] for x in rows if x[0] == r.doc_id)) and r.source_size == total[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * (1 + r.target)
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r["size"] and len(r.shards) == r.copies and all(0 <= s < 5 for s in r.shards)
        taken[r.source] += r.taken
    for s in want:
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], 5)
    again = mixing.mix(docs.repartition(7), shards=5).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    out = Counter(r.doc_id for r in mixing.mixed(docs, shards=5).collect())
    assert out == Counter({r.doc_id: r.copies for r in got if r.copies})
    assert mixing.mix(docs.where("false")).collect() == []


def test_splitting_tree_keeps_exact_quotas(spark):
    quotas = spark.createDataFrame([("a", 700), ("b", 31), (None, 4), ("z", 0)], "source string, quota long")
    rows = mixing.split_tree(quotas, 6, 3).collect()
    for s, q in (("a", 700), ("b", 31), (None, 4)):
        own = sorted((r["first"], r.quota) for r in rows if r.source == s)
        assert sum(n for _, n in own) == q and own[0][0] == 0
        assert all(x[0] + x[1] == y[0] for x, y in zip(own, own[1:]))
    per = Counter()
    for r in rows:
        per[r.shard] += r.quota
    assert len(per) == 6 and max(per.values()) - min(per.values()) <= 3


def test_hypergeometric_draws_follow_their_distribution(spark):
    draws = spark.range(4000).select(mixing.hypergeometric((F.col("id") + 0.5) / 4000.0, F.lit(30).cast("long"), F.lit(50).cast("long"), F.lit(20).cast("long")).alias("k"))
    got = Counter(r.k for r in draws.collect())
    from math import comb

    for k in range(21):
        assert abs(got[k] / 4000 - comb(30, k) * comb(50, 20 - k) / comb(80, 20)) < 2e-3


def plain_set(text, chain=2, reach=6):
    words = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
    anchors, out = set(spotsigs.ANCHORS), set()
    for k, w in enumerate(words):
        if w in anchors:
            tail = [x for x in words[k + 1 : k + 1 + reach] if x not in anchors][:chain]
            if len(tail) == chain:
                out.add((w, *tail))
    return out or {tuple(words)}


def test_spotsigs_compares_edited_and_next_texts(spark):
    rng = random.Random(4)
    pool = spotsigs.ANCHORS[:12] + [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 120))) for _ in range(70)]
    rows = [(k * 3 - 50, t) for k, t in enumerate(texts)] + [(500, None), (501, ""), (502, texts[3]), (503, "one"), (504, "the " * 4000 + "end of it")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, set string").repartition(4)
    got = {r.doc_id: r for r in spotsigs.edited_comparison(docs).collect()}
    ordered = sorted((k, t or "") for k, t in rows)
    prints = {}
    for k, (i, t) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        r, a, b, c = got[i], plain_set(t), plain_set(edited), plain_set(following)
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        for value, other in ((r.near_edited, b), (r.near_next, c)):
            assert abs(value - len(a & other) / len(a | other)) < 1e-12
        assert prints.setdefault(frozenset(a), r.fingerprint) == r.fingerprint
    assert len(set(prints.values())) == len(prints)
    one = spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")
    assert spotsigs.edited_comparison(one).first().edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    assert spotsigs.edited_comparison(one.where("false")).collect() == []
    odd = spark.createDataFrame([(None, "aaaa"), (1, "bbbb"), (1, "bbbb")], "doc_id long, text string")
    assert len(spotsigs.edited_comparison(odd).collect()) == 3


def test_spotsigs_join_finds_every_similar_pair(spark):
    rng = random.Random(6)
    base = [[rng.choice(spotsigs.ANCHORS[:8] + [f"w{k}" for k in range(40)]) for _ in range(150)] for _ in range(6)]
    texts = []
    for b in base:
        for _ in range(6):
            copy = list(b)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(99)}"
            texts.append(" ".join(copy))
    texts += [texts[0], texts[0]]
    pairs, members = spotsigs.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    sets = [plain_set(t) for t in texts]
    of = {r.doc_id: r.class_id for r in members.collect()}
    want = {(i, j) for i in set(of.values()) for j in set(of.values()) if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert {(r.class_a, r.class_b) for r in pairs.collect()} == want and want
    assert of[len(texts) - 1] == 0
