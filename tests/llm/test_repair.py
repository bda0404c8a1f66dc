"""Conversation repair: the trie's answers against every sequence of edits, whole conversations against plain Python."""

import hashlib
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from gleaner.llm import repair

GRAMMAR = re.compile("(s?(ua)+)?")
INK = re.compile(r"[^\x20\x09-\x0D]")


def least(rows):
    """``rows`` of (initial, fault): the least (cost, audit, output) over all edits; outputs are row numbers or None, with initials."""
    best = (2 * len(rows), "D" * len(rows), ())

    def go(i, cost, audit, out, inserted):
        nonlocal best
        if (cost, audit) > best[:2] and cost > best[0]:
            return
        if i == len(rows) and GRAMMAR.fullmatch("".join(r for _, r, _ in out)):
            best = min(best, (cost, audit, out), key=lambda x: x[:2])
        if inserted < 2:
            for r in "ua":
                go(i, cost + 5, audit + "I", (*out, (None, r, False)), inserted + 1)
        if i < len(rows):
            initial, fault = rows[i]
            go(i + 1, cost + 2, audit + "D", out, 0)
            if fault not in ("blank", "duplicate"):
                cut = 5 if fault == "truncated" else 0
                go(i + 1, cost + cut, audit + "K", (*out, (i, initial, True)), 0)
                for r in "ua":
                    go(i + 1, cost + cut + 1, audit + "R", (*out, (i, r, False)), 0)

    go(0, 0, "", (), 0)
    return best


def brute(rows):
    """``rows`` (turn, role, text) of one conversation id, by the contract; short ones only."""
    conv_id, rows = rows
    after = []
    for turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        after += [(turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    faults, seen = [], set()
    for _, role, text in after:
        ink = INK.findall(text)
        faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else None)
        seen.add((role, text))
    initials = [r[1][:1] for r in after]
    cost, audit, out = least([(a, f) for a, f in zip(initials, faults)])
    name = {"u": "user", "a": "assistant"}
    lines = [f"{after[i][1] if kept else name[r]}:{'' if i is None else after[i][2]}" for i, r, kept in out]
    turns = [t for t, _, _ in after if t is not None]
    count = lambda f: sum(x == f for x in faults)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_trie_against_all_edits():
    trie, sizes = repair.Trie(), 0
    words = sorted("".join(p) for n in range(4) for p in product("suaoSUAOx", repeat=n))
    for s in words:
        sizes += len(s)
        fault = lambda c: "blank" if c == "x" else "truncated" if c.isupper() else None
        assert trie.solve(s)[:2] == least([(c.lower(), fault(c)) for c in s])[:2], s
    # A layer is computed once a node of the trie: there are 9 + 81 + 729 below the root.
    assert trie.computed == 819 < sizes


def test_steps_and_ends():
    assert repair.Trie().solve("") == (0, "", [""])
    assert repair.Trie().solve("s") == (2, "D", ["d", ""])
    assert repair.Trie().solve("ua" * 4)[:2] == (0, "K" * 8)
    cost, audit, steps = repair.Trie().solve("u" * 9 + "a")
    assert len(steps) == 11 and audit.count("I") == sum(x.isupper() for s in steps for x in s)
    assert repair.Trie().solve("ua" * 50_000)[:2] == (0, "K" * 100_000)


ODD = [
    (None, 0, "user", "Of no conversation."), (None, 1, "assistant", "Nor this."), (1001, None, None, None), (1001, None, "user", "first."), (1001, 5, "", "no role."), (1001, 5, "user", "same turn"),
    (1002, 0, "tool", "é  !"), (1002, 0, "tool", "é  !"), (1002, 9, "assistant", "\t\n"), (1003, 1, "assistant", "long " * 50_000 + "."), (1003, 1, "user", "x"), (1004, 0, "system", "be kind."), (1004, 1, "system", "s."),
    (1005, 7, "user", "again?"), (1005, 8, "user", "again?"), (1005, 9, "assistant", "Yes.\n"),
]


@pytest.mark.parametrize("parts", [1, 5])
def test_conversations_against_brute_force(spark, sf, parts):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(*r,) for r in ODD] + [(k, t, r, f"{k}.") for k in range(2000, 2150) for t, r in ((0, "user"), (1, "assistant"))] + [(k, 0, "user", "alone.") for k in range(3000, 3100)], rows.schema)
    both = rows.unionByName(odd).withColumn("audit", F.lit("x")).withColumn("last", F.lit(1)).repartition(parts)
    groups = {}
    for r in both.collect():
        groups.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    got = repair.repair(both).collect()
    assert len(got) == len(groups)
    assert {r.conv_id: tuple(r)[1:] for r in got} == {k: brute((k, v)) for k, v in groups.items()}
    assert any(r.audit == "" for r in got) and {c for r in got for c in r.audit} == set("KRD")  # an insert is never cheaper than a delete


def test_long_conversation_and_empty_table(spark):
    rows = spark.range(3000).selectExpr("1L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('text ', id, '.') AS text")
    found = repair.repair(rows).first()
    assert found.gaps > 0 and found.duplicate > 0 and found.cost > 0
    assert repair.repair(rows.where("false")).count() == 0
    assert [f.name for f in repair.repair(rows.where("false")).schema] == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
