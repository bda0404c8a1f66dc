"""Conversation structure repair: the cheapest edits that make roles follow ``(system? (user assistant)+)?``.

1. Rows get their faults without their text: a digest of role and text stands for it. Ordered by turn, a
   conversation becomes one signature, a character a row: its role's initial (``s u a``, others ``o``), in
   capitals if the text is cut off, ``x`` if the row must go (blank, or its role and text came earlier).
2. Signatures are sorted over all partitions, so that those with a common beginning lie together. A task
   walks them depth-first as the prefix trie they spell: the stack holds one DP layer a prefix, a signature
   computes layers only below the prefix it shares with the one before, and its end is a terminal node that
   emits cost, audit and steps. Hot signatures are spread by their conversations' hash and computed once a task.
3. Steps and texts meet by one sort and are hashed as they stream past; no conversation's text is held.

A DP layer has for each state of the grammar (nothing yet, after system, after user, after assistant) the
least (cost, audit) of the rows so far. Inserts are made before a row or at the end, so no audit of a layer
begins another and the order of two audits never changes by what follows: a rank a state replaces the strings.

Bounds: a conversation's signature, digests and audit are in one row (about 70 bytes a turn), its texts in none.
One conversation is hashed by one task, as SHA-256 runs in order; its texts may spill, but are not held.

Nulls: a null role or text is one space, in the damage's key a null id or turn too. Null turns come first and leave
no gap; rows of a null id are one conversation. Rows that share a turn go by role, then by digest; a row repeated
as a whole is a duplicate of the first. An empty role has no initial and is never kept. Conversations that damage
leaves without rows are returned with zeros. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, materialize, partitions

#: What is no blank, what ends a sentence, what edits cost.
INK, END = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
LEGAL = ("su", "ua", "au")
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def damage(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copies): rows as damaged by the crc32 of ``id:turn``; those dropped have 0 copies."""
    said = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(said(id_col), F.lit(":"), said(turn_col)).cast("binary")), F.lit(20))
    role = F.when(fault == 4, F.lit("user")).otherwise(said(role_col))
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(said(text_col), "[.!?]", "")).otherwise(said(text_col))
    return rows.select(rows[id_col].alias("conv_id"), rows[turn_col].alias("turn"), role.alias("role"), text.alias("text"), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"))


def digest(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def signatures(damaged: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, ``COUNTS``, signature, places (of each row turn, role and digest, in order)."""
    rows = damaged.select("conv_id", "turn", "role", digest(F.col("role"), F.col("text")).alias("digest"), (~F.col("text").rlike(INK)).alias("blank"), (~F.col("text").rlike(END)).alias("cut"), (F.col("copies") > 0).alias("live"), F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1)))).alias("copy"))
    # Dropped rows come last: they only keep their conversation in the result.
    order = [F.desc("live"), F.asc_nulls_first("turn")]
    along = Window.partitionBy("conv_id").orderBy(*order, "role", "digest", "copy")
    initial = F.substring("role", 1, 1)
    rows = rows.withColumn("at", F.row_number().over(along)).withColumn("pair", F.concat(F.lag(initial).over(along), initial)).withColumn("before", F.lag("turn").over(along))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy("at"))).where("live OR at = 1")
    duplicate = ~F.col("blank") & (F.col("nth") > 1)
    cut = ~F.col("blank") & ~duplicate & F.col("cut")
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.col("blank") | duplicate, "x").when(cut, F.upper(known)).otherwise(known)
    count = lambda c: F.count_if(F.col("live") & c)
    turn = F.when(F.col("live"), F.col("turn"))
    new_turn = turn.isNotNull() & ~F.coalesce(F.col("before") == F.col("turn"), F.lit(False))
    own = rows.groupBy("conv_id").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_if(new_turn), F.lit(0)).cast("long").alias("gaps"), count(F.col("blank")).alias("blank"), count(duplicate).alias("duplicate"), count(cut).alias("truncated"),
        count(F.col("pair").isNotNull() & ~F.col("pair").isin(*LEGAL)).alias("illegal"), F.sort_array(F.collect_list(F.when(F.col("live"), F.struct("at", symbol.alias("symbol"), "turn", "role", "digest")))).alias("rows"),
    )
    return own.select("conv_id", *COUNTS, F.array_join(F.transform("rows", lambda r: r.symbol), "").alias("signature"), F.transform("rows", lambda r: F.struct(r.turn.alias("turn"), r.role.alias("role"), r.digest.alias("digest"))).alias("places"))


def _moves() -> dict[str, list[list[tuple[int, int, str, str]]]]:
    """By symbol and state: (next state, cost, audit, step) of each way to deal with one row. In a step, capitals are
    inserted roles; then comes ``k`` for keep, ``u`` or ``a`` for the new role, ``d`` for delete."""
    turn_of = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
    letter = {USER: "u", ASSISTANT: "a"}
    out = {}
    for symbol in "suaoSUAOx":
        per_state = []
        for state in range(4):
            ways = [(state, DELETE, "D", "d")]  # an insert before a delete is never least: after it, it costs the same
            now, cost, audit, step = state, 0, "", ""
            while symbol != "x" and len(audit) < 3:
                cut = CUT if symbol.isupper() else 0
                to = turn_of[now]
                role = symbol.lower()
                if role == letter[to]:
                    ways.append((to, cost + cut, audit + "K", step + "k"))
                elif role == "s" and now == NOTHING:
                    ways.append((SYSTEM, cost + cut, audit + "K", step + "k"))
                ways.append((to, cost + REROLE + cut, audit + "R", step + letter[to]))
                now, cost, audit, step = to, cost + INSERT, audit + "I", step + letter[to].upper()
            per_state.append(ways)
        out[symbol] = per_state
    return out


MOVES = _moves()
#: By state: cost, audit and step of what must be inserted at the end.
ENDS = {NOTHING: (0, "", ""), ASSISTANT: (0, "", ""), USER: (INSERT, "I", "A"), SYSTEM: (2 * INSERT, "II", "UA")}
#: A layer is, by state, (cost, rank, state before, audit, step) of its best path, or None.
ROOT = ((0, 0, None, "", ""), None, None, None)


def next_layer(layer: tuple, symbol: str) -> tuple:
    best: list = [None] * 4
    for state, held in enumerate(layer):
        if held is not None:
            for to, cost, audit, step in MOVES[symbol][state]:
                key = (held[0] + cost, held[1], audit)
                if best[to] is None or key < best[to][0]:
                    best[to] = (key, state, step)
    order = sorted((b[0][1:], to) for to, b in enumerate(best) if b is not None)
    rank = {to: k for k, (_, to) in enumerate(order)}
    return tuple(None if b is None else (b[0][0], rank[to], b[1], b[0][2], b[2]) for to, b in enumerate(best))


class Trie:
    """The path from the root of the trie of sorted signatures to the one last asked for: a DP layer a node."""

    def __init__(self):
        self.signature, self.layers, self.answer, self.computed = None, [ROOT], None, 0

    def solve(self, signature: str) -> tuple[int, str, list[str]]:
        """(cost, audit, steps): a step a row and one for the end."""
        if signature == self.signature:
            return self.answer
        shared = 0
        for a, b in zip(signature, self.signature or ""):
            if a != b:
                break
            shared += 1
        del self.layers[shared + 1 :]
        for symbol in signature[shared:]:
            self.layers.append(next_layer(self.layers[-1], symbol))
        self.computed += len(signature) - shared
        self.signature, self.answer = signature, self.terminal()
        return self.answer

    def terminal(self) -> tuple[int, str, list[str]]:
        cost, _, tail, state, step = min((held[0] + ENDS[s][0], held[1], ENDS[s][1], s, ENDS[s][2]) for s, held in enumerate(self.layers[-1]) if held is not None)
        audit, steps = [tail], [step]
        for layer in self.layers[:0:-1]:
            _, _, before, own, step = layer[state]
            audit.append(own)
            steps.append(step)
            state = before
        return cost, "".join(reversed(audit)), steps[::-1]


def plans(own: DataFrame) -> DataFrame:
    """``own`` (with ``signature``) with cost, audit and steps, by the trie of the sorted signatures."""
    n = partitions(own.sparkSession)
    spread = own.repartitionByRange(n, "signature", F.xxhash64("conv_id")).sortWithinPartitions("signature")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in batches:
            found = [trie.solve(s) for s in column(batch, "signature").to_pylist()]
            extra = [pa.array([c for c, _, _ in found], pa.int64()), pa.array([a for _, a, _ in found], pa.string()), pa.array([s for _, _, s in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "cost", "audit", "steps"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return spread.mapInArrow(run, f"{names}, cost long, audit string, steps array<string>")


def repaired_rows(damaged: DataFrame, planned: DataFrame) -> DataFrame:
    """The stream that a repaired conversation is read from, sorted: of each row its text, then its step; last, the
    conversation's summary with what is inserted at the end."""
    blank = lambda c, t: F.lit(None).cast(t).alias(c)
    summary = [*((c, "long") for c in COUNTS), ("cost", "long"), ("audit", "string")]
    types = dict(damaged.dtypes)
    texts = damaged.where("copies > 0").select("conv_id", F.lit(False).alias("last"), "turn", "role", digest(F.col("role"), F.col("text")).alias("digest"), F.lit(0).alias("kind"), "text", blank("step", "string"), *(blank(c, t) for c, t in summary))
    steps = planned.select("conv_id", F.posexplode("steps").alias("at", "step"), "places").where("step <> 'd'").select("conv_id", F.get("places", F.col("at")).alias("p"), "step").where("p IS NOT NULL")
    steps = steps.select("conv_id", F.lit(False).alias("last"), "p.turn", "p.role", "p.digest", F.lit(1).alias("kind"), blank("text", "string"), "step", *(blank(c, t) for c, t in summary))
    ends = planned.select("conv_id", F.lit(True).alias("last"), blank("turn", types["turn"]), blank("role", "string"), blank("digest", "binary"), F.lit(2).alias("kind"), blank("text", "string"), F.element_at("steps", -1).alias("step"), *(F.col(c) for c, _ in summary))
    whole = texts.unionByName(steps).unionByName(ends)
    return whole.repartition(partitions(damaged.sparkSession), "conv_id").sortWithinPartitions("conv_id", "last", F.asc_nulls_first("turn"), "role", "digest", "kind")


def repair(conversations: DataFrame, **columns) -> DataFrame:
    """Damages, repairs and reads back every conversation: conv_id, the counts of its faults, cost, audit, repaired_sha256."""
    damaged = damage(conversations, **columns)
    planned = materialize(plans(materialize(signatures(damaged), "signatures")), "repairs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, text, first = hashlib.sha256(), "", True
        for batch in batches:
            ends, digests = [], []
            rows = zip(*(column(batch, c).to_pylist() for c in ("kind", "step", "role", "text")))
            for k, (kind, step, role, own) in enumerate(rows):
                if kind == 0:
                    text = own
                    continue
                for s in step:
                    if s != "d":
                        line = f"{role}:{text}" if s == "k" else f"user:{text}" if s == "u" else f"assistant:{text}" if s == "a" else "user:" if s == "U" else "assistant:"
                        sha.update(line.encode() if first else b"\n" + line.encode())
                        first = False
                if kind == 2:
                    ends.append(k)
                    digests.append(sha.hexdigest())
                    sha, first = hashlib.sha256(), True
            out = batch.select(["conv_id", *COUNTS, "cost", "audit"]).take(pa.array(ends, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(digests, pa.string())], [*out.schema.names, "repaired_sha256"])

    counts = ", ".join(f"{c} long" for c in COUNTS)
    return repaired_rows(damaged, planned).mapInArrow(run, f"conv_id {dict(damaged.dtypes)['conv_id']}, {counts}, cost long, audit string, repaired_sha256 string")
