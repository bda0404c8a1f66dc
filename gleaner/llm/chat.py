"""Chat formatting and its inverse, in DataFrame expressions only.

    <|turn|>role<|text|>text[<|next|>text ...]<|end|>

Adjacent turns of one role share a ``<|turn|>`` block, their texts parted by ``<|next|>``. Inside roles
and texts each control string (``CONTROLS``) gets a backslash after its first character, and each
backslash a second one, so none of them occurs in the output but as markup, and ``parse`` gets every
turn back. The loss mask is the texts of assistant turns.

Turns are collected in two steps, first ``span`` turn numbers at a time and then a conversation's
pieces, so one very long conversation is sorted, escaped and merged by many tasks; only its finished
pieces meet.

Nulls: a null text or role is an empty one, a null turn number comes first, rows of a null conversation
form one. Turns that share a number go by role, then text; repeated rows are turns of their own. A
conversation without assistant turns has an empty mask; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's own markers, and those of other common templates.
TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
CONTROLS = r"(?=\\)|(?<=<)(?=\||/?s>)|(?<=\[)(?=/?INST\])"
ASSISTANT = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROLS, r"\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", span: int = 256) -> DataFrame:
    """conv_id, formatted."""
    clean = lambda c: F.coalesce(conversations[c].cast("string"), F.lit(""))
    turns = conversations.select(conversations[id_col].alias("conv_id"), F.floor(conversations[turn_col] / span).alias("piece"), F.struct(conversations[turn_col].alias("turn"), clean(role_col).alias("role"), clean(text_col).alias("text")).alias("row"))
    pieces = turns.groupBy("conv_id", "piece").agg(F.sort_array(F.collect_list("row")).alias("rows"))

    def turn(row, i):
        opens = F.concat(F.lit(END + TURN), escaped(row.role), F.lit(TEXT))
        return F.concat(F.when(i == 0, F.lit("")).when(row.role == F.get("rows", i - 1).role, F.lit(NEXT)).otherwise(opens), escaped(row.text))

    # A piece lacks what its first turn opens with and what its last one closes with: its neighbours decide.
    pieces = pieces.select("conv_id", F.struct(F.col("piece"), F.get("rows", 0).role.alias("first"), F.get("rows", F.size("rows") - 1).role.alias("last"), F.array_join(F.transform("rows", turn), "").alias("body")).alias("piece"))
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))

    def piece(p, i):
        opens = F.concat(F.lit(TURN), escaped(p["first"]), F.lit(TEXT))
        return F.concat(F.when(i == 0, opens).when(p["first"] == F.get("pieces", i - 1)["last"], F.lit(NEXT)).otherwise(F.concat(F.lit(END), opens)), p.body)

    return whole.select("conv_id", F.concat(F.array_join(F.transform("pieces", piece), ""), F.lit(END)).alias("formatted"))


def parse(text: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    split = lambda x, mark: F.split(x, mark.replace("|", r"\|"), -1)
    blocks = F.slice(split(text, TURN), 2, 2_000_000_000)

    def turns(block):
        parts = split(F.substring(block, F.lit(1), F.length(block) - len(END)), TEXT)
        return F.transform(split(F.get(parts, 1), NEXT), lambda t: F.struct(unescaped(F.get(parts, 0)).alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(turns: Column) -> Column:
    return F.array_join(F.transform(F.filter(turns, lambda t: t.role == ASSISTANT), lambda t: t.text), "")


def digests(conversations: DataFrame, **columns) -> DataFrame:
    """What is read back from the formatted conversations."""
    rows = formatted(conversations, **columns).select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), parse(F.col("formatted")).alias("turns"))
    rows = rows.select("conv_id", "formatted_chars", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"), loss_text(F.col("turns")).alias("loss"))
    return rows.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
