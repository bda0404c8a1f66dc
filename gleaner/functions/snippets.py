"""Highlighted parts of text: the window shown for a keyword hit, and word highlighting."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .stemming import known_stem, stem

SNIPPET_TOKENS = 24
PARTS = "array<struct<text:string,highlight:boolean>>"
ARROW_PARTS = pa.list_(pa.struct([("text", pa.string()), ("highlight", pa.bool_())]))
#: Texts that are cut at once.
SLICE = 128
_TOKEN = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}\p{Mn}]*")


def _merge(parts: list[tuple[str, bool]]) -> list[dict]:
    return [{"text": t, "highlight": h} for t, h in parts if t]


#: Fixed values of the window's worth: a term's first hit, each further one, a window that starts with the text or a sentence.
FIRST_HIT, MORE_HITS, AT_TEXT, AT_SENTENCE = 1000, 1, 120, 100


def _worth(hits: list[tuple[int, int, int]], at: int, size: int) -> tuple[int, int, int]:
    """(worth, first token, end of the last hit) of the hits that begin in the window at a token."""
    worth, seen, first, last = 0, set(), -1, -1
    for a, b, which in hits:
        if at <= a < at + size:
            worth += MORE_HITS if which in seen else FIRST_HIT
            seen.add(which)
            first, last = a if first < 0 else first, b
    return worth, first, last


def _sentences(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """Tokens that begin a sentence: the first, and each after a full stop or colon and white space."""
    found = [0] if spans else []
    for k in range(1, len(spans)):
        end = spans[k][0]
        before = text[spans[k - 1][1] : end]
        bare = before.rstrip(" \t\n\r")
        if len(bare) < len(before) and bare[-1:] in (".", ":") and bare:
            found.append(k)
    return found


def _window(text: str, spans: list[tuple[int, int]], hits: list[tuple[int, int, int]], size: int) -> int:
    """The window's first token: of those centred on what follows a hit, and those that start the hit's sentence, the
    one worth most; of equals the first."""
    total, best, start = len(spans), 0, 0
    sentences = _sentences(text, spans) if total > size else []
    for a, _, _ in hits:
        worth, first, last = _worth(hits, a, size)
        if worth > best:
            best, start = worth, max(0, min(first - int((size - (last - first)) / 2), total - size))
        if sentences:
            own = max((s for s in sentences if s <= a), default=0)
            if own < a:
                worth = _worth(hits, own, size)[0] + (AT_SENTENCE if own else AT_TEXT)
                if worth > best:
                    best, start = worth, own
    return start


def snippet(text: str, terms: list[list[str]], size: int = SNIPPET_TOKENS) -> list[dict]:
    """The window of ``size`` tokens that shows most of a search, as a full-text index cuts it. ``terms``: stems of each
    term. A phrase is one highlighted part, hits that overlap are one, an ellipsis marks a cut side."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    stems = [known_stem(text[a:b].lower()) for a, b in spans]
    hits = []
    for which, term in enumerate(terms):
        for k in range(len(stems) - len(term) + 1):
            if term and stems[k : k + len(term)] == term:
                hits.append((k, k + len(term), which))
    hits.sort(key=lambda h: (h[0], h[2]))
    low = _window(text, spans, hits, size)
    high = min(low + size, len(spans))
    merged: list[list[int]] = []
    for a, b, _ in hits:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    start = spans[low][0] if low else 0
    end = len(text) if high >= len(spans) else spans[high - 1][1]
    parts, at = [("…" if low else "", False)], start
    for a, b in merged:
        a, b = max(a, low), min(b, high)
        if a < b:
            parts += [(text[at : spans[a][0]], False), (text[spans[a][0] : spans[b - 1][1]], True)]
            at = spans[b - 1][1]
    parts.append((text[at:end] + ("…" if high < len(spans) else ""), False))
    joined: list[tuple[str, bool]] = []
    for t, h in parts:
        if joined and not h and not joined[-1][1]:
            joined[-1] = (joined[-1][0] + t, False)
        else:
            joined.append((t, h))
    return _merge([(t.replace("\n", " "), h) for t, h in joined])


def snippet_column(text: Column, terms: list[str]) -> Column:
    """For the few winners of a search; ``terms`` are the query's."""
    stems = [[stem(w) for w in t.split(" ")] for t in terms]

    @F.arrow_udf(PARTS)
    def run(texts: pa.Array) -> pa.Array:
        # A slice at a time: texts and parts of a whole batch are never Python objects together.
        parts = [pa.array([None if t is None else snippet(t, stems) for t in texts.slice(at, SLICE).to_pylist()], ARROW_PARTS) for at in range(0, max(1, len(texts)), SLICE)]
        return pa.concat_arrays(parts)

    return run(text)


def parse_marked(text: str, start: str = "\ue000", end: str = "\ue001") -> list[dict]:
    """Marked text to parts."""
    parts = []
    for k, piece in enumerate(text.replace("\n", " ").split(start)):
        inside, _, rest = piece.partition(end) if k else ("", "", piece)
        parts += [(inside, True), (rest, False)]
    return _merge(parts)


def highlight_words(text: str, words: list[str]) -> list[dict]:
    """Marks words that start with one of ``words``, whatever the case, to their end; the longest first."""
    own = sorted({w.strip() for w in words if w.strip()}, key=lambda w: (-len(w), w))
    if not own:
        return _merge([(text, False)])
    pattern = regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(map(regex.escape, own))})[\p{{L}}\p{{N}}]*", regex.IGNORECASE)
    parts, at = [], 0
    for m in pattern.finditer(text):
        parts += [(text[at : m.start()], False), (m[0], True)]
        at = m.end()
    return _merge([*parts, (text[at:], False)])


def highlight_column(text: Column, words: Column) -> Column:
    @F.pandas_udf(PARTS)
    def run(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else highlight_words(t, list(w) if w is not None else []) for t, w in zip(texts, lists)])

    return run(text, words)
