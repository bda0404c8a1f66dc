"""Index tokens: letters and numbers, diacritics folded, then the Porter stem (Porter 1980).

Tokens are cut and lower-cased by Catalyst; folding and stemming run once per distinct word, in a
pandas UDF over the vocabulary, and are joined back (``with_stems``)."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The suffix rules of steps 2 to 4.
STEP2 = "ational ate tional tion enci ence anci ance izer ize bli ble alli al entli ent eli e ousli ous ization ize ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble logi log".split()
STEP3 = ("icate", "ic", "ative", "", "alize", "al", "iciti", "ic", "ical", "ic", "ful", "", "ness", "")
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()

_V = r"(?:[aeiou]|(?<=[^aeiou])y)"


def _shape(stem: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in stem:
        out += "v" if ch in "aeiou" or ch == "y" and out[-1:] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x, y."""
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _swap(word: str, rules: list[tuple[str, str]], least: int) -> str:
    for suffix, to in rules:
        if word.endswith(suffix) and len(word) > len(suffix):
            stem = word[: -len(suffix)]
            return stem + to if _measure(stem) > least else word
    return word


_PAIRS2, _PAIRS3 = (sorted(zip(x[::2], x[1::2]), key=lambda r: -len(r[0])) for x in (STEP2, STEP3))
_LONGEST4 = sorted(STEP4, key=len, reverse=True)


def porter(word: str) -> str:
    if not 2 < len(word.encode()) <= 64:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix):
                stem = word[: -len(suffix)]
                if "v" in _shape(stem):
                    word = stem
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                        word = word[:-1]
                    elif _measure(word) == 1 and _short(word):
                        word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _PAIRS2, 0), _PAIRS3, 0)
    for suffix in _LONGEST4:
        if word.endswith(suffix) and len(word) > len(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem[-1] in "st"):
                word = stem
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _short(word[:-1]):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def fold(word: str) -> str:
    """Without diacritics, lower case."""
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def stem(word: str) -> str:
    return porter(fold(word))


def stem_tokens(text: str) -> list[str]:
    """The index tokens of a text, in order (Python form, for queries and tests)."""
    out, now = [], ""
    for ch in text:
        if unicodedata.category(ch)[0] in "LN" or now and unicodedata.category(ch) == "Mn":
            now += ch
        elif now:
            out.append(now)
            now = ""
    return [stem(w) for w in ([*out, now] if now else out)]


def raw_tokens(text: Column) -> Column:
    """Index tokens before folding: letters and numbers, with marks inside them."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}\p{Mn}]*"), F.lit(0))


@F.pandas_udf(T.StringType())
def stem_column(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")


_KNOWN: dict[str, str] = {}
#: Words whose stems a worker keeps; beyond it the table starts anew.
MOST_KNOWN = 1 << 17


def known_stem(word: str) -> str:
    found = _KNOWN.get(word)
    if found is None:
        if len(_KNOWN) >= MOST_KNOWN:
            _KNOWN.clear()
        found = _KNOWN[word] = stem(word)
    return found


#: Texts whose words are stemmed at once.
SLICE = 512


def stem_lists(lists: pa.Array) -> pa.Array:
    """Each list's words stemmed. Only the distinct words of a slice become Python strings."""
    words = lists.flatten().dictionary_encode()
    found = pa.array([known_stem(w) for w in words.dictionary.to_pylist()], words.dictionary.type).take(words.indices)
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate((np.zeros(1, np.int32), ends))), found, mask=lists.is_null())


def stems(text: Column) -> Column:
    """The index tokens of a text, in order: cut by Catalyst, stemmed a slice of an Arrow batch at a time, each distinct
    word once while a worker remembers it."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(lists: pa.Array) -> pa.Array:
        parts = [stem_lists(lists.slice(at, SLICE)) for at in range(0, max(1, len(lists)), SLICE)]
        return pa.concat_arrays(parts)

    return run(raw_tokens(text))


def with_stems(rows: DataFrame, word_col: str, out: str) -> DataFrame:
    """Adds the stem of ``word_col``: computed once a distinct word."""
    vocabulary = rows.select(word_col).distinct().withColumn(out, stem_column(word_col))
    return rows.join(vocabulary, word_col)
