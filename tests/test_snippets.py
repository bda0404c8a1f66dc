"""Snippets against those of SQLite's full-text index, text by text."""

import random
import sqlite3

import pytest

from gleaner.functions import snippets
from gleaner.functions.stemming import stem
from gleaner.functions.text import terms_of

WORDS = "garden budget plan harbour crane tide ferry the of École naïve rope quay lamp meeting notes 2,500 planning budgets".split()


@pytest.fixture(scope="module")
def index():
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table t using fts5(x, tokenize='porter unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.fail("this SQLite has no full-text index to compare with")
    return db


def compare(db, texts, query, size):
    db.execute("delete from t")
    db.executemany("insert into t(rowid, x) values (?, ?)", list(enumerate(texts)))
    terms = terms_of(query)
    match = " OR ".join(f'"{t}"' for t in terms)
    rows = db.execute(f"select rowid, snippet(t, 0, char(57344), char(57345), '…', {size}) from t where t match ?", (match,)).fetchall()
    stems = [[stem(w) for w in t.split(" ")] for t in terms]
    bad = [(query, texts[k], snippets.parse_marked(want), got) for k, want in rows if (got := snippets.snippet(texts[k], stems, size)) != snippets.parse_marked(want)]
    assert not bad, (len(bad), len(rows), bad[0])
    return len(rows)


@pytest.mark.parametrize("seed", range(6))
def test_random_texts(index, seed):
    rng = random.Random(seed)

    def text():
        out = []
        for _ in range(rng.randint(1, 90)):
            out.append(rng.choice(WORDS) if rng.random() < 0.35 else f"w{rng.randint(0, 400)}")
            out.append(rng.choice([" "] * 12 + [". ", ": ", ".\n", "? ", ", ", ".", "\n\n", ".  "]))
        return "".join(out).strip()

    texts, compared = [text() for _ in range(120)], 0
    for query in ("garden budget", "harbour", "ferry tide crane", "plans of the quay", "2,500 ecole", "naive lamp meeting notes rope"):
        compared += compare(index, texts, query, 24)
        compared += compare(index, texts, query, 6)
    assert compared > 300


def test_real_texts(index, spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect() if r.text]
    assert sum(compare(index, texts, q, 24) for q in ("reat thensh tion of the garden", "de la", "und der", "an the in")) > 50
