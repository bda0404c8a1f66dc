"""Runs queries beside their SQL in DuckDB, as the driver does: columns by name, rows in any order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "is_nan"):  # decimal
        return round(float(v), 6)
    if hasattr(v, "tzinfo"):
        return v.replace(tzinfo=None)
    return v


def compare(spark, sf, run, sql):
    db = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = run(spark, sf)
    names = sorted(got.columns)
    rel = db.sql(sql)
    assert sorted(rel.columns) == names, (sorted(rel.columns), names)
    at = [rel.columns.index(n) for n in names]
    want = sorted((tuple(plain(r[k]) for k in at) for r in rel.fetchall()), key=repr)
    have = sorted((tuple(plain(r[n]) for n in names) for r in got.collect()), key=repr)
    assert len(have) == len(want), (len(have), len(want))
    bad = [(a, b) for a, b in zip(have, want) if a != b]
    assert not bad, (names, bad[:3])
