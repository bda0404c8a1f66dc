"""The filter audit against a plain replay of all 120 orders, document by document."""

import itertools
import re
from collections import Counter

from pyspark.sql import functions as F

from gleaner.llm import filter_audit


def brute(docs, labels):
    """``docs`` (doc_id, text, source), ``labels`` (doc_id, quality, toxic), by the contract."""
    texts, fails = {}, []
    for k, t, _ in docs:
        if k is not None:
            texts[t or ""] = min(k, texts.get(t or "", k))
    for k, t, _ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": k is not None and k > texts[t]}
        fails.append({f for f, x in own.items() if x})
    good, toxic = {k for k, q, _ in labels if q == 1 and k is not None}, {k for k, _, x in labels if x == 1 and k is not None}
    parts, out = sorted({s or "" for *_, s in docs}), {}
    for part in parts:
        mine = [(k, f) for (k, _, s), f in zip(docs, fails) if (s or "") == part]
        shapley, rows = Counter(), {}
        for order in map("".join, itertools.permutations("ABCDE")):
            for at, f in enumerate(order):
                before = set(order[:at])
                here = [k for k, x in mine if f in x and not x & before]
                rows[order, at + 1] = (sum(not x & (before | {f}) for _, x in mine), len(here), sum(f in x and bool(x & before) for _, x in mine), sum(x == {f} for _, x in mine), sum(k in good for k in here), sum(k in toxic for k in here), f)
                shapley[f] += len(here)
        out |= {(part, o, s): (*v[:-1], shapley[v[-1]]) for (o, s), v in rows.items()}
    return out


def found(docs, labels):
    rows = filter_audit.audit(docs, labels).collect()
    got = {tuple(r)[:3]: tuple(r)[3:] for r in rows}
    assert len(got) == len(rows)
    return got


def plain(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic")
    odd = [(9001, None, None), (9002, "", "src0"), (9003, "", None), (9003, "", None), (None, "", "src0"), (None, None, None), (9004, "Aa " * 250, ""), (9005, "Aa " * 250, "src1"), (9005, "Aa " * 250, "src1"), (9000, "Aa " * 250, None), (9006, "é x $ " * 90_000, "é"), (9007, "A" * 70_000, "é")]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("mask", F.lit("x")).withColumn("part", F.lit(1)).repartition(4)
    more = [(9001, 1, None), (9001, 0, 1), (9002, None, None), (None, 1, 1), (9005, 1, 1), (9005, 1, 1), (123456, 1, 1)]
    labels = labels.unionByName(spark.createDataFrame(more, labels.schema)).withColumn("n", F.lit(3))
    got = found(docs, labels)
    assert got == brute(plain(docs, "doc_id", "text", "source"), plain(labels, "doc_id", "quality", "toxic"))
    assert len(got) == 600 * docs.select(F.coalesce("source", F.lit(""))).distinct().count()


def test_one_text_in_a_third_of_the_rows(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'copied words', concat('text ', id)) AS text", "concat('s', id % 2) AS source")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality", "CAST(0 AS INT) AS toxic")
    first = {k[0]: v for k, v in found(docs, labels).items() if k[1:] == ("EABCD", 1)}
    assert first == {"s0": (1001, 499, 0, 0, 0, 0, first["s0"][-1]), "s1": (1000, 500, 0, 0, 500, 0, first["s1"][-1])}


def test_lattice_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "x", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.edges(filter_audit.cells(docs, labels)).count() == 80
    assert filter_audit.steps(spark).count() == 600
    assert len(found(docs, labels)) == 600
    assert found(docs.where("false"), labels) == {}
