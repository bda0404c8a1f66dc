import hashlib

import pytest

from gleaner.llm import warc


def expected(rows, least=1000):
    best = {}
    for k, _, h in rows:
        p = (h or "").encode()
        if len(p) >= least and k is not None:
            best[p] = max(best.get(p, k), k)
    out = []
    for k, _, h in rows:
        p = (h or "").encode()
        to = best.get(p)
        to = None if to == k else to
        out.append((k, len(p), hashlib.sha1(p).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def test_round_trip_of_the_table(spark, sf, monkeypatch):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=str) == expected(rows)


def test_nulls_repeats_and_odd_urls(spark):
    long = "é" * 900
    rows = [(1, "http://a.b/x y", long), (7, "https://A.B:8080/?q=1#f", long), (3, None, None), (4, "not a url \n\t", ""), (None, "http://c/", long), (5, "http://[bad", "x" * 999), (6, "http://[bad", "x" * 999), (7, "https://A.B:8080/?q=1#f", long), (-9, "http://a.b/x y", "z" * 1000), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 100)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=str) == expected(rows)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(empty).collect() == []


def test_one_url_over_many_blocks_and_payloads(spark, tmp_path):
    rows = [(k, "http://hot.example/", f"{k % 5}" * 1200) for k in range(3000)] + [(5000 + k, f"http://h{k}.example/p", "s") for k in range(500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    folder = f"file://{tmp_path}/w"
    shards = warc.write_index(warc.write(pages, folder), folder)
    listed = sorted((r["first"], r["name"]) for r in shards.collect())
    assert sum(len(warc.directory(folder, n)) for _, n in listed) > 3
    for k in (0, 1023, 1024, 2999):
        assert len(list(warc.find(folder, listed, warc.capture_key("http://hot.example/", k)))) == 1
    assert list(warc.find(folder, listed, warc.capture_key("http://none/", 1))) == []
    got = warc.read(warc.lookup(warc.keys_of(pages), folder, shards), folder, payload=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == expected(rows)
    assert all(bytes(r.payload).decode() == f"{r.page_id % 5}" * 1200 for r in got if r.record_type == "response" and r.page_id < 3000)


def test_corruption_is_noticed():
    data = warc.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    assert warc.parsed(data)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parsed(data.replace(b"payload\r", b"paylaod\r"))
