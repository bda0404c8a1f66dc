"""The catalog: segments, removals, conflicts, compaction, expiry, upgrades."""

import json
import os

import pytest
from pyspark.sql import functions as F

from gleaner.sources.store import TABLES, ConflictError, Store

LOCATIONS = "id long, path string, added_at long"


def places(spark, *ids):
    return spark.createDataFrame([(i, f"/{i}", 5) for i in ids], LOCATIONS)


def owners(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def held(store, version=None):
    return sorted(r.id for r in store.read("locations", version).collect())


def test_versions_removals_and_conflicts(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    assert held(store) == []
    assert store.commit(0, {"locations": places(spark, 1, 2, 3)}) == 1
    with pytest.raises(ConflictError):
        store.commit(0, {"locations": places(spark, 9)})
    # A row is replaced by removing its owner and adding it anew in one commit.
    changed = places(spark, 2).withColumn("path", F.lit("/new"))
    assert store.commit(1, {"locations": changed}, [(("locations",), owners(spark, 2, 3, 77, None))]) == 2
    assert {r.id: r.path for r in store.read("locations").collect()} == {1: "/1", 2: "/new"}
    assert held(store, 1) == [1, 2, 3]
    assert [r.path for r in store.read("locations", owners=[2]).collect()] == ["/new"]
    assert store.size() > 0


def test_empty_commits_write_nothing(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    store.commit(0, {"locations": places(spark, 1)})
    before = sorted(str(p) for p in tmp_path.rglob("*") if p.is_file())
    assert store.commit(1, {"locations": places(spark).where("false")}, [(("locations",), owners(spark).where("false"))]) == 1
    assert sorted(str(p) for p in tmp_path.rglob("*") if p.is_file()) == before


def test_commits_on_top_of_others(spark, tmp_path):
    store, asked = Store(spark, f"{tmp_path}/store"), []
    store.commit(0, {"locations": places(spark, 1, 2)})
    store.commit(1, {"locations": places(spark, 3)}, [(("locations",), owners(spark, 1))])
    # Another run began at version 1 as well; its owners are its own.
    assert store.commit(1, {"locations": places(spark, 4)}, [(("locations",), owners(spark, 2))], alone=asked.append) == 3
    assert held(store) == [3, 4] and asked == [2]

    def refuse(version):
        raise RuntimeError("the location is gone")

    with pytest.raises(RuntimeError):
        store.commit(1, {"locations": places(spark, 5)}, alone=refuse)
    assert held(store) == [3, 4]


def test_compaction_rewrites_touched_buckets_only(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store", buckets=8)
    store.commit(0, {"locations": places(spark, *range(100))})
    first = store.manifest()["tables"]["locations"]["segments"][0]
    for v, k in enumerate((1000, 1001, 1002), 1):
        store.commit(v, {"locations": places(spark, k)}, [(("locations",), owners(spark, k - 1000))])
    want = held(store)
    touched = set(store.slots_of([0, 1, 2]))
    assert store.compact(segments=100) == 5
    entry = store.manifest()["tables"]["locations"]
    assert entry["removed"] == [] and held(store) == want and held(store, 4) == want
    assert {b for e in entry["segments"] if e["folder"] == first["folder"] for b in e["buckets"]} == set(first["buckets"]) - touched
    assert store.compact(segments=100) == 5  # nothing left to do
    for k in (50, 3):
        assert [r.id for r in store.read("locations", owners=[k]).collect()] == [k]
    dropped = store.expire(keep=1)
    assert store.versions() == [5] and any(f.startswith("removed/") for f in dropped) and held(store) == want
    # Rows of a removed owner may come back later.
    store.commit(5, {}, [(("locations",), owners(spark, 50))])
    store.commit(6, {"locations": places(spark, 50)})
    assert held(store) == want


def test_upgrade_of_an_older_index(spark, tmp_path):
    at = tmp_path / "store"
    rows = {
        "locations": [(1, "/a", 5)],
        "documents": [(7, 7, "t", None, None, 1, 2, "some text")],
        "chunks": [(70, 7, 0, "some text", 1, 0, 9, None)],
        "postings": [("some", 70, [0], 1), ("text", 70, [1], 1)],
    }
    for t, values in rows.items():
        spark.createDataFrame(values, TABLES[t]).write.parquet(f"{at}/{t}/3-abc")
    os.makedirs(at / "manifests")
    (at / "manifests" / "3.json").write_text(json.dumps({"version": 3, "schema_version": 1, "tables": {t: f"{t}/3-abc" for t in rows}}))
    store = Store(spark, str(at))
    assert store.versions() == [3, 4] and store.manifest()["schema_version"] == 2
    assert sorted(r.term for r in store.read("postings").collect()) == ["some", "text"]
    assert {r.owner for r in store.read("postings", with_owner=True).collect()} == {7}
    store.commit(4, {}, [(("documents", "chunks", "postings"), owners(spark, 7))])
    assert store.read("chunks").count() == store.read("postings").count() == 0 and held(store) == [1]
    (at / "manifests" / "9.json").write_text(json.dumps({"version": 9, "schema_version": 3, "tables": {}}))
    with pytest.raises(RuntimeError, match="newer"):
        Store(spark, str(at))
