"""Change sources, bursts, catch-up, and scans of which the latest wins."""

import json
import os
import threading
import time

import pytest

from gleaner.functions.vectors import HashEmbedder
from gleaner.plans.library import Library
from gleaner.sources import files
from gleaner.sources.folder_changes import FolderChanges, FolderStreamReader, differences
from gleaner.streaming import changes
from gleaner.streaming.scans import Scans, Status


def wait_for(condition, seconds=60):
    end = time.monotonic() + seconds
    while time.monotonic() < end:
        if condition():
            return True
        time.sleep(0.1)
    return False


def test_differences():
    assert differences({"/a": [1, 1], "/b": [1, 1], "/c": [1, 1]}, {"/a": [1, 1], "/b": [1, 2], "/d": [1, 1]}) == [("/b", "modify"), ("/c", "remove"), ("/d", "create")]


def test_journal_replays(tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.txt").write_text("a")
    reader = FolderStreamReader([str(tmp_path / "docs")], str(tmp_path / "journal"))
    start = reader.initialOffset()
    assert list(reader.read(start)[0]) == [] and start == {"offset": 0}
    (tmp_path / "docs" / "b.md").write_text("b")
    (tmp_path / "docs" / ".hidden.txt").write_text("x")
    rows, end = reader.read(start)
    rows = list(rows)
    assert [(os.path.basename(p), kind) for p, kind, _ in rows] == [("b.md", "create")] and end == {"offset": 1}
    os.remove(tmp_path / "docs" / "a.txt")
    # A new reader, as after a restart, finds what changed meanwhile; the older batch is the same again.
    later = FolderStreamReader([str(tmp_path / "docs")], str(tmp_path / "journal"))
    assert [(os.path.basename(p), kind) for p, kind, _ in later.read(end)[0]] == [("a.txt", "remove")]
    assert list(later.readBetweenOffsets(start, end)) == rows


def test_batch_reading_of_folders(spark, tmp_path):
    for name in ("a.txt", "x/b.md", "x/y/c.docx", "z/d.mp3", "node_modules/e.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("text")
    spark.dataSource.register(FolderChanges)
    rows = spark.read.format("folder_changes").option("roots", json.dumps([str(tmp_path)])).load()
    assert sorted(os.path.relpath(r.path, tmp_path) for r in rows.collect()) == ["a.txt", "x/b.md", "x/y/c.docx"]
    found, unreadable = files.discover(spark, str(tmp_path), spread=2)
    assert sorted(os.path.relpath(r.path, tmp_path) for r in found.collect()) == ["a.txt", "x/b.md", "x/y/c.docx"] and unreadable == 0


def test_a_long_burst_is_scanned_once_after_it(spark, tmp_path):
    """Changes every half second for longer than the quiet time, in two locations and outside both."""
    source = tmp_path / "events"
    source.mkdir()
    own = spark.createDataFrame([(1, "/a"), (2, "/b"), (3, "/c")], "id long, path string")
    stream = spark.readStream.schema("path string, event_kind string").json(str(source))
    scans = []
    query = changes.watch(stream, lambda: own, lambda k, p: scans.append((k, p, time.monotonic())), quiet_ms=4000, checkpoint=f"{tmp_path}/cp")
    try:
        for k in range(12):
            events = [{"path": f"/{'ab'[k % 2]}/f{k}", "event_kind": "modify"}, {"path": "/c/read", "event_kind": "access"}, {"path": "/other", "event_kind": "create"}]
            (source / f".{k}").write_text("\n".join(map(json.dumps, events)))
            os.rename(source / f".{k}", source / f"{k}.json")
            last = time.monotonic()
            time.sleep(0.5)
        assert wait_for(lambda: len(scans) >= 2)
        time.sleep(1)
        assert [(k, p) for k, p, _ in sorted(scans)] == [(1, "/a"), (2, "/b")]
        assert min(t for *_, t in scans) > last
    finally:
        query.stop()


def test_library_follows_its_folders(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "one.txt").write_text("The first harbour.")
    library = Library(spark, f"{tmp_path}/index", HashEmbedder())
    place = library.add_location(str(docs))
    query = library.watch(str(tmp_path / "journal"), quiet_ms=1000)
    try:
        # What was there before is found by catching up.
        assert library.store.read("documents").count() == 1
        (docs / "two.txt").write_text("A second lighthouse.")
        assert wait_for(lambda: library.store.read("documents").count() == 2, 90)
        assert library.scans.status(place).state in ("done", "embedding")
    finally:
        query.stop()


def test_catch_up_goes_on_after_a_failure(spark, tmp_path, monkeypatch):
    library = Library(spark, f"{tmp_path}/index")
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.txt").write_text(name)
        library.add_location(str(tmp_path / name))
    walk = files.discover
    monkeypatch.setattr(files, "discover", lambda s, root, *a: (_ for _ in ()).throw(OSError("gone")) if root.endswith("/a") else walk(s, root, *a))
    found = library.catch_up()
    assert found[1] == {"error": "gone"} and found[2]["read"] == 1
    assert library.scans.status(1).state == "failed" and library.scans.status(1).error == "gone"
    assert library.scans.status(2).state == "done" and library.scans.status(2).percent == 100


def test_the_latest_scan_wins(spark):
    scans, told = Scans(spark), []
    first = scans.begin(1, told.append)
    started, ended = threading.Event(), []

    def slow():
        def wait(rows):
            for r in rows:
                time.sleep(60)
                yield r

        try:
            with first:
                first.say(state="hashing")
                started.set()
                spark.range(4).mapInPandas(wait, "id long").count()
        except files.Cancelled:
            ended.append(time.monotonic())

    thread = threading.Thread(target=slow)
    thread.start()
    assert started.wait(20)
    assert wait_for(lambda: first.tasks()[1] > 0, 20)
    began = time.monotonic()
    second = scans.begin(1)
    thread.join(30)
    assert ended and ended[0] - began < 30
    # The stale one can neither report nor go on.
    first.say(state="done", important=True)
    assert [s.state for s in told] == ["hashing"] and scans.status(1).state == "discovering"
    with pytest.raises(files.Cancelled):
        first.check()
    second.check()
    scans.forget(1)
    with pytest.raises(files.Cancelled):
        second.check()


def test_a_scan_that_was_replaced_commits_nothing(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.txt").write_text("text")
    library = Library(spark, f"{tmp_path}/index")
    place = library.add_location(str(tmp_path / "docs"))
    before = library.store.manifest()["version"]

    def replaced(status):
        if status.state == "reading":
            library.scans.begin(place)

    with pytest.raises(files.Cancelled):
        library.rescan_location(place, report=replaced)
    assert library.store.manifest()["version"] == before
    assert not [p for p in (tmp_path / "index" / "work").glob("*")]
    assert library.rescan_location(place)["read"] == 1


def test_reports_are_throttled(spark):
    told = []
    scan = Scans(spark).begin(1, told.append)
    for k in range(1000):
        scan.say(files_read=k)
    assert len(told) < 100 and scan.status.files_read == 999
    scan.say(state="reading", files_to_read=2000)
    assert told[-1].state == "reading" and scan.status.percent == pytest.approx(49.95)
    assert Status(1).percent is None and Status(1, "done").percent == 100 and Status(1, "embedding").percent is None
