import io
import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from gleaner.functions.vectors import HashEmbedder
from gleaner.plans.library import Library, LibraryError
from gleaner.sources import files, readers


def docx(body, core=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="urn:w"><w:body>{body}</w:body></w:document>')
        if core:
            z.writestr("docProps/core.xml", f'<cp xmlns:dc="urn:dc">{core}</cp>')
    return out.getvalue()


def write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "docs"
    write(root / "quote.txt", "Repairs to the harbour crane: a quote of EUR 14,250 came in, crane parts extra.")
    write(root / "choir.md", "# Choir\nRehearsals move to the chapel while the hall is painted.")
    write(root / "deck.png", b"not an image")
    write(root / "sub" / "ferry.docx", docx("<w:p><w:r><w:t>Ferry &amp; tides</w:t><w:tab/><w:t>table</w:t></w:r></w:p>", "<dc:title>Ferry times</dc:title>"))
    for skipped in (".git/a.txt", "node_modules/b.txt", "~$draft.docx", ".secret.txt", "song.mp3"):
        write(root / skipped, "x")
    return root


def test_discover_skips_hidden_and_system(spark, folder):
    found, unreadable = files.discover(spark, str(folder))
    assert sorted(os.path.relpath(r.path, folder) for r in found.collect()) == ["choir.md", "deck.png", "quote.txt", "sub/ferry.docx"]
    assert unreadable == 0
    remote = files.discover_remote(spark, f"file://{folder}")
    assert sorted(r.path.split("/docs/")[1] for r in remote.collect()) == ["choir.md", "deck.png", "quote.txt", "sub/ferry.docx"]
    with pytest.raises(files.Cancelled):
        files.discover(spark, str(folder), lambda: True)


def test_readers():
    assert readers.decode(b"\xff\xfea\x00\r\x00\n\x00b\x00\x01") == "a\nb"
    assert readers.decode("﻿gärten\rx".encode()) == "gärten\nx"
    assert readers.decode(b"\xfe\xff\x00a") == "a" and readers.decode(b"a\xff") == "a�"
    pages, title, author, problem = readers.extract(docx("<w:p><w:r><w:t>a&lt;</w:t><w:br/><w:t>b</w:t></w:r></w:p><w:p/>", "<dc:title> </dc:title><dc:creator>Ada</dc:creator>"), "docx", 10)
    assert (pages, title, author, problem) == ([(None, "a<\nb")], None, "Ada", None)
    assert readers.extract(b"zip?", "docx", 4)[3] == "malformed"
    assert readers.extract(b" \n", "text", 2)[3] == "no_text"
    assert readers.extract(b"x", "text", 101 << 20)[3] == "too_large"
    assert readers.extract(b"x", "pdf", 1)[3] == "needs_reader"
    assert readers.extract(b"x", "pdf", 1, {"pdf": readers.pdf_reader(lambda _: ["a  \n\n\n\nb \n", " "])})[0] == [(1, "a\n\nb"), (2, "")]


def test_incremental_indexing_and_search(spark, folder, tmp_path):
    library = Library(spark, f"{tmp_path}/index", HashEmbedder())
    place = library.add_location(str(folder))
    with pytest.raises(LibraryError) as e:
        library.add_location(str(folder / "sub"))
    assert e.value.code == "inside_existing"
    got = library.rescan_location(place)
    assert (got["found"], got["added"], got["read"], got["read_failed"], got["embedded"]) == (4, 4, 3, 0, 3)
    rows = library.search("crane quote").collect()
    assert rows[0].filename == "quote.txt" and rows[0].page_number is None
    assert [p.text for p in rows[0].snippet if p.highlight] == ["crane", "quote", "crane"]
    assert "Mentions “crane”, “quote”" in rows[0].match_reasons and "File name or title matches “quote”" in rows[0].match_reasons
    assert [r.filename for r in library.search("EUR 14,250").collect()][0] == "quote.txt"
    assert [r.filename for r in library.search("deck").collect()] == ["deck.png"]
    seen = library.get_evidence(rows[0].chunk_id)
    assert seen.before + seen.passage + seen.after == "Repairs to the harbour crane: a quote of EUR 14,250 came in, crane parts extra."
    assert library.get_evidence("x") is None
    page, total = library.list_files(kind="docx")
    assert total == 1 and page.first().status == "indexed"
    document = library.get_document(page.first().file_id)
    assert (document.title, document.pages[0].text) == ("Ferry times", "Ferry & tides\ttable")
    # Nothing changed: nothing is read, and nothing written.
    before = sorted(str(p) for p in (tmp_path / "index").rglob("*"))
    got = library.rescan_location(place)
    assert (got["added"], got["checked"], got["removed"], got["read"]) == (0, 0, 0, 0)
    assert sorted(str(p) for p in (tmp_path / "index").rglob("*")) == before
    # An edit, a touch, a deletion and a new file.
    write(folder / "quote.txt", "Cancelled; the old crane stays.")
    os.utime(folder / "choir.md", (time.time() + 9, time.time() + 9))
    os.remove(folder / "sub" / "ferry.docx")
    write(folder / "new.txt", "Mooring ropes are kept in the boathouse.")
    got = library.rescan_location(place)
    assert (got["added"], got["checked"], got["removed"], got["read"]) == (1, 2, 1, 2)
    # One changed file: one bucket a table.
    write(folder / "new.txt", "Mooring ropes are kept in the boathouse now.")
    version = library.store.manifest()["version"]
    assert library.rescan_location(place)["read"] == 1
    wrote = [e for t, x in library.store.manifest()["tables"].items() for e in x["segments"] + x["removed"] if e["version"] == version + 1]
    assert len(wrote) >= 7 and len({b for e in wrote for b in e["buckets"]}) == 1
    # Compacted and expired, it is the same library.
    library.store.compact(segments=1)
    library.store.expire(keep=1)
    assert library.store.versions() == [version + 2]
    assert [r.filename for r in library.search("mooring ropes").collect()] == ["new.txt"]
    assert "quote.txt" in [r.filename for r in library.search("cancelled").collect()]
    report = library.index_report()
    assert (report["files"], report["documents"], report["chunks"], report["embeddings"]) == (4, 3, 3, 3)
    assert library.ai_status()["ocr"]["available"] is False and library.ai_status()["missing_embeddings"] == 0
    assert library.list_locations().first().files == 4
    library.remove_location(place)
    assert library.index_report()["chunks"] == 0


def test_watching_scans_touched_locations_once(spark, tmp_path):
    from gleaner.streaming import changes

    events = [("/a/x", "modify"), ("/a/y", "create"), ("/b/z", "access"), ("/c-old/q", "modify")]
    spark.createDataFrame(events, "path string, event_kind string").coalesce(1).write.parquet(f"{tmp_path}/events")
    own = spark.createDataFrame([(1, "/a"), (2, "/b"), (3, "/c")], "id int, path string")
    stream = spark.readStream.schema("path string, event_kind string").parquet(f"{tmp_path}/events")
    scanned = []
    query = changes.watch(stream, lambda: own, lambda k, p: scanned.append((k, p)), checkpoint=f"{tmp_path}/cp", once=True)
    query.awaitTermination(60)
    assert scanned == [(1, "/a")]


def test_stream_sessions_close_with_the_watermark(spark, tmp_path):
    from gleaner.streaming import changes

    rows = [("2026-01-01 00:00:00",), ("2026-01-01 00:00:01",), ("2026-01-01 00:01:00",)]
    spark.createDataFrame(rows, "t string").select(F.to_timestamp("t").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema("ts timestamp").parquet(f"{tmp_path}/e")
    query = changes.stream_sessions(stream).writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [r.changes for r in spark.table("bursts").collect()] == [2]
