"""A library: locations, their files, and the search over them. One object for the commands a user has."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.functions import chunking, snippets, text, vectors
from gleaner.operators import evidence, hybrid, incremental, keyword, listing, names, semantic
from gleaner.sources import files as folders
from gleaner.sources import readers as reading
from gleaner.sources.folder_changes import FolderChanges
from gleaner.sources.store import CONTENT, Store
from gleaner.streaming import changes
from gleaner.streaming.scans import Scan, Scans, Status

VERSION = "0.1.0"


class LibraryError(Exception):
    """``code`` is one of not_found, not_a_folder, already_added, inside_existing, file_not_found, location_not_found."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


class Library:
    def __init__(self, spark: SparkSession, path: str, embedder: vectors.Embedder | None = None, readers: dict | None = None):
        self.spark, self.store = spark, Store(spark, path)
        self.embedder, self.readers, self.scans = embedder, dict(reading.READERS if readers is None else readers), Scans(spark)

    def _id(self, value) -> int | None:
        try:
            return int(str(value))
        except ValueError:
            return None

    # --- locations

    def list_locations(self) -> DataFrame:
        return listing.location_counts(self.store.read("locations"), self.store.read("files")).orderBy("id")

    def add_location(self, path: str) -> int:
        """Adds a folder; locations inside it become part of it. Scan it with ``rescan_location``."""
        real = os.path.realpath(path)
        if not os.path.exists(real):
            raise LibraryError("not_found", f"{path} does not exist")
        if not os.path.isdir(real):
            raise LibraryError("not_a_folder", f"{path} is not a folder")
        base = self.store.manifest()["version"]
        own = self.store.read("locations", base)
        plan = incremental.nesting(own.select("id", "path"), self.spark.createDataFrame([(real,)], "path string")).first()
        if plan.verdict in ("already_added", "inside_existing"):
            raise LibraryError(plan.verdict, f"{path} is already in the library")
        new_id = (own.agg(F.max("id")).first()[0] or 0) + 1
        added = self.spark.createDataFrame([(new_id, real, int(time.time() * 1000))], own.schema)
        for old in plan.ids or ():
            self.scans.forget(old)
        # Files of locations taken in move to the new one; they are not read again.
        moved = self.store.read("files", base).where(F.col("location_id").isin(list(plan.ids or ()))).withColumn("location_id", F.lit(new_id).cast("long"))
        taken_in = self.spark.createDataFrame([(i,) for i in plan.ids or ()], "id long")
        self.store.commit(base, {"locations": added, "files": moved}, [(("locations",), taken_in), (("files",), moved.select("file_id"))])
        return new_id

    def remove_location(self, location_id) -> None:
        base = self.store.manifest()["version"]
        own = self.store.read("locations", base)
        if own.where(F.col("id") == self._id(location_id)).isEmpty():
            raise LibraryError("location_not_found", "no such location")
        self.scans.forget(self._id(location_id))
        gone = self.store.read("files", base).where(F.col("location_id") == self._id(location_id)).select("file_id")
        self.store.commit(base, {}, [(("locations",), own.where(F.col("id") == self._id(location_id)).select("id")), (("files", *CONTENT), gone)])

    def rescan_location(self, location_id, cancelled: Callable[[], bool] = lambda: False, report: Callable[[Status], None] | None = None) -> dict:
        """Walk, fingerprint, forget, read and embed what changed; one new version, or none if nothing did. Returns the
        run's counts. A scan of the same location that still runs is cancelled; ``report`` is told how far this one is."""
        place = self.store.read("locations").where(F.col("id") == self._id(location_id)).first()
        if place is None:
            raise LibraryError("location_not_found", "no such location")
        with self.scans.begin(place.id, report) as scan:
            work = f"{self.store.path}/work/{uuid.uuid4().hex}"
            try:
                counts = self._rescan(scan, place, lambda: scan.stopped or cancelled(), work)
            finally:
                self.store.fs.delete(self.store._path(work), True)
            scan.say(state="done", important=True)
            return counts

    def catch_up(self, report: Callable[[Status], None] | None = None) -> dict[int, dict]:
        """Scans every location, as at the start of a program; one that is gone or fails does not keep the others."""
        found = {}
        for row in self.store.read("locations").orderBy("id").collect():
            try:
                found[row.id] = self.rescan_location(row.id, report=report)
            except folders.Cancelled:
                found[row.id] = {"cancelled": True}
            except Exception as e:  # noqa: BLE001  reported by the scan's status
                found[row.id] = {"error": str(e).split("\n")[0]}
        return found

    def watch(self, journal: str, quiet_ms: int = 2000, report: Callable[[Status], None] | None = None) -> StreamingQuery:
        """Scans the locations that change, each after the changes end. Catches up first with what changed before."""
        self.spark.dataSource.register(FolderChanges)
        roots = [r.path for r in self.store.read("locations").collect()]
        own = self.spark.createDataFrame(self.store.read("locations").select("id", "path").collect(), "id long, path string")
        events = self.spark.readStream.format("folder_changes").option("roots", json.dumps(roots)).option("journal", journal).load()

        def scan(location_id: int, _: str) -> None:
            try:
                self.rescan_location(location_id, report=report)
            except (folders.Cancelled, LibraryError):
                pass  # a newer scan took over, or the location was removed

        query = changes.watch(events, lambda: own, scan, quiet_ms, checkpoint=f"{journal}/checkpoint")
        self.catch_up(report)
        return query

    def _rescan(self, scan: Scan, place, cancelled: Callable[[], bool], work: str) -> dict:
        def stop_if_cancelled() -> None:
            if cancelled():
                raise folders.Cancelled
            scan.check()

        def written(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{work}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{work}/{name}")

        scan.say(important=True)
        base, now = self.store.manifest()["version"], int(time.time() * 1000)
        seen, unreadable = folders.discover(self.spark, place.path, cancelled)
        old = lambda t, **k: self.store.read(t, base, **k)
        here = old("files").where(F.col("location_id") == place.id)
        compared = written(incremental.classify(seen, here), "changes")
        metrics = incremental.scan_metrics(compared).first().asDict() | {"unreadable": unreadable}
        found = metrics["found"]
        scan.say(state="hashing", files_found=found, files_processed=metrics["unchanged"], files_changed=found - metrics["unchanged"], unreadable=unreadable)
        stop_if_cancelled()
        # Files that are new or look changed are read once; so are those that still wait for it, as for a reader that came since.
        touched = seen.join(compared.where("change IN ('new', 'check')").select("path"), "path", "left_semi")
        known = here.select("path", F.col("content_hash").alias("known_hash"), F.coalesce(F.col("status") != "indexed", F.lit(True)).alias("force"))
        due = touched.select("path", "kind").join(known, "path", "left").withColumn("force", F.coalesce("force", F.lit(True)))
        waiting = listing.pending(here, include_images="image" in self.readers).join(compared.where("change = 'unchanged'").select("path"), "path", "left_semi")
        due = written(due.unionByName(waiting.select("path", "kind", F.col("content_hash").alias("known_hash"), F.lit(True).alias("force"))), "due")
        to_read = due.count()
        gone = here.join(compared.where("change = 'deleted'").select("path"), "path", "left_semi").select("file_id")
        seen_by = Observation("read")
        done = reading.examined(due.repartition(max(1, min(4096, to_read // 16 + 1))), self.readers)
        done = done.observe(seen_by, F.count_if(F.col("was_read")).alias("reads"), F.count_if(F.col("was_read") & F.col("read_problem").isNotNull()).alias("read_failed"), F.count_if(F.col("problem").isNotNull()).alias("failed"))
        scan.say(state="reading", files_processed=found, files_to_read=to_read)
        with scan.following(files_read=to_read):
            done = written(done, "done")
        told = seen_by.get
        counts = {"read": told["reads"] - told["read_failed"], "read_failed": told["read_failed"]}
        scan.say(files_read=to_read, read_failed=told["read_failed"], files_failed=told["failed"])
        stop_if_cancelled()
        checked = touched.join(done.select("path", "content_hash", "problem"), "path").select(
            "path", F.lit(place.id).cast("long").alias("location_id"), text.file_name(F.col("path")).alias("filename"), text.extension(F.col("path")).alias("extension"), "kind", text.mime_type(text.extension(F.col("path"))).alias("mime_type"),
            "size_bytes", "created_at", "modified_at", F.lit(now).alias("scanned_at"), "content_hash", reading.user_message(F.col("problem"), F.col("kind")).alias("error"),
        )
        state = incremental.upsert(here.join(due.select("path"), "path", "left_semi"), checked).join(done.select("path", "was_read", F.col("read_problem").alias("wrong")), "path")
        state = state.withColumn("wrong", reading.user_message(F.col("wrong"), F.col("kind")))
        outcome = lambda ok, bad, name: F.when(F.col("was_read"), F.when(F.col("wrong").isNull(), ok).otherwise(bad)).otherwise(F.col(name)).alias(name)
        kept = [c for c in here.columns if c not in ("status", "indexed_at", "error")]
        state = written(state.select(*kept, outcome(F.lit("indexed"), F.lit("error"), "status"), outcome(F.lit(now), F.lit(None), "indexed_at"), outcome(F.lit(None), F.col("wrong"), "error"), "was_read"), "state")
        reread = state.where("was_read").select("file_id")
        fresh = done.where("was_read AND read_problem IS NULL").join(state.select("path", "file_id"), "path")
        documents = fresh.select(F.col("file_id").alias("document_id"), "file_id", "title", "author", F.lit(None).cast("string").alias("language"), "page_count", "word_count", chunking.full_text(F.col("pages")).alias("extracted_text"))
        made = chunking.chunks_of(fresh.select(F.col("file_id").alias("document_id"), "pages"))
        made = written(made.withColumn("chunk_id", F.shiftrightunsigned(F.xxhash64("document_id", "chunk_index", F.lit(now)), 1)).withColumn("token_count", F.lit(None).cast("int")), "made")
        owner = made.select("chunk_id", F.col("document_id").alias("owner"))
        left = reread.unionByName(gone)
        add, remove = {}, []
        if to_read:
            add["files"] = state
        if told["reads"]:
            add |= {"documents": documents, "chunks": made, "postings": keyword.postings(made).join(owner, "chunk_id"), "chunk_stats": keyword.chunk_stats(made).join(owner, "chunk_id")}
        if to_read or metrics["removed"]:
            remove += [(("files",), state.select("file_id").unionByName(gone)), (CONTENT, left)]
        if self.embedder is not None and self.embedder.available()[0]:
            vectors_add, redone, lacking = self._embeddings(old, made, left, written)
            scan.say(state="embedding", passages_to_embed=lacking)
            counts["embedded"] = lacking
            if lacking:
                add["embeddings"] = vectors_add
                remove.append((("embeddings",), redone))
            scan.say(passages_embedded=lacking)
        stop_if_cancelled()

        def alone(version: int) -> None:
            stop_if_cancelled()
            if self.store.read("locations", version).where(F.col("id") == place.id).isEmpty():
                raise folders.Cancelled

        self.store.commit(base, add, remove, alone)
        return metrics | counts

    def _embeddings(self, old, made: DataFrame, left: DataFrame, written) -> tuple[DataFrame, DataFrame, int]:
        """What a scan adds to the vectors, the owners whose older ones go, and how many passages are embedded: the new
        ones, and those that have no vector of this model. One vector a passage, whatever model it had before."""
        embedder = self.embedder
        stays = old("chunks").join(left.select(F.col("file_id").alias("document_id")), "document_id", "left_anti")
        lacking = written(semantic.missing(stays, old("embeddings"), embedder.model).select("chunk_id", "document_id", "text").unionByName(made.select("chunk_id", "document_id", "text")), "lacking")
        redone = lacking.select(F.col("document_id").alias("owner")).distinct().join(made.select(F.col("document_id").alias("owner")), "owner", "left_anti")
        still = old("embeddings", with_owner=True).where(F.col("model") == embedder.model).join(redone, "owner", "left_semi")
        new = semantic.embedded(lacking, embedder).join(lacking.select("chunk_id", F.col("document_id").alias("owner")), "chunk_id")
        return still.unionByName(new.select(still.columns)), redone, lacking.count()

    # --- search

    def search(self, query: str, limit: int = 20) -> DataFrame:
        """Ranked results with reasons and a passage; ``snippet`` is its highlighted parts."""
        version = self.store.manifest()["version"]
        read = lambda t: self.store.read(t, version)
        files, documents, chunks = read("files"), read("documents"), read("chunks")
        asked = self.spark.createDataFrame([(0, query)], "query_id int, query string")
        words = keyword.search(read("postings"), read("chunk_stats"), chunks, documents, files, asked)
        with_model = self.embedder is not None and self.embedder.available()[0]
        if with_model and query.strip():
            vector = asked.select("query_id", self.embedder.embed_query(F.col("query")).alias("vector"))
            near = semantic.search(read("embeddings"), chunks, documents, files, vector, self.embedder.model, self.embedder.dimensions)
        else:
            near = semantic.search(read("embeddings").where("false"), chunks, documents, files, asked.select("query_id", F.array().cast("array<double>").alias("vector")))
        found = hybrid.fuse(near, words, names.search(files, documents, asked), asked, with_model, max(1, min(50, limit)))
        shown = found.join(chunks.select("chunk_id", F.col("text").alias("whole")), "chunk_id", "left")
        plain = F.array(F.struct(F.col("passage_text").alias("text"), F.lit(False).alias("highlight")))
        part = F.when(F.col("keyword").isNotNull(), snippets.snippet_column(F.col("whole"), text.terms_of(query))).when(F.col("passage_text").isNotNull(), plain)
        return shown.withColumn("snippet", part).drop("whole", "passage_text", "query_id").orderBy("rank")

    def get_evidence(self, chunk_id):
        own = self.spark.createDataFrame([(self._id(chunk_id),)], "chunk_id long")
        return evidence.evidence(self.store.read("chunks"), self.store.read("documents"), self.store.read("files"), own).first()

    def get_document(self, file_id):
        number = self._id(file_id)
        own = [] if number is None else [number]
        documents, chunks = self.store.read("documents", owners=own), self.store.read("chunks", owners=own)
        found = evidence.stored_documents(chunks, documents).first()
        if number is None or found is None:
            raise LibraryError("file_not_found", "no such document")
        return found

    def list_files(self, location_id=None, kind: str | None = None, name: str | None = None, limit: int = listing.PAGE, offset: int = 0) -> tuple[DataFrame, int]:
        rows = listing.matching(self.store.read("files"), None if location_id is None else self._id(location_id), kind, name)
        return listing.page(rows, limit, offset), rows.count()

    def file_path(self, file_id) -> str:
        """Where a file is, to open it."""
        number = self._id(file_id)
        row = self.store.read("files", owners=[number]).first() if number is not None else None
        if row is None:
            raise LibraryError("file_not_found", "no such file")
        if not os.path.exists(row.path):
            raise LibraryError("file_missing", "the file was moved or deleted")
        return row.path

    # --- reports

    def index_report(self) -> dict:
        read = self.store.read
        rows = listing.row_counts(**{t: read(t) for t in ("locations", "files", "documents", "chunks", "embeddings")}).collect()
        return {r.name: r.rows for r in rows} | {"size_bytes": self.store.size(), "path": self.store.path, "network": False}

    def ai_status(self) -> dict:
        ready, reason = (False, "no embedder is configured") if self.embedder is None else self.embedder.available()
        return {
            "embeddings": {"available": ready, "model": getattr(self.embedder, "model", None), "reason": reason},
            "ocr": {"available": "image" in self.readers, "reason": None if "image" in self.readers else "no image reader is registered"},
            "pdf": {"available": "pdf" in self.readers, "reason": None if "pdf" in self.readers else "no PDF reader is registered"},
            "missing_embeddings": semantic.missing(self.store.read("chunks"), self.store.read("embeddings"), self.embedder.model).count() if ready else None,
        }

    def app_info(self) -> dict:
        return {"name": "gleaner", "version": VERSION, "index": self.store.path}
