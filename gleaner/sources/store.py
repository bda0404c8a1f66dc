"""The catalog: tables as segments of Parquet, with one manifest a version.

A commit adds rows as new segments and takes rows away by naming their owners (the file they belong to, for
locations the location): it writes what changed and nothing else, and then one manifest. A reader holds the
version it opened and drops from each segment the rows whose owner was removed by a later one. A commit without
changes writes nothing. ``compact`` rewrites the buckets that have many segments or removals, ``expire`` deletes
what only old versions refer to, and opening an index of an older schema upgrades it, a commit a step.

Rows lie in buckets by a hash of their owner, so a file's rows of every table share a bucket, a look-up by
file reads one bucket and compaction costs what the touched buckets hold."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 2
BUCKETS = 16

#: The columns of each table.
TABLES = {
    "locations": "id long, path string, added_at long",
    "files": "file_id long, location_id long, path string, filename string, extension string, kind string, mime_type string, size_bytes long, created_at long, modified_at long, scanned_at long, indexed_at long, content_hash string, status string, error string",
    "documents": "document_id long, file_id long, title string, author string, language string, page_count int, word_count int, extracted_text string",
    "chunks": "chunk_id long, document_id long, chunk_index int, text string, page_number int, char_start int, char_end int, token_count int",
    "embeddings": "chunk_id long, model string, dimensions int, embedding array<float>",
    "postings": "term string, chunk_id long, positions array<int>, tf int",
    "chunk_stats": "chunk_id long, dl int",
}
#: The column that names a row's owner; the tables below chunks are given an ``owner`` column.
OWNERS = {"locations": "id", "files": "file_id", "documents": "file_id", "chunks": "document_id"}
#: What belongs to a file besides its row in ``files``.
CONTENT = ("documents", "chunks", "embeddings", "postings", "chunk_stats")
#: What each table is sorted by within its buckets, so that look-ups prune row groups.
SORTED = {"postings": "term", "files": "modified_at", "chunks": "document_id", "chunk_stats": "chunk_id", "embeddings": "chunk_id"}
REMOVED = "owner long, version long, slot int"


class ConflictError(RuntimeError):
    """Another run committed first."""


class Store:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(conf)
        self.fs.mkdirs(self._path(f"{self.path}/manifests"))
        self.buckets = buckets
        found = self.manifest()
        self.buckets = found.get("buckets", buckets)
        while found["version"] and found["schema_version"] < SCHEMA_VERSION:
            UPGRADES[found["schema_version"]](self, found)
            found = self.manifest()

    # --- versions

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in self._names("manifests") if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, by default the newest; an empty one before the first."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "schema_version": SCHEMA_VERSION, "buckets": self.buckets, "tables": {}}
        stream = self.fs.open(self._path(f"{self.path}/manifests/{version}.json"))
        try:
            found = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        if found["schema_version"] > SCHEMA_VERSION:
            raise RuntimeError("this index was made by a newer version")
        return found

    def publish(self, found: dict) -> int:
        """Makes ``found`` the manifest of its version; fails if there is one."""
        draft, final = self._path(f"{self.path}/manifests/.{uuid.uuid4().hex}"), self._path(f"{self.path}/manifests/{found['version']}.json")
        out = self.fs.create(draft)
        out.write(bytearray(json.dumps(found).encode()))
        out.close()
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            self.fs.delete(draft, False)
            raise ConflictError(f"version {found['version']} exists")
        return found["version"]

    # --- reading

    def slot(self, owner: Column) -> Column:
        return F.pmod(F.xxhash64(owner.cast("long")), F.lit(self.buckets)).cast("int")

    def slots_of(self, owners: Iterable[int]) -> list[int]:
        ids = self.spark.createDataFrame([(int(o),) for o in owners], "owner long")
        return sorted({r.slot for r in ids.select(self.slot(F.col("owner")).alias("slot")).collect()})

    def _scan(self, entries: list[dict], schema: T.StructType, slots: list[int] | None) -> DataFrame | None:
        paths = []
        for e in entries:
            wanted = e["buckets"] if slots is None else [b for b in e["buckets"] if b in slots]
            if wanted == e["buckets"] and not e.get("partial"):
                paths.append(f"{self.path}/{e['folder']}")
            else:
                paths += [f"{self.path}/{e['folder']}/bucket={b}" for b in wanted]
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*paths) if paths else None

    def read(self, table: str, version: int | None = None, owners: Iterable[int] | None = None, slots: list[int] | None = None, with_owner: bool = False) -> DataFrame:
        """The table's rows in a version; of some owners, or of some buckets, only those buckets are read."""
        entry = self.manifest(version)["tables"].get(table, {"segments": [], "removed": []})
        columns = T._parse_datatype_string(TABLES[table])
        schema = T.StructType([*columns.fields, *T._parse_datatype_string("__owner long, __version long, slot int").fields])
        slots = slots if owners is None else self.slots_of(owners)
        rows = self._scan(entry["segments"], schema, slots)
        if rows is None:
            rows = self.spark.createDataFrame([], schema)
        if owners is not None:
            rows = rows.where(F.col("__owner").isin([int(o) for o in owners]))
        gone = self._scan(entry["removed"], T._parse_datatype_string(REMOVED), slots)
        if gone is not None:
            last = gone.groupBy("owner").agg(F.max("version").alias("gone"))
            rows = rows.join(last, (F.col("__owner") == F.col("owner")) & (F.col("gone") > F.col("__version")), "left_anti")
        return rows.select(*columns.names, *([F.col("__owner").alias("owner")] if with_owner else []))

    # --- writing

    def _write(self, df: DataFrame, label: str, version: int, order: str | None) -> dict | None:
        """Rows with ``slot`` as a folder of buckets; None (and no folder) if there are none."""
        folder = f"{label}/{version}-{uuid.uuid4().hex[:8]}"
        rows = df.withColumn("bucket", F.col("slot")).hint("rebalance", "bucket").sortWithinPartitions("bucket", *([order] if order else []))
        rows.write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        found = sorted(int(n.split("=")[1]) for n in self._names(folder) if n.startswith("bucket="))
        if not found:
            self.fs.delete(self._path(f"{self.path}/{folder}"), True)
            return None
        return {"folder": folder, "version": version, "buckets": found}

    def add(self, table: str, df: DataFrame, version: int) -> dict | None:
        """Writes rows for ``version`` without publishing them."""
        owner = F.col(OWNERS.get(table, "owner")).cast("long")
        columns = T._parse_datatype_string(TABLES[table]).names
        rows = df.select(*columns, owner.alias("__owner"), F.lit(version).cast("long").alias("__version"), self.slot(owner).alias("slot"))
        return self._write(rows, table, version, SORTED.get(table))

    def commit(self, base: int, add: dict[str, DataFrame] | None = None, remove: Iterable[tuple[Iterable[str], DataFrame]] = (), alone: Callable[[int], None] | None = None) -> int:
        """The version after ``base``: ``add`` are rows by table, ``remove`` pairs of tables and owners (first column) whose
        earlier rows go from them. Without changes there is no new version. If another run committed since, this
        fails; with ``alone`` (the caller's owners are no one else's) it goes on top, after ``alone(version)`` agreed."""
        version = base + 1
        added = {t: e for t, df in (add or {}).items() if (e := self.add(t, df, version))}
        taken: dict[str, list[dict]] = {}
        for tables, owners in remove:
            own = owners.select(F.col(owners.columns[0]).cast("long").alias("owner")).where("owner IS NOT NULL").distinct()
            entry = self._write(own.select("owner", F.lit(version).cast("long").alias("version"), self.slot(F.col("owner")).alias("slot")), "removed", version, None)
            for t in tables if entry else ():
                taken.setdefault(t, []).append(entry)
        if not added and not taken:
            return base
        while True:
            found = self.manifest(version - 1)
            for t, e in added.items():
                found["tables"].setdefault(t, {"segments": [], "removed": []})["segments"].append(e)
            for t, entries in taken.items():
                if t in found["tables"]:
                    found["tables"][t]["removed"] += entries
            found |= {"version": version, "schema_version": SCHEMA_VERSION, "buckets": self.buckets}
            try:
                return self.publish(found)
            except ConflictError:
                if alone is None:
                    raise
                version = max(self.versions()) + 1
                alone(version - 1)

    # --- upkeep

    def compact(self, segments: int = 8) -> int:
        """Rewrites each bucket of a table that has over ``segments`` segments or any removal as one, as one new version."""
        found = self.manifest()
        version = found["version"] + 1
        changed = False
        for table, entry in found["tables"].items():
            held = [b for e in entry["segments"] for b in e["buckets"]]
            touched = {b for b in held if held.count(b) > segments} | {b for e in entry["removed"] for b in e["buckets"]}
            if not touched:
                continue
            changed = True
            live = self.read(table, version - 1, slots=sorted(touched), with_owner=True)
            new = self.add(table, live, version)
            kept = [e | {"buckets": left} | ({"partial": True} if left != e["buckets"] or e.get("partial") else {}) for e in entry["segments"] if (left := [b for b in e["buckets"] if b not in touched])]
            found["tables"][table] = {"segments": kept + ([new] if new else []), "removed": []}
        return self.publish(found | {"version": version}) if changed else version - 1

    def expire(self, keep: int = 3) -> list[str]:
        """Deletes all versions but the newest ``keep`` and the folders that none of those needs; gives the folders' names.
        Folders of a version that is not published yet may be those of a running commit and stay."""
        versions = self.versions()
        newest = max(versions, default=0)
        kept = versions[-max(1, keep) :]
        needed = {e["folder"] for v in kept for t in self.manifest(v)["tables"].values() for part in ("segments", "removed") for e in t[part]}
        for v in versions:
            if v not in kept:
                self.fs.delete(self._path(f"{self.path}/manifests/{v}.json"), False)
        dropped = [f for label in (*TABLES, "removed") for n in self._names(label) if (f := f"{label}/{n}") not in needed and int(n.split("-")[0]) <= newest]
        for f in dropped:
            self.fs.delete(self._path(f"{self.path}/{f}"), True)
        return dropped

    def size(self) -> int:
        """Bytes of the whole index."""
        return int(self.fs.getContentSummary(self._path(self.path)).getLength())


def _whole_tables_to_segments(store: Store, found: dict) -> None:
    """Schema 1 had one folder a table, rewritten by each commit, and no owners."""
    version = found["version"] + 1
    old = lambda t: store.spark.read.schema(T._parse_datatype_string(TABLES[t])).parquet(f"{store.path}/{found['tables'][t]}")
    tables = {}
    for t in found["tables"]:
        rows = old(t)
        if t not in OWNERS:
            rows = rows.join(old("chunks").select("chunk_id", F.col("document_id").alias("owner")), "chunk_id")
        if entry := store.add(t, rows, version):
            tables[t] = {"segments": [entry], "removed": []}
    store.publish({"version": version, "schema_version": 2, "buckets": store.buckets, "tables": tables})


#: By schema version, what makes it the next one: one commit each.
UPGRADES: dict[int, Callable[[Store, dict], None]] = {1: _whole_tables_to_segments}
