"""A source of change events: what was created, modified or removed below some folders.

    spark.dataSource.register(FolderChanges)
    spark.readStream.format("folder_changes").option("roots", '["/data/docs"]').option("journal", "/data/journal").load()

Each trigger lists the folders and writes what differs from the last listing to a journal, a file an offset, so a batch
that is read again after a failure has the rows it had, and changes made while no stream ran are found at its next
start. The first listing of a new journal is where it begins and gives no events. Reading (``spark.read``) gives
every file as created, listed by a task a folder.

Rows: path, event_kind (create, modify or remove), ts (when it was seen). Roots and journal are folders that driver and
executors see; the listing of a stream is the driver's, as a watcher's is, and only what changed leaves it."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from gleaner.sources.files import entries_of

SCHEMA = "path string, event_kind string, ts timestamp"


def listing(roots: list[str]) -> dict[str, list]:
    """Path to [size, time of change] of the supported files below the roots."""
    found, todo = {}, list(roots)
    while todo:
        rows, inner = entries_of(todo.pop())
        todo += inner
        found |= {path: [size, modified] for path, kind, size, _, modified in rows if kind}
    return found


def differences(before: dict[str, list], after: dict[str, list]) -> list[tuple[str, str]]:
    changed = [(p, "create" if p not in before else "modify") for p in after if before.get(p) != after[p]]
    return sorted(changed + [(p, "remove") for p in before if p not in after])


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class FolderReader(DataSourceReader):
    def __init__(self, roots: list[str]):
        self.roots = roots

    def partitions(self) -> list[Folder]:
        return [p for root in self.roots for p in (Folder(root, False), *(Folder(inner, True) for inner in entries_of(root)[1]))]

    def read(self, partition: Folder) -> Iterator[tuple]:
        now = datetime.now(timezone.utc)
        rows = listing([partition.path]) if partition.deep else [path for path, kind, *_ in entries_of(partition.path)[0] if kind]
        for path in sorted(rows):
            yield path, "create", now


class FolderStreamReader(SimpleDataSourceStreamReader):
    def __init__(self, roots: list[str], journal: str):
        self.roots, self.journal = roots, journal
        os.makedirs(journal, exist_ok=True)

    def _at(self, n: int) -> str:
        return os.path.join(self.journal, f"{n}.json")

    def _write(self, name: str, value) -> None:
        draft = os.path.join(self.journal, f".{os.path.basename(name)}")
        with open(draft, "w") as f:
            json.dump(value, f)
        os.replace(draft, name)

    def _last(self) -> tuple[int, dict]:
        with open(os.path.join(self.journal, "snapshot.json")) as f:
            found = json.load(f)
        return found["offset"], found["files"]

    def initialOffset(self) -> dict:
        if not os.path.exists(os.path.join(self.journal, "snapshot.json")):
            self._write(os.path.join(self.journal, "snapshot.json"), {"offset": 0, "files": listing(self.roots)})
        return {"offset": self._last()[0]}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        offset, before = self._last()
        after = listing(self.roots)
        if found := differences(before, after):
            now = datetime.now(timezone.utc).timestamp()
            # First the events, then the listing that they lead to: a crash between the two finds them once more.
            self._write(self._at(offset + 1), [[p, kind, now] for p, kind in found])
            offset += 1
            self._write(os.path.join(self.journal, "snapshot.json"), {"offset": offset, "files": after})
        end = {"offset": offset}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        rows = []
        for n in range(start["offset"] + 1, end["offset"] + 1):
            with open(self._at(n)) as f:
                rows += [(p, kind, datetime.fromtimestamp(t, timezone.utc)) for p, kind, t in json.load(f)]
        return iter(rows)

    def commit(self, end: dict) -> None:
        for name in os.listdir(self.journal):
            if name.endswith(".json") and name.split(".")[0].isdigit() and int(name.split(".")[0]) <= end["offset"] - 100:
                os.remove(os.path.join(self.journal, name))


class FolderChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return SCHEMA

    def _roots(self) -> list[str]:
        return json.loads(self.options["roots"])

    def reader(self, schema) -> FolderReader:
        return FolderReader(self._roots())

    def simpleStreamReader(self, schema) -> FolderStreamReader:
        return FolderStreamReader(self._roots(), self.options["journal"])
