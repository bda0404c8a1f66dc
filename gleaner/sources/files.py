"""Folders as DataFrames: which files there are, and their content and hashes.

The listing begins on the driver and goes on in tasks once there are many folders, with the exact rules for what is
skipped; Spark's own listing serves other stores. Content is read by executors, only of files that changed, in pieces."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text

#: Folders that are never entered.
SKIPPED = ("node_modules", "$RECYCLE.BIN", "System Volume Information")
LISTING = "path string, kind string, size_bytes long, created_at long, modified_at long"


class Cancelled(Exception):
    pass


def hidden(name: str) -> bool:
    return name.startswith((".", "~$"))


def kind_of(name: str) -> str | None:
    ext = os.path.splitext(name)[1][1:].lower()
    return {"pdf": "pdf", "txt": "text", "md": "markdown", "markdown": "markdown", "docx": "docx", "png": "image", "jpg": "image", "jpeg": "image", "webp": "image"}.get(ext)


def millis(seconds: float | None) -> int | None:
    return None if seconds is None or seconds < 0 else int(seconds * 1000)


def entries_of(folder: str) -> tuple[list[tuple], list[str]]:
    """The supported files of one folder (a row without kind for what can't be read), and the folders to enter."""
    rows, inner = [], []
    try:
        entries = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return [(folder, None, None, None, None)], []
    for e in entries:
        if hidden(e.name):
            continue
        try:
            if e.is_dir(follow_symlinks=False):
                if e.name not in SKIPPED:
                    inner.append(e.path)
            elif e.is_file(follow_symlinks=False) and (kind := kind_of(e.name)):
                s = e.stat(follow_symlinks=False)
                rows.append((e.path, kind, s.st_size, millis(getattr(s, "st_birthtime", None)), millis(s.st_mtime)))
        except OSError:
            rows.append((e.path, None, None, None, None))
    return rows, inner


def discover(spark: SparkSession, root: str, cancelled: Callable[[], bool] = lambda: False, spread: int = 256) -> tuple[DataFrame, int]:
    """Supported files below a folder that driver and executors see, and how many entries could not be read. Links are
    not followed; the root itself is never skipped. Once ``spread`` folders wait, tasks walk what is below each of
    them, and their rows don't pass the driver."""
    rows, todo = [], [root]
    while todo and len(todo) < spread:
        if cancelled():
            raise Cancelled
        own, inner = entries_of(todo.pop(0))
        rows += own
        todo += inner
    first = spark.createDataFrame([r for r in rows if r[1]], LISTING)
    unreadable = sum(r[1] is None for r in rows)
    if not todo:
        return first, unreadable

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in LISTING.split(", ")]
        for batch in batches:
            waiting = list(batch["path"])
            while waiting:
                own, inner = entries_of(waiting.pop())
                waiting += inner
                if own:
                    frame = pd.DataFrame(own, columns=names)
                    yield frame.astype({"size_bytes": "Int64", "created_at": "Int64", "modified_at": "Int64"})

    below = spark.createDataFrame([(f,) for f in todo], "path string").repartition(len(todo)).mapInPandas(walk, LISTING).persist()
    unreadable += below.where("kind IS NULL").count()
    return first.unionByName(below.where("kind IS NOT NULL")), unreadable


def skipped(relative: Column) -> Column:
    """Whether a path below the root has a hidden, lock or system component."""
    parts = F.split(relative, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    return F.exists(parts, lambda p: F.startswith(p, F.lit(".")) | F.startswith(p, F.lit("~$"))) | F.exists(folders, lambda p: p.isin(*SKIPPED))


def discover_remote(spark: SparkSession, root: str) -> DataFrame:
    """The same from any store Spark reads, listed in parallel; names that Spark itself hides do not appear."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.substring(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), F.lit(len("/" + root.split(":", 1)[-1].strip("/")) + 2), F.lit(1 << 20))
    kind = text.file_kind(F.col("path"))
    return rows.where(~skipped(relative) & kind.isNotNull()).select("path", kind.alias("kind"), F.col("length").alias("size_bytes"), F.lit(None).cast("long").alias("created_at"), text.unix_millis(F.col("modificationTime")).alias("modified_at"))


def stat_and_open(path: str):
    """(size, what opens a stream): the file is not opened yet. Raises OSError."""
    import pyarrow.fs as pafs

    fs, at = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    info = fs.get_file_info(at)
    if not info.is_file:
        raise FileNotFoundError(path)
    return info.size, lambda: fs.open_input_stream(at, compression=None)


#: Bytes that are read at once.
PIECE = 64 << 10


def hash_pieces(stream, keep: bool) -> tuple[str, bytes | None]:
    """SHA-256 of a stream, as lower-case hex, and with ``keep`` its bytes. Else a piece is held at a time."""
    sha, pieces = hashlib.sha256(), []
    while piece := stream.read(PIECE):
        sha.update(piece)
        if keep:
            pieces.append(piece)
    return sha.hexdigest(), b"".join(pieces) if keep else None


def problem_of(error: OSError) -> str:
    return "denied" if isinstance(error, PermissionError) else "missing" if isinstance(error, FileNotFoundError) else "unreadable"


def fingerprint(content: Column) -> Column:
    """SHA-256, as lower-case hex."""
    return F.sha2(content, 256)
