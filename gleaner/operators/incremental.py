"""Incremental maintenance as joins of snapshots: what is new, changed, gone, and what that does to the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text


def looks_unchanged(size: Column, modified: Column, known_size: Column, known_modified: Column) -> Column:
    """Same size and same known time; an unknown time is never trusted."""
    return F.coalesce(modified.isNotNull() & (size == known_size) & (modified == known_modified), F.lit(False))


def classify(seen: DataFrame, known: DataFrame) -> DataFrame:
    """(path, change): new, check (to be hashed), unchanged or deleted. One full outer join by path."""
    a, b = seen.alias("a"), known.alias("b")
    same = looks_unchanged(F.col("a.size_bytes"), F.col("a.modified_at"), F.col("b.size_bytes"), F.col("b.modified_at"))
    change = F.when(F.col("a.path").isNull(), "deleted").when(F.col("b.path").isNull(), "new").when(same, "unchanged").otherwise("check")
    return a.join(b, F.col("a.path") == F.col("b.path"), "full_outer").select(F.coalesce("a.path", "b.path").alias("path"), change.alias("change"))


def deleted(known: DataFrame, seen: DataFrame) -> DataFrame:
    return known.join(seen.select("path"), "path", "left_anti")


def upsert(known: DataFrame, checked: DataFrame) -> DataFrame:
    """The files table after ``checked`` (path, location_id, filename, extension, kind, mime_type, size_bytes,
    created_at, modified_at, scanned_at, content_hash, error) is upserted by path.

    A read error makes the status error; a file whose hash is as before and that had no error keeps status and
    time of indexing; any other is pending. Name and kind of a known file are not rewritten."""
    k, c = known.alias("k"), checked.alias("c")
    same = F.col("c.content_hash").eqNullSafe(F.col("k.content_hash"))
    status = F.when(F.col("c.path").isNull(), F.col("k.status")).when(F.col("c.error").isNotNull(), "error").when(F.col("k.path").isNotNull() & same & (F.col("k.status") != "error"), F.col("k.status")).otherwise("pending")
    taken = lambda n: F.when(F.col("c.path").isNull(), F.col(f"k.{n}")).otherwise(F.col(f"c.{n}")).alias(n)
    first = lambda n: F.coalesce(f"k.{n}", f"c.{n}").alias(n)
    indexed = F.when(F.col("c.path").isNull() | same, F.col("k.indexed_at")).alias("indexed_at")
    # Ids follow from paths, so a rerun gives the same ones.
    file_id = F.coalesce("k.file_id", file_id_of(F.col("c.path"))).alias("file_id")
    return k.join(c, F.col("k.path") == F.col("c.path"), "full_outer").select(file_id, first("location_id"), first("path"), first("filename"), first("extension"), first("kind"), first("mime_type"), taken("size_bytes"), taken("created_at"), taken("modified_at"), taken("scanned_at"), indexed, taken("content_hash"), status.alias("status"), taken("error"))


def file_id_of(path: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(path), 1)


def replaced(old: DataFrame, new: DataFrame, key: str, touched: DataFrame) -> DataFrame:
    """``old`` without the rows of ``touched`` keys, and ``new``."""
    return old.join(touched.select(key).distinct(), key, "left_anti").unionByName(new.select(old.columns))


def cascade(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """The children whose parent is still there."""
    return children.join(parents.select(F.col(parent_key).alias("__parent")), F.col(child_key) == F.col("__parent"), "left_semi")


def scan_metrics(changes: DataFrame) -> DataFrame:
    return changes.agg(
        F.count_if(F.col("change") != "deleted").alias("found"), F.count_if(F.col("change") == "new").alias("added"), F.count_if(F.col("change") == "check").alias("checked"), F.count_if(F.col("change") == "unchanged").alias("unchanged"), F.count_if(F.col("change") == "deleted").alias("removed")
    )


def affected_locations(changes: DataFrame, locations: DataFrame) -> DataFrame:
    """(id, path): each location that holds a changed path, once. A path goes to the first location by id that has it.

    Containment becomes an equi-join: a path is exploded into its ancestors, as many rows as it has components."""
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    up = changes.where(F.coalesce(F.col("event_kind") != "access", F.lit(True)) if "event_kind" in changes.columns else F.lit(True)).select("path").distinct().select("path", F.explode(F.array_distinct(F.transform(ancestors, lambda a: F.when(a == "", "/").otherwise(a)))).alias("root"))
    roots = locations.select("id", F.col("path").alias("location_path"), F.regexp_replace("path", r"(?<=.)/+$", "").alias("root"))
    first = up.join(roots, "root").groupBy("path").agg(F.min(F.struct("id", "location_path")).alias("location"))
    return first.select(F.col("location.id").alias("id"), F.col("location.location_path").alias("path")).distinct()


def nesting(locations: DataFrame, candidates: DataFrame) -> DataFrame:
    """What adding each candidate path would do: already_added, inside_existing, replaces or new; with the ids concerned."""
    pairs = candidates.select(F.col("path").alias("candidate")).join(locations.select("id", "path"), text.under(F.col("candidate"), F.col("path")) | text.under(F.col("path"), F.col("candidate")), "left")
    bare = lambda c: F.regexp_replace(c, r"(?<=.)/+$", "")
    verdict = F.when(F.col("id").isNull(), F.lit(3)).when(bare("candidate") == bare("path"), 0).when(text.under(F.col("candidate"), F.col("path")), 1).otherwise(2)
    worst = pairs.withColumn("v", verdict).groupBy("candidate").agg(F.min("v").alias("v"), F.array_sort(F.collect_list(F.struct("v", "id"))).alias("all"))
    return worst.select("candidate", F.element_at(F.array(*map(F.lit, ("already_added", "inside_existing", "replaces", "new"))), F.col("v") + 1).alias("verdict"), F.transform(F.filter("all", lambda x: (x.v == F.col("v")) & x.id.isNotNull()), lambda x: x.id).alias("ids"))
