"""Listings and counts of files and locations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text

PAGE, MOST = 100, 500


def matching(files: DataFrame, location_id: int | None = None, kind: str | None = None, name: str | None = None) -> DataFrame:
    """Files under the given filters; one that is absent, or a blank name, filters nothing."""
    if location_id is not None:
        files = files.where(F.col("location_id") == location_id)
    if kind is not None:
        files = files.where(F.col("kind") == kind)
    if name is not None and name.strip():
        files = files.where(text.contains_name(F.col("filename"), name.strip()))
    return files


def page(files: DataFrame, limit: int = PAGE, offset: int = 0) -> DataFrame:
    """Newest first, unknown times last, then by path."""
    return files.orderBy(F.desc_nulls_last("modified_at"), "path").offset(max(0, offset)).limit(max(1, min(MOST, limit)))


def page_after(files: DataFrame, last: tuple[int | None, str] | None, limit: int = PAGE) -> DataFrame:
    """The page that follows the row ``last`` (its time and path), whatever was added before it meanwhile: rows that come
    earlier are filtered out, not counted off, so each page costs the same."""
    if last is not None:
        time, path = last
        later = F.col("path") > path
        files = files.where(F.col("modified_at").isNull() & later if time is None else (F.col("modified_at") < time) | F.col("modified_at").isNull() | (F.col("modified_at") == time) & later)
    return page(files, limit)


def location_counts(locations: DataFrame, files: DataFrame) -> DataFrame:
    counts = files.groupBy("location_id").agg(F.count("*").alias("files"), F.count_if(F.col("status") == "indexed").alias("indexed"), F.count_if(F.col("status") == "error").alias("failed"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return locations.join(counts, locations["id"] == counts["location_id"], "left").select("id", "path", text.display_name(F.col("path")).alias("name"), zero("files"), zero("indexed"), zero("failed"))


def row_counts(**tables: DataFrame) -> DataFrame:
    """(name, rows) of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def pending(files: DataFrame, location_id: int | None = None, include_images: bool = False) -> DataFrame:
    """Files to be read, newest first; images only if something can read them."""
    rows = files.where(F.col("status") == "pending")
    if location_id is not None:
        rows = rows.where(F.col("location_id") == location_id)
    if not include_images:
        rows = rows.where(F.col("kind") != "image")
    return rows.orderBy(F.desc_nulls_last("modified_at"), "path")
