"""Passages within their pages, and the stored text of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page_spans(chunks: DataFrame) -> DataFrame:
    """(document_id, page_number, page_start, page_end, chunks): the null page is a page."""
    return chunks.groupBy("document_id", "page_number").agg(F.min("char_start").alias("page_start"), F.max("char_end").alias("page_end"), F.count("*").alias("chunks"))


def evidence(chunks: DataFrame, documents: DataFrame, files: DataFrame, chunk_ids: DataFrame | None = None) -> DataFrame:
    """Per passage: the page's text before it, itself, and after. A passage that its document does not bear out has no row."""
    own = chunks if chunk_ids is None else chunks.join(chunk_ids.select("chunk_id"), "chunk_id", "left_semi")
    scope = chunks if chunk_ids is None else chunks.join(own.select("document_id").distinct(), "document_id", "left_semi")
    spans = page_spans(scope)
    rows = own.join(spans.withColumnRenamed("document_id", "d").withColumnRenamed("page_number", "p"), (F.col("document_id") == F.col("d")) & F.col("page_number").eqNullSafe(F.col("p")))
    rows = rows.join(documents.select("document_id", "file_id", "extracted_text"), "document_id").join(files.select("file_id", "path", "kind"), "file_id")
    for c in ("page_start", "char_start", "char_end", "page_end"):
        rows = rows.withColumn(c, F.greatest(F.col(c), F.lit(0)))
    cut = lambda a, b: F.substring("extracted_text", F.col(a) + 1, F.col(b) - F.col(a))
    sound = (F.col("page_start") <= F.col("char_start")) & (F.col("char_start") <= F.col("char_end")) & (F.col("char_end") <= F.col("page_end")) & (F.col("page_end") <= F.length("extracted_text"))
    rows = rows.where(sound & (cut("char_start", "char_end") == F.col("text")))
    return rows.select("chunk_id", "file_id", "path", "kind", "page_number", cut("page_start", "char_start").alias("before"), cut("char_start", "char_end").alias("passage"), cut("char_end", "page_end").alias("after"))


def document_pages(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, page_number, page_start, page_text): pages as their passages span them, blank ones not at all."""
    rows = page_spans(chunks).join(documents.select("document_id", "extracted_text"), "document_id")
    return rows.select("document_id", "page_number", "page_start", F.substring("extracted_text", F.greatest(F.col("page_start"), F.lit(0)) + 1, F.greatest(F.col("page_end") - F.greatest(F.col("page_start"), F.lit(0)), F.lit(0))).alias("page_text"))


def stored_documents(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Per document: title, author, counts and its pages in order."""
    pages = document_pages(chunks, documents).groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_start", F.col("page_number").alias("number"), F.col("page_text").alias("text")))), lambda p: F.struct(p.number.alias("number"), p.text.alias("text"))).alias("pages"))
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    rows = documents.join(pages, "document_id", "left").join(counts, "document_id", "left")
    return rows.select("file_id", "document_id", "title", "author", "page_count", F.coalesce("word_count", F.lit(0)).alias("word_count"), F.coalesce("chunk_count", F.lit(0).cast("long")).alias("chunk_count"), F.coalesce("pages", F.array().cast("array<struct<number:int,text:string>>")).alias("pages"))
