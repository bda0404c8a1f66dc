"""The engine's tables as views of the test tables: documents as one-page files, conversations as many-page documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ids of the image files: those of documents from here on.
IMAGES = 1_000_000_000


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a readable file, and beside each fifth an image file without text of its own."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "text")
    ext = F.element_at(F.array(*map(F.lit, ("pdf", "txt", "md", "docx"))), (F.col("doc_id") % 4 + 1).cast("int"))
    images = docs.where("doc_id % 5 = 4").select(F.col("doc_id") + IMAGES, "source", F.lit(10).cast("long"), F.concat(F.lit("image "), F.col("doc_id").cast("string")), F.lit("png"), F.lit("Img "), "doc_id")
    rows = docs.withColumn("extension", ext).withColumn("named", F.lit("Doc ")).withColumn("number", F.col("doc_id"))
    rows = rows.union(images).withColumn("filename", F.concat("named", F.col("number").cast("string"), F.lit("."), "extension"))
    rows = rows.withColumn("path", F.concat(F.lit("/"), "source", F.lit("/"), "filename"))
    kind = text.file_kind(F.col("filename"))
    return rows.select(
        F.col("doc_id").alias("file_id"), F.substring("source", 4, 10).cast("int").alias("location_id"), "path", "filename", "extension", kind.alias("kind"), F.col("n_chars").alias("size_bytes"),
        F.when(F.col("doc_id") % 17 != 0, F.col("doc_id") * 1000).alias("modified_at"), F.when(kind == "image", "pending").otherwise("indexed").alias("status"), F.col("text"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read files: one page, titled by its first word."""
    rows = files(spark, sf_dir).where("kind <> 'image'")
    return rows.select(F.col("file_id").alias("document_id"), "file_id", F.regexp_extract("text", r"^[^\s]+", 0).alias("title"), F.col("text").alias("extracted_text"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one passage."""
    docs = documents(spark, sf_dir)
    return docs.select(F.col("document_id").alias("chunk_id"), "document_id", F.lit(None).cast("int").alias("page_number"), F.col("extracted_text").alias("text"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation as one numbered page and one passage, with offsets in the conversation's text."""
    rows = table(spark, sf_dir, "conversations")
    from pyspark.sql import Window

    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0))
    rows = rows.withColumn("char_start", start)
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), F.col("conv_id").alias("document_id"), (F.col("turn") + 1).cast("int").alias("page_number"), "text", "char_start", (F.col("char_start") + F.length("text")).alias("char_end"))


def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    return rows.select(F.col("conv_id").alias("document_id"), F.col("conv_id").alias("file_id"), F.array_join(F.transform("turns", lambda t: t.text), "\n\n").alias("extracted_text"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as searches."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
