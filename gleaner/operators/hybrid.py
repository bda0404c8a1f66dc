"""Hybrid search: meaning, words and names, weighed into one explained result a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text

WEIGHTS, WEIGHTS_WITHOUT_MODEL = (0.65, 0.25, 0.10), (0.0, 0.5, 0.5)


def combine(semantic: Column, keyword: Column, metadata: Column, with_model: bool) -> Column:
    """The weighted mean of the signals; one that is missing counts as 0."""
    weights = WEIGHTS if with_model else WEIGHTS_WITHOUT_MODEL
    total = sum((F.lit(w) * F.coalesce(s, F.lit(0.0)) for w, s in zip(weights, (semantic, keyword, metadata))), F.lit(0.0))
    return total / F.lit(sum(weights))


def path_order(path: Column) -> Column:
    """Sorts paths component by component."""
    return F.split(path, "/")


def fuse(semantic: DataFrame, keyword: DataFrame, names: DataFrame, queries: DataFrame, with_model: bool, limit: int = 20) -> DataFrame:
    """One row a query and file that any signal found, best first. The three lists, of at most a few hundred rows a
    query, meet in one aggregation by (query, file)."""
    nothing = lambda kind: F.lit(None).cast(kind)
    ends = lambda s, k, m, c, t, kt, mt: [s.alias("semantic"), k.alias("keyword"), m.alias("metadata"), c.alias("chunk_id"), t.alias("text"), kt.alias("keyword_terms"), mt.alias("name_terms")]
    page = F.col("page_number").cast("int").alias("page_number")
    base = ["query_id", "file_id", "path", "kind"]
    a = semantic.select(*base, page, F.lit(0).alias("order"), *ends(F.col("score"), nothing("double"), nothing("double"), F.col("chunk_id"), text.shorten(F.col("text")), nothing("array<string>"), nothing("array<string>")))
    share = F.size("matched_terms") / F.greatest(F.col("query_term_count"), F.lit(1)).cast("double")
    b = keyword.select(*base, page, F.lit(1).alias("order"), *ends(nothing("double"), share, nothing("double"), F.col("chunk_id"), nothing("string"), F.col("matched_terms"), nothing("array<string>")))
    part = F.size("matched_terms") / F.greatest(F.col("term_count"), F.lit(1)).cast("double")
    c = names.select(*base, nothing("int").alias("page_number"), F.lit(2).alias("order"), *ends(nothing("double"), nothing("double"), part, nothing("bigint"), nothing("string"), nothing("array<string>"), F.col("matched_terms")))
    # A keyword passage is better evidence than one found by meaning.
    passage = F.max(F.when(F.col("chunk_id").isNotNull(), F.struct("order", "chunk_id", "page_number", "text"))).alias("passage")
    rows = a.unionByName(b).unionByName(c).groupBy("query_id", "file_id").agg(
        F.any_value("path").alias("path"), F.any_value("kind").alias("kind"),
        *(F.max(s).alias(s) for s in ("semantic", "keyword", "metadata", "keyword_terms", "name_terms")), passage,
    )
    rows = rows.join(queries.select("query_id", text.typed_forms(F.col("query")).alias("typed")), "query_id")
    rows = rows.withColumn("relevance", combine(F.col("semantic"), F.col("keyword"), F.col("metadata"), with_model)).withColumn("match_reasons", text.match_reasons(F.col("semantic"), F.col("keyword_terms"), F.col("name_terms"), F.col("typed")))
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance"), F.desc(F.col("metadata").isNotNull()), path_order(F.col("path")))
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    result_id = F.coalesce(F.concat(F.lit("chunk-"), F.col("passage.chunk_id").cast("string")), F.concat(F.lit("file-"), F.col("file_id").cast("string")))
    return ranked.select("query_id", "rank", result_id.alias("result_id"), "file_id", "path", text.file_name(F.col("path")).alias("filename"), "kind", F.col("passage.chunk_id").alias("chunk_id"), F.col("passage.page_number").alias("page_number"), F.col("passage.text").alias("passage_text"), "relevance", text.relevance_label(F.col("relevance")).alias("label"), "match_reasons", "semantic", "keyword", "metadata")
