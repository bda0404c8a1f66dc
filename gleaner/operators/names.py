"""Search by file name and title."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.sources.scratch import written

CANDIDATES = 200


def least_files(rows: DataFrame, key: str, limit: int | None) -> DataFrame:
    """Of each key the ``limit`` least file ids; tasks cut before the shuffle. A file among a query's least is among the
    least of each of its terms and words, so cutting those first loses nothing."""
    if limit is None:
        return rows
    first = Window.partitionBy(key).orderBy("file_id")
    return rows.withColumn("__nth", F.row_number().over(first)).where(F.col("__nth") <= limit).drop("__nth")


def word_matches(words: DataFrame, stems: DataFrame, limit: int | None = None) -> DataFrame:
    """(key, file_id, plain): names with a word that starts with a stem (``stems``: key). The dictionary of distinct words
    offers its beginnings, of the lengths that some stem has and no others, and meets the stems in an equi-join; files come
    in cut to the ``limit`` least a word and stem. A file may come again by another word of its name."""
    lengths = stems.agg(F.collect_set(F.length("key")).alias("lengths"))  # one row
    dictionary = words.select("word").distinct().crossJoin(F.broadcast(lengths))
    asked_for = F.filter("lengths", lambda n: n <= F.length("word"))
    starts = dictionary.select("word", F.explode(F.transform(asked_for, lambda n: F.substring(F.col("word"), F.lit(1), n))).alias("key")).join(stems, "key")
    held = least_files(words, "word", limit).join(starts, "word")
    if limit is not None:
        held = least_files(held.dropDuplicates(["key", "file_id"]), "key", limit)
    return held.select("key", "file_id", F.contains("shown", F.col("key")).alias("plain"))


def phrase_matches(named: DataFrame, phrases: DataFrame, limit: int | None = None) -> DataFrame:
    """(key, file_id, plain): names that hold a phrase's words in a row (``phrases``: key, words), found by its first two."""
    wanted = phrases.withColumn("two", F.slice("words", 1, 2))
    pairs = named.where(F.size("own") > 1).select("file_id", "own", "shown", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("own") - 1), lambda k: F.slice("own", k, 2))).alias("at", "two"))
    held = pairs.join(wanted, "two").where(F.slice("own", F.col("at") + 1, F.size("words")) == F.col("words"))
    if limit is not None:
        held = least_files(held.dropDuplicates(["key", "file_id"]), "key", limit)
    return held.select("key", "file_id", F.contains("shown", text.plural_stem(F.col("key"))).alias("plain"))


#: Pairs of a query and a file that a task puts together.
PAIRS = 1 << 21


def with_names(files: DataFrame, documents: DataFrame) -> DataFrame:
    """``files`` with title, ``own`` (the words of name and title) and ``shown`` (both as a plain text)."""
    named = files.select("file_id", "path", "kind", "filename").join(documents.select("file_id", "title"), "file_id", "left")
    both = F.concat("filename", F.lit(" "), F.coalesce("title", F.lit("")))
    return named.withColumn("own", text.pieces(both)).withColumn("shown", text.ascii_lower(both))


def matching(named: DataFrame, queries: DataFrame, strict_prefilter: bool = False, limit: int | None = None) -> DataFrame:
    """(query_id, file_id, mask): the files of ``with_names`` that have a term of a query, and which: bit ``term_pos`` is set
    (a query has at most 64 terms). Of each query the ``limit`` least ids, if a limit is given, and perhaps some more.

    Queries fan out last, within tasks that hold all of a file's words and phrases, so pairs of a query and a file are
    never shuffled. ``strict_prefilter`` also asks that some term occurs as a plain substring. Nearly always a term that
    matches does so; only the other pairs are looked up again."""
    asked = queries.select("query_id", text.query_terms(F.col("query")).alias("terms")).where(F.size("terms") > 0)
    terms = asked.select("query_id", F.posexplode("terms").alias("term_pos", "term")).withColumn("words", F.split("term", " "))
    # A stem has no blank and a phrase has one, so the two don't meet.
    terms = terms.withColumn("key", F.when(F.size("words") == 1, text.plural_stem(F.col("term"))).otherwise(F.col("term")))
    terms = written(terms.select("query_id", "term_pos", "key", "words"), "terms")
    cut = None if strict_prefilter else limit  # the prefilter comes before the limit
    words = named.select("file_id", "shown", F.explode(F.array_distinct("own")).alias("word"))
    held = word_matches(words, terms.where("size(words) = 1").select("key").distinct(), cut)
    if not terms.where("size(words) > 1").isEmpty():
        held = held.unionByName(phrase_matches(named, terms.where("size(words) > 1").select("key", "words").distinct(), cut))
    if cut is None:
        # As many tasks as the pairs need; without a number the few bytes before the fan-out would be put into few tasks.
        spark = named.sparkSession
        pairs = named.select("file_id").count() * terms.select("query_id").distinct().count()
        held = held.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs // PAIRS)), "file_id")
    bits = terms.select("key", "query_id", F.expr("shiftleft(1L, term_pos)").alias("bit"))
    rows = held.join(bits, "key").groupBy("query_id", "file_id").agg(F.bit_or("bit").alias("mask"), F.bool_or("plain").alias("plain"))
    if not strict_prefilter:
        return rows.drop("plain")
    doubtful = rows.where("NOT plain").join(asked, "query_id").join(named.select("file_id", "filename", "title"), "file_id")
    passed = doubtful.where(text.name_prefilter(F.col("terms"), F.col("filename"), F.col("title"))).select("query_id", "file_id", "mask")
    return rows.where("plain").drop("plain").unionByName(passed)


def search(files: DataFrame, documents: DataFrame, queries: DataFrame, strict_prefilter: bool = False, limit: int = CANDIDATES) -> DataFrame:
    """(query_id, file_id, path, kind, matched_terms, term_count): of each query the ``limit`` least files, read or not,
    whose name or title has a term.

    ``strict_prefilter`` also asks that some term occurs as a plain substring."""
    named = with_names(files, documents)
    asked = queries.select("query_id", text.query_terms(F.col("query")).alias("terms"))
    first = Window.partitionBy("query_id").orderBy("file_id")
    rows = matching(named, queries, strict_prefilter, limit).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= limit)
    rows = rows.join(asked, "query_id").join(files.select("file_id", "path", "kind"), "file_id")
    matched = text.chosen(F.col("terms"), F.col("mask"))
    return rows.select("query_id", "file_id", "path", "kind", matched.alias("matched_terms"), F.size("terms").alias("term_count"))
