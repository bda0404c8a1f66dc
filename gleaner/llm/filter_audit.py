"""Filter interaction audit: what each of five filters removes, in each of their 120 orders.

What a filter does at a step depends only on which filters came before, not on their order: on an edge
(already-applied subset, next filter) of the lattice of subsets, of which there are 5 * 2^4 = 80. So
every document becomes one cell (part, which filters it fails, labels), cells are counted, each cell
contributes to the 80 edges, and the 600 steps of the 120 orders look their edge up: a path through
the lattice is an equi-join. No document is expanded, whatever the number of orders.

Filter E (a text that a smaller id has too) needs no join back to the documents: all documents of one
text fail the same other filters, so a text's rows are counted by part and labels first, with the
least id of each; the least of these is the text's, and only rows of that id pass. A text that a third
of all documents share is one row a part and label before its rows meet.

Texts are known by their SHA-256. A null text is an empty one; a null source is the part ``''``, as an
empty source is. A document whose id is null neither fails E nor makes another fail it, and has no
labels. Repeated rows are documents of their own, equal in all filters. A document is good (toxic) if
any of its label rows says so; labels of no document count nothing. An empty table gives no row.
Other columns, and labels that are null, are not read.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The filters, in the order of their bits, and their limits.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, JUNK = 200, 50, 2, r"[#$%&*|]"
BLANKS = r"[\x20\x09-\x0D]+"


def text_mask(text: Column) -> Column:
    """The bits of filters A to D that a text fails."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    n = F.size(words)
    fails = [
        n < MIN_WORDS,
        F.size(F.array_distinct(words)).cast("long") * 100 < n.cast("long") * MIN_DISTINCT,
        F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") * 100 > F.length(text).cast("long") * MAX_CAPITALS,
        text.rlike(JUNK),
    ]
    return sum((F.when(f, F.lit(1 << k)).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, good, toxic, n): documents by what they fail and how they are labelled."""
    text = F.coalesce(docs[text_col], F.lit(""))
    own = docs.select(docs[id_col].alias("id"), F.coalesce(docs[part_col], F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_mask(text).alias("mask"))
    says = lambda c: F.coalesce(F.max(labels[c] == 1), F.lit(False))
    told = labels.groupBy(labels["doc_id"].alias("id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    kind = ["digest", "part", "mask", "good", "toxic"]
    known = own.join(told, "id", "left").fillna(False, ["good", "toxic"]).groupBy("id", *kind).agg(F.count("*").alias("n"))
    once = known.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"))
    least = F.min("first.id").over(Window.partitionBy("digest"))
    once = once.withColumn("passes", F.col("unnamed") + F.when(F.col("first.id") == least, F.col("first.n")).otherwise(0))
    both = F.explode(F.array(F.struct(F.col("mask").alias("m"), F.col("passes").alias("c")), F.struct((F.col("mask") + (1 << 4)).alias("m"), (F.col("n") - F.col("passes")).alias("c"))))
    rows = once.select("part", "good", "toxic", both.alias("x")).select("part", "good", "toxic", F.col("x.m").alias("mask"), F.col("x.c").alias("c"))
    return rows.groupBy("part", "mask", "good", "toxic").agg(F.sum("c").alias("n"))


def edges(cell: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, applied, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): one row a part and
    edge of the lattice; ``applied`` is the bits of the filters that came before, ``filter`` the next one's bit number."""
    k = len(filters)
    pairs = [(s, f) for f in range(k) for s in range(1 << k) if not s >> f & 1]
    edge = F.explode(F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(f).alias("filter")) for s, f in pairs)))
    rows = cell.select("*", edge.alias("e")).select("part", "mask", "good", "toxic", "n", "e.applied", "e.filter")
    before, fails = F.col("mask").bitwiseAND(F.col("applied")) != 0, F.expr("shiftright(mask, filter) & 1") == 1
    here, count = ~before & fails, lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    sums = rows.groupBy("part", "applied", "filter").agg(
        count(~before & ~fails).alias("kept"), count(here).alias("removed"), count(before & fails).alias("redundant"), count(F.col("mask") == F.expr("shiftleft(1, filter)")).alias("unique_fails"),
        count(here & F.col("good")).alias("good_lost"), count(here & F.col("toxic")).alias("toxic_lost"),
    )
    # As many orders take an edge as there are orders of the filters before it, times those of the filters after it.
    size = F.bit_count("applied")
    orders = F.factorial(size) * F.factorial(F.lit(k - 1) - size)
    return sums.withColumn("shapley", F.sum(F.col("removed") * orders).over(Window.partitionBy("part", "filter")))


def steps(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """(filter_order, step, applied, filter) of every order: 600 rows for five filters."""
    rows = []
    for order in itertools.permutations(range(len(filters))):
        for at, f in enumerate(order):
            rows.append(("".join(filters[x] for x in order), at + 1, sum(1 << x for x in order[:at]), f))
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, filter int")


def audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """One row a part, order and step, zeros included."""
    # 600 rows, whatever the input.
    paths = edges(cells(docs, labels, **columns)).join(F.broadcast(steps(docs.sparkSession)), ["applied", "filter"])
    return paths.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
