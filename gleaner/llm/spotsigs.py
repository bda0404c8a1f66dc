"""Document fingerprints after SpotSigs, in DataFrame expressions only.

Each anchor (a very common word) starts a chain: the next ``chain`` content words (words that are no
anchors) among the ``reach`` words after it. A chain with its anchor, hashed to 64 bits, is a spot
signature; a text's fingerprint is the set of them. A text without a full chain has one signature,
of all its words. Words are runs of letters and digits, lower-cased.

Comparison: sets are partitioned by length such that sets of a Jaccard similarity of at least the
threshold are in the same or in neighbouring partitions, and a pair whose lengths alone rule the
threshold out is pruned before any element is looked at.

The fingerprint column is a digest of the sorted set with its length, equal exactly if the sets are (up
to hash collisions), so equal texts have equal fingerprints. Nulls: a null text is an empty one, and its one signature is
that of no words. Whole texts are used; repeated rows repeat; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions

#: Very common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to in a is that it for on was be with as by this at are from an or which not have has had "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er so "
    "le la les de et un une du que dans qui par pour pas au sur ne se ce il sont plus "
    "el los las en y una del se por con no su para al lo como más o pero sus"
).split()


def signatures(text: Column, chain: int = 2, reach: int = 6) -> Column:
    """The sorted distinct spot signatures of a text, as longs."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    anchor = lambda w: w.isin(*dict.fromkeys(ANCHORS))

    def spots(ws):
        def at(w, i):
            tail = F.filter(F.slice(ws, i + 2, reach), lambda x: ~anchor(x))
            full = F.transform(F.array(tail), lambda t: F.when(F.size(t) >= chain, F.xxhash64(w, *[F.get(t, k) for k in range(chain)])))
            return F.when(anchor(w), F.get(full, 0))

        found = F.filter(F.transform(ws, at), lambda h: h.isNotNull())
        return F.get(F.transform(F.array(found), lambda f: F.when(F.size(f) > 0, F.array_sort(F.array_distinct(f))).otherwise(F.array(F.xxhash64(F.lit(-1), ws)))), 0)

    return F.get(F.transform(F.array(words), spots), 0)


def digest(signature_set: Column) -> Column:
    return F.concat(F.lower(F.lpad(F.hex(F.xxhash64(signature_set)), 16, "0")), F.lit("-"), F.size(signature_set).cast("string"))


def length_partition(size: Column, threshold: float) -> Column:
    """Sets of a similarity of ``threshold`` or more lie in one partition or in two neighbouring ones."""
    return F.floor(F.log(size.cast("double")) / F.lit(-math.log(threshold))).cast("int")


def likeness(a: Column, b: Column, floor: float = 0.05) -> Column:
    """Jaccard similarity of two sets; 0 where their lengths' ratio, its upper bound, is below ``floor``."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    return F.when(small < floor * large, F.lit(0.0)).otherwise(common / (F.size(a) + F.size(b) - common).cast("double"))


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, set) with next_text and next_set, of the next row by ascending id (null
    first, ties by hash of the text); the last row's next is the first.

    Rows go to ranges of ids, and the first row of a range also, marked, to the end of the range
    before it, so no window spans more than a range and texts are shuffled once."""
    lowest = -(1 << 63)
    rows = docs.withColumn("__at", F.coalesce(F.col("doc_id"), F.lit(lowest)))
    parts = partitions(docs.sparkSession)
    found = docs.select(F.coalesce(F.col("doc_id"), F.lit(lowest)).alias("at")).agg(F.min("at").alias("low"), F.percentile_approx("at", [k / parts for k in range(1, parts)] or [0.5], 10_000).alias("cuts")).first()
    if found.low is None:
        return docs.select("*", docs["text"].alias("next_text"), docs["set"].alias("next_set"))
    cuts = sorted({c for c in found.cuts if c > found.low})
    # Two levels of at most sqrt(cuts) comparisons each.
    step = max(1, math.isqrt(len(cuts)))
    groups = [cuts[k : k + step] for k in range(0, len(cuts), step)] or [[]]
    as_array = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<bigint>")
    upto = lambda array: F.size(F.filter(array, lambda c: c <= F.col("__at")))
    top = upto(as_array([g[0] for g in groups if g][1:]))
    place = F.struct(F.lit(0).alias("late"), (F.col("__top") * step + upto(F.get(F.array(*map(as_array, groups)), F.col("__top")))).alias("bucket"))
    rows = rows.withColumn("__top", top).withColumn("__place", place)
    first = F.exists(F.get(F.array(*map(as_array, groups)), F.col("__top")), lambda c: c == F.col("__at"))
    homes = F.array(
        F.col("__place"),
        F.when(first, F.struct(F.lit(1).alias("late"), (F.col("__place.bucket") - 1).alias("bucket"))),
        F.when(F.col("__at") == found.low, F.struct(F.lit(2).alias("late"), F.lit(len(cuts)).alias("bucket"))),
    )
    rows = rows.select("doc_id", "text", "set", "__at", F.explode(F.filter(homes, lambda h: h.isNotNull())).alias("__home"))
    rows = rows.select("doc_id", "text", "set", "__at", F.col("__home.late").alias("late"), F.col("__home.bucket").alias("bucket"))
    order = Window.partitionBy("bucket").orderBy("late", "__at", F.xxhash64("text"))
    # Both columns in one window, so the rows are shuffled once.
    led = rows.select("doc_id", "text", "set", "late", F.lead("text").over(order).alias("next_text"), F.lead("set").over(order).alias("next_set"))
    return led.where("late = 0").drop("late")


def edited_comparison(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text against itself with its last quarter replaced by the next document's first code points,
    and against the next document."""
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text")).withColumn("set", signatures(F.col("text")))
    rows = with_next(rows).withColumn("n_chars", F.length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring("next_text", F.lit(1), quarter)))
    rows = rows.select("doc_id", "n_chars", "set", "next_set", F.sha2("edited", 256).alias("edited_sha256"), signatures(F.col("edited")).alias("edited_set"))
    return rows.select("doc_id", "n_chars", "edited_sha256", digest(F.col("set")).alias("fingerprint"), digest(F.col("edited_set")).alias("edited_fingerprint"), likeness(F.col("set"), F.col("edited_set"), 0.0).alias("near_edited"), likeness(F.col("set"), F.col("next_set"), 0.0).alias("near_next"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pairs, members). ``members``: doc_id, class_id (the smallest id with the same set). ``pairs``: class_a <
    class_b, similarity, of all classes at ``threshold`` or more.

    Equal sets become one class first. A class then offers its rarest signatures, as many as a similar set
    can't miss all of, in its length partition and the next; only classes that meet there are compared."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), signatures(docs[text_col]).alias("set")).withColumn("fp", digest(F.col("set")))
    rows = materialize(rows, "signatures")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("class_id"), F.any_value("set").alias("set")), "classes")
    members = rows.select("doc_id", "fp").join(classes.select("fp", "class_id"), "fp").select("doc_id", "class_id")
    each = classes.select("class_id", F.size("set").alias("n"), F.explode("set").alias("sig"))
    rarity = each.groupBy("sig").agg(F.count("*").alias("df"))
    kept = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    nth = F.row_number().over(Window.partitionBy("class_id").orderBy("df", "sig"))
    prefix = each.join(rarity, "sig").withColumn("nth", nth).where(F.col("nth") <= kept).select("class_id", "n", "sig").withColumn("part", length_partition(F.col("n"), threshold))
    right = prefix.select(F.col("class_id").alias("b"), F.col("n").alias("m"), "sig", F.explode(F.array("part", F.col("part") - 1)).alias("part"))
    bound = (F.least("n", "m") >= F.lit(threshold) * F.greatest("n", "m")) & ((F.col("n") < F.col("m")) | (F.col("n") == F.col("m")) & (F.col("class_id") < F.col("b")))
    met = prefix.withColumnRenamed("class_id", "a").withColumn("class_id", F.col("a")).join(right, ["sig", "part"]).where(bound).select("a", "b").distinct()
    sets = classes.select(F.col("class_id"), "set")
    both = met.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    pairs = both.withColumn("similarity", likeness(F.col("set_a"), F.col("set_b"), threshold)).where(F.col("similarity") >= threshold - 1e-9)
    return pairs.select(F.least("a", "b").alias("class_a"), F.greatest("a", "b").alias("class_b"), "similarity"), members
