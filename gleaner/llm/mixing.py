"""Mixing sources to target weights, in DataFrame expressions only.

Size: the words (separated by ASCII white space) of a text. Sources in code-point order, null last,
weigh 1, 2, 3, repeating, and share the total size; a target stops at ``most`` times its source's
size, and the excess is shared anew by weight. That is water filling: target = min(cap, level *
weight), and the level follows from running sums over the sources sorted by cap / weight.

A source's documents lie in a seeded random order: by a hash, cut into ``2**block_bits`` blocks (more
where the largest source would otherwise have more than ``BLOCK_DOCS`` documents in one) of which the exact
sizes are counted. Taking a source to its target means whole epochs of its blocks, a run of whole blocks
more, and of the few blocks at the border the documents that still fit, so some thousands of documents of
a source are ordered, whatever its size; the other windows run over blocks.

Blocks drawn are dealt to ``shards`` output shards by a splitting tree: a node halves its shards, and
how many blocks of each source go left is one multivariate hypergeometric draw, made source after
source as hypergeometric draws by inversion (quotas and pmf ratios are exact; one row holds a node's
quotas, of length the number of sources). Each shard then takes the next blocks of each source's
permuted order, so draws are disjoint, and orders its documents by a hash of their own.

Nulls: a null text has size 0, a null source is a source, a null id is a document. Rows that repeat an
id are documents of their own (they share a place in the order; ties go by a hash of the row). Sources of
size 0 have target 0. Texts are counted where they are read, however long, and an empty table gives an
empty mix. Draws depend on seed and rows alone, so reruns agree. Extra columns are kept only by ``mixed``,
whatever their names (but ``__mix_*``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Documents of a block, about, in the largest source.
BLOCK_DOCS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """doc_id, source, row (a hash of all columns), size and the place (a hash, as a non-negative long) in the source's order."""
    row = F.xxhash64(*[docs[c] for c in docs.columns])
    rows = docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), row.alias("row"), F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    return rows.withColumn("place", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")), 1))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size, source_docs, weight, target (double). One row a source; the windows run over these rows."""
    source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(nth - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = source.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("weight").over(rest)
    rows = rows.withColumn("level", F.when(level <= F.col("cap") / F.col("weight"), level))
    rows = rows.withColumn("level", F.first("level", ignorenulls=True).over(everything))
    return rows.select("source", "source_size", "source_docs", "weight", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def hypergeometric(uniform: Column, good: Column, bad: Column, drawn: Column) -> Column:
    """A hypergeometric draw by inversion: of ``drawn`` from ``good + bad``, how many are good. Weights follow from
    the ratio of neighbouring probabilities, as logarithms, so no factorial is needed."""
    lo, hi = F.greatest(F.lit(0).cast("long"), drawn - bad), F.least(good, drawn)

    def draw(x):
        step = lambda k: F.log((x.good - k) * (x.drawn - k)) - F.log((k + 1.0) * (x.bad - x.drawn + k + 1))
        # Log weights of lo..hi, and their sum by way of the largest.
        start = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("top"), F.lit(1.0).alias("sum"))

        def add(a, k):
            log = a["log"] + step(k)
            top = F.greatest(a.top, log)
            return F.struct(log.alias("log"), top.alias("top"), (a["sum"] * F.exp(a.top - top) + F.exp(log - top)).alias("sum"))

        total = F.when(x.hi > x.lo, F.aggregate(F.sequence(x.lo, F.greatest(x.lo, x.hi - 1)), start, add)).otherwise(start)
        begun = F.struct(x.lo.alias("at"), F.lit(0.0).alias("log"), F.exp(-x.total.top).alias("below"))

        def walk(a, k):
            more = a.below < x.uniform * x.total["sum"]
            log = a["log"] + step(k)
            return F.when(more, F.struct((k + 1).alias("at"), log.alias("log"), (a.below + F.exp(log - x.total.top)).alias("below"))).otherwise(a)

        return total, begun, walk

    base = F.struct(uniform.alias("uniform"), good.alias("good"), bad.alias("bad"), drawn.alias("drawn"), lo.alias("lo"), hi.alias("hi"))
    bind = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731  a lambda's argument is computed once

    def found(x):
        total = draw(x)[0]
        whole = F.struct(*[x[n].alias(n) for n in ("uniform", "good", "bad", "drawn", "lo", "hi")], total.alias("total"))

        def last(y):
            _, begun, walk = draw(y)
            return F.when(y.hi > y.lo, F.aggregate(F.sequence(y.lo, F.greatest(y.lo, y.hi - 1)), begun, walk, lambda a: a["at"])).otherwise(y.lo)

        return bind(whole, last)

    return bind(base, found)


def split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """``quotas``: (source, quota). Returns (source, shard, first, quota): the blocks of each source that a
    shard takes are ``first .. first + quota - 1`` of its draws. One row carries a node; a level only maps."""
    rows = quotas.agg(F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("null"), "source", F.col("quota").cast("long").alias("quota")))).alias("sources"))
    node = rows.select(F.col("sources"), F.lit(0).alias("shard"), F.lit(shards).alias("width"), F.transform("sources", lambda s: F.struct(F.lit(0).cast("long").alias("first"), s.quota.alias("quota"))).alias("own"))
    levels, width = 0, 1
    while width < shards:
        levels, width = levels + 1, width * 2
    for level in range(levels):
        left = F.floor(F.col("width") / 2).cast("int")
        total = F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x.quota)
        room = F.floor(total * left / F.greatest(F.col("width"), F.lit(1))).cast("long")

        def deal(state, item):
            k = F.size(state.taken)
            uniform = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), F.col("shard"), k), 11).cast("double") / F.lit(float(1 << 53))
            got = hypergeometric(uniform, item.quota, state.others - item.quota, state.room)
            return F.element_at(F.transform(F.array(got), lambda g: F.struct((state.others - item.quota).alias("others"), (state.room - g).alias("room"), F.concat(state.taken, F.array(g)).alias("taken"))), 1)

        start = F.struct(total.alias("others"), room.alias("room"), F.array().cast("array<bigint>").alias("taken"))
        cut = node.withColumn("taken", F.aggregate("own", start, deal, lambda s: s.taken)).withColumn("left", left)
        lower = F.struct(F.col("shard"), F.col("left").alias("width"), F.zip_with("own", "taken", lambda o, t: F.struct(o["first"].alias("first"), t.alias("quota"))).alias("own"))
        upper = F.struct((F.col("shard") + F.col("left")).alias("shard"), (F.col("width") - F.col("left")).alias("width"), F.zip_with("own", "taken", lambda o, t: F.struct((o["first"] + t).alias("first"), (o.quota - t).alias("quota"))).alias("own"))
        both = cut.select("sources", F.explode(F.when(F.col("width") > 1, F.array(lower, upper)).otherwise(F.array(F.struct("shard", "width", "own")))).alias("node"))
        node = both.select("sources", "node.*")
    flat = node.select("shard", F.explode(F.arrays_zip("sources", "own")).alias("x"))
    return flat.select("x.sources.source", "shard", F.col("x.own.first").alias("first"), F.col("x.own.quota").alias("quota")).where("quota > 0")


def mix(docs: DataFrame, shards: int = 16, seed: int = 7, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block_bits: int = 10, margin: int = 64, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of ``docs``: doc_id, source, row, size, source_size, target, copies, taken (size * copies), place
    and shards, one entry a copy."""
    sizes = materialize(sized(docs, id_col, text_col, source_col, seed), "sizes")
    goal = materialize(targets(sizes, weights, most), "targets")
    largest = goal.agg(F.max("source_docs")).first()[0] or 0
    block_bits = max(block_bits, math.ceil(math.log2(max(1, largest / BLOCK_DOCS))))
    sizes = sizes.withColumn("block", F.shiftrightunsigned("place", 63 - block_bits))
    # Exact block sizes: a row for some thousands of documents of a large source.
    counted = materialize(sizes.groupBy("source", "block").agg(F.sum("size").alias("block_size"), F.count("*").alias("block_docs")), "blocks")
    plan = goal.select(F.col("source").alias("goal_source"), "source_size", "target")
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    whole = Window.partitionBy("source")
    upto = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = counted.join(plan, F.col("source").eqNullSafe(F.col("goal_source"))).withColumn("after", F.sum("block_size").over(upto)).withColumn("docs_after", F.sum("block_docs").over(upto))
    # Of the extra epoch, whole blocks are taken up to the border, the blocks around the point where the rest is filled.
    point = F.min(F.when((F.col("rest") > 0) & (F.col("after") > F.col("rest")), F.col("docs_after") - F.col("block_docs"))).over(whole)
    cut = cut.withColumn("point", point).withColumn("border", F.coalesce((F.col("docs_after") > F.col("point") - margin) & (F.col("docs_after") - F.col("block_docs") < F.col("point") + margin), F.lit(False)))
    cut = cut.withColumn("extra", ((F.col("rest") > 0) & ~F.col("border") & (F.col("after") <= F.col("rest"))).cast("int"))
    cut = cut.withColumn("room", F.col("rest") - F.coalesce(F.max(F.when(F.col("extra") == 1, F.col("after"))).over(whole), F.lit(0)))
    cut = cut.select("source", "block", "source_size", "target", "epochs", "extra", "border", "room")
    # Draws: epoch by epoch, blocks in order. A border block counts as a draw, its documents are taken in part.
    drawn = cut.groupBy("source").agg(F.sum(F.col("epochs") + F.col("extra") + F.col("border").cast("int")).alias("quota"))
    dealt = materialize(split_tree(drawn, shards, seed), "quotas")
    rank = F.row_number().over(Window.partitionBy("source").orderBy("epoch", "block")) - 1
    draws = cut.withColumn("epoch", F.explode(F.when(F.col("epochs") + F.col("extra") + F.col("border").cast("int") > 0, F.sequence(F.lit(0).cast("long"), F.col("epochs") + F.col("extra") + F.col("border").cast("int") - 1)))).withColumn("draw", rank)
    lots = dealt.groupBy(F.col("source").alias("lot_source")).agg(F.collect_list(F.struct("first", "quota", "shard")).alias("lots"))
    at = F.filter("lots", lambda x: (x["first"] <= F.col("draw")) & (F.col("draw") < x["first"] + x["quota"]))
    homes = draws.join(lots, F.col("source").eqNullSafe(F.col("lot_source"))).groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("epoch", F.element_at(at, 1)["shard"].alias("shard")))).alias("homes"))
    table = materialize(cut.join(homes.select(F.col("source").alias("home_source"), F.col("block").alias("home_block"), "homes"), F.col("source").eqNullSafe(F.col("home_source")) & (F.col("block") == F.col("home_block")), "left").drop("home_source", "home_block"), "plan")
    table = table.select(F.col("source").alias("plan_source"), F.col("block").alias("plan_block"), "source_size", "target", "epochs", "extra", "border", "room", "homes")
    joined = sizes.join(table, F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("block") == F.col("plan_block")))
    inner, edge = joined.where("NOT border").withColumn("fits", F.col("extra")), joined.where("border")
    # The border's documents go by their order while they fit; then the largest that still fits is added, until none fits.
    border = Window.partitionBy("plan_source")
    filled = border.orderBy("place", F.col("doc_id").asc_nulls_last(), "size", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("upto", F.sum("size").over(filled)).withColumn("fits", (F.col("upto") <= F.col("room")).cast("int"))
    edge = edge.withColumn("left", F.col("room") - F.coalesce(F.max(F.when(F.col("fits") == 1, F.col("upto"))).over(border), F.lit(0)))
    # One pass by falling size: what is skipped doesn't fit later either, so in the end nothing more fits.
    wanted = (F.col("fits") == 0) & (F.col("size") <= F.col("left")) & (F.col("size") > 0)
    edge = edge.withColumn("wanted", wanted).withColumn("nth", F.row_number().over(border.orderBy(F.desc("wanted"), F.desc("size"), "place", F.col("doc_id").asc_nulls_last(), "row")))
    begun = F.struct(F.col("left").cast("double").alias("left"), F.array().cast("array<int>").alias("added"))
    fill = lambda a, x: F.when(x["size"] <= a.left, F.struct((a.left - x["size"]).alias("left"), F.concat(a.added, F.array(x.nth)).alias("added"))).otherwise(a)
    asked = edge.where("wanted").groupBy(F.col("plan_source").alias("fill_source")).agg(F.max("left").alias("left"), F.sort_array(F.collect_list(F.struct("nth", "size"))).alias("sizes"))
    added = asked.select("fill_source", F.aggregate("sizes", begun, fill, lambda a: a.added).alias("added"))
    edge = edge.join(added, F.col("plan_source").eqNullSafe(F.col("fill_source")), "left").withColumn("fits", F.when(F.coalesce(F.array_contains("added", F.col("nth")), F.lit(False)), 1).otherwise(F.col("fits")))
    edge = edge.select(inner.columns)
    copies = F.col("epochs") + F.col("fits")
    return inner.unionByName(edge).select("doc_id", "source", "row", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "place", F.transform(F.slice(F.coalesce("homes", F.array().cast("array<struct<epoch:bigint,shard:int>>")), F.lit(1), copies.cast("int")), lambda h: h.shard).alias("shards"))


def mixed(docs: DataFrame, shards: int = 16, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **more) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, shard by shard and shuffled within. Rows
    that are alike in every column are one row, taken as often as all of them."""
    plan = mix(docs, shards, seed, id_col=id_col, text_col=text_col, source_col=source_col, **more)
    taken = plan.where("copies > 0").select(F.col("row").alias("__mix_row"), F.col("place").alias("__mix_place"), F.explode("shards").alias("__mix_shard"))
    taken = taken.groupBy("__mix_row", "__mix_shard").agg(F.min("__mix_place").alias("__mix_place"), F.count("*").cast("int").alias("__mix_n"))
    # One row of each, chosen before the shuffle by the same key that then meets the plan.
    once = Window.partitionBy("__mix_row").orderBy(F.lit(0))
    rows = docs.withColumn("__mix_row", F.xxhash64(*[docs[c] for c in docs.columns])).withColumn("__mix_nth", F.row_number().over(once)).where("__mix_nth = 1")
    rows = rows.join(taken, "__mix_row").withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_n"))))
    order = F.xxhash64(F.lit(seed), "__mix_shard", "__mix_place", "__mix_row")
    return rows.repartition(shards, "__mix_shard").sortWithinPartitions("__mix_shard", order).select(*docs.columns)
