"""Places in a global order without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.sources.scratch import written


def with_place(rows: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """``rows`` with each row's place (from 1) in the order. Rows are range-partitioned and numbered within partitions;
    the partitions' sizes, a row each, say how far the earlier ones count. Equal keys share a partition, in any order."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # Number of the partition in the upper bits, of the row in the lower 33.
    numbered = written(sorted_rows.withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part, at = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r.part, r["count"]) for r in numbered.groupBy(part.alias("part")).count().collect())  # as many as partitions
    before, total = [], 0
    for p, count in sizes:
        before.append((p, total))
        total += count
    offsets = rows.sparkSession.createDataFrame(before, "__part long, __before long")
    placed = numbered.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return placed.withColumn(name, F.col("__before") + at + 1).drop("__at", "__part", "__before")
