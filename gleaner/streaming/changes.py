"""Change events: a burst is over once nothing changed for a while; then the locations it touched are scanned."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleaner.operators.incremental import affected_locations

QUIET = "2 seconds"


def relevant(events: DataFrame) -> DataFrame:
    """All but reads."""
    return events.where(F.coalesce(F.col("event_kind") != "access", F.lit(True)))


def sessions(events: DataFrame, gap: str = QUIET, ts_col: str = "ts", span: int = 3600) -> DataFrame:
    """(start, last, changes): bursts of a batch of events, over all locations; events at most a gap apart are one burst.

    Each ``span`` seconds of time find their own bursts, so the events are spread over tasks. Only bursts that begin or end within a
    gap of a span's border, two a span at most, may go on in the next: those alone are stitched in order."""
    micros = F.unix_micros(F.col(ts_col).cast("timestamp"))
    timed = events.where(F.col(ts_col).isNotNull()).select(F.col(ts_col).alias("ts"), F.floor(micros / (span * 1_000_000)).alias("span"))
    own = timed.groupBy("span", F.session_window("ts", gap)).agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("changes"))
    quiet, border = F.expr(f"INTERVAL {gap}"), lambda k: F.timestamp_micros(k * (span * 1_000_000))
    inner = (F.col("start") > border(F.col("span")) + quiet) & (F.col("last") < border(F.col("span") + 1) - quiet)
    own = own.select("start", "last", "changes", inner.alias("inner"))
    order = Window.orderBy("start")
    edge = own.where("NOT inner").withColumn("new", F.coalesce((F.col("start") > F.lag("last").over(order) + quiet).cast("int"), F.lit(1)))
    edge = edge.withColumn("burst", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    stitched = edge.groupBy("burst").agg(F.min("start").alias("start"), F.max("last").alias("last"), F.sum("changes").alias("changes")).drop("burst")
    return own.where("inner").select("start", "last", "changes").unionByName(stitched)


def stream_sessions(events: DataFrame, gap: str = QUIET, late: str = "10 seconds", ts_col: str = "ts", key_col: str = "location") -> DataFrame:
    """The same on a stream, by event time and key: a burst closes once the watermark passes it."""
    keyed = events if key_col in events.columns else events.withColumn(key_col, F.lit(0))
    return keyed.withWatermark(ts_col, late).groupBy(F.session_window(ts_col, gap).alias("w"), key_col).agg(F.count("*").alias("changes")).select(key_col, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "changes")


def _until_quiet(quiet_ms: int):
    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            ids, paths, changes = state.get
            state.remove()
            yield pd.DataFrame({"id": list(ids), "path": list(paths), "changes": list(changes)})
            return
        held = {i: [p, n] for i, p, n in zip(*state.get)} if state.exists else {}
        for batch in batches:
            for i, p, n in zip(batch["id"].tolist(), batch["path"].tolist(), batch["changes"].tolist()):
                held.setdefault(i, [p, 0])[1] += n
        state.update((list(held), [p for p, _ in held.values()], [n for _, n in held.values()]))
        state.setTimeoutDuration(quiet_ms)

    return run


def touched(events: DataFrame, locations: DataFrame) -> DataFrame:
    """(id, path, changes) a changed path and the location that holds it, not grouped: on a stream, of each micro-batch."""
    roots = locations.select("id", F.col("path").alias("location_path"), F.regexp_replace("path", r"(?<=.)/+$", "").alias("root"))
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    up = relevant(events).select(F.explode(F.array_distinct(F.transform(ancestors, lambda a: F.when(a == "", "/").otherwise(a)))).alias("root"))
    return up.join(roots, "root").select(F.col("id").cast("long").alias("id"), F.col("location_path").alias("path"), F.lit(1).cast("long").alias("changes"))


def quiet_bursts(events: DataFrame, locations: DataFrame, quiet_ms: int = 2000) -> DataFrame:
    """A stream of the locations that each burst of changes touched, all at once when nothing changed anywhere for
    ``quiet_ms`` of the wall clock, however long the burst; so the last burst needs no later event.

    One state for all locations, as a burst is over all of them: a row a touched location, never a row a change."""
    everything = touched(events, locations).withColumn("burst", F.lit(0)).groupBy("burst")
    return everything.applyInPandasWithState(_until_quiet(quiet_ms), "id long, path string, changes long", "ids array<long>, paths array<string>, changes array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def watch(events: DataFrame, locations: Callable[[], DataFrame], scan: Callable[[int, str], None], quiet_ms: int = 2000, checkpoint: str | None = None, once: bool = False) -> StreamingQuery:
    """Scans each touched location once after each burst. ``locations`` are those at the start of the stream.
    ``once`` handles what is there as one burst and ends: the catch-up of a program that does not stay."""

    def handle(batch: DataFrame, _: int) -> None:
        for row in (affected_locations(batch, locations()) if once else batch).collect():  # at most the locations, a short list
            scan(row.id, row.path)

    bursts = relevant(events) if once else quiet_bursts(events, locations(), quiet_ms)
    writer = bursts.writeStream.foreachBatch(handle)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    # Whether a burst is over is looked at a few times in each quiet time.
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{max(1, quiet_ms // 4)} milliseconds")).start()
