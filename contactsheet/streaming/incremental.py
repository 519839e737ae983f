"""Structured Streaming: windows over an event stream with late data, segments kept current, listings folded into a log of files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from contactsheet.operators.maintenance import snapshot_diff
from contactsheet.params import GAP_HOURS


def activity(events: DataFrame, *, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Counts and sums by type and tumbling window; rows later than ``late`` are dropped and state is let go."""
    ts = F.col("ts").cast("timestamp")
    rows = events.select("event_type", "value", ts.alias("at")).withWatermark("at", late)
    out = rows.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, *, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Sessions by user: rows at most ``gap`` apart. The same on a batch and on a stream."""
    rows = events.select("user_id", F.col("ts").cast("timestamp").alias("at")).withWatermark("at", late)
    out = rows.groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def stream_of(spark: SparkSession, path: str, schema: StructType, *, files: int = 1) -> DataFrame:
    """The Parquet files of a folder as a stream, ``files`` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def latest(spark: SparkSession, table: str, schema: str, keys: list[str], before: int | None = None) -> DataFrame:
    """The rows in force of a log that a stream keeps below ``table``: of each key the row of its last batch (earlier than
    ``before``, if given). Batches are folders ``table/batch=N`` of changed rows."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(table) if _exists(spark, table) else spark.createDataFrame([], f"{schema}, batch long")
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    names = [c for c in rows.columns if c != "batch"]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in names if c not in keys]), "batch").alias("__last"))
    return last.select(*keys, "__last.*").select(*names)


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


_FILES = "root_id int, rel_path string, size long, mtime double, status string"


def listed_files(spark: SparkSession, table: str) -> DataFrame:
    """(root_id, rel_path, size, mtime, status): the files that ``fold_listings`` has in force."""
    return latest(spark, table, _FILES, ["root_id", "rel_path"])


def fold_listings(listings: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Runs every new listing through the snapshot difference and writes what it changes.

    ``listings`` streams (root_id, rel_path, size, mtime). A batch writes its new and changed files to ``table/batch=N`` and
    nothing else; ``listed_files`` reads the last state of each. A retried batch writes its own folder again, so the result
    is the same as without the failure. A batch is a part of a tree and tells nothing missing.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("root_id", "rel_path", "size", "mtime").groupBy("root_id", "rel_path").agg(F.max_by("size", "mtime").alias("size"), F.max("mtime").alias("mtime"))
        known = latest(spark, table, _FILES, ["root_id", "rel_path"], epoch).join(rows.select("root_id", "rel_path"), ["root_id", "rel_path"], "left_semi")
        changed = snapshot_diff(known, rows, complete=False).where(F.col("change") != "unchanged").select("root_id", "rel_path")
        fresh = rows.join(changed, ["root_id", "rel_path"], "left_semi").withColumn("status", F.lit("ok"))
        fresh.write.mode("overwrite").parquet(f"{table}/batch={epoch}")

    return listings.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_SEGMENT = "key string, start double, end double, n long, there boolean"


def _merged(parts: list[tuple[float, float, int]], gap: float) -> list[tuple[float, float, int]]:
    """Ranges of time (start, end, rows) with those at most ``gap`` seconds apart put together."""
    out: list[tuple[float, float, int]] = []
    for start, end, n in sorted(parts):
        if out and start - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(out[-1][1], end), out[-1][2] + n)
        else:
            out.append((start, end, n))
    return out


def segment_changes(photos: DataFrame, *, gap: float = GAP_HOURS * 3600, late: str = "30 days") -> DataFrame:
    """(key, start, end, n, there): how a stream of photos changes the segments of each key (a device, a user).

    ``photos`` streams (key string, ts timestamp). A key's state is the ranges of its segments that a photo may still reach: a
    new photo widens one, begins one, or joins two, and only these are told: with ``there`` a segment as it is now, without
    it one that began at ``start`` and is no more. In whatever order photos come, what is in force in the end is what all
    of them give at once. A timer lets go of ranges that the watermark (``late``) has passed by; later photos are dropped.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in zip(*state.get, strict=True)] if state.exists else []
        passed = state.getCurrentWatermarkMs() / 1000 - gap
        if state.hasTimedOut:
            now = [r for r in held if r[1] >= passed]
        else:
            new = [(float(t), float(t), 1) for frame in frames for t in frame["seconds"]]
            now = _merged(held + new, gap)
            gone = {r[0] for r in held} - {r[0] for r in now}
            known = set(held)
            changed = [(key[0], s, e, n, True) for s, e, n in now if (s, e, n) not in known] + [(key[0], s, None, None, False) for s in sorted(gone)]
            yield pd.DataFrame(changed, columns=["key", "start", "end", "n", "there"]).astype({"n": "Int64", "end": "float64", "there": "bool"})
        if not now:
            state.remove()
            return
        state.update(tuple(map(list, zip(*now, strict=True))))
        state.setTimeoutTimestamp(max(int((min(r[1] for r in now) + gap) * 1000) + 1, state.getCurrentWatermarkMs() + 1))

    rows = photos.where(F.col("ts").isNotNull()).select("key", F.col("ts").alias("at"), (F.unix_micros("ts") / 1e6).alias("seconds")).withWatermark("at", late)
    return rows.groupBy("key").applyInPandasWithState(fold, _SEGMENT, "starts array<double>, ends array<double>, counts array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def fold_segments(changes: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch of ``segment_changes`` to ``table/batch=N``; ``segments_in_force`` reads what holds."""

    def step(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={epoch}")

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def segments_in_force(spark: SparkSession, table: str) -> DataFrame:
    """(key, start, end, n): the segments that the changes written so far leave."""
    return latest(spark, table, _SEGMENT, ["key", "start"]).where("there").drop("there")
