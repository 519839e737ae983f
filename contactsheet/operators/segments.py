"""Segmentation over time, as-of joins and stateful folds.

Where the next row decides, ``lag`` and a running sum of breaks do it inside Spark's windows, by user or by device so
that no window holds everything. Where the running merged state decides, a fold runs over the few segments of a key.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contactsheet.functions.geo import haversine_km
from contactsheet.functions.vectors import dot, hamming, normalised
from contactsheet.params import ASOF_SECONDS, GAP_HOURS, LIVE_SECONDS, LIVE_SKEW, MIN_GAP_MINUTES, OVERNIGHT_HOURS, SAME_DAY_HOURS, STACK_COSINE, STACK_PHASH, TRACK_SECONDS, TRAVEL_GAP_MINUTES, TRAVEL_KM, TRIP_DAYS, TRIP_GAP_DAYS, TRIP_KM
from contactsheet.storage import materialise


def numbered_segments(rows: DataFrame, key: str, ts: str, tie: str, *, gap_hours: float = GAP_HOURS, position: tuple[str, str] | None = None) -> DataFrame:
    """``rows`` with ``segment``, counted from 0 by key: a new one after a gap of more than ``gap_hours``, or, with
    positions, after 45 minutes and 30 km; never within 20 minutes."""
    own = Window.partitionBy(key).orderBy(ts, tie)
    gap = F.col(ts) - F.lag(ts).over(own)
    split = gap > gap_hours * 3600
    if position:
        lat, lon = position
        split |= (gap >= TRAVEL_GAP_MINUTES * 60) & (haversine_km(F.lag(lat).over(own), F.lag(lon).over(own), F.col(lat), F.col(lon)) >= TRAVEL_KM)
    breaks = F.when(F.coalesce(split & (gap >= MIN_GAP_MINUTES * 60), F.lit(False)), 1).otherwise(0)
    return rows.withColumn("__break", breaks).withColumn("segment", F.sum("__break").over(own).cast("long")).drop("__break")


def segment_facts(rows: DataFrame, key: str, ts: str, what: str) -> DataFrame:
    """A segment's size, span and most frequent ``what`` (the least of several)."""
    counts = rows.groupBy(key, "segment", what).agg(F.count("*").alias("c"), F.min(ts).alias("a"), F.max(ts).alias("b"))
    return counts.groupBy(key, "segment").agg(F.sum("c").alias("n"), F.min("a").alias("start_ts"), F.max("b").alias("end_ts"), F.min_by(what, F.struct(-F.col("c"), F.col(what))).alias("top"))


def merge_sessions(segments: DataFrame, key: str, *, cap_hours: float = SAME_DAY_HOURS, overnight_hours: float = OVERNIGHT_HOURS) -> DataFrame:
    """Consecutive segments of a key become one event if they are of one day, or at most ``overnight_hours`` apart,
    at most ``cap_hours`` apart, with the same ``top``; each is compared with what was merged so far.

    (key, segment, event): the fold's state is one row, so it streams through a key's sorted segments.
    """

    def fold(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = event = end = top = None
        for frame in frames:
            out = []
            for k, segment, start, stop, what in zip(frame[key], frame["segment"], frame["start_ts"], frame["end_ts"], frame["top"], strict=True):
                if k != now and not (pd.isna(k) and pd.isna(now)) or event is None:
                    now, event, end, top = k, 0, stop, what
                else:
                    gap = (start - end) / 3600
                    near = int(end // 86400) == int(start // 86400) or gap <= overnight_hours
                    if not (near and gap <= cap_hours and what == top):
                        event, top = event + 1, what
                    end = max(end, stop)
                out.append((k, segment, event))
            yield pd.DataFrame(out, columns=[key, "segment", "event"])

    ordered = segments.select(key, "segment", "start_ts", "end_ts", "top").repartition(key).sortWithinPartitions(key, "segment")
    return ordered.mapInPandas(fold, f"`{key}` {segments.schema[key].dataType.simpleString()}, segment long, event long")


def bursts(rows: DataFrame, key: str, ts: str, tie: str, gap_seconds: float, eligible: Column, *, phash: str | None = None, vec: str | None = None) -> DataFrame:
    """Runs of two or more consecutive eligible rows at most ``gap_seconds`` apart and, where the columns are named, with
    hashes at most STACK_PHASH bits and vectors at least STACK_COSINE alike (an unknown one does not part them); an
    ineligible row ends a run. (key, burst, first, n)."""
    own = Window.partitionBy(key).orderBy(ts, tie)
    ok = F.coalesce(eligible, F.lit(False))
    joined = F.coalesce(ok & F.lag(ok).over(own) & (F.col(ts) - F.lag(ts).over(own) <= gap_seconds), F.lit(False))
    if phash is not None:
        joined &= F.coalesce(hamming(F.col(phash), F.lag(phash).over(own)) <= STACK_PHASH, F.lit(True))
    if vec is not None:
        joined &= F.coalesce(dot(normalised(F.col(vec)), normalised(F.lag(vec).over(own))) >= STACK_COSINE, F.lit(True))
    marked = rows.withColumn("__ok", ok).withColumn("__new", F.when(joined, 0).otherwise(1)).withColumn("burst", F.sum("__new").over(own).cast("long"))
    return marked.where("__ok").groupBy(key, "burst").agg(F.min_by(tie, F.struct(ts, tie)).alias("first"), F.count("*").alias("n")).where(F.col("n") >= 2)


def inherit_nearest(rows: DataFrame, key: str, ts: str, tie: str, value: str, *, within: float = ASOF_SECONDS) -> DataFrame:
    """Rows without ``value`` take it from the one before, else the one after, of the same key within ``within``
    seconds (the first that fits, not the nearer): ``rows`` with ``inherited``."""
    anchor = F.when(F.col(value).isNotNull(), F.struct(F.col(ts).alias("t"), F.col(value).alias("v")))
    latest = F.last(anchor, ignorenulls=True)  # growing frames in both directions: one pass each, whatever the key's size
    before = latest.over(Window.partitionBy(key).orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, -1))
    after = latest.over(Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(tie).desc()).rowsBetween(Window.unboundedPreceding, -1))
    found = rows.withColumn("__b", before).withColumn("__a", after)
    fits = lambda c: F.when(F.abs(F.col(ts) - F.col(f"{c}.t")) <= within, F.col(f"{c}.v"))
    return found.withColumn("inherited", F.coalesce(F.col(value), fits("__b"), fits("__a"))).drop("__b", "__a")


def interpolate(points: DataFrame, asked: DataFrame, key: str, ts: str, *, within: float = TRACK_SECONDS) -> DataFrame:
    """The position between the track points before and after each asked time, both within ``within`` seconds;
    at a track's ends the one there is. ``points`` (key, ts, x), ``asked`` (key, ts, id): (id, x), rounded to 7."""
    both = points.select(key, ts, F.col("x"), F.lit(None).cast(asked.schema["id"].dataType).alias("id")).unionAll(asked.select(key, ts, F.lit(None).cast("double").alias("x"), "id"))
    no_point = F.col("x").isNull()
    point = F.when(~no_point, F.struct(F.col(ts).alias("t"), F.col("x").alias("v")))
    latest = lambda *order: F.last(point, ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = both.withColumn("b", latest(F.col(ts), no_point)).withColumn("a", latest(F.col(ts).desc(), no_point.desc())).where(no_point)
    before, after = F.col(ts) - F.col("b.t"), F.col("a.t") - F.col(ts)
    between = F.col("b.v") + (F.col("a.v") - F.col("b.v")) * before / F.nullif(before + after, F.lit(0.0))
    value = (
        F.when((before <= within) & (after <= within), F.coalesce(between, F.col("b.v")))
        .when(F.col("b").isNull() & (after <= within), F.col("a.v"))
        .when(F.col("a").isNull() & (before <= within), F.col("b.v"))
    )
    return rows.select("id", F.round(value, 7).alias("x")).where(F.col("x").isNotNull())


def live_pairs(stills: DataFrame, films: DataFrame, *, seconds: float = LIVE_SECONDS, skew: float = LIVE_SKEW) -> DataFrame:
    """Still and film of one folder and stem, the film short and close in time where both times are known; each
    takes part once. ``stills`` (id, folder, stem, taken_ts), ``films`` (id, folder, stem, taken_ts, duration)."""
    a = stills.select(F.col("id").alias("still_id"), "folder", "stem", F.col("taken_ts").alias("a_ts"))
    b = films.where(F.col("duration") <= seconds).select(F.col("id").alias("film_id"), "folder", "stem", F.col("taken_ts").alias("b_ts"))
    close = F.col("a_ts").isNull() | F.col("b_ts").isNull() | (F.abs(F.col("a_ts") - F.col("b_ts")) <= skew)
    pairs = a.join(b, ["folder", "stem"]).where(close)
    first = pairs.withColumn("r", F.row_number().over(Window.partitionBy("film_id").orderBy("still_id"))).where("r = 1")
    return first.withColumn("r", F.row_number().over(Window.partitionBy("still_id").orderBy("film_id"))).where("r = 1").select("still_id", "film_id")


def trips(events: DataFrame, key: str, tie: str, home: Column) -> DataFrame:
    """Runs of consecutive away events (``away_km`` at least 60), at most two days apart, that last three quarters
    of a day or hold two events: (key, trip, start_ts, end_ts, events). ``home`` marks a row that ends a trip."""
    own = Window.partitionBy(key).orderBy("start_ts", "end_ts", tie)
    away = F.coalesce((F.col("away_km") >= TRIP_KM) & ~home, F.lit(False))
    goes_on = F.coalesce(away & F.lag(away).over(own) & (F.col("start_ts") - F.lag("end_ts").over(own) <= TRIP_GAP_DAYS * 86400), F.lit(False))
    marked = events.withColumn("__away", away).withColumn("__new", F.when(goes_on, 0).otherwise(1)).withColumn("trip", F.sum("__new").over(own).cast("long"))
    found = marked.where("__away").groupBy(key, "trip").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.count("*").alias("events"))
    return found.where((F.col("end_ts") - F.col("start_ts") >= TRIP_DAYS * 86400) | (F.col("events") >= 2))


def match_by_overlap(new: DataFrame, old: DataFrame, *, least: float = 0.5) -> DataFrame:
    """The old group each new group continues. New groups choose in their order, each the old one of the greatest Jaccard
    overlap of members, at least ``least``, that is still free (of several the lowest). ``new`` and ``old`` are (grp, member):
    (new_grp, old_grp, jaccard).

    All choose at once and an old group goes to the first in order; who was refused chooses anew, which may take from a
    later one what it had. It ends with what the walk in order gives, after as many rounds as groups contend."""
    n, o = new.toDF("new_grp", "member"), old.toDF("old_grp", "member")
    size_n, size_o = n.groupBy("new_grp").agg(F.count("*").alias("n_new")), o.groupBy("old_grp").agg(F.count("*").alias("n_old"))
    both = n.join(o, "member").groupBy("new_grp", "old_grp").agg(F.count("*").alias("shared")).join(size_n, "new_grp").join(size_o, "old_grp")
    rated = both.withColumn("jaccard", F.round(F.col("shared") / (F.col("n_new") + F.col("n_old") - F.col("shared")), 6)).where(F.col("jaccard") >= least)
    open_ = materialise(rated.select("new_grp", "old_grp", "jaccard"), "overlaps")
    while True:
        choice = open_.withColumn("r", F.row_number().over(Window.partitionBy("new_grp").orderBy(F.col("jaccard").desc(), "old_grp"))).where("r = 1").drop("r")
        chosen = materialise(choice.withColumn("r", F.row_number().over(Window.partitionBy("old_grp").orderBy("new_grp"))), "choices")
        refused = chosen.where("r > 1").select("new_grp", "old_grp")
        if not refused.limit(1).count():
            return chosen.select("new_grp", "old_grp", "jaccard")
        open_ = materialise(open_.join(refused, ["new_grp", "old_grp"], "left_anti"), "overlaps")


def survivors(merged: DataFrame, rounds: int = 30) -> DataFrame:
    """Whom each merged person leads to, over chains of merges, safe on cycles. ``merged`` (id, merged_into):
    (id, survivor); doubling the step each round, a chain of n needs log2(n) rounds, of which no more are planned than
    ``rounds`` and none once nothing moves."""
    now = merged.select("id", F.coalesce("merged_into", "id").alias("survivor"))
    for _ in range(rounds):
        step = now.select(F.col("id").alias("at"), F.col("survivor").alias("next"))
        after = now.join(step, F.col("survivor") == F.col("at"), "left").select("id", F.coalesce("next", "survivor").alias("survivor"), F.col("survivor").alias("was"))
        after = materialise(after, "survivors")
        moved = after.where(F.col("survivor") != F.col("was")).limit(1).count()
        now = after.select("id", "survivor")
        if not moved:
            break
    return now
