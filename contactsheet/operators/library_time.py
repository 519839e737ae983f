"""Scans over a whole library in the order of time, without a key to part it.

The rows are put in order by ranges of time, so that each task has a slice of it; what a row needs of the one before is
found inside its slice, and a table of one row a slice carries the last state of each slice over to the next. So runs,
segments and as-of values take as many tasks as there are slices, whatever the keys of the rows.

The event rule keeps more state than that: whether a segment is full, and what was merged so far. Both are decided on
small tables: days of a run, and segments, of which there are at most three an hour. Segments more than 20 hours apart
are never merged, so what lies between two such gaps is folded on its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contactsheet.functions.geo import haversine_km
from contactsheet.operators.events import _first_most, _Part, _plain
from contactsheet.params import ASOF_SECONDS, GAP_HOURS, MAX_EVENT_PHOTOS, MIN_GAP_MINUTES, MULTIDAY_HOURS, OVERNIGHT_HOURS, SAME_DAY_HOURS, TRAVEL_GAP_MINUTES, TRAVEL_KM, TRIP_DAYS, TRIP_GAP_DAYS, TRIP_KM
from contactsheet.storage import materialise

SLICE = "__slice"


def in_slices(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with the number of its slice of the order, written once, each slice in order."""
    return materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(SLICE, F.spark_partition_id()), "slices")


def numbered_runs(rows: DataFrame, order: list[str], splits: Callable[[Callable[[str], Column]], Column], carried: list[str], *, run: str = "run") -> DataFrame:
    """``rows``, written once, with ``run``, counted from 0 over the whole order: a new one begins where ``splits`` holds
    (a null does not). It is given a function from a column's name to its value in the row before; ``carried`` names the
    columns it reads, of either row. ``order`` must tell all rows apart; its columns are not null."""
    sliced = in_slices(rows, order)
    own = Window.partitionBy(SLICE).orderBy(*order)
    state, at = F.struct(*carried), F.struct(*order)
    local = sliced.withColumn("__before", F.lag(state).over(own))
    split = F.when(F.col("__before").isNotNull() & F.coalesce(splits(lambda c: F.col(f"__before.{c}")), F.lit(False)), 1).otherwise(0)
    local = materialise(local.withColumn("__run", F.sum(split).over(own).cast("long")).drop("__before"), "slice-runs")
    ends = local.groupBy(SLICE).agg(F.min_by(state, at).alias("__first"), F.max_by(state, at).alias("__last"), F.max("__run").alias("__runs"))
    # One row a slice, of which there are as many as partitions of a shuffle.
    by_slice = Window.partitionBy(F.lit(0)).orderBy(SLICE)
    ends = ends.select(SLICE, "__runs", F.lag("__last").over(by_slice).alias("__before"), "__first.*")
    ends = ends.withColumn("__split", F.when(F.col("__before").isNotNull() & F.coalesce(splits(lambda c: F.col(f"__before.{c}")), F.lit(False)), 1).otherwise(0))
    earlier = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select(SLICE, (F.coalesce(F.sum("__runs").over(earlier), F.lit(0)) + F.sum("__split").over(by_slice.rowsBetween(Window.unboundedPreceding, 0))).alias("__offset"))
    numbered = local.join(F.broadcast(offsets), SLICE)  # a row a slice
    return numbered.withColumn(run, (F.col("__run") + F.col("__offset")).cast("long")).drop(SLICE, "__run", "__offset")


def inherit_nearest(rows: DataFrame, order: list[str], value: str, *, within: float = ASOF_SECONDS) -> DataFrame:
    """J8 over the whole library: rows without ``value`` take it from the last row before that has one, else from the first
    after, within ``within`` of the first column of ``order``: ``rows`` with ``inherited``."""
    ts = order[0]
    sliced = in_slices(rows, order)
    anchor = F.when(F.col(value).isNotNull(), F.struct(F.col(ts).alias("t"), F.col(value).alias("v")))
    at = F.struct(*order)
    ends = sliced.groupBy(SLICE).agg(F.max_by(anchor, F.when(anchor.isNotNull(), at)).alias("__last"), F.min_by(anchor, F.when(anchor.isNotNull(), at)).alias("__first"))
    by_slice = Window.partitionBy(F.lit(0)).orderBy(SLICE)  # one row a slice
    before, after = by_slice.rowsBetween(Window.unboundedPreceding, -1), by_slice.rowsBetween(1, Window.unboundedFollowing)
    ends = ends.select(SLICE, F.last("__last", ignorenulls=True).over(before).alias("__into"), F.first("__first", ignorenulls=True).over(after).alias("__from"))
    own = Window.partitionBy(SLICE)
    back = own.orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    found = sliced.join(F.broadcast(ends), SLICE)  # a row a slice
    found = found.withColumn("__b", F.coalesce(F.last(anchor, ignorenulls=True).over(own.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.col("__into")))
    found = found.withColumn("__a", F.coalesce(F.last(anchor, ignorenulls=True).over(back), F.col("__from")))
    fits = lambda c: F.when(F.abs(F.col(ts) - F.col(f"{c}.t")) <= within, F.col(f"{c}.v"))
    return found.withColumn("inherited", F.coalesce(F.col(value), fits("__b"), fits("__a"))).drop(SLICE, "__into", "__from", "__b", "__a")


def _hard_segments(rows: DataFrame, tie: str, gap_hours: float) -> DataFrame:
    """Rows with ``hard``: a new one after a gap of more than ``gap_hours``, or after 45 minutes and 30 km."""

    def splits(before: Callable[[str], Column]) -> Column:
        gap = F.col("taken_ts") - before("taken_ts")
        far = (gap >= TRAVEL_GAP_MINUTES * 60) & (haversine_km(before("lat"), before("lon"), F.col("lat"), F.col("lon")) >= TRAVEL_KM)
        return ((gap > gap_hours * 3600) | F.coalesce(far, F.lit(False))) & (gap >= MIN_GAP_MINUTES * 60)

    return numbered_runs(rows, ["taken_ts", tie], splits, ["taken_ts", "lat", "lon"], run="hard")


def _full_days(days: DataFrame, cap: int) -> DataFrame:
    """(hard, day, sub): the days on which a run that was full begins a further segment. ``days`` (hard, day, n)."""
    large = days.groupBy("hard").agg(F.sum("n").alias("total"), F.count("*").alias("of")).where((F.col("total") > cap) & (F.col("of") > 1)).select("hard")

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        size, sub, out = 0, 0, []
        for hard, day, n in frame.sort_values("day").itertuples(index=False, name=None):  # a run's days
            if size >= cap:
                size, sub = 0, sub + 1
            size += n
            out.append((hard, day, sub))
        return pd.DataFrame(out, columns=["hard", "day", "sub"])

    return days.join(large, "hard", "left_semi").select("hard", "day", "n").groupBy("hard").applyInPandas(fold, "hard long, day long, sub long").where("sub > 0")


def segments(rows: DataFrame, tie: str = "id", *, cap: int = MAX_EVENT_PHOTOS, gap_hours: float = GAP_HOURS) -> DataFrame:
    """W1 over the whole library: ``rows`` with ``hard`` and ``sub``, which name a segment: it ends after a gap of more than
    ``gap_hours``, after 45 minutes and 30 km, or, with ``cap`` rows, at the end of the day (of UTC); never within 20
    minutes, but for the cap. ``rows`` (tie, taken_ts, lat, lon, ...); those without a date take no part."""
    dated = rows.where(F.col("taken_ts").isNotNull())
    hard = materialise(_hard_segments(dated, tie, gap_hours).withColumn("day", F.floor(F.col("taken_ts") / 86400).cast("long")), "hard-segments")
    full = materialise(_full_days(hard.groupBy("hard", "day").agg(F.count("*").alias("n")), cap), "full-days")
    return hard.join(full, ["hard", "day"], "left").withColumn("sub", F.coalesce("sub", F.lit(0)).cast("long")).drop("day")


def _facts(parts: DataFrame, tie: str) -> DataFrame:
    """(hard, sub, first, start, end, size, first_at, last_at, place_id, folder, cities): what the fold needs of a
    segment; ``place_id`` and ``folder`` list (first, v, n) of its distinct places and folders."""
    at, key = F.struct("taken_ts", tie), ["hard", "sub"]
    located = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), at)
    most = lambda what: parts.where(F.col(what).isNotNull() & (F.col(what).cast("string") != "")).groupBy(*key, what).agg(F.count("*").alias("n"), F.min(at).alias("first")).groupBy(*key).agg(F.collect_list(F.struct(F.col("first.taken_ts").alias("t"), F.col(f"first.{tie}").alias("i"), F.col(what).alias("v"), "n")).alias(what))  # noqa: E731 - one entry for each place or folder of a segment
    facts = parts.groupBy(*key).agg(
        F.min_by(tie, at).alias("first"), F.min("taken_ts").alias("start"), F.max("taken_ts").alias("end"), F.count("*").alias("size"),
        F.min_by(F.struct("lat", "lon"), located).alias("first_at"), F.max_by(F.struct("lat", "lon"), located).alias("last_at"),
    )
    cities = parts.where(F.col("place_id").isNotNull()).groupBy(*key, "place_id").agg(F.first("city").alias("city")).groupBy(*key).agg(F.collect_list(F.struct("place_id", F.coalesce("city", F.lit("")).alias("city"))).alias("cities"))
    return facts.join(most("place_id"), key, "left").join(most("folder"), key, "left").join(cities, key, "left")


def _merged(now: list[_Part], starts: list[tuple], joins: Callable[[_Part, _Part], bool]) -> tuple[list[_Part], list]:
    """Neighbouring parts merged while ``joins`` holds of what was merged so far and the next; and for each of the parts
    given the name of the first that its result began with."""
    out: list[_Part] = []
    names: list = []
    for part, name in zip(now, starts, strict=True):
        if out and joins(out[-1], part):
            out[-1].absorb(part)
            names.append(names[-1])
        else:
            out.append(part)
            names.append(name)
    return out, names


def event_names(rows: DataFrame, tie: str = "id", *, cap: int = MAX_EVENT_PHOTOS, gap_hours: float = GAP_HOURS) -> DataFrame:
    """W1, W2, W3 over the whole library as one sequence: (tie, segment, session, event), each named by its first row.

    The rules are those of ``events.event_numbers``, which walks the rows of a key one by one. ``rows`` (tie, taken_ts,
    place_id, city, folder, lat, lon); ids tell all rows apart; rows without a date take no part; null places, folders and
    positions are unknown. An empty table gives an empty table.
    """
    parts = materialise(segments(rows.select(tie, "taken_ts", "place_id", "city", "folder", "lat", "lon"), tie, cap=cap, gap_hours=gap_hours), "segments")
    facts = materialise(_facts(parts, tie), "segment-facts")
    far = lambda before: F.col("start") - before("end") > MULTIDAY_HOURS * 3600
    chunks = numbered_runs(facts, ["start", "hard", "sub"], far, ["start", "end"], run="chunk")
    kind = rows.schema[tie].dataType.simpleString()

    def near(a: _Part, b: _Part) -> bool:
        gap = (b.start - a.end) / 3600
        return (a.end // 86400 == b.start // 86400 or gap <= OVERNIGHT_HOURS) and gap <= SAME_DAY_HOURS and a.same_place(b) and a.size + b.size <= 2 * cap

    def goes_on(a: _Part, b: _Part) -> bool:
        return (b.start - a.end) / 3600 <= MULTIDAY_HOURS and a.same_place(b) and a.size + b.size <= 2 * cap and bool(a.folders) and _first_most(a.folders) == _first_most(b.folders)

    def part_of(r) -> _Part:
        counts = lambda entries: {e["v"]: e["n"] for e in sorted(entries, key=lambda e: (e["t"], e["i"]))} if entries is not None else {}
        point = lambda p: None if p is None else (p["lat"], p["lon"])
        cities = {c["place_id"]: c["city"] for c in r.cities} if r.cities is not None else {}
        return _Part(r.start, r.end, 0, r.size, counts(r.place_id), counts(r.folder), cities, point(_plain(r.first_at)), point(_plain(r.last_at)))

    def closed(held: list) -> pd.DataFrame:
        parts, names = [part_of(r) for r in held], [r.first for r in held]
        sessions, session_of = _merged(parts, names, near)
        heads = list(dict.fromkeys(session_of))
        _, event_of = _merged(sessions, heads, goes_on)
        event = dict(zip(heads, event_of, strict=True))
        return pd.DataFrame({"hard": [r.hard for r in held], "sub": [r.sub for r in held], "segment": names, "session": session_of, "event": [event[s] for s in session_of]})

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for frame in frames:
            for r in frame.itertuples(index=False):
                if held and r.chunk != now:
                    yield closed(held)
                    held = []
                now = r.chunk
                held.append(r)
        if held:
            yield closed(held)

    ordered = chunks.repartition("chunk").sortWithinPartitions("chunk", "start", "hard", "sub")
    named = materialise(ordered.mapInPandas(fold, f"hard long, sub long, segment {kind}, session {kind}, event {kind}"), "event-names")
    return parts.select(tie, "hard", "sub").join(named, ["hard", "sub"]).select(tie, "segment", "session", "event")


def event_rows(named: DataFrame, rows: DataFrame, tie: str = "id") -> DataFrame:
    """(event, photos, start_ts, end_ts, place_id, lat, lon) of ``event_names``: an event's size, span, most frequent
    place (the one met first of several) and median position."""
    joined = named.select(tie, "event").join(rows.select(tie, "taken_ts", "place_id", "lat", "lon"), tie)
    by_place = joined.where(F.col("place_id").isNotNull()).groupBy("event", "place_id").agg(F.count("*").alias("n"), F.min(F.struct("taken_ts", tie)).alias("first"))
    top = by_place.groupBy("event").agg(F.min_by("place_id", F.struct(-F.col("n"), F.col("first"))).alias("place_id"))
    facts = joined.groupBy("event").agg(F.count("*").alias("photos"), F.min("taken_ts").alias("start_ts"), F.max("taken_ts").alias("end_ts"), F.round(F.median("lat"), 6).alias("lat"), F.round(F.median("lon"), 6).alias("lon"))
    return facts.join(top, "event", "left").select("event", "photos", "start_ts", "end_ts", "place_id", "lat", "lon")


def trips(events: DataFrame, tie: str, home: Column) -> DataFrame:
    """A13 over the whole library: (trip, start_ts, end_ts, events, photos, place_id, cover): runs of consecutive away events
    (``away_km`` at least 60), at most two days apart, that last three quarters of a day or hold two events.

    ``trip`` is the first event's id, ``place_id`` the place of the most events (of several the first), ``cover`` the cover
    of the event of the most photos (of several the first). ``events`` (tie, start_ts, end_ts, away_km, place_id, photos,
    cover); ``home`` marks an event that ends a trip."""
    marked = events.where(F.col("start_ts").isNotNull()).withColumn("away", F.coalesce((F.col("away_km") >= TRIP_KM) & ~home, F.lit(False)))
    ends = lambda before: ~(F.col("away") & before("away") & (F.col("start_ts") - before("end_ts") <= TRIP_GAP_DAYS * 86400))
    runs = materialise(numbered_runs(marked, ["start_ts", tie], ends, ["away", "start_ts", "end_ts"]).where("away"), "away-events")
    at = F.struct("start_ts", tie)
    by_place = runs.where(F.col("place_id").isNotNull()).groupBy("run", "place_id").agg(F.count("*").alias("n"), F.min(at).alias("first"))
    top = by_place.groupBy("run").agg(F.min_by("place_id", F.struct(-F.col("n"), F.col("first"))).alias("place_id"))
    found = runs.groupBy("run").agg(F.min_by(tie, at).alias("trip"), F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.count("*").alias("events"), F.sum(F.coalesce("photos", F.lit(0))).cast("long").alias("photos"), F.min_by("cover", F.struct(-F.coalesce("photos", F.lit(0)), at)).alias("cover"))
    found = found.where((F.col("end_ts") - F.col("start_ts") >= TRIP_DAYS * 86400) | (F.col("events") >= 2))
    return found.join(top, "run", "left").select("trip", "start_ts", "end_ts", "events", "photos", "place_id", "cover")
