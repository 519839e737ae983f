"""Events by the whole rule: segments with a size cap, then sessions of one day and days of one place merged.

Whether a segment is full, and what was merged so far, is running state, so one fold walks the sorted rows of a key.
It holds the open event's counts only, whatever the key's size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactsheet.params import EARTH_KM, GAP_HOURS, MAX_EVENT_PHOTOS, MIN_GAP_MINUTES, MULTIDAY_HOURS, OVERNIGHT_HOURS, SAME_CITY_KM, SAME_DAY_HOURS, TRAVEL_GAP_MINUTES, TRAVEL_KM


def _km(a: tuple[float, float], b: tuple[float, float]) -> float:
    (lat1, lon1), (lat2, lon2) = np.radians(a), np.radians(b)
    h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return float(2 * EARTH_KM * np.arcsin(min(1.0, np.sqrt(h))))


def _first_most(counts: dict) -> object:
    """The most frequent key, the one met first of several."""
    return max(counts, key=counts.get) if counts else None


@dataclass
class _Part:
    """What is known of a segment, or of the segments merged so far."""

    start: float
    end: float
    number: int = 0
    size: int = 0
    places: dict = field(default_factory=dict)
    folders: dict = field(default_factory=dict)
    cities: dict = field(default_factory=dict)
    first_at: tuple[float, float] | None = None
    last_at: tuple[float, float] | None = None

    def add(self, ts: float, place, city, folder, lat, lon) -> None:
        self.end, self.size = ts, self.size + 1
        if place is not None:
            self.places[place] = self.places.get(place, 0) + 1
            self.cities[place] = city
        if folder:
            self.folders[folder] = self.folders.get(folder, 0) + 1
        if lat is not None and lon is not None:
            self.last_at = (lat, lon)
            self.first_at = self.first_at or self.last_at

    def absorb(self, other: _Part) -> None:
        self.end, self.size = other.end, self.size + other.size
        for mine, more in ((self.places, other.places), (self.folders, other.folders)):
            for k, n in more.items():
                mine[k] = mine.get(k, 0) + n
        self.cities |= other.cities
        self.first_at, self.last_at = self.first_at or other.first_at, other.last_at or self.last_at

    def same_place(self, other: _Part) -> bool:
        """Equal most frequent places or cities of them; else the positions where one ends and the other begins within
        15 km; else true if either has no place."""
        a, b = _first_most(self.places), _first_most(other.places)
        if a is not None and b is not None and (a == b or (self.cities[a] and self.cities[a] == other.cities[b])):
            return True
        if self.last_at and other.first_at:
            return _km(self.last_at, other.first_at) < SAME_CITY_KM
        return a is None or b is None


def _plain(x):
    return None if x is None or (isinstance(x, float) and np.isnan(x)) or x is pd.NA else x


def event_numbers(rows: DataFrame, key: str, tie: str, *, cap: int = MAX_EVENT_PHOTOS, gap_hours: float = GAP_HOURS) -> DataFrame:
    """(key, tie, segment, session, event), numbers from 0 by key, for every dated row.

    Segments end after a gap of more than ``gap_hours``, after 45 minutes and 30 km, or, with ``cap`` rows, at the end of
    the day; never within 20 minutes, but for the cap. Consecutive segments of one day, or at most 6 hours apart, at most
    10 hours apart, at the same place and together at most twice ``cap`` rows are one session; sessions at most 20 hours
    apart at the same place with the same dominant folder one event. ``rows`` (key, tie, taken_ts, place_id, city, folder,
    lat, lon); rows without a date take no part, a null key is a key.
    """
    dated = rows.where(F.col("taken_ts").isNotNull()).select(key, tie, "taken_ts", "place_id", "city", "folder", "lat", "lon")
    ordered = dated.repartition(key).sortWithinPartitions(key, "taken_ts", tie)

    def segments(frames: Iterable[pd.DataFrame]) -> Iterator[tuple]:
        """(key, tie, segment number, the segment so far, whether the row begins it)."""
        now, part, last = object(), None, None
        for frame in frames:
            for k, i, ts, place, city, folder, lat, lon in frame.itertuples(index=False, name=None):
                k, place, city, folder, lat, lon = map(_plain, (k, place, city, folder, lat, lon))
                begins = True
                if k == now:
                    before, last_lat, last_lon = last
                    gap = ts - before
                    split = gap > gap_hours * 3600
                    if not split and gap >= TRAVEL_GAP_MINUTES * 60 and None not in (lat, lon, last_lat, last_lon):
                        split = _km((last_lat, last_lon), (lat, lon)) >= TRAVEL_KM
                    full = part.size >= cap and ts // 86400 != before // 86400
                    begins = (split and gap >= MIN_GAP_MINUTES * 60) or full or (split and part.size >= cap)
                if begins:
                    part = _Part(ts, ts, part.number + 1 if k == now else 0)
                now, last = k, (ts, lat, lon)
                part.add(ts, place, city, folder, lat, lon)
                yield k, i, part, begins

    def fold(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A segment can be merged once it is whole, so rows wait, as numbers, until their segment ends.
        now, session, event, sessions, events = object(), None, None, 0, 0
        waiting: list[tuple] = []
        open_part = None

        def closed() -> pd.DataFrame:
            nonlocal now, session, event, sessions, events
            k, part = waiting[0][0], open_part
            if k != now:
                now, session, event, sessions, events = k, None, None, 0, 0
            joins = False
            if session is not None:
                gap = (part.start - session.end) / 3600
                near = session.end // 86400 == part.start // 86400 or gap <= OVERNIGHT_HOURS
                joins = near and gap <= SAME_DAY_HOURS and session.same_place(part) and session.size + part.size <= 2 * cap
            if joins:
                session.absorb(part)
            else:
                sessions += session is not None
                session = part
            out = pd.DataFrame({key: [w[0] for w in waiting], tie: [w[1] for w in waiting], "segment": [w[2] for w in waiting], "session": sessions})
            waiting.clear()
            return out

        for k, i, part, begins in segments(frames):
            if begins and waiting:
                yield closed()
            open_part = part
            waiting.append((k, i, part.number))
        if waiting:
            yield closed()

    kind = lambda c: rows.schema[c].dataType.simpleString()
    numbered = ordered.mapInPandas(fold, f"`{key}` {kind(key)}, `{tie}` {kind(tie)}, segment long, session long")
    return _days_merged(dated, numbered, key, tie, cap)


def _days_merged(dated: DataFrame, numbered: DataFrame, key: str, tie: str, cap: int) -> DataFrame:
    """W3 over the sessions of W2: ``numbered`` with ``event``."""
    rows = dated.withColumnRenamed(key, "__key").join(numbered.withColumnRenamed(key, "__of").withColumnRenamed(tie, "__tie"), (F.col("__key").eqNullSafe(F.col("__of"))) & (F.col(tie) == F.col("__tie"))).drop("__of", "__tie")
    at = F.struct("taken_ts", tie)
    most = lambda what: rows.where(F.col(what).isNotNull()).groupBy("__key", "session", what).agg(F.count("*").alias("n"), F.min(at).alias("first")).groupBy(F.col("__key").alias(f"{what}_key"), F.col("session").alias(f"{what}_session")).agg(F.collect_list(F.struct("first", F.col(what).alias("v"), "n")).alias(what))  # noqa: E731 - a session's own places or folders, at most 2 * cap
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    facts = rows.groupBy("__key", "session").agg(
        F.min("taken_ts").alias("start"), F.max("taken_ts").alias("end"), F.count("*").alias("size"),
        F.min_by(F.struct("lat", "lon"), F.when(located, at)).alias("first_at"), F.max_by(F.struct("lat", "lon"), F.when(located, at)).alias("last_at"),
        F.map_from_entries(F.collect_set(F.when(F.col("place_id").isNotNull(), F.struct("place_id", F.coalesce("city", F.lit("")))))).alias("cities"),
    )
    of = lambda what: F.col("__key").eqNullSafe(F.col(f"{what}_key")) & (F.col("session") == F.col(f"{what}_session"))
    joined = facts.join(most("place_id"), of("place_id"), "left").join(most("folder"), of("folder"), "left")
    joined = joined.select("__key", "session", "start", "end", "size", "first_at", "last_at", "cities", "place_id", "folder")
    key_type = rows.schema["__key"].dataType.simpleString()

    def fold(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, event, number = object(), None, 0
        for frame in frames:
            out = []
            for k, session, start, end, size, first_at, last_at, cities, place, folder in frame.itertuples(index=False, name=None):
                k = _plain(k)
                counts = lambda entries: {e["v"]: e["n"] for e in sorted(entries, key=lambda e: (e["first"]["taken_ts"], e["first"][tie]))} if entries is not None else {}
                point = lambda p: None if p is None else (p["lat"], p["lon"])
                part = _Part(start, end, 0, size, counts(place), counts(folder), dict(cities or {}), point(first_at), point(last_at))
                if k != now:
                    now, event, number = k, part, 0
                elif (start - event.end) / 3600 <= MULTIDAY_HOURS and event.same_place(part) and event.size + size <= 2 * cap and event.folders and _first_most(event.folders) == _first_most(part.folders):
                    event.absorb(part)
                else:
                    event, number = part, number + 1
                out.append((k, session, number))
            yield pd.DataFrame(out, columns=["k", "s", "event"])

    ordered = joined.repartition("__key").sortWithinPartitions("__key", "session")
    events = ordered.mapInPandas(fold, f"k {key_type}, s long, event long")
    return rows.join(events, F.col("__key").eqNullSafe(F.col("k")) & (F.col("session") == F.col("s"))).select(F.col("__key").alias(key), tie, "segment", "session", "event")


def event_rows(numbered: DataFrame, rows: DataFrame, key: str, tie: str) -> DataFrame:
    """(key, event, photos, start_ts, end_ts, place_id, lat, lon): an event's size, span, most frequent place (first
    met of several) and median position."""
    joined = numbered.join(rows.select(F.col(tie).alias("__t"), "taken_ts", "place_id", "lat", "lon"), F.col(tie) == F.col("__t"))
    by_place = joined.where(F.col("place_id").isNotNull()).groupBy(key, "event", "place_id").agg(F.count("*").alias("n"), F.min(F.struct("taken_ts", tie)).alias("first"))
    top = by_place.groupBy(key, "event").agg(F.min_by("place_id", F.struct(-F.col("n"), F.col("first"))).alias("place_id"))
    facts = joined.groupBy(key, "event").agg(F.count("*").alias("photos"), F.min("taken_ts").alias("start_ts"), F.max("taken_ts").alias("end_ts"), F.round(F.median("lat"), 6).alias("lat"), F.round(F.median("lon"), 6).alias("lon"))
    return facts.join(top, [key, "event"], "left").select(key, "event", "photos", "start_ts", "end_ts", "place_id", "lat", "lon")
