"""Row predicates: visibility, the grid's filters, and set filters over faces, tags, places and albums.

Every filter is a ``Column`` or a semi-join, so Catalyst pushes what it can to the scan. Where a null counts as a
match, the predicate says so.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactsheet.params import BLURRY, LARGE_BYTES, MEME_TAGS, PET_TAGS, RAW_ENDINGS, SELFIE_FACES, SELFIE_WIDTH, TAG_FILTER, TEXT_TAGS


def visible(photos: DataFrame) -> DataFrame:
    """Indexed, not hidden, and not the film of a live photo."""
    return photos.where((F.col("status") == "ok") & (F.col("hidden") == 0) & (F.col("live_component") == 0))


def epoch_range(year: int, month: int | None = None) -> tuple[int, int]:
    """The half-open range of epoch seconds of a year (1826 to 2200) or a month."""
    from datetime import UTC, datetime

    if not 1826 <= year <= 2200 or (month is not None and not 1 <= month <= 12):
        raise ValueError("year or month out of range")
    end = (year + 1, 1) if month is None or month == 12 else (year, month + 1)
    return int(datetime(year, month or 1, 1, tzinfo=UTC).timestamp()), int(datetime(*end, 1, tzinfo=UTC).timestamp())


def taken_in(year: int, month: int | None = None) -> Column:
    start, end = epoch_range(year, month)
    return (F.col("taken_ts") >= start) & (F.col("taken_ts") < end)


def not_taken_in(year: int, month: int | None = None) -> Column:
    """The negated window keeps photos without a date."""
    return F.col("taken_ts").isNull() | ~taken_in(year, month)


def in_folder(folder: str, exact: bool = False) -> Column:
    """The folder itself, or it and everything below; no wildcard has a meaning."""
    return (F.col("folder") == folder) if exact else (F.col("folder") == folder) | F.col("folder").startswith(folder + "/")


def panorama() -> Column:
    """P5: a wide or very tall image that is not a screenshot."""
    w, h = F.col("width"), F.col("height")
    return (F.col("media_type") == "image") & (w > 0) & (h > 0) & ((w / h >= 2.0) | (h / w >= 2.5)) & not_screenshot()


def not_screenshot() -> Column:
    return F.coalesce("source_kind", F.lit("")) != "screenshot"


def live() -> Column:
    """A photo with a film of its own, beside it or inside."""
    return F.col("live_video_id").isNotNull() | (F.coalesce("motion_offset", F.lit(0)) > 0)


def with_marks(photos: DataFrame, faces: DataFrame, photo_tags: DataFrame, *, pets: tuple[str, ...] = PET_TAGS, texts: tuple[str, ...] = TEXT_TAGS, memes: tuple[str, ...] = MEME_TAGS, least: float = TAG_FILTER) -> DataFrame:
    """``photos`` with what collections ask of faces and tags: has_wide_face, has_pet, has_text, has_meme. Faces and tags
    are reduced to one row a photo before they are joined."""
    wide = faces.where(F.col("x2") - F.col("x1") > SELFIE_WIDTH).groupBy("photo_id").agg(F.lit(True).alias("has_wide_face"))
    named = {"has_pet": pets, "has_text": texts, "has_meme": memes}
    wanted = [t for tags in named.values() for t in tags]
    strong = photo_tags.where((F.col("score") >= least) & F.col("tag").isin(*wanted))
    held = strong.groupBy("photo_id").agg(*[F.bool_or(F.col("tag").isin(*tags)).alias(name) for name, tags in named.items()])
    rows = photos.join(wide.withColumnRenamed("photo_id", "__w"), F.col("id") == F.col("__w"), "left").join(held.withColumnRenamed("photo_id", "__t"), F.col("id") == F.col("__t"), "left").drop("__w", "__t")
    return rows.select("*").fillna(False, ["has_wide_face", *named])


def collections() -> dict[str, Column]:
    """P5: the named collections, over ``photos`` or, where faces or tags count, over ``with_marks``."""
    return {
        "videos": F.col("media_type") == "video",
        "live": live(),
        "panoramas": panorama(),
        "selfies": F.col("has_wide_face") & (F.col("face_count") <= SELFIE_FACES),
        "raw": F.col("ext").isin(*RAW_ENDINGS),
        "stacks": F.col("stack_id") == F.col("id"),
        "pets": F.col("has_pet"),
        "screenshots": F.col("source_kind") == "screenshot",
        "documents": F.col("has_text"),
        "memes": F.col("has_meme"),
        "blurry": (F.col("media_type") == "image") & (F.col("blur") < BLURRY) & not_screenshot(),
        "large": F.col("size") >= LARGE_BYTES,
        "no_location": F.col("lat").isNull() & F.col("place_id").isNull(),
        "no_date": F.col("date_confidence") == "low",
    }


@dataclass(frozen=True)
class GridFilter:
    """The grid's optional clauses, joined by AND."""

    year: int | None = None
    month: int | None = None
    source: str | None = None
    camera: str | None = None
    folder: str | None = None
    folder_exact: bool = False
    place: int | None = None
    media: str | None = None  #: image, video or live
    min_rating: int | None = None
    has_faces: bool = False
    include_screenshots: bool = True
    archived: str = "include"  #: include, exclude or only
    collection: str | None = None  #: one of ``collections``, "hidden" (what hiding took away) or "archive"
    collapse_stacks: bool = False

    def columns(self) -> list[Column]:
        out = []
        if self.archived != "include":
            out.append(F.col("archived") == (1 if self.archived == "only" else 0))
        if self.collection == "archive":
            out.append(F.col("archived") == 1)
        elif self.collection not in (None, "hidden"):
            out.append(collections()[self.collection])
        if self.month is not None and self.year is None:
            raise ValueError("a month needs a year")
        if self.year is not None:
            out.append(taken_in(self.year, self.month))
        for name, value in (("source_kind", self.source), ("camera_model", self.camera), ("place_id", self.place)):
            if value is not None:
                out.append(F.col(name) == value)
        if self.media is not None:
            out.append(live() if self.media == "live" else F.col("media_type") == self.media)
        if self.folder is not None:
            out.append(in_folder(self.folder, self.folder_exact))
        if self.min_rating is not None:
            out.append(F.coalesce("rating", F.lit(0)) >= self.min_rating)
        if self.has_faces:
            out.append(F.col("face_count") > 0)
        if self.collapse_stacks:
            out.append(F.col("stack_hidden") == 0)
        if not self.include_screenshots and self.source is None and self.collection != "screenshots":
            out.append(not_screenshot())
        return out


def grid(photos: DataFrame, spec: GridFilter, favourites: DataFrame | None = None) -> DataFrame:
    """Visible photos (for the collection "hidden", the hidden ones) that meet every clause; with ``favourites`` (photo_id)
    of a user, only those."""
    hidden = 1 if spec.collection == "hidden" else 0
    shown = photos.where((F.col("status") == "ok") & (F.col("hidden") == hidden) & (F.col("live_component") == 0))
    out = reduce(lambda df, c: df.where(c), spec.columns(), shown)
    return out if favourites is None else out.join(favourites, out["id"] == favourites["photo_id"], "left_semi")


@dataclass(frozen=True)
class DateClause:
    """Windows of seconds (either end open, both ends in), months of any year, a span of days like ("12-24", "12-26"),
    all of which must hold; ``exclude`` turns them round and keeps photos without a date."""

    windows: tuple[tuple[float | None, float | None], ...] = ()
    months: tuple[int, ...] = ()
    day_span: tuple[str, str] | None = None
    exclude: bool = False

    def column(self) -> Column:
        ts, parts = F.col("taken_ts"), []
        if self.windows:
            ends = lambda lo, hi: (F.lit(True) if lo is None else ts >= lo) & (F.lit(True) if hi is None else ts <= hi)
            parts.append(reduce(lambda a, b: a | b, [ends(*w) for w in self.windows]))
        if self.months:
            parts.append(F.month(F.timestamp_seconds(ts)).isin(*self.months))
        if self.day_span:
            parts.append(F.date_format(F.timestamp_seconds(ts), "MM-dd").between(*self.day_span))
        inside = reduce(lambda a, b: a & b, parts, F.lit(True))
        return ts.isNull() | ~inside if self.exclude else ts.isNotNull() & inside if parts else F.lit(True)


def _holding_all(rows: DataFrame, column: str, values: Iterable) -> DataFrame:
    """(photo_id) of photos with a row for every value; partial results are one flag a value, not the rows."""
    wanted = list(dict.fromkeys(values))
    flags = [F.bool_or(F.col(column) == v).alias(f"v{i}") for i, v in enumerate(wanted)]
    every = reduce(lambda a, b: a & b, [F.col(f"v{i}") for i in range(len(wanted))])
    return rows.where(F.col(column).isin(wanted)).groupBy("photo_id").agg(*flags).where(every).select("photo_id")


def with_all_persons(photos: DataFrame, faces: DataFrame, persons: Iterable[int]) -> DataFrame:
    """Photos that show every person; one pass over faces and one shuffle, whatever their number."""
    full = _holding_all(faces, "person_id", persons)
    return photos.join(full, photos["id"] == full["photo_id"], "left_semi")


def with_any_person(photos: DataFrame, faces: DataFrame, persons: Iterable[int]) -> DataFrame:
    met = faces.where(F.col("person_id").isin(list(persons))).select("photo_id")
    return photos.join(met, photos["id"] == met["photo_id"], "left_semi")


def with_no_person(photos: DataFrame, faces: DataFrame, persons: Iterable[int]) -> DataFrame:
    met = faces.where(F.col("person_id").isin(list(persons))).select("photo_id")
    return photos.join(met, photos["id"] == met["photo_id"], "left_anti")


def without_people(photos: DataFrame, faces: DataFrame) -> DataFrame:
    """No assigned face and no detected one."""
    assigned = faces.where(F.col("person_id").isNotNull()).select("photo_id")
    return photos.where(F.coalesce("face_count", F.lit(0)) == 0).join(assigned, photos["id"] == assigned["photo_id"], "left_anti")


def with_tags(photos: DataFrame, photo_tags: DataFrame, include: Iterable[str] = (), exclude: Iterable[str] = (), least: float = TAG_FILTER) -> DataFrame:
    """Photos with every tag of ``include`` and none of ``exclude``, at a score of ``least`` or more."""
    include, exclude = list(dict.fromkeys(include)), list(exclude)
    strong = photo_tags.where(F.col("score") >= least)
    out = photos
    if include:
        full = _holding_all(strong, "tag", include)
        out = out.join(full, out["id"] == full["photo_id"], "left_semi")
    if exclude:
        bad = strong.where(F.col("tag").isin(exclude)).select("photo_id")
        out = out.join(bad, out["id"] == bad["photo_id"], "left_anti")
    return out


def expand_places(places: DataFrame, names: Iterable[str]) -> DataFrame:
    """The named places and what lies inside them: places of a city of that name, of a region that a chosen place
    both names and lies in, and of such a country; never upwards or sideways. ``places`` (id, name, city, admin1, country).

    The names of the chosen places come to the driver, which has the caller's own list of them anyway.
    """
    names = list(dict.fromkeys(names))
    chosen = places.where(F.col("name").isin(*names)) if names else places.limit(0)
    held = chosen.agg(F.collect_set("admin1").alias("admins"), F.collect_set("country").alias("countries")).first()
    admins, countries = [n for n in names if n in held["admins"]], [n for n in names if n in held["countries"]]
    inside = F.col("name").isin(*names) | F.col("city").isin(*names)
    for column, found in (("admin1", admins), ("country", countries)):
        if found:
            inside |= F.col(column).isin(*found)
    return places.where(F.coalesce(inside, F.lit(False)))


def not_in_places(ids: Iterable[int]) -> Column:
    """Photos without a place are kept."""
    return ~F.coalesce("place_id", F.lit(-1)).isin(list(ids))


def in_album(photos: DataFrame, members: DataFrame) -> DataFrame:
    """Members of an album by id, or by the same content under another id."""
    contents = photos.join(members, photos["id"] == members["photo_id"], "left_semi").where(F.col("sha256").isNotNull()).select(F.col("sha256").alias("content")).distinct()
    by_id = photos.join(members, photos["id"] == members["photo_id"], "left_semi")
    by_content = photos.join(contents, photos["sha256"] == contents["content"], "left_semi")
    return by_id.unionAll(by_content).dropDuplicates(["id"])


def flags() -> Column:
    """Favourite 1, faces 2, video 4, as one number."""
    return (F.when(F.col("rating") >= 5, 1).otherwise(0) + F.when(F.col("face_count") > 0, 2).otherwise(0) + F.when(F.col("media_type") == "video", 4).otherwise(0)).cast("int")


def in_event(photos: DataFrame, event: Column, trips: DataFrame, wanted: int | str) -> DataFrame:
    """Photos of an event, or of a trip by membership, each once. ``trips`` (trip, photo_id)."""
    members = trips.where(F.col("trip") == wanted).select("photo_id")
    by_trip = photos.join(members, photos["id"] == members["photo_id"], "left_semi")
    return photos.where(event == wanted).unionAll(by_trip).dropDuplicates(["id"])


@dataclass(frozen=True)
class Details:
    """The search's further clauses, joined by AND. Screenshots: True for only, False for none, None for either."""

    videos: bool | None = None
    sources: tuple[str, ...] = ()
    min_rating: int | None = None
    colours: tuple[str, ...] = ()
    screenshots: bool | None = None
    min_faces: int | None = None
    max_faces: int | None = None
    live: bool = False
    favourites: bool = False  #: needs a column ``favourite``
    selfies: bool = False  #: needs ``with_marks``
    visual: bool = False  #: the search has words to see in the picture
    best_first: bool = False
    phrases: bool = False  #: the search has words to read in the picture

    def columns(self) -> list[Column]:
        out = []
        if self.videos is not None:
            out.append((F.coalesce("media_type", F.lit("image")) == "video") == F.lit(self.videos))
        if self.sources:
            out.append(F.col("source_kind").isin(*self.sources))
        if self.min_rating is not None:
            out.append(F.coalesce("rating", F.lit(0)) >= self.min_rating)
        if self.colours:
            out.append(F.arrays_overlap("colours", F.array(*map(F.lit, self.colours))))
        if self.screenshots is not None:
            out.append(~not_screenshot() if self.screenshots else not_screenshot())
        elif (self.visual or self.best_first) and not self.phrases:
            out.append(not_screenshot())  # to be seen or to be best, a picture is no screenshot unless asked for
        if self.live:
            out.append(live())
        if self.favourites:
            out.append(F.col("favourite"))
        if self.selfies:
            out.append(collections()["selfies"])
        if self.min_faces is not None:
            out.append(F.coalesce("face_count", F.lit(0)) >= self.min_faces)
        if self.max_faces is not None:
            out.append(F.coalesce("face_count", F.lit(0)) <= self.max_faces)
        return out


def detailed(photos: DataFrame, spec: Details) -> DataFrame:
    return reduce(lambda df, c: df.where(c), spec.columns(), photos)


def with_companions(photos: DataFrame) -> DataFrame:
    """(id), once each: photos and the films of those that are live photos."""
    return photos.select("id").unionAll(photos.where(F.col("live_video_id").isNotNull()).select("live_video_id")).distinct()
