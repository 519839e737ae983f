"""Work lists, exports, uploads, events' upkeep and places inferred for photos."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contactsheet.functions.geo import haversine_km
from contactsheet.functions.text import free_name, quality, safe_name
from contactsheet.operators.facets import best_id
from contactsheet.operators.segments import inherit_nearest
from contactsheet.params import FACE_QUALITY, FACE_SCORE, FACE_SIZE


def pending(photos: DataFrame, versions: dict[str, int], *, retry_errors: bool = False) -> DataFrame:
    """(id, need_...): photos whose columns of done versions are older or missing; files that are gone have no work,
    and failed ones only on retry. ``versions``: the wanted version by column."""
    alive = photos.where(~F.col("status").isin("missing", "trashed", "deleted"))
    if not retry_errors:
        alive = alive.where(F.col("status") != "error")
    needs = {c: F.coalesce(F.col(c) < v, F.lit(True)) for c, v in versions.items()}
    some = F.lit(False)
    for need in needs.values():
        some |= need
    return alive.where(some).select("id", *[need.alias(f"need_{c}") for c, need in needs.items()])


def new_uploads(uploads: DataFrame, photos: DataFrame) -> DataFrame:
    """Uploads of content that neither the library nor an earlier upload holds: (upload_id, sha256)."""
    first = uploads.groupBy("sha256").agg(F.min("upload_id").alias("upload_id"))
    return first.join(photos.select("sha256").distinct(), "sha256", "left_anti").select("upload_id", "sha256")


def list_folder(files: DataFrame, folder: str) -> DataFrame:
    """One level below ``folder`` of a flat listing: (name, is_dir, size): its files, and the first part of the paths
    of deeper ones."""
    base = folder + "/" if folder else ""
    rest = F.substring(F.col("path"), len(base) + 1, 1 << 20)
    rows = files.where(F.col("path").startswith(base)).select(rest.alias("rest"), "size").where(F.col("rest") != "")
    is_dir = F.col("rest").contains("/")
    return rows.groupBy(F.split_part("rest", F.lit("/"), F.lit(1)).alias("name"), is_dir.alias("is_dir")).agg(F.sum(F.when(~is_dir, F.col("size"))).alias("size"))


def export_plan(photos: DataFrame, layout: str) -> DataFrame:
    """(id, folder, name, size): where each photo of an export goes: by date, as it was, or flat; a name that is
    taken in its folder gets a number."""
    at = F.timestamp_seconds("taken_ts")
    where = {"date": F.coalesce(F.date_format(at, "yyyy/MM"), F.lit("Undated")), "original": F.col("folder"), "flat": F.lit("")}[layout]
    rows = photos.select("id", where.alias("out"), "filename", "size")
    n = F.row_number().over(Window.partitionBy("out", F.lower("filename")).orderBy("id"))
    dot = F.regexp_replace("filename", r"(\.[^.]*)?$", "")
    name = F.when(n == 1, F.col("filename")).otherwise(F.concat(dot, F.lit(" ("), n.cast("string"), F.lit(")"), F.regexp_extract("filename", r"(\.[^.]*)$", 1)))
    return rows.select("id", F.col("out").alias("folder"), name.alias("name"), "size")


def export_groups(photos: DataFrame, library: DataFrame, layout: str, *, faces: DataFrame | None = None, people: DataFrame | None = None, mode: str = "any", frames: bool = False, films: bool = False) -> DataFrame:
    """(label, id, folder, name, size): the files of an export and where each goes.

    ``photos`` is the pool (an album, an event, a year: whatever filter made it). With ``people`` (id, label) it is narrowed:
    ``mode`` "each" gives every person a folder of their photos, "together" keeps photos with all of them, "any" with one of
    them; ``faces`` (photo_id, person_id). ``frames`` adds the other shots of chosen stacks, ``films`` the films of live
    photos, out of what is in order in ``library``. ``layout`` as for ``export_plan``, below the label's folder; of equal names
    in a folder, all but the first get a number. A photo of several people is listed under each of them."""
    chosen = photos.select(F.lit("").alias("label"), "id")
    if people is not None:
        met = faces.select("photo_id", F.col("person_id").alias("p")).join(people.select(F.col("id").alias("p"), "label"), "p").select("photo_id", "p", "label").distinct()
        if mode == "each":
            with_label = met.select(F.col("photo_id").alias("id"), safe_name(F.col("label")).alias("label")).distinct()
            chosen = photos.select("id").join(with_label, "id").select("label", "id")
        elif mode in ("together", "any"):
            wanted = people.select("id").distinct().count() if mode == "together" else 1
            having = met.groupBy("photo_id").agg(F.countDistinct("p").alias("n")).where(F.col("n") >= wanted).select(F.col("photo_id").alias("id"))
            chosen = chosen.join(having, "id", "left_semi").select("label", "id")
        else:
            raise ValueError("mode is each, together or any")
    every, fine = chosen, library.where(F.col("status") == "ok")
    if frames:
        every = every.unionAll(chosen.join(fine.select(F.col("id").alias("more"), "stack_id"), F.col("id") == F.col("stack_id")).select("label", "more"))
    if films:
        of = chosen.join(library.select("id", "live_video_id"), "id").where(F.col("live_video_id").isNotNull())
        every = every.unionAll(of.join(fine.select(F.col("id").alias("more")), F.col("live_video_id") == F.col("more")).select("label", "more"))
    at = F.timestamp_seconds("taken_ts")
    where = {"date": F.coalesce(F.date_format(at, "yyyy/MM"), F.lit("Undated")), "original": F.col("folder"), "flat": F.lit("")}[layout]
    folder = F.array_join(F.filter(F.array("label", where), lambda x: x.isNotNull() & (x != "")), "/")
    rows = every.distinct().join(library.select("id", "taken_ts", "folder", "filename", "size"), "id").select("label", "id", folder.alias("folder"), "filename", "size")
    nth = F.row_number().over(Window.partitionBy("folder", F.lower("filename")).orderBy("id"))
    return rows.select("label", "id", "folder", free_name(F.col("filename"), nth).alias("name"), "size")


def expand(chosen: DataFrame, photos: DataFrame, partner: str) -> DataFrame:
    """Chosen photos in their order, then those of the library whose ``partner`` is chosen, each once: (id, place)."""
    extra = photos.where(F.col("status") == "ok").join(chosen.select(F.col("id").alias("c")), F.col(partner) == F.col("c"), "left_semi").select("id", F.lit(1).alias("later"), F.col("id").alias("place"))
    both = chosen.select("id", F.lit(0).alias("later"), F.col("place").cast("long")).unionAll(extra.withColumn("place", F.col("place").cast("long")))
    return both.groupBy("id").agg(F.min(F.struct("later", "place")).alias("p")).select("id", F.col("p.later").alias("later"), F.col("p.place").alias("place"))


def caption_batch(photos: DataFrame, covers: DataFrame, done: DataFrame, limit: int) -> DataFrame:
    """The next photos to caption: not done yet, event covers first, then by quality."""
    rows = photos.join(done.select(F.col("photo_id").alias("d")), F.col("id") == F.col("d"), "left_anti")
    rows = rows.join(covers.select(F.col("cover_id").alias("c")).distinct(), F.col("id") == F.col("c"), "left")
    return rows.orderBy(F.col("c").isNull(), F.coalesce("quality_score", F.lit(0.0)).desc(), "id").limit(limit).select("id", F.col("c").isNotNull().alias("is_cover"))


def expired(trash: DataFrame, now: float) -> DataFrame:
    """What the trash may let go."""
    return trash.where(F.col("expires_at") <= now)


def album_links(uploads: DataFrame, photos: DataFrame, albums: DataFrame) -> DataFrame:
    """(album_id, photo_id) of uploads whose content is in the library by now, for manual albums that are shown."""
    open_ = albums.where((F.col("kind") == "manual") & (F.col("hidden") == 0)).select("album_id")
    rows = uploads.where(F.col("album_id").isNotNull()).join(photos.select(F.col("id").alias("photo_id"), "sha256"), "sha256")
    return rows.join(open_, "album_id").select("album_id", "photo_id").distinct()


def raw_pairs(media: DataFrame) -> DataFrame:
    """(raw_id, view_id): RAW files with the first viewable file of their folder and stem."""
    views = media.where(F.col("media_type") == "image").groupBy("folder", "stem").agg(F.min("id").alias("view_id"))
    return media.where(F.col("media_type") == "raw").join(views, ["folder", "stem"]).select(F.col("id").alias("raw_id"), "view_id")


def unambiguous(names: DataFrame, photos: DataFrame) -> DataFrame:
    """(img_name, id): exported names that one photo of the folder has; ambiguous names match nothing.
    ``names`` (folder, img_name), ``photos`` (id, folder, filename)."""
    both = names.join(photos.select("id", F.col("folder").alias("f"), "filename"), (F.col("folder") == F.col("f")) & (F.lower("img_name") == F.lower("filename")))
    return both.groupBy("folder", "img_name").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").select("folder", "img_name", "id")


# ---- events and places


def event_stats(members: DataFrame, photos: DataFrame, faces: DataFrame) -> DataFrame:
    """An event's photos, people and surest location (high, medium, low, then none). ``members`` (event,
    photo_id); ``photos`` has location_confidence."""
    rank = F.element_at(F.create_map(F.lit("high"), F.lit(3), F.lit("medium"), F.lit(2), F.lit("low"), F.lit(1)), F.coalesce("location_confidence", F.lit("")))
    own = members.join(photos.select("id", rank.alias("rank")), F.col("photo_id") == F.col("id")).groupBy("event").agg(F.count("*").alias("photos"), F.max(F.coalesce("rank", F.lit(0))).alias("rank"))
    people = members.join(faces.where(F.col("person_id").isNotNull()).select(F.col("photo_id").alias("p"), "person_id"), F.col("photo_id") == F.col("p")).groupBy("event").agg(F.countDistinct("person_id").alias("people"))
    names = F.element_at(F.array(*map(F.lit, ("unknown", "low", "medium", "high"))), F.col("rank") + 1)
    return own.join(people, "event", "left").select("event", "photos", F.coalesce("people", F.lit(0)).alias("people"), names.alias("confidence"))


def visible_covers(events: DataFrame, members: DataFrame, shown: DataFrame) -> DataFrame:
    """(event, cover_id): the stored cover while it is shown, else the best shown photo by rating and quality."""
    best = members.join(shown, F.col("photo_id") == F.col("id")).groupBy("event").agg(F.max(F.struct(F.coalesce("rating", F.lit(0)).alias("r"), F.coalesce("quality_score", F.lit(0.0)).alias("q"), (-F.col("id")).alias("i"))).alias("b"))
    stored = events.join(shown.select(F.col("id").alias("s")), F.col("cover_id") == F.col("s"), "left").select("event", F.col("s"))
    return stored.join(best, "event", "left").select("event", F.coalesce("s", -F.col("b.i")).alias("cover_id"))


def infer_places(photos: DataFrame, *, within: float, folder_places: DataFrame | None = None) -> DataFrame:
    """(id, place_id, location_source): a photo's own place, else its event's most frequent (the least of
    several), else that of the photo before or after it by the same camera within ``within`` seconds, else the place its
    folder names. ``photos`` (id, event, camera_model, taken_ts, place_id), ``folder_places`` (id, place_id) of
    ``places.folder_place``."""
    counts = photos.where(F.col("place_id").isNotNull() & F.col("event").isNotNull()).groupBy("event", "place_id").agg(F.count("*").alias("n"))
    mode = counts.groupBy("event").agg(F.min_by("place_id", F.struct(-F.col("n"), F.col("place_id"))).alias("of_event"))
    dated = inherit_nearest(photos.where(F.col("taken_ts").isNotNull()), "camera_model", "taken_ts", "id", "place_id", within=within).select(F.col("id").alias("d"), F.col("inherited").alias("of_time"))
    rows = photos.join(mode, "event", "left").join(dated, F.col("id") == F.col("d"), "left")
    if folder_places is None:
        rows = rows.withColumn("of_folder", F.lit(None).cast("long"))
    else:
        rows = rows.join(folder_places.select(F.col("id").alias("f"), F.col("place_id").alias("of_folder")), F.col("id") == F.col("f"), "left")
    source = F.when(F.col("place_id").isNotNull(), "gps").when(F.col("of_event").isNotNull(), "event").when(F.col("of_time").isNotNull(), "nearby_time").when(F.col("of_folder").isNotNull(), "folder")
    return rows.select("id", F.coalesce("place_id", "of_event", "of_time", "of_folder").alias("place_id"), source.alias("location_source"))


def home_distance(places: DataFrame, homes: DataFrame) -> DataFrame:
    """(id, km): how far each place is from the nearest home; homes are two places at most, which are broadcast."""
    h = F.broadcast(homes.limit(2).select(F.col("lat").alias("hlat"), F.col("lon").alias("hlon")).withColumn("one", F.lit(1)))
    return places.withColumn("one", F.lit(1)).join(h, "one").groupBy("id").agg(F.round(F.min(haversine_km(F.col("lat"), F.col("lon"), F.col("hlat"), F.col("hlon"))), 4).alias("km"))


def geocode(photos: DataFrame, lookup: Callable[[DataFrame], DataFrame], decimals: int = 3) -> DataFrame:
    """(id, place_id): ``lookup`` is asked once for each distinct cell of ``cells`` and its answer joined back to the
    photos. ``lookup`` takes (id, lat, lon) and gives (id, place_id); the id is the cell's."""
    cell = F.xxhash64(F.round("lat", decimals), F.round("lon", decimals))
    found = lookup(cells(photos, decimals).select(cell.alias("id"), "lat", "lon"))
    at = photos.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("id", cell.alias("cell"))
    return at.join(found.select(F.col("id").alias("cell"), "place_id"), "cell", "left").select("id", "place_id")


def cells(photos: DataFrame, decimals: int = 3) -> DataFrame:
    """The distinct cells that photos' positions round to, each to be looked up once."""
    return photos.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(F.round("lat", decimals).alias("lat"), F.round("lon", decimals).alias("lon")).distinct()


# ---- faces


def clusterable() -> Column:
    """A face good enough to found a cluster."""
    return (F.col("quality") >= FACE_QUALITY) & (F.col("det_score") >= FACE_SCORE) & (F.col("size_px") >= FACE_SIZE)


def review_order(faces: DataFrame, person: int, limit: int, offset: int = 0) -> DataFrame:
    """A person's faces, the least sure first (unknown counts as 0)."""
    rows = faces.where(F.col("person_id") == person).withColumn("sure", F.coalesce("confidence", F.lit(0.0)))
    return rows.orderBy("sure", "photo_id", "size_px").offset(offset).limit(limit).select("photo_id", "sure", "size_px")


def continue_identities(clusters: DataFrame) -> DataFrame:
    """(label, person_id): a person goes on in the one cluster that holds most of its faces, and a cluster takes the
    person of whom it holds most among those. ``clusters`` (id, label, person_id)."""
    held = clusters.where(F.col("person_id").isNotNull()).groupBy("label", "person_id").agg(F.count("*").alias("n"))
    own = held.withColumn("r", F.row_number().over(Window.partitionBy("person_id").orderBy(F.col("n").desc(), F.col("label").desc()))).where("r = 1")
    return own.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.col("n").desc(), "person_id"))).where("r = 1").select("label", "person_id", "n")


def recompute_quality(photos: DataFrame, faces: DataFrame) -> DataFrame:
    """M5: (id, face_quality, quality): the best face of each photo, null without one, and the photo's quality with it.
    ``photos`` (id, blur, brightness, clipped, contrast, width, height, source_kind)."""
    best = faces.groupBy("photo_id").agg(F.max("quality").alias("face_quality"))
    rows = photos.join(best, F.col("id") == F.col("photo_id"), "left")
    value = quality(*map(F.col, ("blur", "brightness", "clipped", "contrast", "width", "height")), F.coalesce("source_kind", F.lit("")), face=F.col("face_quality"))
    return rows.select("id", F.round("face_quality", 6).alias("face_quality"), value.alias("quality"))


# ---- lists


def redacted_log(log: DataFrame, readable: DataFrame) -> DataFrame:
    """Log entries with the photos one may not see taken out of their lists; entries left without any are dropped.
    ``log`` (entry, photo_ids), ``readable`` (id)."""
    rows = log.select("entry", F.posexplode("photo_ids").alias("i", "pid")).join(readable.select("id"), F.col("pid") == F.col("id"), "left_semi")
    return rows.groupBy("entry").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "pid"))), lambda x: x["pid"]).alias("photo_ids"))  # an entry's own list bounds it


def duplicate_listing(groups: DataFrame, kinds: tuple[str, ...], limit: int) -> DataFrame:
    """Groups by the rank of their kind, then by size."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")), F.lit(99))
    return groups.orderBy(rank, F.col("members").desc(), "grp").limit(limit).select("grp", "kind", "members", "reclaimable")


def favourites(marks: DataFrame, photos: DataFrame) -> DataFrame:
    """(user_id, n) of visible favourites."""
    return marks.join(photos.select("id"), F.col("photo_id") == F.col("id"), "left_semi").groupBy("user_id").agg(F.countDistinct("photo_id").alias("n"))


def best_by_source(photos: DataFrame) -> DataFrame:
    """Each source's photos and best one."""
    return photos.groupBy("source_kind").agg(F.count("*").alias("n"), best_id(F.col("quality_score")).alias("best_id"))
