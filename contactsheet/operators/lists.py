"""Small lists and counts behind the pages: who may see what, orders, vocabularies and their fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: O1: the grid's orders; each ends with the id, so that pages do not overlap.
GRID_ORDERS = ("date_desc", "date_asc", "quality", "added", "size")


def grid_order(name: str) -> list[Column]:
    """O1: the columns to order by."""
    last = F.col("id").desc()
    return {
        "date_desc": [F.col("taken_ts").desc_nulls_last(), last],
        "date_asc": [F.col("taken_ts").asc_nulls_last(), F.col("id")],
        "quality": [F.col("quality_score").desc_nulls_last(), last],
        "added": [F.col("added_ts").desc_nulls_last(), last],
        "size": [F.col("size").desc_nulls_last(), last],
    }[name]


def page(photos: DataFrame, order: str, limit: int, offset: int = 0) -> DataFrame:
    """One page of a grid."""
    return photos.orderBy(*grid_order(order)).offset(offset).limit(limit)


def search_order(found: DataFrame, sort: str, limit: int) -> DataFrame:
    """O2: found photos by "quality" (rating, quality, newest; three times ``limit``, to be thinned by ``diversify``),
    "worst" (unknown quality last), "date_asc", "date_desc", or "relevance" by their ``score``."""
    newest, key = F.col("taken_ts").desc_nulls_last(), F.col("id")
    order = {
        "quality": [F.coalesce("rating", F.lit(0)).desc(), F.coalesce("quality_score", F.lit(0.0)).desc(), newest, key],
        "worst": [F.coalesce("quality_score", F.lit(1e9)), newest, key],
        "date_asc": [F.col("taken_ts").asc_nulls_first(), key],
        "date_desc": [newest, key],
        "relevance": [F.col("score").desc(), key] if "score" in found.columns else [newest, key],
    }[sort]
    return found.orderBy(*order).limit(3 * limit if sort == "quality" else limit)


def visible_albums(albums: DataFrame, user: int) -> DataFrame:
    """P25: albums that are shared or one's own."""
    return albums.where((F.col("shared") == 1) | (F.col("owner") == user))


def trash_list(trash: DataFrame, photos: DataFrame) -> DataFrame:
    """What is in the trash, newest first, without films of live photos: (id, trashed_at). ``trash`` (photo_id,
    trashed_at)."""
    rows = trash.join(photos.where(F.col("live_component") == 0).select("id"), F.col("photo_id") == F.col("id"))
    return rows.select("id", "trashed_at").orderBy(F.col("trashed_at").desc(), "id")


def private_counts(photos: DataFrame) -> DataFrame:
    """(private_to, photos, locked): each account's private photos, and how many are locked; null for locked ones of
    nobody."""
    rows = photos.where((F.col("status") == "locked") | F.col("private_to").isNotNull())
    return rows.groupBy("private_to").agg(F.count("*").alias("photos"), F.count_if(F.col("status") == "locked").alias("locked"))


def visible_errors(errors: DataFrame, photos: DataFrame, user: int) -> DataFrame:
    """Errors without a photo, or of photos that are neither locked nor private to another: (error, photo_id)."""
    rows = errors.join(photos.select(F.col("id").alias("p"), "status", "private_to"), F.col("photo_id") == F.col("p"), "left")
    mine = F.col("private_to").isNull() | (F.col("private_to") == user)
    return rows.where(F.col("p").isNull() | ((F.col("status") != "locked") & mine)).select("error", "photo_id")


def events_with_persons(members: DataFrame, trips: DataFrame, faces: DataFrame, persons: list[int]) -> DataFrame:
    """(event) of events or trips that show every person: over their own photos, or those of a trip's events.
    ``members`` (event, photo_id), ``trips`` (trip, event)."""
    wanted = list(dict.fromkeys(persons))
    of_trips = trips.join(members, "event").select(F.col("trip").alias("event"), "photo_id")
    seen = members.select("event", "photo_id").unionAll(of_trips).join(faces.where(F.col("person_id").isin(*wanted)).select(F.col("photo_id").alias("f"), "person_id"), F.col("photo_id") == F.col("f"))
    return seen.groupBy("event").agg(F.countDistinct("person_id").alias("n")).where(F.col("n") == len(wanted)).select("event")


def library_counts(photos: DataFrame, faces: DataFrame, photo_tags: DataFrame, persons: DataFrame) -> DataFrame:
    """One row: photos, videos, seconds of video, faces, unassigned faces, people with a photo, named people,
    tags in use. Each table is reduced to one row before they meet."""
    of_photos = photos.agg(F.count_if(F.col("media_type") == "image").alias("photos"), F.count_if(F.col("media_type") == "video").alias("videos"), F.coalesce(F.sum(F.when(F.col("media_type") == "video", F.col("duration"))), F.lit(0.0)).alias("seconds"))
    of_faces = faces.agg(F.count("*").alias("faces"), F.count_if(F.col("person_id").isNull()).alias("unassigned"), F.countDistinct("person_id").alias("people"))
    of_tags = photo_tags.agg(F.countDistinct("tag").alias("tags"))
    of_names = persons.agg(F.count("name").alias("named"))
    rows = [df.withColumn("one", F.lit(1)) for df in (of_photos, of_faces, of_tags, of_names)]  # one row each
    return rows[0].join(rows[1], "one").join(rows[2], "one").join(rows[3], "one").drop("one")


def fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """(n, mark): how many rows, and a sum of their hashes that changes with any of them, whatever their order."""
    whole = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns])
    mark = F.conv(F.substring(F.md5(whole.cast("binary")), 1, 8), 16, 10).cast("long")
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(mark), F.lit(0)).alias("mark"))


def label_sources(faces: DataFrame) -> DataFrame:
    """(person_id, faces, by_user): how many of a person's faces were labelled by hand."""
    return faces.where(F.col("person_id").isNotNull()).groupBy("person_id").agg(F.count("*").alias("faces"), F.count_if(F.col("source") == "user").alias("by_user"))


def tag_list(photo_tags: DataFrame, least: float) -> DataFrame:
    """(tag, photos, strong): tags with all their photos and those at ``least`` or more."""
    return photo_tags.groupBy("tag").agg(F.count("*").alias("photos"), F.count_if(F.col("score") >= least).alias("strong"))


def usage(faces: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(kind, model, n): faces and vectors by the model that made them. Both have a column ``model``."""
    count = lambda rows, kind: rows.groupBy("model").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.col("model").cast("string").alias("model"), "n")
    return count(faces, "faces").unionAll(count(embeddings, "vectors"))


def scopes(photos: DataFrame, places: DataFrame) -> DataFrame:
    """(scope, value): the countries and the years the library has photos of."""
    countries = places.select(F.col("id").alias("p"), "country").join(photos.select("place_id"), F.col("p") == F.col("place_id"), "left_semi").where(F.col("country").isNotNull()).select(F.lit("country").alias("scope"), F.col("country").alias("value"))
    years = photos.where(F.col("taken_ts").isNotNull()).select(F.lit("year").alias("scope"), F.date_format(F.timestamp_seconds("taken_ts"), "yyyy").alias("value"))
    return countries.unionAll(years).distinct()


def gallery(photos: DataFrame, places: DataFrame, members: DataFrame) -> DataFrame:
    """K9: (album, place_in, id, caption, file): the rows of an album's gallery, in its order: the caption is the date and
    the place, the file's name its number and ending."""
    rows = members.join(photos, F.col("photo_id") == F.col("id")).join(places.select(F.col("id").alias("p"), F.col("name").alias("place")), F.col("place_id") == F.col("p"), "left")
    caption = F.array_join(F.filter(F.array(F.date_format(F.timestamp_seconds("taken_ts"), "d MMMM yyyy"), F.col("place")), lambda x: x.isNotNull()), " · ")
    return rows.select("album", "place_in", "id", caption.alias("caption"), F.concat(F.lpad(F.col("place_in").cast("string"), 5, "0"), F.col("ext")).alias("file"))


def shifted(photos: DataFrame, edits: DataFrame) -> DataFrame:
    """(id, taken_ts) after corrections: a shift in seconds or an absolute time, just one of the two; an edit with
    both or neither is refused as null. ``edits`` (photo_id, shift, absolute)."""
    ok = edits.where(F.col("shift").isNotNull() != F.col("absolute").isNotNull())
    rows = photos.select("id", "taken_ts").join(ok, F.col("id") == F.col("photo_id"), "left")
    return rows.select("id", F.coalesce("absolute", F.col("taken_ts") + F.coalesce("shift", F.lit(0.0))).alias("taken_ts"))


def cascade(changed: DataFrame, photos: DataFrame, members: DataFrame, covers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What follows when photos are hidden or shown. (events, stacks) that hold a changed photo: each event's visible
    photos now, and its cover if that is still seen (else null; an event without any is to be dropped), each stack's
    visible head, the least id (null if none is left). ``members`` (event, photo_id), ``covers`` (event, cover_id),
    ``changed`` (id). Only the touched events and stacks are recomputed."""
    seen = (F.col("status") == "ok") & (F.col("hidden") == 0)
    hit = members.join(changed, F.col("photo_id") == F.col("id"), "left_semi").select("event").distinct()
    own = members.join(hit, "event", "left_semi").join(photos.select("id", seen.alias("seen")), F.col("photo_id") == F.col("id")).join(covers, "event", "left")
    events = own.groupBy("event").agg(F.count_if("seen").alias("photos"), F.max(F.when(F.col("seen") & (F.col("id") == F.col("cover_id")), F.col("cover_id"))).alias("cover_id"))
    stacks = photos.join(changed, "id", "left_semi").where(F.col("stack_id").isNotNull()).select("stack_id").distinct()
    heads = photos.join(stacks, "stack_id", "left_semi").groupBy("stack_id").agg(F.min(F.when(seen, F.col("id"))).alias("head"), F.count_if(seen).alias("photos"))
    return events, heads
