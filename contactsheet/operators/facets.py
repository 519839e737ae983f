"""Grouped aggregates: statistics, timelines, covers, people, places, tags and events.

Covers are ``max_by`` over a struct, so a group's best row needs no window and no sort; ties go to the lower id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contactsheet.params import CATEGORY_DENSITY, CATEGORY_DOMINANCE, CATEGORY_SHARE, TAG_FILTER


def taken() -> Column:
    """The capture time; wall clock kept as if it were UTC."""
    return F.timestamp_seconds(F.col("taken_ts"))


def best_id(score: Column, key: str = "id") -> Column:
    """The ``key`` of the row with the greatest score (null least), then the least key."""
    return F.max(F.struct(F.coalesce(score, F.lit(float("-inf"))).alias("s"), (-F.col(key)).alias("k"))).getField("k") * -1


def stats_row(photos: DataFrame) -> DataFrame:
    """A1, A5: the library's figures in one pass."""
    ok = (F.col("status") == "ok") & (F.col("hidden") == 0)
    count = lambda on: F.count_if(F.coalesce(on, F.lit(False)))
    return photos.agg(
        count(ok).alias("photos"),
        count(ok & (F.col("media_type") == "video")).alias("videos"),
        count(ok & (F.col("source_kind") == "screenshot")).alias("screenshots"),
        count(ok & F.col("place_id").isNotNull()).alias("located"),
        count(ok & F.col("taken_ts").isNull()).alias("undated"),
        count(F.col("hidden") == 1).alias("hidden"),
        count(F.col("status") == "missing").alias("missing"),
        F.sum(F.when(ok, F.col("size")).otherwise(0)).alias("bytes"),
        F.countDistinct(F.when(ok, F.col("camera_model"))).alias("cameras"),
        F.countDistinct(F.when(ok, F.col("place_id"))).alias("places"),
    )


def counts_by(rows: DataFrame, key: str) -> DataFrame:
    """A2: rows by a key, nulls as a group."""
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def per_day(photos: DataFrame) -> DataFrame:
    """A3: photos by day."""
    return photos.where(F.col("taken_ts").isNotNull()).groupBy(F.date_format(taken(), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def busiest_day(photos: DataFrame) -> DataFrame:
    """A3: the day with most photos, the earliest of several; with the number of days and of years."""
    return per_day(photos).agg(F.min_by("day", F.struct(-F.col("n"), F.col("day"))).alias("day"), F.max("n").alias("n"), F.count("*").alias("days"), F.countDistinct(F.substring("day", 1, 4)).alias("years"))


def timeline(photos: DataFrame) -> DataFrame:
    """A4: months with their count, span and cover; no screenshots, no undated photos."""
    rows = photos.where(F.col("taken_ts").isNotNull() & (F.coalesce("source_kind", F.lit("")) != "screenshot"))
    return rows.groupBy(F.date_format(taken(), "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), best_id(F.col("quality_score")).alias("cover_id"), F.min("taken_ts").alias("first_ts"), F.max("taken_ts").alias("last_ts"))


def person_counts(faces: DataFrame, photos: DataFrame) -> DataFrame:
    """Distinct photos by person."""
    seen = faces.where(F.col("person_id").isNotNull()).select("photo_id", "person_id").join(photos.select("id"), F.col("photo_id") == F.col("id"), "left_semi")
    return seen.groupBy("person_id").agg(F.countDistinct("photo_id").alias("photos"))


def person_stats(faces: DataFrame, photos: DataFrame) -> DataFrame:
    """A person's faces, photos, first and last date, mean quality, and the photo of the best face."""
    rows = faces.where(F.col("person_id").isNotNull()).join(photos.select("id", "taken_ts"), F.col("photo_id") == F.col("id"))
    size = F.col("quality") * F.least("size_px", F.lit(400.0))
    return rows.groupBy("person_id").agg(
        F.count("*").alias("faces"), F.countDistinct("photo_id").alias("photos"), F.min("taken_ts").alias("first_ts"), F.max("taken_ts").alias("last_ts"), F.round(F.avg("quality"), 6).alias("quality"), best_id(F.round(size, 6), "photo_id").alias("cover_photo")
    )


def co_occurring(faces: DataFrame, person: int, limit: int) -> DataFrame:
    """Who shares most photos with a person."""
    own = faces.where(F.col("person_id") == person).select(F.col("photo_id").alias("own")).distinct()
    others = faces.where(F.col("person_id").isNotNull() & (F.col("person_id") != person)).join(own, F.col("photo_id") == F.col("own"), "left_semi")
    return others.groupBy("person_id").agg(F.countDistinct("photo_id").alias("shared")).orderBy(F.col("shared").desc(), "person_id").limit(limit)


def constellation(faces: DataFrame, people: int = 12, pairs: int = 40) -> DataFrame:
    """Pairs, a < b, among the people with most photos, by photos that show both."""
    seen = faces.where(F.col("person_id").isNotNull()).select("photo_id", "person_id").distinct()
    top = seen.groupBy("person_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "person_id").limit(people).select("person_id")
    kept = seen.join(F.broadcast(top), "person_id")  # at most ``people`` rows are broadcast
    a, b = kept.toDF("a", "photo"), kept.toDF("b", "photo")
    return a.join(b, "photo").where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count("*").alias("shared")).orderBy(F.col("shared").desc(), "a", "b").limit(pairs)


def city_rollup(faces: DataFrame, photos: DataFrame, places: DataFrame) -> DataFrame:
    """Photos of each person by country and place."""
    seen = faces.where(F.col("person_id").isNotNull()).select("photo_id", "person_id").distinct()
    rows = seen.join(photos.select("id", "place_id"), F.col("photo_id") == F.col("id"))
    counts = rows.groupBy("person_id", "place_id").agg(F.count("*").alias("photos"))
    return counts.join(places.select(F.col("id").alias("place"), "name", "country"), F.col("place_id") == F.col("place")).select("person_id", "country", "name", "photos")


def places_list(photos: DataFrame, faces: DataFrame, places: DataFrame) -> DataFrame:
    """Places with photos, last date, people and cover."""
    seen = faces.where(F.col("person_id").isNotNull()).select("photo_id", "person_id").distinct()
    located = photos.where(F.col("place_id").isNotNull())
    people = seen.join(located.select("id", "place_id"), F.col("photo_id") == F.col("id")).groupBy("place_id").agg(F.countDistinct("person_id").alias("people"))
    own = located.groupBy("place_id").agg(F.count("*").alias("photos"), F.max("taken_ts").alias("last_ts"), best_id(F.col("quality_score")).alias("cover_id"))
    return own.join(people, "place_id", "left").join(places.select(F.col("id").alias("place_id"), "name", "country"), "place_id").select("place_id", "name", "country", "photos", "last_ts", F.coalesce("people", F.lit(0)).alias("people"), "cover_id")


def best_of_place(photos: DataFrame, top: int) -> DataFrame:
    """A place's best photos by rank."""
    rank = F.row_number().over(Window.partitionBy("place_id").orderBy(F.col("quality_score").desc_nulls_last(), "id"))
    return photos.where(F.col("place_id").isNotNull()).select("place_id", "id", rank.alias("rank")).where(F.col("rank") <= top)


def collection_counts(photos: DataFrame, named: dict[str, Column]) -> DataFrame:
    """Every collection's size and cover, from one pass over the photos."""
    tagged = F.array(*[F.struct(F.lit(name).alias("collection"), F.coalesce(on, F.lit(False)).alias("member")) for name, on in named.items()])
    rows = photos.select("id", "quality_score", F.explode(F.filter(tagged, lambda x: x["member"])).alias("c"))
    return rows.groupBy(F.col("c.collection").alias("collection")).agg(F.count("*").alias("n"), best_id(F.col("quality_score")).alias("cover_id"))


def folder_children(photos: DataFrame, parent: str) -> DataFrame:
    """The folders right below ``parent`` ('' for the top), with count and cover of all below them."""
    below = photos.where(F.col("folder").startswith(parent + "/")) if parent else photos
    child = F.split_part(F.col("folder"), F.lit("/"), F.lit(len(parent.split("/")) + 1 if parent else 1))
    return below.groupBy(child.alias("child")).agg(F.count("*").alias("n"), best_id(F.col("quality_score")).alias("cover_id")).where(F.col("child") != "")


def top_tags(photos: DataFrame, photo_tags: DataFrame, least: float = TAG_FILTER, at_least: int = 2) -> DataFrame:
    """Tags by count times mean score, of tags that ``at_least`` photos hold."""
    rows = photo_tags.where(F.col("score") >= least).join(photos.select("id"), F.col("photo_id") == F.col("id"), "left_semi")
    return rows.groupBy("tag").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("score")).where(F.col("n") >= at_least)


def category(photos: DataFrame, photo_tags: DataFrame, group: Column, bonus: tuple[str, ...] = ()) -> DataFrame:
    """The dominant tag of each group of photos, or null: by density (score sum over photos, event tags x 1.25),
    the share of photos that hold it, and how far it leads the second."""
    rows = photos.select("id", group.alias("grp"))
    sizes = rows.groupBy("grp").agg(F.count("*").alias("photos"))
    factor = F.when(F.col("tag").isin(list(bonus)), 1.25).otherwise(1.0) if bonus else F.lit(1.0)
    held = photo_tags.where(F.col("score") >= TAG_FILTER).join(rows, F.col("photo_id") == F.col("id")).groupBy("grp", "tag").agg(F.round(F.sum(F.col("score") * factor), 6).alias("total"), F.count("*").alias("n"))
    by = Window.partitionBy("grp").orderBy(F.col("total").desc(), "tag")
    ranked = held.select("grp", "tag", "total", "n", F.row_number().over(by).alias("rank"), F.lead("total").over(by).alias("second")).where(F.col("rank") == 1)
    joined = sizes.join(ranked, "grp", "left")
    density = F.col("total") / F.col("photos")
    good = (density >= CATEGORY_DENSITY) & (F.col("n") / F.col("photos") >= CATEGORY_SHARE) & (F.col("second").isNull() | (F.col("total") >= CATEGORY_DOMINANCE * F.col("second")))
    return joined.select("grp", "photos", F.when(good, F.col("tag")).alias("category"), F.round(F.when(good, F.least(F.lit(1.0), density / 1.5)), 4).alias("confidence"))


def event_covers(photos: DataFrame, group: Column) -> DataFrame:
    """A10: the cover of each group: quality (40 if unknown), 12 a face, 8 for a camera or phone."""
    score = F.coalesce("quality_score", F.lit(40.0)) + 12 * F.coalesce("face_count", F.lit(0)) + F.when(F.coalesce("source_kind", F.lit("")).isin("camera", "phone"), 8).otherwise(0)
    return photos.groupBy(group.alias("grp")).agg(best_id(F.round(score, 4)).alias("cover_id"), F.count("*").alias("photos"))


def home_places(photos: DataFrame, top: int = 2, share: float = 0.15) -> DataFrame:
    """Places by distinct days; a further one is a home only with ``share`` of the days of the first six."""
    days = photos.where(F.col("place_id").isNotNull() & F.col("taken_ts").isNotNull()).groupBy("place_id").agg(F.countDistinct(F.floor(F.col("taken_ts") / 86400)).alias("days"))
    first = days.orderBy(F.col("days").desc(), "place_id").limit(6)
    whole = Window.partitionBy(F.lit(0))  # six rows
    ranked = first.withColumn("rank", F.row_number().over(whole.orderBy(F.col("days").desc(), "place_id"))).withColumn("total", F.sum("days").over(whole))
    return ranked.where((F.col("rank") <= top) & ((F.col("rank") == 1) | (F.col("days") >= share * F.col("total")))).select("place_id", "days", "rank")


def on_this_day(photos: DataFrame, month_day: str, before_year: int, per_year: int = 8) -> DataFrame:
    """The best photos of a day of the year, for each earlier year."""
    rows = photos.where(F.col("taken_ts").isNotNull()).select("id", "quality_score", F.date_format(taken(), "MM-dd").alias("md"), F.year(taken()).alias("year")).where((F.col("md") == month_day) & (F.col("year") < before_year))
    rank = F.row_number().over(Window.partitionBy("year").orderBy(F.col("quality_score").desc_nulls_last(), "id"))
    return rows.select("year", "id", rank.alias("rank")).where(F.col("rank") <= per_year)


def spread(photos: DataFrame, per_day: int, limit: int) -> DataFrame:
    """The best photos, at most ``per_day`` of a day."""
    day = F.date_format(taken(), "yyyy-MM-dd")
    rank = F.row_number().over(Window.partitionBy("day").orderBy(F.col("quality_score").desc_nulls_last(), "id"))
    rows = photos.where(F.col("taken_ts").isNotNull()).select("id", "quality_score", day.alias("day")).withColumn("rank", rank).where(F.col("rank") <= per_day)
    return rows.orderBy(F.col("quality_score").desc_nulls_last(), "id").limit(limit).select("id", "day", "rank")
