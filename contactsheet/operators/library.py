"""Row-level security, listings, search facets, albums, samples and findings over the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contactsheet.operators.facets import best_id
from contactsheet.params import TAG_STORED
from contactsheet.storage import materialise


def readable(user: int | None, *, unlocked: bool = False) -> Column:
    """Rows one user may see: indexed or missing ones that are neither locked nor private, the locked ones
    once unlocked, and one's own private ones. Needs columns status and private_to."""
    mine = F.lit(False) if user is None else (F.col("status") == "private") & (F.col("private_to") == user)
    return F.col("status").isin("ok", "missing") & F.col("private_to").isNull() | (F.lit(unlocked) & (F.col("status") == "locked")) | F.coalesce(mine, F.lit(False))


def text_candidates(photos: DataFrame, photo_tags: DataFrame, kinds: tuple[str, ...], tags: tuple[str, ...], least: float = TAG_STORED) -> DataFrame:
    """Photos that may hold text: by their source, or by a tag; one pass, no row twice."""
    tagged = photo_tags.where(F.col("tag").isin(*tags) & (F.col("score") >= least)).select(F.col("photo_id").alias("t_id")).distinct()
    rows = photos.join(tagged, F.col("id") == F.col("t_id"), "left")
    return rows.where(F.coalesce(F.col("source_kind").isin(*kinds), F.lit(False)) | F.col("t_id").isNotNull()).drop("t_id")


def missing_from(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Distinct keys that a known set lacks."""
    have = known.select(F.col(known_key).alias(key)).distinct()
    return rows.select(key).where(F.col(key).isNotNull()).distinct().join(have, key, "left_anti")


def map_points(photos: DataFrame, places: DataFrame, limit: int) -> DataFrame:
    """Located photos, newest first, to five decimals."""
    at = places.select(F.col("id").alias("p_id"), F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))
    rows = photos.select("id", "place_id", "taken_ts").join(at, F.col("place_id") == F.col("p_id"))
    return rows.orderBy(F.col("taken_ts").desc_nulls_last(), "id").limit(limit).select("id", "lat", "lon")


def sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement, by a hash of the key and the seed: the same at every partitioning."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), key).limit(n)


def thin(points: DataFrame, key: str, ts: str, most: int) -> DataFrame:
    """At most ``most`` evenly spaced points of each track, first and last among them."""
    own = Window.partitionBy(key)
    rows = points.withColumn("i", F.row_number().over(own.orderBy(ts, "id")) - 1).withColumn("n", F.count("*").over(own))
    # Point j of the thinned track stands at floor(j * (n - 1) / (most - 1)): a row is one if some j lands on it.
    j = F.ceil(F.col("i") * (most - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    lands = F.floor(j * (F.col("n") - 1) / (most - 1)) == F.col("i")
    return rows.where((F.col("n") <= most) | lands).drop("i", "n")


def search_facets(found: DataFrame, faces: DataFrame, events: DataFrame | None = None, trips: DataFrame | None = None) -> DataFrame:
    """(facet, entity, n): matched photos by person, by place and, with ``events`` (photo_id, event), by event; with
    ``trips`` (event, trip) also by the trip that holds the event."""
    people = faces.where(F.col("person_id").isNotNull()).join(found.select("id"), F.col("photo_id") == F.col("id"), "left_semi").groupBy(F.col("person_id").cast("long").alias("entity")).agg(F.countDistinct("photo_id").alias("n"))
    by_place = found.where(F.col("place_id").isNotNull()).groupBy(F.col("place_id").cast("long").alias("entity")).agg(F.count("*").alias("n"))
    out = people.select(F.lit("person").alias("facet"), "entity", "n").unionAll(by_place.select(F.lit("place"), "entity", "n"))
    if events is not None:
        matched = events.join(found.select("id"), F.col("photo_id") == F.col("id"), "left_semi").groupBy(F.col("event").cast("long").alias("entity")).agg(F.countDistinct("photo_id").alias("n"))
        out = out.unionAll(matched.select(F.lit("event"), "entity", "n"))
        if trips is not None:
            rolled = matched.join(trips.select(F.col("event").cast("long").alias("entity"), F.col("trip").cast("long").alias("trip")), "entity").groupBy("trip").agg(F.sum("n").alias("n"))
            out = out.unionAll(rolled.select(F.lit("trip"), F.col("trip").alias("entity"), "n"))
    return out


def context_cards(found: DataFrame, every: DataFrame, group: str, *, least: int = 3, share: float = 0.12, top: int = 6) -> DataFrame:
    """The groups of which at least three photos and 12 in a hundred matched, the most matched first."""
    matched = found.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("matched"))
    sizes = every.groupBy(group).agg(F.count("*").alias("size"))
    rows = matched.join(sizes, group).where((F.col("matched") >= least) & (F.col("matched") >= share * F.col("size")))
    return rows.orderBy(F.col("matched").desc(), group).limit(top)


def album_facts(members: DataFrame, photos: DataFrame) -> DataFrame:
    """An album's visible size, span, and cover: the chosen one if it is a visible member, else the best.
    ``members`` (album, photo_id, chosen)."""
    rows = members.join(photos.select("id", "taken_ts", "quality_score"), F.col("photo_id") == F.col("id"))
    chosen = F.min(F.when(F.col("chosen"), F.col("id")))
    return rows.groupBy("album").agg(F.count("*").alias("n"), F.min("taken_ts").alias("first_ts"), F.max("taken_ts").alias("last_ts"), F.coalesce(chosen, best_id(F.col("quality_score"))).alias("cover_id"))


def person_years(faces: DataFrame, photos: DataFrame, person: int) -> DataFrame:
    """A person's photos by year with the best one: quality and 20 times the face's."""
    own = faces.where(F.col("person_id") == person).groupBy("photo_id").agg(F.max("quality").alias("q"))
    rows = own.join(photos.where(F.col("taken_ts").isNotNull()), F.col("photo_id") == F.col("id"))
    return rows.groupBy(F.year(F.timestamp_seconds("taken_ts")).alias("year")).agg(F.count("*").alias("n"), best_id(F.round(F.coalesce("quality_score", F.lit(0.0)) + 20 * F.col("q"), 6)).alias("best_id"))


def findings(photos: DataFrame, *, missing_share: float = 0.05, undated_share: float = 0.02, duplicate_share: float = 0.1) -> DataFrame:
    """(finding, n, share) of what exceeds its share of the library."""
    facts = photos.agg(F.count("*").alias("all"), F.count_if(F.col("status") == "missing").alias("missing"), F.count_if(F.col("taken_ts").isNull()).alias("undated"), (F.count("*") - F.countDistinct("sha256")).alias("duplicate"))
    rules = F.array(*[F.struct(F.lit(name).alias("finding"), F.col(name).alias("n"), F.lit(share).alias("limit")) for name, share in (("missing", missing_share), ("undated", undated_share), ("duplicate", duplicate_share))])
    rows = facts.select("all", F.inline(rules))
    return rows.where(F.col("n") > F.col("limit") * F.col("all")).select("finding", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


def suggestions(rows: DataFrame, name: str, counts: DataFrame, text: str, limit: int) -> DataFrame:
    """Names that contain a text, whatever the case, by their photos. ``rows`` (id, name), ``counts`` (id, n)."""
    held = rows.where(F.lower(name).contains(text.lower()))
    return held.join(counts, "id", "left").select("id", name, F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.col("n").desc(), "id").limit(limit)


def first_seen_order(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys in the order of their first appearance."""
    return rows.groupBy(key).agg(F.min(order).alias("place"))


def widen(found: DataFrame, base: DataFrame, photo_tags: DataFrame, tag: str, least: float = TAG_STORED) -> DataFrame:
    """What was found, and what of the base holds the tag weakly."""
    weak = photo_tags.where((F.col("tag") == tag) & (F.col("score") >= least)).select("photo_id")
    return found.select("id").unionAll(base.join(weak, F.col("id") == F.col("photo_id"), "left_semi").select("id")).distinct()


def one_to_one(rated: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """Pairs by falling score, each side once, as a greedy walk would take them: every round takes the pairs
    that are the best of both their sides, and drops what they use. Ties go to the lower left, then right."""
    rest, taken = materialise(rated.select(left, right, score), "pairs"), None
    order = [F.col(score).desc(), F.col(left), F.col(right)]
    while True:
        ranked = rest.withColumn("__l", F.row_number().over(Window.partitionBy(left).orderBy(*order))).withColumn("__r", F.row_number().over(Window.partitionBy(right).orderBy(*order)))
        best = materialise(ranked.where("__l = 1 and __r = 1").select(left, right, score), "pairs")
        if not best.limit(1).count():
            return best if taken is None else taken
        taken = best if taken is None else taken.unionAll(best)
        rest = materialise(rest.join(best.select(left), left, "left_anti").join(best.select(right), right, "left_anti").select(left, right, score), "pairs")


def name_suggestions(named: DataFrame, faces: DataFrame, contents: DataFrame, *, least: int = 3, share: float = 0.6, coverage: float = 0.5) -> DataFrame:
    """(person_id, name, photos, score): a name for a person, from names that sidecars give whole photos: on most
    of the person's photos that have any, and on few without the person. Counted by content. ``named`` (photo_id,
    name), ``faces`` (photo_id, person_id), ``contents`` (id, content)."""
    by_content = lambda rows, what: rows.join(contents, F.col("photo_id") == F.col("id")).select("content", what).distinct()
    names, people = by_content(named, "name"), by_content(faces.where(F.col("person_id").isNotNull()), "person_id")
    labelled = people.join(names.select("content").distinct(), "content", "left_semi")
    both = people.join(names, "content").groupBy("person_id", "name").agg(F.count("*").alias("photos"))
    rated = both.join(labelled.groupBy("person_id").agg(F.count("*").alias("own")), "person_id").join(names.groupBy("name").agg(F.count("*").alias("all")), "name")
    good = (F.col("photos") >= least) & (F.col("photos") >= share * F.col("own")) & (F.col("photos") >= coverage * F.col("all"))
    rated = rated.where(good).withColumn("score", F.round(F.col("photos") * F.col("photos") / F.col("own") / F.col("all"), 6))
    return one_to_one(rated, "person_id", "name", "score").join(rated.select("person_id", "name", "photos"), ["person_id", "name"]).select("person_id", "name", "photos", "score")
