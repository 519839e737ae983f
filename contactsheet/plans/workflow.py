"""Registered queries over work lists, exports, uploads, events and inferred places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contactsheet.adapter import WITH, Library
from contactsheet.functions import scores
from contactsheet.operators import places, predicates, segments, workflow
from contactsheet.operators.facets import home_places
from contactsheet.operators.predicates import visible
from contactsheet.plans import registry

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
query = registry(QUERIES, ORACLE_SQL, WITH)

_EVENTS = """, members AS (SELECT camera_model || '/' || floor(taken_ts / 2592000)::BIGINT AS event, id AS photo_id FROM visible WHERE taken_ts IS NOT NULL)
"""


def _members(lib: Library) -> DataFrame:
    rows = visible(lib.photos).where(F.col("taken_ts").isNotNull())
    return rows.select(F.concat_ws("/", "camera_model", F.floor(F.col("taken_ts") / 2592000).cast("string")).alias("event"), F.col("id").alias("photo_id"))


@query(
    """, s AS (SELECT id, CASE WHEN id % 10 = 0 THEN 'error' ELSE status END AS status, CASE WHEN id % 3 <> 0 THEN id % 5 END AS meta, CASE WHEN id % 4 <> 0 THEN id % 7 END AS faces FROM photos)
SELECT id, coalesce(meta < 3, true) AS need_meta, coalesce(faces < 2, true) AS need_faces FROM s WHERE status NOT IN ('missing', 'error') AND (coalesce(meta < 3, true) OR coalesce(faces < 2, true))"""
)
def s4_pending(lib: Library) -> DataFrame:
    k = F.col("id")
    rows = lib.photos.select("id", F.when(k % 10 == 0, "error").otherwise(F.col("status")).alias("status"), F.when(k % 3 != 0, k % 5).alias("meta"), F.when(k % 4 != 0, k % 7).alias("faces"))
    return workflow.pending(rows, {"meta": 3, "faces": 2})


@query("SELECT min(id) AS upload_id, sha256 FROM photos WHERE id % 6 = 1 AND sha256 NOT IN (SELECT sha256 FROM photos WHERE id % 5 = 0) GROUP BY sha256")
def s16_new_uploads(lib: Library) -> DataFrame:
    uploads = lib.photos.where(F.col("id") % 6 == 1).select(F.col("id").alias("upload_id"), "sha256")
    return workflow.new_uploads(uploads, lib.photos.where(F.col("id") % 5 == 0))


@query(
    """, f AS (SELECT substr(folder || CASE WHEN id % 3 = 0 THEN '' ELSE '/' || filename END, 10) AS rest, size FROM visible WHERE starts_with(folder || '/', 'BUILDING/'))
SELECT split_part(rest, '/', 1) AS name, contains(rest, '/') AS is_dir, sum(CASE WHEN NOT contains(rest, '/') THEN size END)::BIGINT AS size FROM f WHERE rest <> '' GROUP BY 1, 2"""
)
def s17_list_folder(lib: Library) -> DataFrame:
    path = F.when(F.col("id") % 3 == 0, F.col("folder")).otherwise(F.concat_ws("/", "folder", "filename"))
    return workflow.list_folder(visible(lib.photos).select(path.alias("path"), "size"), "BUILDING")


@query(
    """, e AS (SELECT id, coalesce(strftime(make_timestamp((taken_ts * 1000000)::BIGINT), '%Y/%m'), 'Undated') AS folder, camera_model || '.jpg' AS f, size FROM visible),
n AS (SELECT *, row_number() OVER (PARTITION BY folder, f ORDER BY id) AS r FROM e)
SELECT id, folder, CASE WHEN r = 1 THEN f ELSE replace(f, '.jpg', ' (' || r || ').jpg') END AS name, size FROM n"""
)
def p3_export_plan(lib: Library) -> DataFrame:
    return workflow.export_plan(visible(lib.photos).withColumn("filename", F.concat("camera_model", F.lit(".jpg"))), "date")


_GROUPS = """, b AS (SELECT id FROM visible WHERE rating >= 3), w AS (SELECT DISTINCT photo_id AS id, person_id, name FROM faces JOIN persons p ON p.id = person_id WHERE p.id % 5 = 1 AND photo_id IN (SELECT id FROM b)),
c AS ({chosen}),
x AS (SELECT label, id FROM c UNION SELECT label, p.id FROM c JOIN photos p ON p.stack_id = c.id WHERE status = 'ok' UNION SELECT label, v.id FROM c JOIN photos p ON p.id = c.id JOIN photos v ON v.id = p.live_video_id WHERE v.status = 'ok'),
r AS (SELECT label, id, CASE WHEN label = '' THEN '' ELSE label || '/' END || coalesce(strftime(make_timestamp((taken_ts * 1000000)::BIGINT), '%Y/%m'), 'Undated') AS folder, camera_model AS f, size FROM x JOIN photos USING (id)),
n AS (SELECT *, row_number() OVER (PARTITION BY folder, f ORDER BY id) AS k FROM r)
SELECT label, id, folder, CASE WHEN k = 1 THEN f || '.jpg' ELSE f || ' (' || k || ').jpg' END AS name, size FROM n"""


def _export(lib: Library, mode: str, one_in: int = 5) -> DataFrame:
    photos = lib.photos.withColumn("filename", F.concat("camera_model", F.lit(".jpg")))
    people = lib.persons.where(F.col("id") % one_in == 1).select("id", F.col("name").alias("label"))
    return workflow.export_groups(visible(photos).where(F.col("rating") >= 3), photos, "date", faces=lib.faces, people=people, mode=mode, frames=True, films=True)


@query(_GROUPS.format(chosen="SELECT name AS label, id FROM w"))
def p3_export_each(lib: Library) -> DataFrame:
    return _export(lib, "each")


@query(_GROUPS.format(chosen="SELECT '' AS label, id FROM w WHERE person_id % 50 = 1 GROUP BY id HAVING count(DISTINCT person_id) = (SELECT count(*) FROM persons WHERE id % 50 = 1)"))
def p3_export_together(lib: Library) -> DataFrame:
    return _export(lib, "together", 50)


@query(_GROUPS.format(chosen="SELECT DISTINCT '' AS label, id FROM w"))
def p3_export_any(lib: Library) -> DataFrame:
    return _export(lib, "any")


@query(
    """, c AS (SELECT id, rating::BIGINT AS place FROM photos WHERE id % 50 = 7), x AS (SELECT id, 0 AS later, place FROM c UNION ALL SELECT id, 1, id FROM photos WHERE status = 'ok' AND (id // 50) * 50 + 7 IN (SELECT id FROM c) AND id % 2 = 1)
SELECT id, min(later) AS later, arg_min(place, (later, place)) AS place FROM x GROUP BY id"""
)
def p35_expand(lib: Library) -> DataFrame:
    chosen = lib.photos.where(F.col("id") % 50 == 7).select("id", F.col("rating").alias("place"))
    rows = lib.photos.withColumn("partner", F.when(F.col("id") % 2 == 1, F.floor(F.col("id") / 50) * 50 + 7))
    return workflow.expand(chosen, rows, "partner")


@query("SELECT id, id % 40 = 2 AS is_cover FROM visible WHERE id % 3 <> 0 ORDER BY id % 40 <> 2, coalesce(quality_score, 0) DESC, id LIMIT 100")
def p34_caption_batch(lib: Library) -> DataFrame:
    covers = lib.photos.where(F.col("id") % 40 == 2).select(F.col("id").alias("cover_id"))
    return workflow.caption_batch(visible(lib.photos), covers, lib.photos.where(F.col("id") % 3 == 0).select(F.col("id").alias("photo_id")), 100)


@query("SELECT id, taken_ts + 86400 * (id % 60) AS expires_at FROM photos WHERE taken_ts + 86400 * (id % 60) <= 820454400")
def t10_expired(lib: Library) -> DataFrame:
    return workflow.expired(lib.photos.select("id", (F.col("taken_ts") + 86400 * (F.col("id") % 60)).alias("expires_at")), 820454400.0)


@query("SELECT DISTINCT u.id % 20 AS album_id, p.id AS photo_id FROM photos u JOIN photos p ON p.sha256 = u.sha256 WHERE u.id % 9 = 0 AND u.id % 20 % 3 <> 0 AND u.id % 20 <> 4 AND u.id % 2 = 0")
def j19_album_links(lib: Library) -> DataFrame:
    uploads = lib.photos.where(F.col("id") % 9 == 0).select("sha256", F.when(F.col("id") % 2 == 0, F.col("id") % 20).alias("album_id"))
    albums = lib.photos.select((F.col("id") % 20).alias("album_id")).distinct().withColumn("kind", F.when(F.col("album_id") % 3 == 0, "smart").otherwise("manual")).withColumn("hidden", (F.col("album_id") == 4).cast("int"))
    return workflow.album_links(uploads, lib.photos, albums)


@query(
    """, m AS (SELECT id, folder, id % 199 AS stem, CASE WHEN id % 5 = 0 THEN 'raw' ELSE 'image' END AS t FROM visible), v AS (SELECT folder, stem, min(id) AS view_id FROM m WHERE t = 'image' GROUP BY 1, 2)
SELECT id AS raw_id, view_id FROM m JOIN v USING (folder, stem) WHERE t = 'raw'"""
)
def j13_raw_pairs(lib: Library) -> DataFrame:
    rows = visible(lib.photos).select("id", "folder", (F.col("id") % 199).alias("stem"), F.when(F.col("id") % 5 == 0, "raw").otherwise("image").alias("media_type"))
    return workflow.raw_pairs(rows)


@query("SELECT folder, camera_model AS img_name, min(id) AS id FROM visible GROUP BY 1, 2 HAVING count(*) = 1")
def j17_unambiguous(lib: Library) -> DataFrame:
    rows = visible(lib.photos)
    return workflow.unambiguous(rows.select("folder", F.upper("camera_model").alias("img_name")).distinct(), rows.select("id", "folder", F.col("camera_model").alias("filename"))).withColumn("img_name", F.lower("img_name"))


@query(
    _EVENTS
    + """, c AS (SELECT event, count(*) AS photos, max(CASE WHEN place_id % 4 = 0 THEN 3 WHEN place_id % 4 = 1 THEN 2 WHEN place_id % 4 = 2 THEN 1 ELSE 0 END) AS r FROM members JOIN visible ON id = photo_id GROUP BY 1),
f AS (SELECT event, count(DISTINCT person_id) AS people FROM members JOIN faces USING (photo_id) WHERE person_id IS NOT NULL GROUP BY 1)
SELECT event, photos, coalesce(people, 0) AS people, ['unknown', 'low', 'medium', 'high'][r + 1] AS confidence FROM c LEFT JOIN f USING (event)"""
)
def a8_event_stats(lib: Library) -> DataFrame:
    p = F.col("place_id") % 4
    rows = visible(lib.photos).withColumn("location_confidence", F.when(p == 0, "high").when(p == 1, "medium").when(p == 2, "low"))
    return workflow.event_stats(_members(lib), rows, lib.faces)


@query(
    _EVENTS
    + """, e AS (SELECT event, min(photo_id) AS cover_id FROM members GROUP BY 1), s AS (SELECT * FROM visible WHERE archived = 0),
b AS (SELECT event, arg_max(id, (coalesce(rating, 0), coalesce(quality_score, 0), -id)) AS best FROM members JOIN s ON id = photo_id GROUP BY 1)
SELECT event, CASE WHEN cover_id IN (SELECT id FROM s) THEN cover_id ELSE best END AS cover_id FROM e LEFT JOIN b USING (event)"""
)
def a32_visible_cover(lib: Library) -> DataFrame:
    events = _members(lib).groupBy("event").agg(F.min("photo_id").alias("cover_id"))
    return workflow.visible_covers(events, _members(lib), visible(lib.photos).where(F.col("archived") == 0))


@query(
    """, p AS (SELECT id, CASE WHEN id % 6 = 0 THEN folder END AS event, camera_model, taken_ts, CASE WHEN id % 4 = 0 THEN place_id END AS place_id FROM visible),
c AS (SELECT event, place_id, count(*) AS n FROM p WHERE event IS NOT NULL AND place_id IS NOT NULL GROUP BY 1, 2), m AS (SELECT event, arg_min(place_id, (-n, place_id)) AS of_event FROM c GROUP BY 1),
w AS (SELECT *, last_value(CASE WHEN place_id IS NOT NULL THEN {'t': taken_ts, 'v': place_id} END IGNORE NULLS) OVER (PARTITION BY camera_model ORDER BY taken_ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
  first_value(CASE WHEN place_id IS NOT NULL THEN {'t': taken_ts, 'v': place_id} END IGNORE NULLS) OVER (PARTITION BY camera_model ORDER BY taken_ts, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM p WHERE taken_ts IS NOT NULL),
t AS (SELECT id, coalesce(CASE WHEN abs(taken_ts - b.t) <= 604800 THEN b.v END, CASE WHEN abs(taken_ts - a.t) <= 604800 THEN a.v END) AS of_time FROM w)
SELECT p.id, coalesce(place_id, of_event, of_time, of_folder) AS place_id, CASE WHEN place_id IS NOT NULL THEN 'gps' WHEN of_event IS NOT NULL THEN 'event' WHEN of_time IS NOT NULL THEN 'nearby_time' WHEN of_folder IS NOT NULL THEN 'folder' END AS location_source
FROM p LEFT JOIN m USING (event) LEFT JOIN t ON t.id = p.id LEFT JOIN (SELECT id, r_regionkey AS of_folder FROM visible JOIN region ON id % 5 = r_regionkey WHERE id % 7 = 0 AND r_regionkey <> 3) f ON f.id = p.id"""
)
def m22_infer_places(lib: Library) -> DataFrame:
    rows = visible(lib.photos).select("id", F.when(F.col("id") % 6 == 0, F.col("folder")).alias("event"), "camera_model", "taken_ts", F.when(F.col("id") % 4 == 0, F.col("place_id")).alias("place_id"))
    # One photo in seven lies in a folder named after a region; one region is too small to count.
    region = lib.table("region")
    paths = visible(lib.photos).where(F.col("id") % 7 == 0).join(region, F.col("id") % 5 == F.col("r_regionkey")).select("id", F.concat_ws("/", F.lit("2019"), F.concat(F.lit("Trip to "), F.initcap("r_name"))).alias("folder"))
    cities = region.select(F.col("r_regionkey").alias("place_id"), F.col("r_name").alias("name"), F.when(F.col("r_regionkey") == 3, 400).otherwise(90_000).alias("population"))
    return workflow.infer_places(rows, within=604800.0, folder_places=places.names_in_path(paths, cities, skip=("trip",)))


@query(
    """, d AS (SELECT place_id, count(DISTINCT floor(taken_ts / 86400)) AS days FROM visible WHERE place_id IS NOT NULL AND taken_ts IS NOT NULL GROUP BY 1 ORDER BY days DESC, place_id LIMIT 2),
h AS (SELECT lat AS hlat, lon AS hlon FROM places WHERE id IN (SELECT place_id FROM d))
SELECT id, round(min(2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(hlat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(hlat)) * pow(sin(radians(hlon - lon) / 2), 2))))), 4) AS km FROM places, h GROUP BY 1"""
)
def j30_home_distance(lib: Library) -> DataFrame:
    homes = home_places(visible(lib.photos), share=0.0).join(lib.places, F.col("place_id") == F.col("id"))
    return workflow.home_distance(lib.places, homes)


@query(
    """, c AS (SELECT DISTINCT round(lat, 1) AS lat, round(lon, 1) AS lon FROM visible WHERE lat IS NOT NULL),
d AS (SELECT c.lat, c.lon, p.id, round(2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(p.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - c.lon) / 2), 2)))), 6) AS km FROM c, places p),
n AS (SELECT lat, lon, id AS place_id FROM d WHERE km <= 60 QUALIFY row_number() OVER (PARTITION BY lat, lon ORDER BY km, id) = 1)
SELECT v.id, place_id FROM (SELECT id, round(lat, 1) AS lat, round(lon, 1) AS lon FROM visible WHERE lat IS NOT NULL) v LEFT JOIN n USING (lat, lon)"""
)
def m23_geocode(lib: Library) -> DataFrame:
    spots = lib.places.select(F.col("id").alias("place_id"), "lat", "lon")
    return workflow.geocode(visible(lib.photos), lambda cells: places.nearest_within(cells, spots, 60.0).select("id", "place_id"), 1)


@query("SELECT DISTINCT round(s_acctbal / 100, 0) AS lat, round(s_acctbal / 50, 0) AS lon FROM supplier")
def m23_cells(lib: Library) -> DataFrame:
    return workflow.cells(lib.table("supplier").select((F.col("s_acctbal") / 100).alias("lat"), (F.col("s_acctbal") / 50).alias("lon")), 0)


@query("SELECT photo_id, person_id, quality FROM faces WHERE quality >= 0.35 AND size_px >= 40 AND size_px / 50 >= 0.6")
def p28_clusterable(lib: Library) -> DataFrame:
    return lib.faces.withColumn("det_score", F.col("size_px") / 50).where(workflow.clusterable()).select("photo_id", "person_id", "quality")


@query("SELECT photo_id, coalesce(CASE WHEN photo_id % 3 <> 0 THEN quality END, 0.0) AS sure, size_px FROM faces WHERE person_id = 1 ORDER BY sure, photo_id, size_px LIMIT 40 OFFSET 10")
def p31_face_review(lib: Library) -> DataFrame:
    return workflow.review_order(lib.faces.withColumn("confidence", F.when(F.col("photo_id") % 3 != 0, F.col("quality"))), 1, 40, 10)


@query(
    """, c AS (SELECT photo_id % 60 AS label, person_id, count(*) AS n FROM faces WHERE person_id IS NOT NULL GROUP BY 1, 2), o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY n DESC, label DESC) = 1)
SELECT label, person_id, n FROM o QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, person_id) = 1"""
)
def g10_continue_identities(lib: Library) -> DataFrame:
    return workflow.continue_identities(lib.faces.select((F.col("photo_id") % 60).alias("label"), "person_id"))


@query(
    """, b AS (SELECT photo_id, max(quality) AS fq FROM faces GROUP BY 1), q AS (SELECT v.*, fq, (v.id % 100) / 100.0::DOUBLE AS brightness, (v.id % 40) / 100.0::DOUBLE AS clipped, (v.id % 30) / 100.0::DOUBLE AS contrast FROM visible v LEFT JOIN b ON b.photo_id = v.id),
s AS (SELECT *, CASE WHEN blur > 0 THEN least(1, greatest(0, (log10(blur) - 1.2) / (2.9::DOUBLE - 1.2))) ELSE 0 END AS sharp,
  greatest(0, 0.5 * (1 - pow(least(1, abs(brightness - 0.47) / 0.47), 1.5)) + 0.25 * least(1, contrast / 0.22) + 0.25 * (1 - least(1, clipped / 0.35))) AS exposed, least(1, greatest(0, log2(greatest(width::DOUBLE * height / 1e6, 0.05) / 0.3) / log2(40.0))) AS fine FROM q)
SELECT id, round(fq, 6) AS face_quality, round(100 * (0.35 * sharp + 0.2 * exposed + 0.1 * fine + coalesce(fq * 0.1, 0)) / (0.65 + CASE WHEN fq IS NULL THEN 0 ELSE 0.1 END) * CASE WHEN source_kind = 'screenshot' THEN 0.5 WHEN source_kind IN ('whatsapp', 'download') THEN 0.85 ELSE 1 END, 2) AS quality FROM s"""
)
def m5_recompute_quality(lib: Library) -> DataFrame:
    k = F.col("id")
    rows = visible(lib.photos).withColumn("brightness", (k % 100) / 100.0).withColumn("clipped", (k % 40) / 100.0).withColumn("contrast", (k % 30) / 100.0)
    return workflow.recompute_quality(rows, lib.faces)


@query("SELECT id // 20 AS entry, string_agg(id::VARCHAR, ',' ORDER BY id) AS photo_ids FROM visible GROUP BY 1")
def p29_redacted_log(lib: Library) -> DataFrame:
    log = lib.photos.groupBy(F.floor(F.col("id") / 20).alias("entry")).agg(F.array_sort(F.collect_list("id")).alias("photo_ids"))  # an entry lists 20 photos
    return workflow.redacted_log(log, visible(lib.photos)).select("entry", F.array_join(F.col("photo_ids").cast("array<string>"), ",").alias("photo_ids"))


@query(
    """SELECT id AS grp, CASE id % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'near' ELSE 'similar' END AS kind, rating AS members, size AS reclaimable FROM visible
ORDER BY CASE id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END, rating DESC, id LIMIT 4000"""
)
def a23_duplicate_listing(lib: Library) -> DataFrame:
    k = F.col("id") % 3
    groups = visible(lib.photos).select(F.col("id").alias("grp"), F.when(k == 0, "exact").when(k == 1, "near").otherwise("similar").alias("kind"), F.col("rating").alias("members"), F.col("size").alias("reclaimable"))
    return workflow.duplicate_listing(groups, ("exact", "near", "similar"), 4000)


@query("SELECT user_id, count(DISTINCT id) AS n FROM (SELECT user_id, event_id AS id FROM events) JOIN visible USING (id) GROUP BY 1")
def a37_favourites(lib: Library) -> DataFrame:
    return workflow.favourites(lib.table("events").select("user_id", F.col("event_id").alias("photo_id")), visible(lib.photos))


@query("SELECT source_kind, count(*) AS n, arg_max(id, (quality_score, -id)) AS best_id FROM visible GROUP BY 1")
def a25_best_by_source(lib: Library) -> DataFrame:
    return workflow.best_by_source(visible(lib.photos))


@query(
    """, s AS (SELECT camera_model, folder AS top, taken_ts AS start_ts, taken_ts AS end_ts, row_number() OVER (PARTITION BY camera_model ORDER BY taken_ts, id)::BIGINT AS segment FROM visible WHERE taken_ts IS NOT NULL),
m AS (SELECT camera_model, segment, end_ts AS e, 0::BIGINT AS event, top AS t FROM s WHERE segment = 1 UNION ALL
  SELECT s.camera_model, s.segment, greatest(e, end_ts), CASE WHEN (floor(e / 86400) = floor(start_ts / 86400) OR (start_ts - e) / 3600 <= 240) AND (start_ts - e) / 3600 <= 240 AND top = t THEN event ELSE event + 1 END, top
  FROM m JOIN s ON s.camera_model = m.camera_model AND s.segment = m.segment + 1)
SELECT camera_model, segment, event FROM m""",
    recursive=True,
)
def w3_multiday_merge(lib: Library) -> DataFrame:
    rows = visible(lib.photos).where(F.col("taken_ts").isNotNull())
    order = Window.partitionBy("camera_model").orderBy("taken_ts", "id")
    parts = rows.select("camera_model", F.row_number().over(order).cast("long").alias("segment"), F.col("taken_ts").alias("start_ts"), F.col("taken_ts").alias("end_ts"), F.col("folder").alias("top"))
    return segments.merge_sessions(parts, "camera_model", cap_hours=240.0, overnight_hours=240.0)


@query(_EVENTS + "SELECT id FROM visible WHERE folder = 'BUILDING/1996/03' OR id IN (SELECT photo_id FROM members WHERE event = 'cam1/320')")
def p16_event_or_trip(lib: Library) -> DataFrame:
    trips = _members(lib).select(F.when(F.col("event") == "cam1/320", "BUILDING/1996/03").otherwise(F.col("event")).alias("trip"), "photo_id")
    return predicates.in_event(visible(lib.photos), F.col("folder"), trips, "BUILDING/1996/03").select("id")


@query(
    """SELECT id FROM visible WHERE media_type <> 'video' AND source_kind IN ('phone', 'camera', 'download') AND coalesce(rating, 0) >= 1 AND coalesce(source_kind, '') <> 'screenshot'
  AND face_count BETWEEN 1 AND 2 AND (id % 5 = 0 OR id % 5 = 2)"""
)
def p22_details(lib: Library) -> DataFrame:
    colour = F.element_at(F.array(*map(F.lit, ("red", "green", "blue", "white", None))), (F.col("id") % 5 + 1).cast("int"))
    rows = visible(lib.photos).withColumn("colours", F.when(F.col("id") % 5 != 4, F.array(colour, F.lit("grey"))))
    return predicates.detailed(rows, predicates.Details(False, ("phone", "camera", "download"), 1, ("red", "blue"), False, 1, 2)).select("id")


@query(
    """SELECT id, round(1 / (1 + exp(-30 * (quality_score / 1e6 - 0.2))), 6) AS aesthetic, round(least(1.0, greatest(0.0, (rating - 1) / 3)), 6) AS confidence, round(1 / (1 + exp(-(rating * 0.5 - 1))), 6) AS probability,
  CASE WHEN id % 4 IN (1, 3) THEN height ELSE width END AS w, CASE WHEN id % 4 IN (1, 3) THEN width ELSE height END AS h FROM visible"""
)
def m11_scores(lib: Library) -> DataFrame:
    size = scores.shown_size(F.col("width"), F.col("height"), (F.col("id") % 4 * 90).cast("int"))
    shown = visible(lib.photos).withColumn("s", size)
    return shown.select("id", F.round(scores.aesthetic(F.col("quality_score") / 1e6, F.lit(0.2)), 6).alias("aesthetic"), F.round(scores.tag_confidence(F.col("rating")), 6).alias("confidence"), F.round(scores.probability(F.col("rating"), 0.5, -1.0), 6).alias("probability"), F.col("s.w").alias("w"), F.col("s.h").alias("h"))
