"""Registered queries over filters and facets, with the SQL that checks each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactsheet.adapter import WITH, Library
from contactsheet.operators import facets, predicates
from contactsheet.operators.predicates import GridFilter, visible
from contactsheet.plans import registry

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


query = registry(QUERIES, ORACLE_SQL, WITH)


@query("SELECT id FROM visible")
def p1_visible(lib: Library) -> DataFrame:
    return visible(lib.photos).select("id")


@query(
    """SELECT id, taken_ts FROM visible WHERE archived = 0 AND taken_ts >= epoch(TIMESTAMP '1996-01-01')
  AND taken_ts < epoch(TIMESTAMP '1997-01-01') AND media_type = 'image' AND rating >= 2 AND face_count > 0
  AND coalesce(source_kind, '') <> 'screenshot' AND (folder = 'BUILDING' OR starts_with(folder, 'BUILDING/'))"""
)
def p2_grid_filter(lib: Library) -> DataFrame:
    spec = GridFilter(year=1996, media="image", min_rating=2, has_faces=True, include_screenshots=False, archived="exclude", folder="BUILDING")
    return predicates.grid(lib.photos, spec).select("id", "taken_ts")


@query("SELECT id FROM visible WHERE taken_ts >= epoch(TIMESTAMP '1997-03-01') AND taken_ts < epoch(TIMESTAMP '1997-04-01')")
def p7_year_range(lib: Library) -> DataFrame:
    return predicates.grid(lib.photos, GridFilter(year=1997, month=3)).select("id")


@query("SELECT id FROM visible v WHERE EXISTS (SELECT 1 FROM photo_tags t WHERE t.photo_id = v.id AND t.tag = (SELECT min(p_type) FROM part) AND t.score >= 2.0)")
def p9_tag_semi(lib: Library) -> DataFrame:
    tag = lib.table("part").agg(F.min("p_type").alias("tag"))
    strong = lib.photo_tags.where(F.col("score") >= 2.0).join(F.broadcast(tag), "tag", "left_semi")  # one row is broadcast
    return visible(lib.photos).join(strong, F.col("id") == F.col("photo_id"), "left_semi").select("id")


@query("SELECT id FROM visible v WHERE EXISTS (SELECT 1 FROM faces f WHERE f.photo_id = v.id AND person_id = 1) AND EXISTS (SELECT 1 FROM faces f WHERE f.photo_id = v.id AND person_id = 2)")
def p13_person_all(lib: Library) -> DataFrame:
    return predicates.with_all_persons(visible(lib.photos), lib.faces, [1, 2]).select("id")


@query("SELECT id FROM visible v WHERE EXISTS (SELECT 1 FROM faces f WHERE f.photo_id = v.id AND person_id IN (1, 2, 3))")
def p13_person_any(lib: Library) -> DataFrame:
    return predicates.with_any_person(visible(lib.photos), lib.faces, [1, 2, 3]).select("id")


@query("SELECT id FROM visible v WHERE NOT EXISTS (SELECT 1 FROM faces f WHERE f.photo_id = v.id AND person_id IN (1, 2, 3))")
def p13_person_none(lib: Library) -> DataFrame:
    return predicates.with_no_person(visible(lib.photos), lib.faces, [1, 2, 3]).select("id")


@query("SELECT id FROM visible v WHERE face_count = 0 AND NOT EXISTS (SELECT 1 FROM faces f WHERE f.photo_id = v.id AND person_id < 40)")
def p14_no_people(lib: Library) -> DataFrame:
    return predicates.without_people(visible(lib.photos), lib.faces.where(F.col("person_id") < 40)).select("id")


@query(
    """, c AS (SELECT * FROM places WHERE name IN ('NATION_4', 'NATION_10', 'NATION_7'))
SELECT id, name, city FROM places p WHERE name IN (SELECT name FROM c) OR city IN (SELECT name FROM c) OR admin1 IN (SELECT name FROM c WHERE name IN (SELECT admin1 FROM c)) OR country IN (SELECT name FROM c WHERE name IN (SELECT country FROM c))"""
)
def p15_place_expand(lib: Library) -> DataFrame:
    return predicates.expand_places(lib.places, ["NATION_4", "NATION_10", "NATION_7"]).select("id", "name", "city")


@query("SELECT id FROM photos WHERE status = 'ok' AND hidden = 1 AND live_component = 0 AND stack_hidden = 0 AND (live_video_id IS NOT NULL OR motion_offset > 0 OR rating >= 0) AND id % 3 = 0")
def p6_hidden_view(lib: Library) -> DataFrame:
    loved = lib.photos.where(F.col("id") % 3 == 0).select(F.col("id").alias("photo_id"))
    return predicates.grid(lib.photos, GridFilter(collection="hidden", collapse_stacks=True), loved).select("id")


@query("SELECT id FROM visible WHERE archived = 1 AND coalesce(source_kind, '') <> 'screenshot'")
def p6_archive_view(lib: Library) -> DataFrame:
    return predicates.grid(lib.photos, GridFilter(collection="archive", include_screenshots=False)).select("id")


@query("SELECT id FROM visible WHERE (live_video_id IS NOT NULL OR coalesce(motion_offset, 0) > 0) AND camera_model = 'cam7'")
def p12_live(lib: Library) -> DataFrame:
    return predicates.grid(lib.photos, GridFilter(media="live", camera="cam7")).select("id")


_DATED = ", d AS (SELECT *, make_timestamp((taken_ts * 1000000)::BIGINT) AS t FROM visible)\n"


@query(_DATED + "SELECT id FROM d WHERE (taken_ts BETWEEN epoch(TIMESTAMP '1996-01-01') AND epoch(TIMESTAMP '1996-12-31 23:59:59') OR taken_ts >= epoch(TIMESTAMP '2000-01-01')) AND month(t) IN (11, 12, 1)")
def p17_windows_and_months(lib: Library) -> DataFrame:
    (a, b), (c, _) = predicates.epoch_range(1996), predicates.epoch_range(2000)
    return visible(lib.photos).where(predicates.DateClause(windows=((a, b - 1), (c, None)), months=(11, 12, 1)).column()).select("id")


@query(_DATED + "SELECT id FROM d WHERE t IS NULL OR NOT (strftime(t, '%m-%d') BETWEEN '12-24' AND '12-26')")
def p17_day_span_not(lib: Library) -> DataFrame:
    return visible(lib.photos).where(predicates.DateClause(day_span=("12-24", "12-26"), exclude=True).column()).select("id")


@query(
    """SELECT id FROM visible v WHERE (live_video_id IS NOT NULL OR coalesce(motion_offset, 0) > 0 OR id % 2 = 0) AND coalesce(source_kind, '') <> 'screenshot' AND id % 4 = 0 AND face_count <= 2
  AND EXISTS (SELECT 1 FROM faces f WHERE f.photo_id = v.id AND f.x2 - f.x1 > 0.22)"""
)
def p22_selfies_and_favourites(lib: Library) -> DataFrame:
    rows = predicates.with_marks(visible(lib.photos), lib.faces, lib.photo_tags.limit(0)).withColumn("favourite", F.col("id") % 4 == 0)
    return predicates.detailed(rows, predicates.Details(favourites=True, selfies=True, best_first=True)).select("id")


@query("SELECT id FROM visible WHERE taken_ts IS NULL OR NOT (taken_ts >= epoch(TIMESTAMP '1996-01-01') AND taken_ts < epoch(TIMESTAMP '1997-01-01'))")
def p17_month_not(lib: Library) -> DataFrame:
    return visible(lib.photos).where(predicates.not_taken_in(1996)).select("id")


@query(
    """, e AS (SELECT min(p_type) AS a, max(p_type) AS b FROM part), t AS MATERIALIZED (SELECT photo_id, bool_or(tag = a) AS yes, bool_or(tag = b) AS no FROM photo_tags, e WHERE score >= 1.5 AND tag IN (a, b) GROUP BY 1)
SELECT v.id FROM visible v JOIN t ON t.photo_id = v.id WHERE yes AND NOT no"""
)
def p18_tags_include_exclude(lib: Library) -> DataFrame:
    ends = lib.table("part").agg(F.min("p_type").alias("a"), F.max("p_type").alias("b")).first()
    return predicates.with_tags(visible(lib.photos), lib.photo_tags, [ends["a"]], [ends["b"]], 1.5).select("id")


@query("""SELECT id FROM photos WHERE id % 10 = 3 OR sha256 IN (SELECT sha256 FROM photos WHERE id % 10 = 3)""")
def p19_content_membership(lib: Library) -> DataFrame:
    members = lib.photos.where(F.col("id") % 10 == 3).select(F.col("id").alias("photo_id"))
    return predicates.in_album(lib.photos, members).select("id")


@query("SELECT id FROM visible WHERE coalesce(place_id, -1) NOT IN (1, 2, 3)")
def p21_place_exclusion(lib: Library) -> DataFrame:
    return visible(lib.photos).where(predicates.not_in_places([1, 2, 3])).select("id")


@query("SELECT id, ((rating >= 5)::INT + 2 * (face_count > 0)::INT + 4 * (media_type = 'video')::INT)::INT AS flags FROM visible")
def p26_flags(lib: Library) -> DataFrame:
    return visible(lib.photos).select("id", predicates.flags().alias("flags"))


@query("""SELECT v.id, person_id, quality FROM faces f JOIN visible v ON v.id = f.photo_id WHERE person_id IS NULL AND quality >= 0.35""")
def p32_unassigned_faces(lib: Library) -> DataFrame:
    faces = lib.faces.where(F.col("person_id").isNull() & (F.col("quality") >= 0.35))
    return faces.join(visible(lib.photos).select("id"), F.col("photo_id") == F.col("id")).select("id", "person_id", "quality")


@query("SELECT id FROM photos WHERE id % 3 = 0 UNION SELECT live_video_id FROM photos WHERE id % 3 = 0 AND live_video_id IS NOT NULL")
def p33_companions(lib: Library) -> DataFrame:
    return predicates.with_companions(lib.photos.where(F.col("id") % 3 == 0))


@query(
    """SELECT count(*) FILTER (status = 'ok' AND hidden = 0) AS photos, count(*) FILTER (status = 'ok' AND hidden = 0 AND media_type = 'video') AS videos,
  count(*) FILTER (status = 'ok' AND hidden = 0 AND source_kind = 'screenshot') AS screenshots, count(*) FILTER (status = 'ok' AND hidden = 0 AND place_id IS NOT NULL) AS located,
  count(*) FILTER (status = 'ok' AND hidden = 0 AND taken_ts IS NULL) AS undated, count(*) FILTER (hidden = 1) AS hidden, count(*) FILTER (status = 'missing') AS missing,
  sum(CASE WHEN status = 'ok' AND hidden = 0 THEN size ELSE 0 END)::BIGINT AS bytes, count(DISTINCT CASE WHEN status = 'ok' AND hidden = 0 THEN camera_model END) AS cameras,
  count(DISTINCT CASE WHEN status = 'ok' AND hidden = 0 THEN place_id END) AS places FROM photos"""
)
def a1_stats_row(lib: Library) -> DataFrame:
    return facets.stats_row(lib.photos)


@query("SELECT source_kind, count(*) AS n FROM visible GROUP BY source_kind")
def a2_group_counts(lib: Library) -> DataFrame:
    return facets.counts_by(visible(lib.photos), "source_kind")


@query("SELECT strftime(make_timestamp((taken_ts * 1000000)::BIGINT), '%Y-%m-%d') AS day, count(*) AS n FROM visible WHERE taken_ts IS NOT NULL GROUP BY 1")
def a3_per_day(lib: Library) -> DataFrame:
    return facets.per_day(visible(lib.photos))


@query(
    """, d AS (SELECT strftime(make_timestamp((taken_ts * 1000000)::BIGINT), '%Y-%m-%d') AS day, count(*) AS n FROM visible WHERE taken_ts IS NOT NULL GROUP BY 1)
SELECT (SELECT day FROM d ORDER BY n DESC, day LIMIT 1) AS day, max(n) AS n, count(*) AS days, count(DISTINCT substr(day, 1, 4)) AS years FROM d"""
)
def a3_busiest_day(lib: Library) -> DataFrame:
    return facets.busiest_day(visible(lib.photos))


_TIMELINE = """, t AS (SELECT *, strftime(make_timestamp((taken_ts * 1000000)::BIGINT), '%Y-%m') AS month FROM visible
  WHERE taken_ts IS NOT NULL AND coalesce(source_kind, '') <> 'screenshot'{person})
SELECT month, count(*) AS n, arg_max(id, (quality_score, -id)) AS cover_id, min(taken_ts) AS first_ts, max(taken_ts) AS last_ts FROM t GROUP BY month"""


@query(_TIMELINE.format(person=" AND id IN (SELECT photo_id FROM faces WHERE person_id = 1)"))
def a4_timeline(lib: Library) -> DataFrame:
    return facets.timeline(predicates.with_any_person(visible(lib.photos), lib.faces, [1]))


@query(_TIMELINE.format(person=""))
def a4_timeline_all(lib: Library) -> DataFrame:
    return facets.timeline(visible(lib.photos))


@query("SELECT person_id, count(DISTINCT photo_id) AS photos FROM faces WHERE person_id IS NOT NULL AND photo_id IN (SELECT id FROM visible) GROUP BY 1")
def j2_person_counts(lib: Library) -> DataFrame:
    return facets.person_counts(lib.faces, visible(lib.photos))


@query(
    """SELECT person_id, count(*) AS faces, count(DISTINCT photo_id) AS photos, min(taken_ts) AS first_ts, max(taken_ts) AS last_ts, round(avg(quality), 6) AS quality,
  arg_max(photo_id, (round(quality * least(size_px, 400.0), 6), -photo_id)) AS cover_photo FROM faces JOIN visible ON id = photo_id WHERE person_id IS NOT NULL GROUP BY 1"""
)
def a6_person_stats(lib: Library) -> DataFrame:
    return facets.person_stats(lib.faces, visible(lib.photos))


@query(
    """SELECT f.person_id, count(DISTINCT f.photo_id) AS shared FROM faces f WHERE f.person_id <> 1 AND f.photo_id IN (SELECT photo_id FROM faces WHERE person_id = 1)
GROUP BY 1 ORDER BY shared DESC, f.person_id LIMIT 12"""
)
def j4_cooccur(lib: Library) -> DataFrame:
    return facets.co_occurring(lib.faces, 1, 12)


@query(
    """, s AS (SELECT DISTINCT photo_id, person_id FROM faces WHERE person_id IS NOT NULL),
top AS (SELECT person_id FROM s GROUP BY 1 ORDER BY count(*) DESC, person_id LIMIT 12)
SELECT x.person_id AS a, y.person_id AS b, count(*) AS shared FROM s x JOIN s y ON x.photo_id = y.photo_id AND x.person_id < y.person_id
WHERE x.person_id IN (FROM top) AND y.person_id IN (FROM top) GROUP BY 1, 2 ORDER BY shared DESC, a, b LIMIT 40"""
)
def j5_constellation(lib: Library) -> DataFrame:
    return facets.constellation(lib.faces)


@query(
    """, s AS (SELECT DISTINCT photo_id, person_id FROM faces WHERE person_id IS NOT NULL)
SELECT person_id, country, name, count(*) AS photos FROM s JOIN visible v ON v.id = photo_id JOIN places p ON p.id = v.place_id GROUP BY 1, 2, 3"""
)
def j6_city_rollup(lib: Library) -> DataFrame:
    return facets.city_rollup(lib.faces, visible(lib.photos), lib.places)


@query(
    """, c AS (SELECT place_id, count(*) AS photos, max(taken_ts) AS last_ts, arg_max(id, (quality_score, -id)) AS cover_id FROM visible WHERE place_id IS NOT NULL GROUP BY 1),
w AS (SELECT place_id, count(DISTINCT person_id) AS people FROM visible JOIN faces ON photo_id = id WHERE person_id IS NOT NULL GROUP BY 1)
SELECT c.place_id, name, country, photos, last_ts, coalesce(people, 0) AS people, cover_id FROM c LEFT JOIN w USING (place_id) JOIN places ON places.id = c.place_id"""
)
def a14_places(lib: Library) -> DataFrame:
    return facets.places_list(visible(lib.photos), lib.faces, lib.places)


@query(
    """, r AS (SELECT place_id, id, row_number() OVER (PARTITION BY place_id ORDER BY quality_score DESC NULLS LAST, id)::INT AS rank FROM visible WHERE place_id IS NOT NULL)
SELECT * FROM r WHERE rank <= 3"""
)
def a15_cover_rownum(lib: Library) -> DataFrame:
    return facets.best_of_place(visible(lib.photos), 3)


@query(
    """, t AS (SELECT photo_id, bool_or(tag IN ('SMALL', 'PROMO')) AS pet, bool_or(tag = 'LARGE') AS txt, bool_or(tag = 'MEDIUM') AS meme FROM photo_tags WHERE score >= 2.0 GROUP BY 1),
v AS (SELECT visible.*, coalesce(pet, false) AS pet, coalesce(txt, false) AS txt, coalesce(meme, false) AS meme, id IN (SELECT photo_id FROM faces WHERE x2 - x1 > 0.22) AS wide FROM visible LEFT JOIN t ON t.photo_id = id),
c AS (
  SELECT 'videos' AS collection, * FROM v WHERE media_type = 'video' UNION ALL SELECT 'live', * FROM v WHERE live_video_id IS NOT NULL OR coalesce(motion_offset, 0) > 0 UNION ALL
  SELECT 'panoramas', * FROM v WHERE media_type = 'image' AND (width / height >= 2.0 OR height / width >= 2.5) AND coalesce(source_kind, '') <> 'screenshot' UNION ALL
  SELECT 'selfies', * FROM v WHERE wide AND face_count <= 2 UNION ALL SELECT 'raw', * FROM v WHERE ext IN ('.cr2', '.cr3', '.nef', '.arw', '.dng') UNION ALL SELECT 'stacks', * FROM v WHERE stack_id = id UNION ALL
  SELECT 'pets', * FROM v WHERE pet UNION ALL SELECT 'screenshots', * FROM v WHERE source_kind = 'screenshot' UNION ALL SELECT 'documents', * FROM v WHERE txt UNION ALL SELECT 'memes', * FROM v WHERE meme UNION ALL
  SELECT 'blurry', * FROM v WHERE media_type = 'image' AND blur < 35 AND coalesce(source_kind, '') <> 'screenshot' UNION ALL SELECT 'large', * FROM v WHERE size >= 20971520 UNION ALL
  SELECT 'no_location', * FROM v WHERE place_id IS NULL AND lat IS NULL UNION ALL SELECT 'no_date', * FROM v WHERE date_confidence = 'low')
SELECT collection, count(*) AS n, arg_max(id, (quality_score, -id)) AS cover_id FROM c GROUP BY 1"""
)
def a16_collections(lib: Library) -> DataFrame:
    rows = predicates.with_marks(visible(lib.photos), lib.faces, lib.photo_tags, pets=("SMALL", "PROMO"), texts=("LARGE",), memes=("MEDIUM",))
    return facets.collection_counts(rows, predicates.collections())


@query("""SELECT split_part(folder, '/', 2) AS child, count(*) AS n, arg_max(id, (quality_score, -id)) AS cover_id FROM visible WHERE starts_with(folder, 'BUILDING/') GROUP BY 1""")
def a17_folder_browse(lib: Library) -> DataFrame:
    return facets.folder_children(visible(lib.photos), "BUILDING")


@query("SELECT tag, count(*) AS n, round(avg(score), 4) AS score FROM photo_tags WHERE score >= 2.0 AND photo_id IN (SELECT id FROM visible) GROUP BY 1 HAVING count(*) >= 2")
def a18_having(lib: Library) -> DataFrame:
    return facets.top_tags(visible(lib.photos), lib.photo_tags)


@query(
    """, g AS (SELECT place_id AS grp, count(*) AS photos FROM visible GROUP BY 1),
h AS (SELECT place_id AS grp, tag, round(sum(score), 6) AS total, count(*) AS n FROM photo_tags JOIN visible ON id = photo_id WHERE score >= 2.0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS rank, lead(total) OVER w AS second FROM h WINDOW w AS (PARTITION BY grp ORDER BY total DESC, tag)),
j AS (SELECT g.grp, photos, tag, total, n, second, (total / photos >= 0.25 AND n / photos >= 0.08 AND (second IS NULL OR total >= 1.6 * second)) AS good
  FROM g LEFT JOIN r ON g.grp = r.grp AND rank = 1)
SELECT grp, photos, CASE WHEN good THEN tag END AS category, round(CASE WHEN good THEN least(1.0, total / photos / 1.5) END, 4) AS confidence FROM j"""
)
def a9_category_density(lib: Library) -> DataFrame:
    return facets.category(visible(lib.photos), lib.photo_tags, F.col("place_id"))


@query(
    """SELECT place_id AS grp, arg_max(id, (round(coalesce(quality_score, 40.0) + 12 * face_count + CASE WHEN source_kind IN ('camera', 'phone') THEN 8 ELSE 0 END, 4), -id)) AS cover_id,
  count(*) AS photos FROM visible GROUP BY 1"""
)
def a10_event_cover(lib: Library) -> DataFrame:
    return facets.event_covers(visible(lib.photos), F.col("place_id"))


@query(
    """, d AS (SELECT place_id, count(DISTINCT floor(taken_ts / 86400)) AS days FROM visible WHERE place_id IS NOT NULL AND taken_ts IS NOT NULL GROUP BY 1 ORDER BY days DESC, place_id LIMIT 6),
r AS (SELECT *, row_number() OVER (ORDER BY days DESC, place_id)::INT AS rank, sum(days) OVER () AS total FROM d)
SELECT place_id, days, rank FROM r WHERE rank <= 2 AND (rank = 1 OR days >= 0.15 * total)"""
)
def a12_home(lib: Library) -> DataFrame:
    return facets.home_places(visible(lib.photos))


@query(
    """, m AS (SELECT id, quality_score, strftime(make_timestamp((taken_ts * 1000000)::BIGINT), '%m-%d') AS md, year(make_timestamp((taken_ts * 1000000)::BIGINT))::INT AS year FROM visible WHERE taken_ts IS NOT NULL),
r AS (SELECT year, id, row_number() OVER (PARTITION BY year ORDER BY quality_score DESC NULLS LAST, id)::INT AS rank FROM m WHERE md = '07-04' AND year < 1998)
SELECT * FROM r WHERE rank <= 8"""
)
def a26_on_this_day(lib: Library) -> DataFrame:
    return facets.on_this_day(visible(lib.photos), "07-04", 1998)


@query(
    """, d AS (SELECT id, quality_score, strftime(make_timestamp((taken_ts * 1000000)::BIGINT), '%Y-%m-%d') AS day FROM visible WHERE taken_ts IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY quality_score DESC NULLS LAST, id)::INT AS rank FROM d)
SELECT id, day, rank FROM r WHERE rank <= 2 ORDER BY quality_score DESC NULLS LAST, id LIMIT 60"""
)
def w5_spread(lib: Library) -> DataFrame:
    return facets.spread(visible(lib.photos), 2, 60)


@query("SELECT id FROM visible ORDER BY taken_ts DESC NULLS LAST, id DESC LIMIT 50 OFFSET 100")
def o6_paging(lib: Library) -> DataFrame:
    return visible(lib.photos).orderBy(F.col("taken_ts").desc_nulls_last(), F.col("id").desc()).offset(100).limit(50).select("id")


@query(
    """SELECT id, name, photos FROM (SELECT p.id, p.name, count(DISTINCT photo_id) AS photos FROM persons p JOIN faces f ON f.person_id = p.id GROUP BY 1, 2)
ORDER BY name IS NULL, photos DESC, id LIMIT 30"""
)
def o4_named_first(lib: Library) -> DataFrame:
    counts = lib.faces.where(F.col("person_id").isNotNull()).groupBy("person_id").agg(F.countDistinct("photo_id").alias("photos"))
    return lib.persons.join(counts, F.col("id") == F.col("person_id")).orderBy(F.col("name").isNull(), F.col("photos").desc(), "id").limit(30).select("id", "name", "photos")


@query("SELECT person_id, count(*) AS n FROM (SELECT person_id FROM faces WHERE quality >= 0.9 UNION ALL SELECT person_id FROM faces WHERE size_px >= 49) WHERE person_id IS NOT NULL GROUP BY 1")
def g1_union_all(lib: Library) -> DataFrame:
    both = lib.faces.where(F.col("quality") >= 0.9).select("person_id").unionAll(lib.faces.where(F.col("size_px") >= 49).select("person_id"))
    return both.where(F.col("person_id").isNotNull()).groupBy("person_id").agg(F.count("*").alias("n"))
