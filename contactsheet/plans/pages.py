"""Registered queries behind the library's pages: listings, facets, albums, samples and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactsheet.adapter import WITH, Library
from contactsheet.operators import library
from contactsheet.operators.predicates import visible
from contactsheet.plans import registry

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
query = registry(QUERIES, ORACLE_SQL, WITH)

_SECURED = """, s AS (SELECT id, CASE WHEN id % 12 = 0 THEN 'locked' WHEN id % 12 = 1 THEN 'private' ELSE status END AS status, CASE WHEN id % 12 = 1 THEN id % 3 END AS private_to FROM photos)
"""


@query(_SECURED + "SELECT id FROM s WHERE (status IN ('ok', 'missing') AND private_to IS NULL) OR status = 'locked' OR (status = 'private' AND private_to = 1)")
def p23_row_visibility(lib: Library) -> DataFrame:
    k = F.col("id") % 12
    rows = lib.photos.select("id", F.when(k == 0, "locked").when(k == 1, "private").otherwise(F.col("status")).alias("status"), F.when(k == 1, F.col("id") % 3).alias("private_to"))
    return rows.where(library.readable(1, unlocked=True)).select("id")


@query("SELECT id FROM visible WHERE source_kind IN ('screenshot', 'download') OR id IN (SELECT photo_id FROM photo_tags WHERE tag LIKE 'S%' AND tag = 'SMALL' AND score >= 1.5)")
def p27_text_candidates(lib: Library) -> DataFrame:
    return library.text_candidates(visible(lib.photos), lib.photo_tags, ("screenshot", "download"), ("SMALL",)).select("id")


@query("SELECT DISTINCT sha256 FROM visible WHERE sha256 NOT IN (SELECT sha256 FROM photos WHERE id % 3 = 0)")
def p36_missing_thumbs(lib: Library) -> DataFrame:
    return library.missing_from(visible(lib.photos), "sha256", lib.photos.where(F.col("id") % 3 == 0), "sha256")


@query("SELECT v.id, round(p.lat, 5) AS lat, round(p.lon, 5) AS lon FROM visible v JOIN places p ON p.id = place_id ORDER BY taken_ts DESC NULLS LAST, v.id LIMIT 500")
def p40_map_points(lib: Library) -> DataFrame:
    return library.map_points(visible(lib.photos), lib.places, 500)


@query("SELECT id FROM visible ORDER BY md5(id || ':7'), id LIMIT 40")
def o8_sample(lib: Library) -> DataFrame:
    return library.sample(visible(lib.photos), "id", 40, 7).select("id")


@query(
    """, t AS (SELECT camera_model AS track, taken_ts, id, row_number() OVER (PARTITION BY camera_model ORDER BY taken_ts, id) - 1 AS i, count(*) OVER (PARTITION BY camera_model) AS n FROM visible WHERE taken_ts IS NOT NULL)
SELECT track, taken_ts, id FROM t WHERE n <= 50 OR i IN (SELECT floor(j * (t.n - 1) / 49) FROM range(50) r(j))"""
)
def o9_thin(lib: Library) -> DataFrame:
    points = visible(lib.photos).where(F.col("taken_ts").isNotNull()).select(F.col("camera_model").alias("track"), "taken_ts", "id")
    return library.thin(points, "track", "taken_ts", 50)


@query(
    """, f AS (SELECT * FROM visible WHERE rating >= 4)
SELECT 'person' AS facet, person_id AS entity, count(DISTINCT photo_id) AS n FROM faces WHERE person_id IS NOT NULL AND photo_id IN (SELECT id FROM f) GROUP BY 2
UNION ALL SELECT 'place', place_id, count(*) FROM f WHERE place_id IS NOT NULL GROUP BY 2 UNION ALL SELECT 'event', id // 50, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'trip', id // 50 // 10, count(*) FROM f WHERE id // 50 % 3 = 0 GROUP BY 2"""
)
def a20_search_facets(lib: Library) -> DataFrame:
    events = lib.photos.select(F.col("id").alias("photo_id"), F.floor(F.col("id") / 50).alias("event"))
    trips = events.select("event", F.floor(F.col("event") / 10).alias("trip")).where(F.col("event") % 3 == 0).distinct()
    return library.search_facets(visible(lib.photos).where(F.col("rating") >= 4), lib.faces, events, trips)


@query(
    """, m AS (SELECT folder, count(*) AS matched FROM visible WHERE rating >= 4 GROUP BY 1), s AS (SELECT folder, count(*) AS size FROM visible GROUP BY 1)
SELECT folder, matched, size FROM m JOIN s USING (folder) WHERE matched >= 3 AND matched >= 0.12 * size ORDER BY matched DESC, folder LIMIT 6"""
)
def a21_context_cards(lib: Library) -> DataFrame:
    return library.context_cards(visible(lib.photos).where(F.col("rating") >= 4), visible(lib.photos), "folder")


@query(
    """, m AS (SELECT id % 50 AS album, id AS photo_id, id % 350 = id % 50 AS chosen FROM photos)
SELECT album, count(*) AS n, min(taken_ts) AS first_ts, max(taken_ts) AS last_ts, coalesce(min(id) FILTER (chosen), arg_max(id, (quality_score, -id))) AS cover_id FROM m JOIN visible ON id = photo_id GROUP BY 1"""
)
def a35_albums(lib: Library) -> DataFrame:
    k = F.col("id")
    members = lib.photos.select((k % 50).alias("album"), k.alias("photo_id"), (k % 350 == k % 50).alias("chosen"))
    return library.album_facts(members, visible(lib.photos))


@query(
    """, o AS (SELECT photo_id, max(quality) AS q FROM faces WHERE person_id = 1 GROUP BY 1)
SELECT year(make_timestamp((taken_ts * 1000000)::BIGINT))::INT AS year, count(*) AS n, arg_max(id, (round(coalesce(quality_score, 0) + 20 * q, 6), -id)) AS best_id FROM o JOIN visible ON id = photo_id WHERE taken_ts IS NOT NULL GROUP BY 1"""
)
def a25_person_detail(lib: Library) -> DataFrame:
    return library.person_years(lib.faces, visible(lib.photos), 1)


@query(
    """, f AS (SELECT count(*) AS a, count(*) FILTER (status = 'missing') AS m, count(*) FILTER (taken_ts IS NULL) AS u, count(*) - count(DISTINCT sha256) AS d FROM photos)
SELECT finding, n, round(n / a, 6) AS share FROM (SELECT 'missing' AS finding, m AS n, 0.05 AS l, a FROM f UNION ALL SELECT 'undated', u, 0.02, a FROM f UNION ALL SELECT 'duplicate', d, 0.1, a FROM f) WHERE n > l * a"""
)
def a36_findings(lib: Library) -> DataFrame:
    return library.findings(lib.photos)


@query(
    """, c AS (SELECT person_id AS id, count(DISTINCT photo_id) AS n FROM faces WHERE person_id IS NOT NULL GROUP BY 1)
SELECT p.id, name, coalesce(n, 0) AS n FROM persons p LEFT JOIN c ON c.id = p.id WHERE contains(lower(name), '00001') ORDER BY n DESC, p.id LIMIT 8"""
)
def a34_suggestions(lib: Library) -> DataFrame:
    counts = lib.faces.where(F.col("person_id").isNotNull()).groupBy(F.col("person_id").alias("id")).agg(F.countDistinct("photo_id").alias("n"))
    return library.suggestions(lib.persons, "name", counts, "00001", 8)


@query("SELECT camera_model, min(id) AS place FROM visible GROUP BY 1")
def g3_first_seen(lib: Library) -> DataFrame:
    return library.first_seen_order(visible(lib.photos), "camera_model", "id")


@query("SELECT id FROM visible WHERE rating = 5 UNION SELECT id FROM visible WHERE id IN (SELECT photo_id FROM photo_tags WHERE tag = 'SMALL' AND score >= 1.5)")
def g2_widen(lib: Library) -> DataFrame:
    rows = visible(lib.photos)
    return library.widen(rows.where(F.col("rating") == 5), rows, lib.photo_tags, "SMALL")


@query(
    """, c AS (SELECT id, sha256 AS content FROM photos), n AS (SELECT DISTINCT content, 'name' || person_id AS name FROM faces JOIN c ON c.id = photo_id WHERE person_id % 5 = 0 AND photo_id % 4 <> 0),
w AS (SELECT DISTINCT content, person_id FROM faces JOIN c ON c.id = photo_id WHERE person_id IS NOT NULL), b AS (SELECT person_id, name, count(*) AS photos FROM w JOIN n USING (content) GROUP BY 1, 2),
o AS (SELECT person_id, count(*) AS own FROM w WHERE content IN (SELECT content FROM n) GROUP BY 1), a AS (SELECT name, count(*) AS every FROM n GROUP BY 1),
r AS (SELECT person_id, name, photos, round(photos * photos / own / every, 6) AS score FROM b JOIN o USING (person_id) JOIN a USING (name) WHERE photos >= 3 AND photos >= 0.05 * own AND photos >= 0.5 * every),
k AS (SELECT *, row_number() OVER (ORDER BY score DESC, person_id, name) AS i FROM r),
g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS p, []::VARCHAR[] AS q, false AS kept UNION ALL
  SELECT i, CASE WHEN f THEN list_append(p, person_id) ELSE p END, CASE WHEN f THEN list_append(q, name) ELSE q END, f FROM (SELECT k.i, g.p, g.q, k.person_id, k.name, NOT list_contains(g.p, k.person_id) AND NOT list_contains(g.q, k.name) AS f FROM g JOIN k ON k.i = g.i + 1))
SELECT person_id, name, photos, score FROM k JOIN g USING (i) WHERE kept""",
    recursive=True,
)
def j31_name_suggestions(lib: Library) -> DataFrame:
    named = lib.faces.where((F.col("person_id") % 5 == 0) & (F.col("photo_id") % 4 != 0)).select("photo_id", F.concat(F.lit("name"), F.col("person_id").cast("string")).alias("name"))
    return library.name_suggestions(named, lib.faces, lib.photos.select("id", F.col("sha256").alias("content")), share=0.05)


@query("SELECT photo_id, count(*) AS n, count(*) FILTER (person_id IS NULL) AS unknown, p.status FROM faces LEFT JOIN (SELECT id, status FROM photos WHERE id % 5 <> 0) p ON p.id = photo_id GROUP BY photo_id, p.status")
def j27_left_join(lib: Library) -> DataFrame:
    known = lib.photos.where(F.col("id") % 5 != 0).select("id", "status")
    return lib.faces.join(known, F.col("photo_id") == F.col("id"), "left").groupBy("photo_id", "status").agg(F.count("*").alias("n"), F.count_if(F.col("person_id").isNull()).alias("unknown"))


@query("SELECT sha256, arg_max(id, (taken_ts, id)) AS id FROM visible WHERE taken_ts IS NOT NULL GROUP BY 1")
def k12_distinct_content(lib: Library) -> DataFrame:
    rows = visible(lib.photos).where(F.col("taken_ts").isNotNull())
    return rows.groupBy("sha256").agg(F.max_by("id", F.struct("taken_ts", "id")).alias("id"))


@query("SELECT folder, count(DISTINCT camera_model) AS cameras, min(rating) AS low, max(rating) AS high FROM visible GROUP BY 1 HAVING count(*) >= 3")
def a2_folder_facts(lib: Library) -> DataFrame:
    return visible(lib.photos).groupBy("folder").agg(F.countDistinct("camera_model").alias("cameras"), F.min("rating").alias("low"), F.max("rating").alias("high"), F.count("*").alias("n")).where("n >= 3").drop("n")
