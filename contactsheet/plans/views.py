"""Registered queries over events by the whole rule, memories, orders, lists and corrections."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactsheet.adapter import WITH, Library
from contactsheet.operators import duplicates, events, lists, memories
from contactsheet.operators.predicates import visible
from contactsheet.plans import registry

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
query = registry(QUERIES, ORACLE_SQL, WITH)

CAP = 6  #: a small cap, so that full segments occur in small tables


def _shots(lib: Library) -> DataFrame:
    """Visible photos about an hour apart in bursts by camera, with the city of their place."""
    rows = visible(lib.photos).where(F.col("taken_ts").isNotNull())
    city = lib.places.select(F.col("id").alias("p"), F.coalesce("city", "name").alias("city"))
    ts = F.col("taken_ts") - F.col("taken_ts") % (86400 * 4) + (F.col("id") * 7919 % 1000) * 150.0
    return rows.withColumn("taken_ts", ts).join(city, F.col("place_id") == F.col("p"), "left").select("camera_model", "id", "taken_ts", "place_id", "city", F.split_part("folder", F.lit("/"), F.lit(1)).alias("folder"), "lat", "lon")


_SHOTS = """, shots AS (SELECT camera_model, v.id, taken_ts - taken_ts % 345600 + (v.id * 7919 % 1000) * 150.0 AS ts, place_id, coalesce(p.city, p.name) AS city, split_part(folder, '/', 1) AS folder, v.lat, v.lon
  FROM visible v LEFT JOIN places p ON p.id = place_id WHERE taken_ts IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY camera_model ORDER BY ts, id) AS r FROM shots),
m AS (SELECT camera_model, id, r, ts, lat, lon, 0::BIGINT AS segment, 1 AS size FROM o WHERE r = 1 UNION ALL
  SELECT o.camera_model, o.id, o.r, o.ts, o.lat, o.lon, segment + b::INT, CASE WHEN b THEN 1 ELSE size + 1 END FROM m JOIN o ON o.camera_model = m.camera_model AND o.r = m.r + 1,
  LATERAL (SELECT o.ts - m.ts AS gap),
  LATERAL (SELECT coalesce(gap > 9000 OR (gap >= 2700 AND o.lat IS NOT NULL AND m.lat IS NOT NULL AND 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(o.lat - m.lat) / 2), 2) + cos(radians(m.lat)) * cos(radians(o.lat)) * pow(sin(radians(o.lon - m.lon) / 2), 2)))) >= 30), false) AS split,
    size >= 6 AND floor(o.ts / 86400) <> floor(m.ts / 86400) AS over),
  LATERAL (SELECT (split AND gap >= 1200) OR over OR (split AND size >= 6) AS b))
"""


@query(_SHOTS + "SELECT camera_model, id, segment FROM m", recursive=True)
def w1_capped_segments(lib: Library) -> DataFrame:
    return events.event_numbers(_shots(lib), "camera_model", "id", cap=CAP).select("camera_model", "id", "segment")


@query()
def w3_events(lib: Library) -> DataFrame:
    rows = _shots(lib)
    return events.event_rows(events.event_numbers(rows, "camera_model", "id", cap=CAP), rows, "camera_model", "id")


@query(
    """, b AS (SELECT id AS person_id, birth_date, coalesce(try_cast('1998-' || strftime(birth_date, '%m-%d') AS DATE), DATE '1998-03-01') - DATE '1998-07-04' AS days_to, (1998 - year(birth_date))::INT AS turning FROM persons WHERE birth_date IS NOT NULL),
s AS (SELECT DISTINCT person_id, photo_id FROM faces),
r AS (SELECT b.*, v.id, rating, quality_score, CAST(make_timestamp((taken_ts * 1000000)::BIGINT) AS DATE) AS day FROM b JOIN s USING (person_id) JOIN visible v ON v.id = photo_id WHERE days_to BETWEEN -1 AND 7 AND archived = 0 AND taken_ts IS NOT NULL),
q AS (SELECT *, year(day)::INT AS year, row_number() OVER (PARTITION BY person_id, year(day) ORDER BY rating DESC, coalesce(quality_score, 0) DESC, id)::INT AS rank FROM r
  WHERE abs(coalesce(try_cast(year(day) || '-' || strftime(birth_date, '%m-%d') AS DATE), make_date(year(day), 3, 1)) - day) <= 2)
SELECT person_id, days_to::INT AS days_to, turning, year, rank, id FROM q WHERE rank <= 8"""
)
def a26_birthdays(lib: Library) -> DataFrame:
    return memories.birthdays(visible(lib.photos), lib.faces, lib.persons, datetime.date(1998, 7, 4))


@query(
    """, y AS (SELECT *, (2000 - year(make_timestamp((taken_ts * 1000000)::BIGINT)))::INT AS years FROM visible WHERE taken_ts IS NOT NULL AND archived = 0 AND coalesce(source_kind, '') <> 'screenshot'),
r AS (SELECT years, id, row_number() OVER (PARTITION BY years ORDER BY rating DESC, coalesce(quality_score, 0) DESC, id)::INT AS rank FROM y WHERE years IN (1, 2, 3, 5)) SELECT years, rank, id FROM r WHERE rank <= 8"""
)
def a26_years_ago(lib: Library) -> DataFrame:
    return memories.years_ago(visible(lib.photos), 2000)


@query(
    """SELECT 'date_asc' AS sort, id FROM (FROM visible ORDER BY taken_ts NULLS LAST, id LIMIT 30 OFFSET 10) UNION ALL SELECT 'date_desc', id FROM (FROM visible ORDER BY taken_ts DESC NULLS LAST, id DESC LIMIT 30 OFFSET 10)
UNION ALL SELECT 'quality', id FROM (FROM visible ORDER BY quality_score DESC NULLS LAST, id DESC LIMIT 30 OFFSET 10) UNION ALL SELECT 'added', id FROM (FROM visible ORDER BY added_ts DESC, id DESC LIMIT 30 OFFSET 10)
UNION ALL SELECT 'size', id FROM (FROM visible ORDER BY size DESC, id DESC LIMIT 30 OFFSET 10)"""
)
def o1_grid_orders(lib: Library) -> DataFrame:
    pages = [lists.page(visible(lib.photos), name, 30, 10).select(F.lit(name).alias("sort"), "id") for name in lists.GRID_ORDERS]
    out = pages[0]
    for one in pages[1:]:
        out = out.unionAll(one)
    return out


@query(
    """, f AS (SELECT * FROM visible WHERE rating >= 1 AND place_id = 3)
SELECT 'quality' AS sort, id FROM (FROM f ORDER BY rating DESC, coalesce(quality_score, 0) DESC, taken_ts DESC NULLS LAST, id LIMIT 60) UNION ALL SELECT 'worst', id FROM (FROM f ORDER BY coalesce(quality_score, 1e9), taken_ts DESC NULLS LAST, id LIMIT 20)
UNION ALL SELECT 'date_asc', id FROM (FROM f ORDER BY taken_ts NULLS FIRST, id LIMIT 20) UNION ALL SELECT 'date_desc', id FROM (FROM f ORDER BY taken_ts DESC NULLS LAST, id LIMIT 20)"""
)
def o2_search_orders(lib: Library) -> DataFrame:
    found = visible(lib.photos).where((F.col("rating") >= 1) & (F.col("place_id") == 3))
    pages = [lists.search_order(found, name, 20).select(F.lit(name).alias("sort"), "id") for name in ("quality", "worst", "date_asc", "date_desc")]
    return pages[0].unionAll(pages[1]).unionAll(pages[2]).unionAll(pages[3])


_PRIVATE = ", s AS (SELECT * EXCLUDE (status), CASE WHEN id % 12 = 0 THEN 'locked' ELSE status END AS status, CASE WHEN id % 12 = 1 THEN id % 3 END AS private_to FROM photos)\n"


def _private(lib: Library) -> DataFrame:
    k = F.col("id") % 12
    return lib.photos.withColumn("status", F.when(k == 0, "locked").otherwise(F.col("status"))).withColumn("private_to", F.when(k == 1, F.col("id") % 3))


@query("SELECT n_nationkey AS album FROM nation WHERE n_nationkey % 4 = 0 OR n_regionkey = 2")
def p25_visible_albums(lib: Library) -> DataFrame:
    albums = lib.table("nation").select(F.col("n_nationkey").alias("album"), (F.col("n_nationkey") % 4 == 0).cast("int").alias("shared"), F.col("n_regionkey").alias("owner"))
    return lists.visible_albums(albums, 2).select("album")


@query("SELECT id, floor(epoch(l_shipdate))::BIGINT AS trashed_at FROM lineitem JOIN photos ON id = l_orderkey WHERE l_linenumber = 1 AND live_component = 0 AND l_returnflag = 'R'")
def p37_trash_list(lib: Library) -> DataFrame:
    trash = lib.table("lineitem").where("l_linenumber = 1 and l_returnflag = 'R'").select(F.col("l_orderkey").alias("photo_id"), F.unix_timestamp("l_shipdate").alias("trashed_at"))
    return lists.trash_list(trash, lib.photos)


@query(_PRIVATE + "SELECT private_to, count(*) AS photos, count(*) FILTER (status = 'locked') AS locked FROM s WHERE status = 'locked' OR private_to IS NOT NULL GROUP BY 1")
def p38_private_counts(lib: Library) -> DataFrame:
    return lists.private_counts(_private(lib))


@query(_PRIVATE + "SELECT event_id AS error, CASE WHEN event_id % 4 <> 0 THEN event_id % 9000 END AS photo_id FROM events LEFT JOIN s ON s.id = CASE WHEN event_id % 4 <> 0 THEN event_id % 9000 END WHERE event_type = 'error' AND (s.id IS NULL OR (s.status <> 'locked' AND coalesce(private_to, 1) = 1))")
def p39_visible_errors(lib: Library) -> DataFrame:
    errors = lib.table("events").where("event_type = 'error'").select(F.col("event_id").alias("error"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 9000).alias("photo_id"))
    return lists.visible_errors(errors, _private(lib), 1)


@query(
    """, m AS (SELECT place_id::VARCHAR AS event, id AS photo_id FROM visible WHERE place_id IS NOT NULL), t AS (SELECT DISTINCT 'trip' || (place_id % 6) AS trip, place_id::VARCHAR AS event FROM visible WHERE place_id IS NOT NULL),
a AS (SELECT event, photo_id FROM m UNION ALL SELECT trip, photo_id FROM t JOIN m USING (event))
SELECT event FROM a JOIN faces USING (photo_id) WHERE person_id IN (1, 2, 5, 9) GROUP BY 1 HAVING count(DISTINCT person_id) = 4"""
)
def j28_events_with_persons(lib: Library) -> DataFrame:
    place = F.col("place_id").cast("string")
    rows = visible(lib.photos).where(F.col("place_id").isNotNull())
    members = rows.select(place.alias("event"), F.col("id").alias("photo_id"))
    trips = rows.select(F.concat(F.lit("trip"), (F.col("place_id") % 6).cast("string")).alias("trip"), place.alias("event")).distinct()
    return lists.events_with_persons(members, trips, lib.faces, [1, 2, 5, 9])


@query(
    """SELECT (SELECT count(*) FROM visible WHERE media_type = 'image') AS photos, (SELECT count(*) FROM visible WHERE media_type = 'video') AS videos, (SELECT coalesce(sum(duration), 0) FROM visible WHERE media_type = 'video') AS seconds,
  (SELECT count(*) FROM faces) AS faces, (SELECT count(*) FROM faces WHERE person_id IS NULL) AS unassigned, (SELECT count(DISTINCT person_id) FROM faces) AS people, (SELECT count(name) FROM persons) AS named, (SELECT count(DISTINCT p_type) FROM part JOIN lineitem ON l_partkey = p_partkey) AS tags"""
)
def a24_library_counts(lib: Library) -> DataFrame:
    return lists.library_counts(visible(lib.photos), lib.faces, lib.photo_tags, lib.persons)


@query("SELECT person_id, count(*) AS faces, count(*) FILTER (source = 'user') AS by_user FROM faces WHERE person_id IS NOT NULL GROUP BY 1")
def a30_label_sources(lib: Library) -> DataFrame:
    return lists.label_sources(lib.faces)


@query("SELECT tag, count(*) AS photos, count(*) FILTER (score >= 2.0) AS strong FROM photo_tags GROUP BY 1")
def a30_tag_list(lib: Library) -> DataFrame:
    return lists.tag_list(lib.photo_tags, 2.0)


@query("SELECT 'faces' AS kind, model, count(*) AS n FROM faces GROUP BY 2 UNION ALL SELECT 'vectors', label::VARCHAR, count(*) FROM embeddings GROUP BY 2")
def a33_usage(lib: Library) -> DataFrame:
    return lists.usage(lib.faces, lib.table("embeddings").select(F.col("label").alias("model")))


@query("SELECT DISTINCT 'country' AS scope, country AS value FROM places WHERE id IN (SELECT place_id FROM visible) UNION SELECT 'year', strftime(make_timestamp((taken_ts * 1000000)::BIGINT), '%Y') FROM visible WHERE taken_ts IS NOT NULL")
def a38_scopes(lib: Library) -> DataFrame:
    return lists.scopes(visible(lib.photos), lib.places)


@query("SELECT count(*) AS n, coalesce(sum(('0x' || substr(md5(concat_ws(chr(31), coalesce(id::VARCHAR, '\\N'), coalesce(name, '\\N'), coalesce(strftime(birth_date, '%Y-%m-%d'), '\\N'))), 1, 8))::BIGINT), 0)::BIGINT AS mark FROM persons")
def a29_fingerprint(lib: Library) -> DataFrame:
    return lists.fingerprint(lib.persons, "id", "name", "birth_date")


@query(
    """SELECT place_id % 5 AS album, v.id % 700 AS place_in, v.id, concat_ws(' · ', strftime(make_timestamp((taken_ts * 1000000)::BIGINT), '%-d %B %Y'), p.name) AS caption, lpad((v.id % 700)::VARCHAR, 5, '0') || ext AS file
FROM visible v JOIN places p ON p.id = place_id WHERE rating = 5"""
)
def k9_gallery(lib: Library) -> DataFrame:
    rows = visible(lib.photos)
    members = rows.where((F.col("rating") == 5) & F.col("place_id").isNotNull()).select(F.col("id").alias("photo_id"), (F.col("place_id") % 5).alias("album"), (F.col("id") % 700).alias("place_in"))
    return lists.gallery(rows, lib.places, members)


@query("SELECT id, CASE WHEN id % 6 = 1 THEN 1e9 WHEN id % 6 = 2 THEN taken_ts + 3600 ELSE taken_ts END AS taken_ts FROM photos")
def d10_shifted(lib: Library) -> DataFrame:
    k = F.col("id") % 6
    edits = lib.photos.where(k.isin(1, 2, 3)).select(F.col("id").alias("photo_id"), F.when(k.isin(2, 3), 3600.0).alias("shift"), F.when(k.isin(1, 3), 1e9).alias("absolute"))
    return lists.shifted(lib.photos, edits)


_CASCADE = """, c AS (SELECT id FROM photos WHERE id % 101 = 0 AND place_id < 12), seen AS (SELECT * FROM photos WHERE status = 'ok' AND hidden = 0),
"""


@query(
    _CASCADE
    + """hit AS (SELECT DISTINCT place_id FROM photos WHERE id IN (FROM c)), k AS (SELECT place_id, min(id) AS cover FROM photos GROUP BY 1)
SELECT place_id AS event, (SELECT count(*) FROM seen s WHERE s.place_id = hit.place_id) AS photos, (SELECT max(s.id) FROM seen s, k WHERE s.place_id = hit.place_id AND k.place_id = hit.place_id AND s.id = k.cover) AS cover_id FROM hit"""
)
def t7_cascade_events(lib: Library) -> DataFrame:
    return _cascade(lib)[0]


@query(_CASCADE + "hit AS (SELECT DISTINCT stack_id FROM photos WHERE id IN (FROM c) AND stack_id IS NOT NULL) SELECT stack_id, (SELECT min(id) FROM seen s WHERE s.stack_id = hit.stack_id) AS head, (SELECT count(*) FROM seen s WHERE s.stack_id = hit.stack_id) AS photos FROM hit")
def t7_cascade_stacks(lib: Library) -> DataFrame:
    return _cascade(lib)[1]


def _cascade(lib: Library) -> tuple[DataFrame, DataFrame]:
    members = lib.photos.where(F.col("place_id").isNotNull()).select(F.col("place_id").alias("event"), F.col("id").alias("photo_id"))
    covers = members.groupBy("event").agg(F.min("photo_id").alias("cover_id"))
    changed = lib.photos.where((F.col("id") % 101 == 0) & (F.col("place_id") < 12)).select("id")
    return lists.cascade(changed, lib.photos, members, covers)


_COPIES = """, g AS (SELECT sha256, min(id) AS a, max(id) AS b FROM photos GROUP BY 1 HAVING count(*) = 2), p AS (SELECT id, place_id, source_kind, width, height, size, id // 2 AS sha FROM photos),
r AS (SELECT x.id AS a, y.id AS b, (x.id * 7 + y.id) % 12 AS bits, x.source_kind AS ak, y.source_kind AS bk, x.width AS aw, x.height AS ah, y.width AS bw, y.height AS bh, x.size AS az, y.size AS bz, x.sha AS ash, y.sha AS bsh FROM p x JOIN p y ON y.id = x.id + 1 AND x.place_id IS NOT NULL)
"""


@query(
    _COPIES
    + """SELECT a, b, CASE WHEN ash = bsh THEN 'exact' WHEN coalesce(bk, '') = 'screenshot' AND coalesce(ak, '') <> 'screenshot' THEN 'screenshot' WHEN abs(aw / ah - bw / bh) > 0.02 * greatest(aw / ah, 1) THEN 'cropped'
  WHEN aw <> bw OR ah <> bh THEN 'resized' WHEN bits > 4 THEN 'edited' WHEN bz < az THEN 'compressed' ELSE 'duplicate' END AS relation FROM r"""
)
def g14_relation(lib: Library) -> DataFrame:
    fields = F.struct("id", "sha256", "source_kind", "width", "height", "size")
    x = lib.photos.where(F.col("place_id").isNotNull()).select(fields.alias("kept"), (F.col("id") + 1).alias("next"))
    pairs = x.join(lib.photos.select(fields.alias("other"), F.col("id").alias("next")), "next")
    bits = (F.col("kept.id") * 7 + F.col("other.id")) % 12
    return pairs.select(F.col("kept.id").alias("a"), F.col("other.id").alias("b"), duplicates.relation("kept", "other", bits).alias("relation"))


_GROUPS = """, f AS (SELECT substr(sha1('exact:' || string_agg(id::VARCHAR, ',' ORDER BY id)), 1, 16) AS signature, sha256, count(*) AS n, min(id) AS first FROM photos GROUP BY sha256 HAVING count(*) > 1),
st AS (SELECT signature, CASE WHEN first % 3 = 0 THEN 'dismissed' ELSE 'open' END AS status FROM f WHERE first % 5 <> 0 UNION ALL SELECT md5(p_partkey::VARCHAR), 'open' FROM part WHERE p_partkey < 50)
"""


def _signed(lib: Library) -> tuple[DataFrame, DataFrame]:
    groups = lib.photos.groupBy("sha256").agg(F.collect_list("id").alias("ids"), F.count("*").alias("n"), F.min("id").alias("first")).where(F.col("n") > 1)  # copies of one content, two each here
    found = groups.select(duplicates.signature(F.lit("exact"), F.col("ids")).alias("signature"), "n", "first")
    old = found.where(F.col("first") % 5 != 0).select("signature", F.when(F.col("first") % 3 == 0, "dismissed").otherwise("open").alias("status"))
    gone = lib.table("part").where(F.col("p_partkey") < 50).select(F.md5(F.col("p_partkey").cast("string").cast("binary")), F.lit("open"))
    return found, old.unionAll(gone)


@query(_GROUPS + "SELECT f.signature, n, coalesce(status, 'open') AS status FROM f LEFT JOIN st USING (signature)")
def g12_keep_status(lib: Library) -> DataFrame:
    return duplicates.keep_status(*_signed(lib))[0].select("signature", "n", "status")


@query(_GROUPS + "SELECT signature FROM st WHERE status = 'open' AND signature NOT IN (SELECT signature FROM f)")
def g12_stale(lib: Library) -> DataFrame:
    return duplicates.keep_status(*_signed(lib))[1].select("signature")


@query(_GROUPS + "SELECT signature FROM f WHERE signature NOT IN (SELECT signature FROM st WHERE status = 'dismissed')")
def g11_not_dismissed(lib: Library) -> DataFrame:
    found, stored = _signed(lib)
    return duplicates.not_dismissed(found, stored.where("status = 'dismissed'")).select("signature")
