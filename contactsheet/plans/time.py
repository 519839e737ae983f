"""Registered queries over time: segments, bursts, as-of joins, trips, dates and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactsheet.adapter import WITH, Library
from contactsheet.functions import geo, text
from contactsheet.operators import segments, tracks
from contactsheet.operators.predicates import visible
from contactsheet.plans import registry
from contactsheet.streaming import incremental

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
query = registry(QUERIES, ORACLE_SQL, WITH)

_SEGMENTS = """, g AS (SELECT *, ts - lag(ts) OVER w AS gap FROM stream WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(CASE WHEN gap > 6 * 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS segment FROM g),
c AS (SELECT user_id, segment, event_type, count(*) AS c, min(ts) AS a, max(ts) AS b FROM s GROUP BY 1, 2, 3),
f AS (SELECT user_id, segment, sum(c)::BIGINT AS n, min(a) AS start_ts, max(b) AS end_ts, arg_min(event_type, (-c, event_type)) AS top FROM c GROUP BY 1, 2)
"""


def _facts(lib: Library) -> DataFrame:
    rows = segments.numbered_segments(lib.stream, "user_id", "ts", "event_id", gap_hours=6)
    return segments.segment_facts(rows, "user_id", "ts", "event_type")


@query(_SEGMENTS + "SELECT * FROM f")
def w1_segments(lib: Library) -> DataFrame:
    return _facts(lib)


@query(
    _SEGMENTS
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY segment) AS r FROM f),
m AS (SELECT user_id, segment, r, end_ts AS e, 0::BIGINT AS event, top AS t FROM o WHERE r = 1 UNION ALL
  SELECT o.user_id, o.segment, o.r, greatest(e, end_ts),
    CASE WHEN (floor(e / 86400) = floor(start_ts / 86400) OR (start_ts - e) / 3600 <= 6) AND (start_ts - e) / 3600 <= 10 AND top = t THEN event ELSE event + 1 END, top
  FROM m JOIN o ON o.user_id = m.user_id AND o.r = m.r + 1)
SELECT user_id, segment, event FROM m""",
    recursive=True,
)
def w2_merge_fold(lib: Library) -> DataFrame:
    return segments.merge_sessions(_facts(lib), "user_id")


@query(
    """, e AS (SELECT *, event_type <> 'error' AS ok FROM stream),
g AS (SELECT *, coalesce(ok AND lag(ok) OVER w AND ts - lag(ts) OVER w <= 7200, false) AS joined FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS burst FROM g)
SELECT user_id, burst, arg_min(event_id, (ts, event_id)) AS first, count(*) AS n FROM b WHERE ok GROUP BY 1, 2 HAVING count(*) >= 2"""
)
def w4_bursts(lib: Library) -> DataFrame:
    return segments.bursts(lib.stream, "user_id", "ts", "event_id", 7200, F.col("event_type") != "error")


@query(
    """, e AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN value END AS known FROM stream),
w AS (SELECT *, last_value(CASE WHEN known IS NOT NULL THEN {'t': ts, 'v': known} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
  first_value(CASE WHEN known IS NOT NULL THEN {'t': ts, 'v': known} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM e)
SELECT event_id, coalesce(known, CASE WHEN abs(ts - b.t) <= 14400 THEN b.v END, CASE WHEN abs(ts - a.t) <= 14400 THEN a.v END) AS inherited FROM w"""
)
def j8_asof_inherit(lib: Library) -> DataFrame:
    rows = lib.stream.withColumn("known", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    return segments.inherit_nearest(rows, "user_id", "ts", "event_id", "known", within=14400).select("event_id", "inherited")


@query(
    """, p AS (SELECT user_id, ts, value AS x FROM stream WHERE event_id % 2 = 0), q AS (SELECT user_id, ts, event_id AS id FROM stream WHERE event_id % 2 = 1),
j AS (SELECT q.id, q.ts, b.ts AS bt, b.x AS bx, a.ts AS nt, a.x AS ax FROM q ASOF LEFT JOIN p b ON b.user_id = q.user_id AND b.ts <= q.ts ASOF LEFT JOIN p a ON a.user_id = q.user_id AND a.ts >= q.ts),
r AS (SELECT id, round(CASE WHEN ts - bt <= 21600 AND nt - ts <= 21600 THEN coalesce(bx + (ax - bx) * (ts - bt) / nullif(nt - bt, 0), bx)
  WHEN bt IS NULL AND nt - ts <= 21600 THEN ax WHEN nt IS NULL AND ts - bt <= 21600 THEN bx END, 7) AS x FROM j)
SELECT id, x FROM r WHERE x IS NOT NULL"""
)
def j9_interpolate(lib: Library) -> DataFrame:
    points = lib.stream.where(F.col("event_id") % 2 == 0).select("user_id", "ts", F.col("value").alias("x"))
    asked = lib.stream.where(F.col("event_id") % 2 == 1).select("user_id", "ts", F.col("event_id").alias("id"))
    return segments.interpolate(points, asked, "user_id", "ts", within=21600)


_TRACKS = """, p AS (SELECT user_id % 40 AS track, ts, value / 10 - 40 AS lat, value / 5 + user_id % 7 AS lon FROM stream WHERE event_id % 2 = 0), q AS (SELECT event_id AS id, ts + event_id % 5 * 700 AS utc FROM stream WHERE event_id % 2 = 1),
t AS (SELECT track, min(ts) AS start_ts, max(ts) AS end_ts FROM p GROUP BY 1), c AS (SELECT * FROM q JOIN t ON utc BETWEEN start_ts - 2400 AND end_ts + 2400),
j AS (SELECT c.*, b.ts AS bt, b.lat AS blat, b.lon AS blon, a.ts AS nt, a.lat AS alat, a.lon AS alon FROM c ASOF LEFT JOIN p b ON b.track = c.track AND b.ts < c.utc ASOF LEFT JOIN p a ON a.track = c.track AND a.ts >= c.utc),
r AS (SELECT id, track, start_ts, CASE WHEN bt IS NOT NULL AND nt IS NOT NULL THEN CASE WHEN utc - bt <= 2400 AND nt - utc <= 2400 THEN {'lat': round(blat + (utc - bt) / (nt - bt) * (alat - blat), 7), 'lon': round(blon + (utc - bt) / (nt - bt) * (alon - blon), 7)} END
  WHEN bt IS NOT NULL AND utc - bt <= 2400 THEN {'lat': round(blat, 7), 'lon': round(blon, 7)} WHEN bt IS NULL AND nt - utc <= 2400 THEN {'lat': round(alat, 7), 'lon': round(alon, 7)} END AS pos FROM j)
SELECT id, pos.lat AS lat, pos.lon AS lon, track FROM r WHERE pos IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY start_ts, track) = 1"""


@query(_TRACKS)
def j9_tracks(lib: Library) -> DataFrame:
    k, user = F.col("event_id"), F.col("user_id")
    points = lib.stream.where(k % 2 == 0).select((user % 40).alias("track"), "ts", (F.col("value") / 10 - 40).alias("lat"), (F.col("value") / 5 + user % 7).alias("lon"))
    return tracks.positions(points, lib.stream.where(k % 2 == 1).select(k.alias("id"), (F.col("ts") + k % 5 * 700).alias("utc")), within=2400)


_LIVE = """, a AS (SELECT id, folder, id % 300 AS stem, taken_ts FROM visible WHERE media_type = 'image'), b AS (SELECT id, folder, id % 300 AS stem, taken_ts, (id % 9)::DOUBLE AS duration FROM visible WHERE media_type = 'video'),
j AS (SELECT a.id AS still_id, b.id AS film_id FROM a JOIN b USING (folder, stem) WHERE duration <= 5 AND (a.taken_ts IS NULL OR b.taken_ts IS NULL OR abs(a.taken_ts - b.taken_ts) <= 2000000)),
k AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY film_id ORDER BY still_id) = 1)
SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY still_id ORDER BY film_id) = 1"""


@query(_LIVE)
def j12_live_pairs(lib: Library) -> DataFrame:
    rows = visible(lib.photos).withColumn("stem", F.col("id") % 300)
    films = rows.where(F.col("media_type") == "video").withColumn("duration", (F.col("id") % 9).cast("double"))
    return segments.live_pairs(rows.where(F.col("media_type") == "image"), films, skew=2_000_000)


@query(
    """, e AS (SELECT id, camera_model, taken_ts AS start_ts, taken_ts + 3600 AS end_ts, (place_id * 5)::DOUBLE AS away_km FROM visible WHERE taken_ts IS NOT NULL),
g AS (SELECT *, coalesce(away_km >= 60, false) AS away FROM e),
h AS (SELECT *, coalesce(away AND lag(away) OVER w AND start_ts - lag(end_ts) OVER w <= 172800, false) AS goes_on FROM g WINDOW w AS (PARTITION BY camera_model ORDER BY start_ts, end_ts, id)),
t AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY camera_model ORDER BY start_ts, end_ts, id ROWS UNBOUNDED PRECEDING)::BIGINT AS trip FROM h)
SELECT camera_model, trip, min(start_ts) AS start_ts, max(end_ts) AS end_ts, count(*) AS events FROM t WHERE away GROUP BY 1, 2 HAVING max(end_ts) - min(start_ts) >= 64800 OR count(*) >= 2"""
)
def a13_trips(lib: Library) -> DataFrame:
    rows = visible(lib.photos).where(F.col("taken_ts").isNotNull())
    events = rows.select("id", "camera_model", F.col("taken_ts").alias("start_ts"), (F.col("taken_ts") + 3600).alias("end_ts"), (F.col("place_id") * 5).cast("double").alias("away_km"))
    return segments.trips(events, "camera_model", "id", F.lit(False))


@query(
    """, n AS (SELECT camera_model AS g, id AS m FROM visible), o AS (SELECT camera_model || (id % 3 = 0)::INT AS g, id AS m FROM visible WHERE id % 5 <> 0),
s AS (SELECT n.g AS a, o.g AS b, count(*) AS c FROM n JOIN o USING (m) GROUP BY 1, 2),
j AS (SELECT a AS new_grp, b AS old_grp, round(c / ((SELECT count(*) FROM n WHERE g = a) + (SELECT count(*) FROM o WHERE g = b) - c), 6) AS jaccard FROM s),
k AS (SELECT * FROM j WHERE jaccard >= 0.5), l AS (SELECT a, row_number() OVER (ORDER BY a) AS i FROM (SELECT DISTINCT new_grp AS a FROM k)),
r AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS used, NULL::VARCHAR AS new_grp, NULL::VARCHAR AS old_grp, NULL::DOUBLE AS jaccard UNION ALL
  SELECT r.i + 1, CASE WHEN min(k.old_grp) IS NULL THEN r.used ELSE list_append(r.used, arg_min(k.old_grp, (-k.jaccard, k.old_grp))) END, l.a, arg_min(k.old_grp, (-k.jaccard, k.old_grp)), max(k.jaccard)
  FROM r JOIN l ON l.i = r.i + 1 LEFT JOIN k ON k.new_grp = l.a AND NOT list_contains(r.used, k.old_grp) GROUP BY r.i, r.used, l.a)
SELECT new_grp, old_grp, jaccard FROM r WHERE old_grp IS NOT NULL""",
    recursive=True,
)
def j32_event_identity(lib: Library) -> DataFrame:
    rows = visible(lib.photos)
    old = rows.where(F.col("id") % 5 != 0).select(F.concat("camera_model", (F.col("id") % 3 == 0).cast("int").cast("string")), "id")
    return segments.match_by_overlap(rows.select("camera_model", "id"), old)


@query(
    """, m AS (SELECT id, CASE WHEN id % 8 <> 0 THEN id - 1 END AS merged_into FROM persons)
SELECT id, id - id % 8 AS survivor FROM m WHERE id - id % 8 >= 1 UNION ALL SELECT id, 0 FROM m WHERE id < 8"""
)
def w7_merge_chain(lib: Library) -> DataFrame:
    merged = lib.persons.select("id", F.when(F.col("id") % 8 != 0, F.col("id") - 1).alias("merged_into"))
    return segments.survivors(merged)


@query(
    """SELECT id, strftime(make_timestamp((taken_ts * 1000000)::BIGINT), '%Y-%m-%d %H:%M:%S') AS day, month(make_timestamp((taken_ts * 1000000)::BIGINT))::INT AS month,
  strftime(make_timestamp((taken_ts * 1000000)::BIGINT), '%m-%d') AS md, floor(taken_ts / 86400)::BIGINT AS day_number FROM visible WHERE taken_ts IS NOT NULL"""
)
def d2_buckets(lib: Library) -> DataFrame:
    at = F.timestamp_seconds("taken_ts")
    rows = visible(lib.photos).where(F.col("taken_ts").isNotNull())
    return rows.select("id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("day"), F.month(at).alias("month"), F.date_format(at, "MM-dd").alias("md"), F.floor(F.col("taken_ts") / 86400).alias("day_number"))


@query("""SELECT id, strftime(try_strptime(regexp_extract(filename, '(\\d{8}_\\d{6})'), '%Y%m%d_%H%M%S'), '%Y-%m-%d %H:%M:%S') AS taken, 'datetime' AS precision FROM photos""")
def d4_filename_date(lib: Library) -> DataFrame:
    found = text.date_from_filename(F.col("filename"))
    return lib.photos.select("id", found.alias("d")).select("id", F.date_format("d.ts", "yyyy-MM-dd HH:mm:ss").alias("taken"), F.col("d.precision").alias("precision"))


@query(
    """SELECT id, round(2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(lat - 48.85) / 2), 2) + cos(radians(48.85)) * cos(radians(lat)) * pow(sin(radians(lon - 2.35) / 2), 2)))), 4) AS km FROM places"""
)
def m1_haversine(lib: Library) -> DataFrame:
    return lib.places.select("id", F.round(geo.haversine_km(F.lit(48.85), F.lit(2.35), F.col("lat"), F.col("lon")), 4).alias("km"))


@query(
    """, q AS (SELECT * EXCLUDE (blur), (id % 900)::DOUBLE AS blur, (id % 100) / 100.0::DOUBLE AS brightness, (id % 40) / 100.0::DOUBLE AS clipped, (id % 30) / 100.0::DOUBLE AS contrast FROM visible),
s AS (SELECT *, CASE WHEN blur > 0 THEN least(1, greatest(0, (log10(blur) - 1.2) / 1.7)) ELSE 0 END AS sharp,
  greatest(0, 0.5 * (1 - pow(least(1, abs(brightness - 0.47) / 0.47), 1.5)) + 0.25 * least(1, contrast / 0.22) + 0.25 * (1 - least(1, clipped / 0.35))) AS exposed,
  least(1, greatest(0, log2(greatest(width::DOUBLE * height / 1e6, 0.05) / 0.3) / log2(40.0))) AS fine FROM q)
SELECT id, round(100 * (0.35 * sharp + 0.2 * exposed + 0.1 * fine) / 0.65 * CASE WHEN source_kind = 'screenshot' THEN 0.5 WHEN source_kind IN ('whatsapp', 'download') THEN 0.85 ELSE 1 END, 2) AS quality FROM s"""
)
def m4_quality(lib: Library) -> DataFrame:
    k = F.col("id")
    value = text.quality((k % 900).cast("double"), (k % 100) / 100.0, (k % 40) / 100.0, (k % 30) / 100.0, F.col("width"), F.col("height"), F.coalesce("source_kind", F.lit("")))
    return visible(lib.photos).select("id", value.alias("quality"))


@query(
    """, d AS (SELECT place_id, make_timestamp((min(taken_ts) * 1000000)::BIGINT) AS a, make_timestamp((max(taken_ts) * 1000000)::BIGINT) AS b FROM visible WHERE taken_ts IS NOT NULL GROUP BY 1)
SELECT place_id, strftime(a, '%b %Y') || ' – ' || strftime(b, '%b %Y') AS label, (year(b) - year(a) - (strftime(b, '%m-%d') < strftime(a, '%m-%d'))::INT)::INT AS years FROM d"""
)
def f7_date_range_label(lib: Library) -> DataFrame:
    spans = visible(lib.photos).where(F.col("taken_ts").isNotNull()).groupBy("place_id").agg(F.timestamp_seconds(F.min("taken_ts")).alias("a"), F.timestamp_seconds(F.max("taken_ts")).alias("b"))
    return spans.select("place_id", text.date_range_label(F.col("a"), F.col("b")).alias("label"), text.age_on(F.col("a"), F.col("b")).alias("years"))


@query(
    """, g AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM stream),
s AS (SELECT *, sum(CASE WHEN gap >= 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, round(min(ts), 3) AS start_ts, round(max(ts) + 21600, 3) AS end_ts, count(*) AS n FROM s GROUP BY user_id, k"""
)
def t11_sessions(lib: Library) -> DataFrame:
    found = incremental.sessions(lib.table("events"))
    return found.select("user_id", F.round(F.unix_micros("start") / 1e6, 3).alias("start_ts"), F.round(F.unix_micros("end") / 1e6, 3).alias("end_ts"), "n")


@query(
    """SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start_ts, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"""
)
def t11_activity(lib: Library) -> DataFrame:
    return incremental.activity(lib.table("events")).select(F.unix_timestamp("start").alias("start_ts"), "event_type", "n", "total")
