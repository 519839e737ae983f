"""Registered queries over a whole library in the order of time, without a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactsheet.adapter import WITH, Library
from contactsheet.operators import library_time
from contactsheet.plans import registry

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
query = registry(QUERIES, ORACLE_SQL, WITH)

_KM = "2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"

#: Photos shot in blocks of forty, or every five minutes for a day and more; every few blocks at another place.
_SHOTS = """, t AS (SELECT id, 1500000000.0::DOUBLE + id // 400 * 259200 + CASE WHEN id // 400 % 3 = 1 THEN id % 400 * 300 ELSE id % 400 // 40 * 14400 + id % 40 * 60 END AS taken_ts,
  CASE WHEN id % 31 <> 0 AND id // 40 % 5 <> 4 THEN (id // 120 % 25)::INT END AS place_id, CASE WHEN id // 120 % 4 <> 3 THEN 'N' || (id // 120 % 25 // 4) END AS city, 'f' || (id // 200 % 3) AS folder,
  CASE WHEN id % 3 = 0 AND id % 31 <> 0 THEN id // 120 % 25 * 6.5::DOUBLE - 80 END AS lat, CASE WHEN id % 3 = 0 AND id % 31 <> 0 THEN id // 120 % 25 * 13.0::DOUBLE - 160 END AS lon
  FROM photos WHERE id % 13 <> 5)
"""

_SEGMENTS = (
    _SHOTS
    + """, b AS (SELECT *, lag({{'ts': taken_ts, 'lat': lat, 'lon': lon}}) OVER (ORDER BY taken_ts, id) AS p FROM t),
g AS (SELECT *, CASE WHEN taken_ts - p.ts >= 1200 AND (taken_ts - p.ts > {hours} * 3600 OR coalesce(taken_ts - p.ts >= 2700 AND p.lat IS NOT NULL AND b.lat IS NOT NULL AND """
    + _KM.format(a="p", b="b")
    + """ >= 30, false)) THEN 1 ELSE 0 END AS brk FROM b),
h AS (SELECT *, sum(brk) OVER (ORDER BY taken_ts, id)::BIGINT AS hard, floor(taken_ts / 86400)::BIGINT AS day FROM g),
d AS (SELECT hard, day, count(*) AS n, row_number() OVER (PARTITION BY hard ORDER BY day) AS r FROM h GROUP BY 1, 2),
c AS (SELECT hard, day, r, n AS size, 0::BIGINT AS sub FROM d WHERE r = 1 UNION ALL
  SELECT d.hard, d.day, d.r, CASE WHEN size >= {cap} THEN d.n ELSE size + d.n END, sub + (size >= {cap})::BIGINT FROM c JOIN d ON d.hard = c.hard AND d.r = c.r + 1),
s AS (SELECT h.* EXCLUDE (p), sub, dense_rank() OVER (ORDER BY h.hard, sub) AS seg FROM h JOIN c USING (hard, day))
"""
)


def _shots(lib: Library) -> DataFrame:
    k = F.col("id")
    whole = lambda x: F.floor(x).cast("long")
    place, group = whole(k / 120) % 25, whole(k / 400)
    ts = 1_500_000_000.0 + group * 259_200 + F.when(group % 3 == 1, k % 400 * 300).otherwise(whole(k % 400 / 40) * 14_400 + k % 40 * 60)
    located = (k % 3 == 0) & (k % 31 != 0)
    return lib.photos.where(k % 13 != 5).select(
        "id",
        ts.cast("double").alias("taken_ts"),
        F.when((k % 31 != 0) & (whole(k / 40) % 5 != 4), place.cast("int")).alias("place_id"),
        F.when(whole(k / 120) % 4 != 3, F.concat(F.lit("N"), whole(place / 4).cast("string"))).alias("city"),
        F.concat(F.lit("f"), (whole(k / 200) % 3).cast("string")).alias("folder"),
        F.when(located, place * 6.5 - 80).alias("lat"),
        F.when(located, place * 13.0 - 160).alias("lon"),
    )


@query(_SEGMENTS.format(hours=4, cap=100) + "SELECT id, hard, sub FROM s", recursive=True)
def w1_library_segments(lib: Library) -> DataFrame:
    return library_time.segments(_shots(lib), cap=100, gap_hours=4).select("id", "hard", "sub")


#: Neighbouring segments within 20 hours, and what any stretch i to j of them has: the fold looks its state up here.
_EVENTS = (
    _SEGMENTS.format(hours=2.5, cap=100)
    + """, f AS (SELECT seg, arg_min(id, (taken_ts, id)) AS head, min(taken_ts) AS a, max(taken_ts) AS b, count(*) AS n FROM s GROUP BY 1),
k AS (SELECT *, sum(CASE WHEN a - l > 72000 THEN 1 ELSE 0 END) OVER (ORDER BY seg) AS chunk FROM (SELECT *, lag(b) OVER (ORDER BY seg) AS l FROM f)),
ij AS (SELECT x.seg AS i, y.seg AS j FROM k x JOIN k y ON x.chunk = y.chunk AND x.seg <= y.seg),
w AS (SELECT i, j, s.* FROM ij JOIN s ON s.seg BETWEEN i AND j),
mp AS (SELECT i, j, arg_min(place_id, (-n, f)) AS place, arg_min(city, (-n, f)) AS city FROM (SELECT i, j, place_id, any_value(city) AS city, count(*) AS n, min((taken_ts, id)) AS f FROM w WHERE place_id IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
mf AS (SELECT i, j, arg_min(folder, (-n, f)) AS folder FROM (SELECT i, j, folder, count(*) AS n, min((taken_ts, id)) AS f FROM w GROUP BY 1, 2, 3) GROUP BY 1, 2),
x AS (SELECT i, j, min(taken_ts) AS a, max(taken_ts) AS b, count(*) AS n, arg_min({'lat': lat, 'lon': lon}, (taken_ts, id)) FILTER (lat IS NOT NULL) AS first_at, arg_max({'lat': lat, 'lon': lon}, (taken_ts, id)) FILTER (lat IS NOT NULL) AS last_at FROM w GROUP BY 1, 2),
r AS (SELECT x.*, place, city, folder FROM x LEFT JOIN mp USING (i, j) LEFT JOIN mf USING (i, j)),
m AS (SELECT 1::BIGINT AS seg, 1::BIGINT AS i UNION ALL SELECT m.seg + 1, CASE WHEN {near} THEN m.i ELSE m.seg + 1 END FROM m JOIN r p ON p.i = m.i AND p.j = m.seg JOIN r q ON q.i = m.seg + 1 AND q.j = m.seg + 1),
o AS (SELECT i AS i, max(seg) AS j, row_number() OVER (ORDER BY i) AS nr FROM m GROUP BY i),
e AS (SELECT nr, i, i AS first FROM o WHERE nr = 1 UNION ALL SELECT o.nr, o.i, CASE WHEN {on} THEN e.first ELSE o.i END FROM e JOIN o b ON b.nr = e.nr JOIN o ON o.nr = e.nr + 1 JOIN r p ON p.i = e.first AND p.j = b.j JOIN r q ON q.i = o.i AND q.j = o.j)
SELECT s.id, f.head AS segment, g.head AS session, h.head AS event FROM s JOIN f USING (seg) JOIN m USING (seg) JOIN f g ON g.seg = m.i JOIN e ON e.i = m.i JOIN f h ON h.seg = e.first"""
)
_PLACE = (
    "coalesce(p.place = q.place OR p.city = q.city, false) OR CASE WHEN p.last_at IS NOT NULL AND q.first_at IS NOT NULL THEN "
    "2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(q.first_at.lat - p.last_at.lat) / 2), 2) + cos(radians(p.last_at.lat)) * cos(radians(q.first_at.lat)) * pow(sin(radians(q.first_at.lon - p.last_at.lon) / 2), 2)))) < 15 "
    "ELSE p.place IS NULL OR q.place IS NULL END"
)
_NEAR = f"(floor(p.b / 86400) = floor(q.a / 86400) OR q.a - p.b <= 21600) AND q.a - p.b <= 36000 AND p.n + q.n <= 200 AND ({_PLACE})"
_ON = f"q.a - p.b <= 72000 AND p.n + q.n <= 200 AND coalesce(p.folder = q.folder, false) AND ({_PLACE})"


@query(_EVENTS.replace("{near}", _NEAR).replace("{on}", _ON), recursive=True)
def w3_library_events(lib: Library) -> DataFrame:
    return library_time.event_names(_shots(lib), cap=100)


@query(
    _SHOTS
    + """, w AS (SELECT *, last_value(CASE WHEN lat IS NOT NULL THEN {'t': taken_ts, 'v': lat} END IGNORE NULLS) OVER (ORDER BY taken_ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
  first_value(CASE WHEN lat IS NOT NULL THEN {'t': taken_ts, 'v': lat} END IGNORE NULLS) OVER (ORDER BY taken_ts, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM t)
SELECT id, coalesce(lat, CASE WHEN abs(taken_ts - b.t) <= 90 THEN b.v END, CASE WHEN abs(taken_ts - a.t) <= 90 THEN a.v END) AS inherited FROM w"""
)
def j8_library_inherit(lib: Library) -> DataFrame:
    return library_time.inherit_nearest(_shots(lib), ["taken_ts", "id"], "lat", within=90).select("id", "inherited")


@query(
    """, e AS (SELECT id, 1500000000.0::DOUBLE + id * 40000 AS start_ts, 1500000000.0::DOUBLE + id * 40000 + id % 7 * 1000 AS end_ts, CASE WHEN id // 5 % 3 <> 0 THEN (id % 97 * 5)::DOUBLE END AS away_km, place_id, id % 50 AS photos, id * 2 AS cover, coalesce(place_id = 3, false) AS home FROM photos WHERE id % 6 <> 1),
g AS (SELECT *, coalesce(away_km >= 60 AND NOT home, false) AS away FROM e),
h AS (SELECT *, coalesce(away AND lag(away) OVER w AND start_ts - lag(end_ts) OVER w <= 172800, false) AS goes_on FROM g WINDOW w AS (ORDER BY start_ts, id)),
t AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (ORDER BY start_ts, id) AS run FROM h),
p AS (SELECT run, arg_min(place_id, (-n, f)) AS place_id FROM (SELECT run, place_id, count(*) AS n, min((start_ts, id)) AS f FROM t WHERE away AND place_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
f AS (SELECT run, arg_min(id, (start_ts, id)) AS trip, min(start_ts) AS start_ts, max(end_ts) AS end_ts, count(*) AS events, sum(photos)::BIGINT AS photos, arg_min(cover, (-photos, start_ts, id)) AS cover FROM t WHERE away GROUP BY 1)
SELECT trip, start_ts, end_ts, events, photos, place_id, cover FROM f LEFT JOIN p USING (run) WHERE end_ts - start_ts >= 64800 OR events >= 2"""
)
def a13_library_trips(lib: Library) -> DataFrame:
    k = F.col("id")
    start = 1_500_000_000.0 + k * 40_000
    events = lib.photos.where(k % 6 != 1).select("id", start.alias("start_ts"), (start + k % 7 * 1000).alias("end_ts"), F.when(F.floor(k / 5) % 3 != 0, (k % 97 * 5).cast("double")).alias("away_km"), "place_id", (k % 50).alias("photos"), (k * 2).alias("cover"))
    return library_time.trips(events, "id", F.coalesce(F.col("place_id") == 3, F.lit(False)))
