"""Registered queries over evidence beside the photos: sidecars, tracks and tables that are written and read back, dates,
names and places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactsheet.adapter import WITH, Library
from contactsheet.functions import text
from contactsheet.operators import maintenance, places
from contactsheet.plans import registry
from contactsheet.sources import evidence, export, files
from contactsheet.storage import shared_path

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
query = registry(QUERIES, ORACLE_SQL, WITH)


def _written(lib: Library, rows: DataFrame, name: str) -> str:
    """The folder that ``rows`` (path, content) were written to as files."""
    target = shared_path(lib.spark, name)
    files.export_files(rows, target)
    return target


# Fixed values of the query: an epoch second in 2020.
_BASE = 1_577_836_800


@query(
    f"""SELECT s_suppkey AS id, 'photo ' || s_suppkey || '.jpg' AS title, CASE WHEN s_suppkey % 7 <> 0 THEN ({_BASE} + s_suppkey * 3600)::DOUBLE END AS taken_ts, CASE WHEN s_suppkey % 5 <> 0 THEN (s_suppkey % 180 - 90)::DOUBLE END AS lat,
  CASE WHEN s_suppkey % 5 <> 0 THEN (s_suppkey % 360 - 180)::DOUBLE END AS lon, CASE WHEN s_suppkey % 3 <> 0 THEN s_name END AS description, CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Ana' ELSE 'Ana,' || s_name END AS people,
  s_suppkey % 2 = 0 AS favorited, s_suppkey % 11 = 0 AS archived FROM supplier"""
)
def s8_takeout_sidecars(lib: Library) -> DataFrame:
    k = F.col("s_suppkey")
    named = lambda *names: F.array(*[F.struct(n.alias("name")) for n in names])
    people = F.when(k % 4 == 0, named(F.lit(" "))).when(k % 4 == 1, named(F.lit("Ana"), F.lit("Ana "))).otherwise(named(F.col("s_name"), F.lit("Ana")))
    located = k % 5 != 0
    body = F.to_json(
        F.struct(
            F.concat(F.lit("photo "), k.cast("string"), F.lit(".jpg")).alias("title"),
            F.when(k % 3 == 0, "  ").otherwise(F.col("s_name")).alias("description"),
            F.struct(F.when(k % 7 == 0, "0").otherwise((_BASE + k * 3600).cast("string")).alias("timestamp")).alias("photoTakenTime"),
            F.struct(F.when(located, k % 180 - 90).otherwise(0).cast("double").alias("latitude"), F.when(located, k % 360 - 180).otherwise(0).cast("double").alias("longitude")).alias("geoData"),
            people.alias("people"),
            (k % 2 == 0).alias("favorited"),
            F.when(k % 11 == 0, True).alias("archived"),
        )
    )
    where = _written(lib, lib.table("supplier").select(F.concat((k % 10).cast("string"), F.lit("/"), k.cast("string"), F.lit(".json")).alias("path"), body.alias("content")), "takeout")
    found = evidence.read_takeout(lib.spark, where)
    return found.select(F.regexp_extract("path", r"(\d+)\.json$", 1).cast("long").alias("id"), "title", "taken_ts", "lat", "lon", "description", F.array_join("people", ",").alias("people"), "favorited", "archived")


@query(
    """SELECT s_suppkey AS id, (s_suppkey % 6)::INT AS rating, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'sea & sun,k' || s_suppkey % 9 END AS keywords, CASE WHEN s_suppkey % 4 <> 0 THEN '<' || s_name || '>' END AS description, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE s_name END AS people
FROM supplier WHERE s_suppkey % 6 > 0 OR s_suppkey % 3 <> 0 OR s_suppkey % 4 <> 0 OR s_suppkey % 5 <> 0"""
)
def s11_xmp_sidecars(lib: Library) -> DataFrame:
    k = F.col("s_suppkey")
    none = F.array().cast("array<string>")
    photos = lib.table("supplier").select(
        (k % 10).cast("string").alias("folder"),
        F.concat(k.cast("string"), F.lit(".jpg")).alias("filename"),
        (k % 6).cast("int").alias("rating"),
        F.when(k % 3 == 0, none).otherwise(F.array(F.lit("sea & sun"), F.concat(F.lit("k"), (k % 9).cast("string")))).alias("keywords"),
        F.when(k % 5 == 0, none).otherwise(F.array("s_name")).alias("people"),
        F.when(k % 4 != 0, F.concat(F.lit("<"), "s_name", F.lit(">"))).alias("description"),
    )
    made = export.xmp_sidecars(photos)
    # Keywords are written as subjects too, as other programs do.
    subjects = F.regexp_replace("xml", "<lr:hierarchicalSubject>(.*)</lr:hierarchicalSubject>", "<dc:subject>$1</dc:subject><lr:hierarchicalSubject>$1</lr:hierarchicalSubject>")
    found = evidence.read_xmp(lib.spark, _written(lib, made.select("path", subjects.alias("content")), "xmp"))
    words = F.filter("keywords", lambda w: ~w.startswith("People|"))
    return found.select(F.regexp_extract("path", r"(\d+)\.jpg\.xmp$", 1).cast("long").alias("id"), "rating", F.array_join(words, ",").alias("keywords"), "description", F.array_join("people", ",").alias("people"))


@query(
    """SELECT event_id % 40 AS track, round(epoch_us(date_trunc('second', ts)) / 1e6, 3) AS ts, round(value / 10 - 40, 6) AS lat, round(value / 5 + 1, 6) AS lon FROM events WHERE event_id % 9 <> 0"""
)
def s12_gpx_points(lib: Library) -> DataFrame:
    # One file for each track and day, so a file stays small; every ninth point has no time and is left out.
    k, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    point = F.concat(
        F.lit('<trkpt lat="'), F.round(F.col("value") / 10 - 40, 6).cast("string"), F.lit('" lon="'), F.round(F.col("value") / 5 + 1, 6).cast("string"), F.lit('">'),
        F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("<time>"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</time>"))), F.lit("</trkpt>"),
    )
    of = lib.table("events").select((k % 40).alias("track"), F.date_format(ts, "yyyyMMdd").alias("day"), point.alias("point")).groupBy("track", "day").agg(F.array_join(F.collect_list("point"), "").alias("points"))
    body = F.concat(F.lit('<gpx xmlns="http://www.topografix.com/GPX/1/1"><trk><name>'), F.col("track").cast("string"), F.lit("</name><trkseg>"), F.col("points"), F.lit("</trkseg></trk></gpx>"))
    rows = of.select(F.concat("day", F.lit("/"), F.col("track").cast("string"), F.lit(".gpx")).alias("path"), body.alias("content"))
    found = evidence.read_gpx(lib.spark, _written(lib, rows, "gpx"))
    return found.select(F.col("track").cast("long").alias("track"), F.round("ts", 3).alias("ts"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query(
    """SELECT 'IMG_' || c_custkey || '.JPG' AS img_name, epoch(make_timestamp(2000 + c_custkey % 20, 1 + c_custkey % 12, 1 + c_custkey % 28, c_custkey % 24, c_custkey % 60, 0))::DOUBLE AS created_ts, c_custkey % 3 = 0 AS favorite, c_custkey % 7 = 0 AS hidden, c_custkey % 5 = 0 AS deleted FROM customer"""
)
def s10_icloud_details(lib: Library) -> DataFrame:
    k = F.col("c_custkey")
    at = F.make_timestamp((2000 + k % 20).cast("int"), (1 + k % 12).cast("int"), (1 + k % 28).cast("int"), (k % 24).cast("int"), (k % 60).cast("int"), F.lit(0))
    yes = lambda on: F.when(on, "yes").otherwise("no")
    line = F.concat_ws(",", F.concat(F.lit("IMG_"), k.cast("string"), F.lit(".JPG")), F.concat(F.lit('"'), F.date_format(at, "EEEE MMMM d,yyyy h:mm a"), F.lit(' GMT"')), yes(k % 3 == 0), yes(k % 7 == 0), yes(k % 5 == 0))
    where = shared_path(lib.spark, "icloud")
    lib.table("customer").select(line.alias("value")).unionAll(lib.spark.createDataFrame([("imgName,originalCreationDate,favorite,hidden,deleted",)], "value string")).write.text(where)
    return evidence.read_icloud(lib.spark, where)


_GAZETTEER = """, g AS (SELECT s_suppkey AS geonameid, s_name AS name, (s_suppkey * 7 % 160 - 80) + (s_suppkey % 10) * 0.02 AS lat, (s_suppkey * 7 % 350 - 175) + (s_suppkey % 9) * 0.03 AS lon, CASE s_suppkey % 5 WHEN 0 THEN 'PPLA' WHEN 1 THEN 'PPLA3' WHEN 2 THEN 'PPLH' ELSE 'PPL' END AS fcode,
  'C' || s_nationkey AS country, 'A' || s_suppkey % 4 AS admin1, CASE WHEN s_suppkey % 6 <> 0 THEN s_suppkey * 977 % 90000 ELSE 0 END AS population FROM supplier WHERE s_suppkey % 13 <> 0)
"""


def _gazetteer(lib: Library) -> DataFrame:
    k = F.col("s_suppkey")
    code = F.when(k % 5 == 0, "PPLA").when(k % 5 == 1, "PPLA3").when(k % 5 == 2, "PPLH").otherwise("PPL")
    position = [((k * 7 % 160 - 80) + (k % 10) * F.lit(0.02)).alias("lat"), ((k * 7 % 350 - 175) + (k % 9) * F.lit(0.03)).alias("lon")]
    facts = [F.concat(F.lit("C"), F.col("s_nationkey").cast("string")).alias("country"), F.concat(F.lit("A"), (k % 4).cast("string")).alias("admin1"), F.when(k % 6 != 0, k * 977 % 90_000).alias("population")]
    return lib.table("supplier").select(k.alias("geonameid"), F.col("s_name").alias("name"), *position, F.when(k % 13 == 0, "H").otherwise("P").alias("fclass"), code.alias("fcode"), *facts)


@query(_GAZETTEER + "SELECT geonameid, name, round(lat, 6) AS lat, round(lon, 6) AS lon, fcode, country, admin1, population::BIGINT AS population FROM g WHERE fcode <> 'PPLH'")
def s13_gazetteer(lib: Library) -> DataFrame:
    rows = _gazetteer(lib)
    blank = F.lit("")
    columns = ["geonameid", "name", blank, blank, "lat", "lon", "fclass", "fcode", "country", blank, "admin1", blank, blank, blank, "population", blank, blank, blank, blank]
    line = F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), blank) if isinstance(c, str) else c for c in columns]), "\t")
    where = shared_path(lib.spark, "gazetteer")
    both = rows.select(line.alias("value"))
    both.unionAll(both.where("value LIKE '1%'")).write.text(where)  # some lines twice
    found = evidence.read_gazetteer(lib.spark, where)
    return found.select("geonameid", "name", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "fcode", "country", "admin1", "population")


@query(
    _GAZETTEER
    + """, q AS (SELECT c_custkey AS id, (c_custkey * 7 % 160 - 80) + (c_custkey % 11) * 0.02 AS lat, (c_custkey * 7 % 350 - 175) + (c_custkey % 8) * 0.03 AS lon FROM customer),
d AS (SELECT q.id, geonameid AS p, population, fcode, round(2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(g.lat - q.lat) / 2), 2) + cos(radians(q.lat)) * cos(radians(g.lat)) * pow(sin(radians(g.lon - q.lon) / 2), 2)))), 6) AS km,
  least(35.0, 2.5 + 6 * greatest(0.0, log10(greatest(population, 1) / 10000.0)) + CASE WHEN fcode = 'PPLA' THEN 2 ELSE 0 END) AS reach, CASE fcode WHEN 'PPLA' THEN 0.5 WHEN 'PPLA3' THEN 0.2 ELSE 0 END AS bonus FROM q, g),
s AS (SELECT *, round(log10(greatest(population, 1) + 1) - 1.2 * km / reach + bonus, 9) AS score FROM d WHERE km <= 60),
k AS (SELECT id, arg_min({'p': p, 'km': km, 'n': population, 'f': fcode, 'r': reach}, (km, p)) FILTER (km <= 15) AS l, arg_min({'p': p, 'km': km, 'n': population, 'f': fcode, 'r': reach}, (-score, p)) FILTER (km <= 35 AND km <= reach) AS c,
  arg_min({'p': p, 'km': km, 'n': population, 'f': fcode, 'r': reach}, (km, p)) FILTER (km <= 25 AND population >= 5000) AS b, arg_min({'p': p, 'km': km, 'n': population, 'f': fcode, 'r': reach}, (km, p)) AS x FROM s GROUP BY 1),
t AS (SELECT id, l, coalesce(c, b, l, x) AS c FROM k)
SELECT id, CASE WHEN coalesce(c.p <> l.p AND ((l.km <= 3 AND c.n < 20000 AND c.f NOT IN ('PPLA', 'PPLA3') AND c.km > l.km) OR (l.n >= 3000 AND c.km / c.r > 0.75 AND c.n < 300000)), false) THEN l.p ELSE c.p END AS city_id, l.p AS locality_id FROM t"""
)
def m3_city_of(lib: Library) -> DataFrame:
    k = F.col("c_custkey")
    points = lib.table("customer").select(k.alias("id"), ((k * 7 % 160 - 80) + (k % 11) * F.lit(0.02)).alias("lat"), ((k * 7 % 350 - 175) + (k % 8) * F.lit(0.03)).alias("lon"))
    return places.city_of(points, _gazetteer(lib).where("fclass = 'P'"))


@query(
    """, o AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN '+' ELSE '-' END AS s, c_custkey % 17 AS h, c_custkey * 7 % 70 AS m FROM customer)
SELECT id, CASE WHEN m < 60 AND h * 60 + m <= 840 THEN CASE s WHEN '-' THEN -1 ELSE 1 END * (h * 60 + m) END::INT AS minutes FROM o"""
)
def d3_offsets(lib: Library) -> DataFrame:
    k = F.col("c_custkey")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    said = F.concat(F.when(k % 2 == 0, " +").otherwise("-"), two(k % 17), F.when(k % 3 == 0, ":").otherwise(""), two(k * 7 % 70), F.when(k % 5 == 0, " ").otherwise(""))
    return lib.table("customer").select(k.alias("id"), text.offset_minutes(said).alias("minutes"))


_FOLDERS = """, f AS (SELECT c_custkey AS id, (1995 + c_custkey % 20)::INT AS y, (1 + c_custkey * 5 % 12)::INT AS m, (1 + c_custkey * 3 % 28)::INT AS d, c_custkey % 6 AS k FROM customer)
"""


@query(
    _FOLDERS
    + """SELECT id, CASE WHEN k < 5 THEN strftime(make_timestamp(y, CASE WHEN k = 4 THEN 7 ELSE m END, CASE k WHEN 0 THEN d WHEN 1 THEN d WHEN 4 THEN 1 ELSE 15 END, 0, 0, 0), '%Y-%m-%d') END AS day, CASE k WHEN 0 THEN 'date' WHEN 1 THEN 'date' WHEN 2 THEN 'month' WHEN 3 THEN 'month' WHEN 4 THEN 'year' END AS precision FROM f"""
)
def d5_folder_dates(lib: Library) -> DataFrame:
    k = F.col("c_custkey")
    y, m, d = (1995 + k % 20), (1 + k * 5 % 12), (1 + k * 3 % 28)
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    name = F.date_format(F.make_date(F.lit(2000), m.cast("int"), F.lit(1)), "MMMM")
    ys = y.cast("string")
    folder = (
        F.when(k % 6 == 0, F.concat(F.lit("1991/"), ys, F.lit("-"), two(m), F.lit("-"), two(d), F.lit(" Goa")))
        .when(k % 6 == 1, F.concat(F.lit("Trips/"), ys, two(m), two(d), F.lit("/raw")))
        .when(k % 6 == 2, F.concat(F.lit("1991/"), name, F.lit(" "), ys))
        .when(k % 6 == 3, F.concat(F.lit("Phone/"), ys, F.lit("_"), two(m)))
        .when(k % 6 == 4, F.concat(F.lit("Old "), ys, F.lit("/scans")))
        .otherwise("Camera/Roll")
    )
    return lib.table("customer").select(k.alias("id"), text.date_from_folder(folder).alias("d")).select("id", F.date_format("d.ts", "yyyy-MM-dd").alias("day"), "d.precision")


@query(
    """, p AS (SELECT id, id % 2 = 0 AS exif, id % 3 = 0 AS digitized, id % 5 = 0 AS xmp, id % 4 = 0 AS named, id % 7 = 0 AS modified, id % 8 = 1 AS folder FROM photos)
SELECT id, CASE WHEN exif THEN 1 WHEN digitized THEN 2 WHEN xmp THEN 3 WHEN modified THEN 5 WHEN folder THEN 7 ELSE 8 END AS day, CASE WHEN exif THEN 'exif' WHEN digitized THEN 'exif_digitized' WHEN xmp THEN 'xmp' WHEN modified THEN 'exif_modified' WHEN folder THEN 'folder' ELSE 'mtime' END AS source,
  CASE WHEN exif OR digitized OR xmp THEN 'high' WHEN modified THEN 'medium' ELSE 'low' END AS confidence FROM p"""
)
def d6_capture_dates(lib: Library) -> DataFrame:
    k = F.col("id")
    on = lambda day, when: F.when(when, F.make_timestamp(F.lit(2001), F.lit(1), F.lit(day), F.lit(3), F.lit(4), F.lit(5)))
    named = F.when(k % 4 == 0, F.struct(on(6, F.lit(True)).alias("ts"), F.lit("date").alias("precision"), F.lit(None).cast("string").alias("source")))
    found = evidence.capture_date(on(1, k % 2 == 0), on(2, k % 3 == 0), on(3, k % 5 == 0), named, on(5, k % 7 == 0), on(7, k % 8 == 1), on(9, F.lit(True)), on(8, F.lit(True)))
    return lib.photos.select("id", found.alias("d")).select("id", F.dayofmonth("d.ts").alias("day"), "d.source", "d.confidence")


@query(
    """SELECT id, CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Ana' ELSE 'Ana, ' || name || ' and Bo' END AS names, CASE WHEN id % 4 <> 0 AND city IS NOT NULL THEN 'Birthday in ' || city WHEN id % 4 <> 0 THEN 'Birthday' ELSE coalesce(CASE WHEN id % 8 = 0 THEN 'Beach' END, city, 'March 2001') END AS title,
  concat_ws(', ', name, CASE WHEN city <> name THEN city END, CASE WHEN admin1 <> name AND admin1 IS DISTINCT FROM city THEN admin1 END) AS label FROM places"""
)
def f6_titles(lib: Library) -> DataFrame:
    k = F.col("id")
    names = F.when(k % 3 == 0, F.array(F.lit(""))).when(k % 3 == 1, F.array(F.lit("Ana"), F.lit(None).cast("string"))).otherwise(F.array(F.lit("Ana"), F.lit(""), F.col("name"), F.lit("Bo")))
    title = text.event_title(F.when(k % 4 != 0, "Birthday"), F.col("city"), F.when(k % 8 == 0, "Beach"), F.lit("2001-03-04").cast("timestamp"))
    return lib.places.select("id", text.joined_names(names).alias("names"), title.alias("title"), text.place_label(F.col("name"), F.col("city"), F.col("admin1")).alias("label"))


@query("SELECT id, CASE id % 4 WHEN 0 THEN 'img_' || id || '-edited|img_' || id WHEN 1 THEN 'IMG-Effects|IMG' WHEN 2 THEN 'img_' || id ELSE 'edited' END AS stems FROM photos")
def f12_stems(lib: Library) -> DataFrame:
    k = F.col("id")
    own = F.concat(F.lit("img_"), k.cast("string"))
    stem = F.when(k % 4 == 0, F.concat(own, F.lit("-edited"))).when(k % 4 == 1, "IMG-Effects").when(k % 4 == 2, own).otherwise("edited")
    return lib.photos.select("id", F.array_join(text.stem_variants(stem), "|").alias("stems"))


@query("SELECT id, coalesce(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (abs(lat) < 1e-6 AND abs(lon) < 1e-6), false) AS is_real FROM (SELECT id, CASE id % 7 WHEN 0 THEN 0 WHEN 1 THEN 95 ELSE lat END AS lat, CASE id % 7 WHEN 0 THEN 0 WHEN 2 THEN -181 ELSE lon END AS lon FROM photos)")
def m21_positions(lib: Library) -> DataFrame:
    k = F.col("id")
    lat, lon = F.when(k % 7 == 0, 0.0).when(k % 7 == 1, 95.0).otherwise(F.col("lat")), F.when(k % 7 == 0, 0.0).when(k % 7 == 2, -181.0).otherwise(F.col("lon"))
    return lib.photos.select("id", F.coalesce(evidence.real_position(lat, lon), F.lit(False)).alias("is_real"))


_NAMES = """, m AS (SELECT id, folder, 'photo of the day number ' || id AS s, id % 8 AS k FROM photos)
"""


@query(
    _NAMES
    + """SELECT id, CASE k WHEN 0 THEN s || '.jpg.json' WHEN 1 THEN s || '.jpg.supplemental-metadata.json' WHEN 2 THEN s || '.jpg.suppl.json' WHEN 3 THEN s || '.json' WHEN 4 THEN s || '.jpg(2).json' WHEN 5 THEN s || '.jpg.json' END AS sidecar FROM m WHERE k < 6"""
)
def j16_sidecars(lib: Library) -> DataFrame:
    k = F.col("id") % 8
    stem = F.concat(F.lit("photo of the day number "), F.col("id").cast("string"))
    filename = F.when(k == 4, F.concat(stem, F.lit("(2).jpg"))).when(k == 5, F.concat(stem, F.lit("-edited.JPG"))).otherwise(F.concat(stem, F.lit(".jpg")))
    endings = {0: [".jpg.json", ".json"], 1: [".jpg.supplemental-metadata.json", ".jpg.supp.json"], 2: [".jpg.suppl.json", ".jpg.su.json"], 3: [".json"], 4: [".jpg(2).json", ".jpg.json"], 5: [".jpg.json"], 6: [".jpg(3).json"], 7: [".png.json"]}
    made = F.lit(None).cast("array<string>")
    for n, own in endings.items():
        made = F.when(k == n, F.array(*[F.concat(stem, F.lit(e)) for e in own])).otherwise(made)
    sidecars = lib.photos.select("folder", F.explode(made).alias("sidecar"))
    return evidence.match_sidecars(lib.photos.select("id", "folder", filename.alias("filename")), sidecars)


@query(
    """, m AS (SELECT id, folder, 's' || id // 2 AS stem, id % 5 AS k, CASE WHEN id % 2 = 1 AND id // 2 % 3 = 0 THEN 'raw' ELSE 'image' END AS media_type FROM photos),
o AS (SELECT id, stem || '.' || id || '.jpg.XMP' AS xmp FROM m WHERE k = 0), f AS (SELECT *, row_number() OVER (PARTITION BY folder, stem ORDER BY media_type <> 'raw', id) AS r FROM m),
s AS (SELECT DISTINCT folder, stem FROM m WHERE k = 1 OR k = 3)
SELECT id, xmp FROM o UNION ALL SELECT id, stem || '.xmp' FROM f JOIN s USING (folder, stem) WHERE r = 1 AND k <> 0"""
)
def j18_xmp_files(lib: Library) -> DataFrame:
    k = F.col("id")
    stem = F.concat(F.lit("s"), F.floor(k / 2).cast("string"))
    media = lib.photos.select("id", "folder", F.concat(stem, F.lit("."), k.cast("string"), F.lit(".jpg")).alias("filename"), stem.alias("stem"), F.when((k % 2 == 1) & (F.floor(k / 2) % 3 == 0), "raw").otherwise("image").alias("media_type"))
    own = media.where(k % 5 == 0).select("folder", F.concat("filename", F.lit(".XMP")).alias("xmp"))
    shared = media.where((k % 5).isin(1, 3)).select("folder", F.concat("stem", F.lit(".xmp")).alias("xmp")).distinct()
    return evidence.match_xmp(media, own.unionAll(shared))


@query("SELECT photo_id, tag, score FROM photo_tags WHERE photo_id % 3 <> 0 UNION ALL SELECT photo_id, tag, -1.0 FROM photo_tags WHERE photo_id % 3 = 0 AND photo_id % 2 = 0")
def k4_insert_missing(lib: Library) -> DataFrame:
    old = lib.photo_tags.where(F.col("photo_id") % 3 != 0)
    new = lib.photo_tags.where(F.col("photo_id") % 2 == 0).withColumn("score", F.lit(-1.0))
    return maintenance.insert_missing(old, new.unionAll(new), ["photo_id", "tag"])


@query("""SELECT 'rate' AS action, 'photo' AS entity_type, id AS entity_id, '{"id":' || id || ',"rating":' || rating || '}' AS details, 'ana' AS actor FROM visible WHERE rating >= 4""")
def k13_audit_rows(lib: Library) -> DataFrame:
    changed = lib.photos.where((F.col("status") == "ok") & (F.col("hidden") == 0) & (F.col("live_component") == 0) & (F.col("rating") >= 4)).select("id", "rating")
    return export.audit_rows(changed, "rate", "photo", "id", "ana")
