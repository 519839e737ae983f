"""Registered queries over text, the keyword index and incremental maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactsheet.adapter import WITH, Library
from contactsheet.functions import text
from contactsheet.operators import keywords, maintenance, postings
from contactsheet.operators.predicates import visible
from contactsheet.plans import registry
from contactsheet.sources import export, files
from contactsheet.storage import shared_path

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
query = registry(QUERIES, ORACLE_SQL, WITH)

_FOLD = "strip_accents(lower(text))"
_WORDS = f""", w AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace({_FOLD}, '[''\u2019]s\\b', '', 'g'), '[^a-z0-9\\-]+'), lambda x: x <> '') AS w FROM documents)
"""


@query(f"SELECT doc_id, md5({_FOLD}) AS folded FROM documents")
def f1_fold(lib: Library) -> DataFrame:
    return lib.table("documents").select("doc_id", F.md5(text.fold(F.col("text")).cast("binary")).alias("folded"))


@query(_WORDS + "SELECT doc_id, len(w)::INT AS n, md5(array_to_string(w, ' ')) AS words FROM w")
def f2_tokens(lib: Library) -> DataFrame:
    words = lib.table("documents").select("doc_id", text.tokens(F.col("text")).alias("w"))
    return words.select("doc_id", F.when(F.col("w").isNotNull(), F.size("w")).alias("n"), F.md5(F.array_join("w", " ").cast("binary")).alias("words"))


@query(_WORDS + "SELECT doc_id FROM w WHERE list_contains(w, 'the') AND list_contains(w, 'license')")
def f13_fts_and(lib: Library) -> DataFrame:
    return keywords.search_all(lib.table("documents"), "text", ["the", "license"]).select("doc_id")


@query(_WORDS + "SELECT doc_id FROM w WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' licensed under the ')")
def p20_phrase(lib: Library) -> DataFrame:
    return keywords.search_phrase(lib.table("documents"), "text", ["licensed", "under", "the"]).select("doc_id")


@query(
    _WORDS
    + """, c AS (SELECT doc_id, len(w) AS l, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'license')) AS b FROM w),
f AS (SELECT count(*)::DOUBLE AS n, avg(l) AS m, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c)
SELECT doc_id, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / m)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / m)), 6) AS score
FROM c, f WHERE a > 0 AND b > 0 ORDER BY score DESC, doc_id LIMIT 500"""
)
def f13_bm25(lib: Library) -> DataFrame:
    return keywords.bm25(lib.table("documents"), "doc_id", "text", ["the", "license"])


_ASKED = _WORDS + f""", i AS (SELECT item_id AS query_id, list_filter(regexp_split_to_array(regexp_replace({_FOLD}, '[''\u2019]s\\b', '', 'g'), '[^a-z0-9\\-]+'), lambda x: x <> '') AS terms FROM benchmark)
"""


def _index(lib: Library) -> postings.Index:
    """An index of ``documents`` that was built from another state of them: some absent, some with another text, some since
    deleted; and then brought up to date."""
    docs, k = lib.table("documents").select("doc_id", "text"), F.col("doc_id")
    before = docs.where(k % 7 != 3).select("doc_id", F.when(k % 11 == 4, F.concat(F.lit("formerly the license of "), "text")).otherwise(F.col("text")).alias("text"))
    gone = docs.where(k % 13 == 1).select((k + 1_000_000_000).alias("doc_id"), "text")
    return postings.update(postings.build(before.unionAll(gone), "doc_id", "text"), docs, "doc_id", "text")


def _items(lib: Library) -> DataFrame:
    return lib.table("benchmark").select(F.col("item_id").alias("query_id"), text.tokens(F.col("text")).alias("terms"))


def _longest(lib: Library) -> DataFrame:
    """Of every item its two longest words."""
    by_size = lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)
    return _items(lib).select("query_id", F.slice(F.array_sort(F.array_distinct("terms"), by_size), 1, 2).alias("terms"))


_TWO = _ASKED + """, o AS (SELECT query_id, list_distinct(terms) AS terms FROM i), u AS (SELECT query_id, unnest(terms) AS term FROM o),
q AS (SELECT query_id, term FROM u QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY len(term) DESC, term) <= 2)
"""


@query(_TWO + "SELECT query_id, doc_id AS key FROM q JOIN w ON list_contains(w, term) GROUP BY 1, 2 HAVING count(*) = 2")
def f13_index_and(lib: Library) -> DataFrame:
    return postings.search_all(_index(lib), _longest(lib))


@query(_ASKED + "SELECT query_id, doc_id AS key FROM i JOIN w ON contains(' ' || array_to_string(w, ' ') || ' ', ' ' || array_to_string(terms, ' ') || ' ')")
def p20_index_phrase(lib: Library) -> DataFrame:
    return postings.search_phrase(_index(lib), _items(lib)).select("query_id", "key")


@query(
    _TWO
    + """, c AS (SELECT query_id, term, doc_id, len(w) AS l, len(list_filter(w, lambda x: x = term)) AS tf FROM q JOIN w ON list_contains(w, term)),
f AS (SELECT count(*)::DOUBLE AS n, avg(coalesce(len(w), 0)) AS m FROM w), d AS (SELECT query_id, term, count(*) AS df FROM c GROUP BY 1, 2),
s AS (SELECT query_id, doc_id AS key, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / m))), 6) AS score FROM c JOIN d USING (query_id, term), f GROUP BY 1, 2 HAVING count(*) = 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key)::INT AS rank, key, score FROM s QUALIFY rank <= 100"""
)
def f13_index_bm25(lib: Library) -> DataFrame:
    return postings.bm25(_index(lib), _longest(lib), 100)


@query(
    """, n AS (SELECT photo_id, string_agg(DISTINCT name, ' ' ORDER BY name) AS names FROM faces JOIN persons ON persons.id = person_id WHERE name IS NOT NULL GROUP BY 1),
t AS (SELECT photo_id, string_agg(tag, ' ' ORDER BY tag) AS tags FROM photo_tags WHERE score >= 1.5 GROUP BY 1)
SELECT v.id, concat_ws(' ', filename, folder, p.name, country, names, tags) AS doc FROM visible v LEFT JOIN places p ON p.id = place_id LEFT JOIN n ON n.photo_id = v.id LEFT JOIN t ON t.photo_id = v.id"""
)
def f14_document(lib: Library) -> DataFrame:
    # The lists hold one photo's names and tags.
    joined = lambda rows, what, name: rows.groupBy("photo_id").agg(F.array_join(F.array_sort(F.collect_set(what)), " ").alias(name))
    names = joined(lib.faces.join(lib.persons.where(F.col("name").isNotNull()), F.col("person_id") == F.col("id")).select("photo_id", "name"), "name", "names").withColumnRenamed("photo_id", "n_id")
    tags = joined(lib.photo_tags.where(F.col("score") >= 1.5), "tag", "tags").withColumnRenamed("photo_id", "t_id")
    place = lib.places.select(F.col("id").alias("p_id"), F.col("name").alias("place"), "country")
    rows = visible(lib.photos).join(place, F.col("place_id") == F.col("p_id"), "left").join(names, F.col("id") == F.col("n_id"), "left").join(tags, F.col("id") == F.col("t_id"), "left")
    return rows.select("id", keywords.document(*map(F.col, ("filename", "folder", "place", "country", "names", "tags"))).alias("doc"))


_NAMES = """, n AS (SELECT id, source_kind AS was, CASE id % 8 WHEN 0 THEN 'WhatsApp Image ' || strftime(d, '%Y-%m-%d') || ' at 2.' || strftime(d, '%M') || '.09 PM.jpeg' WHEN 1 THEN 'Screen Shot ' || strftime(d, '%Y-%m-%d') || ' at 12.03.04 AM.png'
    WHEN 2 THEN 'FB_IMG_' || (1565524312345 + id * 1000) || '.jpg' WHEN 3 THEN 'IMG-' || strftime(d, '%Y%m%d') || '-WA' || id || '.jpg' WHEN 4 THEN strftime(d, '%Y-%m-%d') || ' 14.30.12.jpg' WHEN 5 THEN 'scan ' || id || ' (2).jpg'
    WHEN 6 THEN 'IMG_' || strftime(d, '%Y%m%d') || '_256199.jpg' ELSE filename END AS name,
  CASE id % 3 WHEN 0 THEN folder WHEN 1 THEN 'Phone/Downloads' ELSE 'Old/Screenshots' END AS dir, CASE id % 5 WHEN 0 THEN 'NIKON CORPORATION' WHEN 1 THEN 'samsung' END AS make, CASE id % 7 WHEN 0 THEN 'Adobe Lightroom' END AS software, d
  FROM photos, LATERAL (SELECT make_timestamp((coalesce(taken_ts, 0) * 1000000)::BIGINT + 86400000000 * 366 * 15) AS d))
"""


def _named(lib: Library) -> DataFrame:
    """Photos under names of many kinds, with folders, makers and software."""
    k, d = F.col("id"), F.timestamp_seconds(F.coalesce("taken_ts", F.lit(0.0)) + 86400 * 366 * 15)
    on = lambda form: F.date_format(d, form)
    join = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    name = (
        F.when(k % 8 == 0, join("WhatsApp Image ", on("yyyy-MM-dd"), " at 2.", on("mm"), ".09 PM.jpeg"))
        .when(k % 8 == 1, join("Screen Shot ", on("yyyy-MM-dd"), " at 12.03.04 AM.png"))
        .when(k % 8 == 2, join("FB_IMG_", (1_565_524_312_345 + k * 1000).cast("string"), ".jpg"))
        .when(k % 8 == 3, join("IMG-", on("yyyyMMdd"), "-WA", k.cast("string"), ".jpg"))
        .when(k % 8 == 4, join(on("yyyy-MM-dd"), " 14.30.12.jpg"))
        .when(k % 8 == 5, join("scan ", k.cast("string"), " (2).jpg"))
        .when(k % 8 == 6, join("IMG_", on("yyyyMMdd"), "_256199.jpg"))
        .otherwise(F.col("filename"))
    )
    folder = F.when(k % 3 == 0, F.col("folder")).when(k % 3 == 1, "Phone/Downloads").otherwise("Old/Screenshots")
    make = F.when(k % 5 == 0, "NIKON CORPORATION").when(k % 5 == 1, "samsung")
    return lib.photos.select("id", name.alias("name"), folder.alias("dir"), make.alias("make"), F.when(k % 7 == 0, "Adobe Lightroom").alias("software"))


@query(
    _NAMES
    + """SELECT id, CASE WHEN id % 8 = 1 OR dir LIKE '%Screenshots%' THEN 'screenshot' WHEN id % 8 IN (0, 3) THEN 'whatsapp' WHEN make IS NOT NULL AND (software IS NOT NULL OR id % 8 = 5) THEN 'edited' WHEN make = 'samsung' THEN 'phone' WHEN make IS NOT NULL THEN 'camera'
  WHEN dir LIKE '%Downloads' OR id % 8 = 2 THEN 'download' WHEN id % 8 = 5 THEN 'scan' WHEN id % 8 IN (4, 7) THEN 'phone' ELSE 'unknown' END AS kind FROM n"""
)
def m20_source_kind(lib: Library) -> DataFrame:
    return _named(lib).select("id", text.source_kind(F.col("name"), F.col("dir"), F.col("make"), software=F.col("software")).alias("kind"))


@query(
    _NAMES
    + """SELECT id, CASE id % 8 WHEN 0 THEN strftime(d, '%Y-%m-%d 14:%M:09') WHEN 1 THEN strftime(d, '%Y-%m-%d 00:03:04') WHEN 2 THEN strftime(make_timestamp((1565524312345 + id * 1000) * 1000), '%Y-%m-%d %H:%M:%S') WHEN 3 THEN strftime(d, '%Y-%m-%d 12:00:00')
  WHEN 4 THEN strftime(d, '%Y-%m-%d 14:30:12') WHEN 6 THEN strftime(d, '%Y-%m-%d 12:00:00') WHEN 7 THEN strftime(strptime(regexp_extract(name, '(\\d{8}_\\d{6})'), '%Y%m%d_%H%M%S'), '%Y-%m-%d %H:%M:%S') END AS taken,
  CASE WHEN id % 8 IN (3, 6) THEN 'date' WHEN id % 8 <> 5 THEN 'datetime' END AS precision, CASE id % 8 WHEN 0 THEN 'whatsapp' WHEN 1 THEN 'screenshot' WHEN 2 THEN 'download' WHEN 3 THEN 'whatsapp' WHEN 4 THEN 'phone' WHEN 7 THEN 'phone' END AS source FROM n"""
)
def d4_filename_kinds(lib: Library) -> DataFrame:
    rows = _named(lib).select("id", text.date_from_filename(F.col("name"), 2200).alias("d"))
    return rows.select("id", F.date_format("d.ts", "yyyy-MM-dd HH:mm:ss").alias("taken"), F.col("d.precision").alias("precision"), F.col("d.source").alias("source"))


_LISTING = """, known AS (SELECT id % 4 AS root_id, filename AS rel_path, size, coalesce(taken_ts, 0) AS mtime, status FROM photos),
listing AS (SELECT root_id, rel_path, CASE WHEN size % 7 = 0 THEN size + 1 ELSE size END AS size, mtime + CASE WHEN size % 5 = 0 THEN 0.5 WHEN size % 5 = 1 THEN 2 ELSE 0 END AS mtime FROM known WHERE root_id <> 3 AND size % 11 <> 0
  UNION ALL SELECT root_id, 'new/' || rel_path, size, mtime FROM known WHERE root_id = 1 AND size % 13 = 0)
"""


@query(
    _LISTING
    + """SELECT coalesce(k.root_id, n.root_id) AS root_id, coalesce(k.rel_path, n.rel_path) AS rel_path, CASE WHEN n.rel_path IS NULL THEN 'missing' WHEN k.rel_path IS NULL THEN 'new' WHEN status = 'missing' THEN 'restored'
  WHEN k.size <> n.size OR abs(k.mtime - n.mtime) > 1 THEN 'changed' ELSE 'unchanged' END AS change
FROM known k FULL JOIN listing n ON k.root_id = n.root_id AND k.rel_path = n.rel_path
WHERE n.rel_path IS NOT NULL OR (k.root_id IN (SELECT root_id FROM listing) AND status <> 'missing')"""
)
def s3_snapshot_diff(lib: Library) -> DataFrame:
    known = lib.photos.select((F.col("id") % 4).alias("root_id"), F.col("filename").alias("rel_path"), "size", F.coalesce("taken_ts", F.lit(0.0)).alias("mtime"), "status")
    kept = known.where((F.col("root_id") != 3) & (F.col("size") % 11 != 0))
    shift = F.when(F.col("size") % 5 == 0, 0.5).when(F.col("size") % 5 == 1, 2.0).otherwise(0.0)
    listing = kept.select("root_id", "rel_path", F.when(F.col("size") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), (F.col("mtime") + shift).alias("mtime"))
    fresh = known.where((F.col("root_id") == 1) & (F.col("size") % 13 == 0)).select("root_id", F.concat(F.lit("new/"), F.col("rel_path")), "size", "mtime")
    return maintenance.snapshot_diff(known, listing.unionAll(fresh))


@query(
    """, k AS (SELECT id % 4 AS root_id, folder || '/' || (id % 7) || '/' || filename AS rel_path, size, coalesce(taken_ts, 0) AS mtime, CASE WHEN id % 19 = 0 THEN 'trashed' ELSE status END AS status FROM photos),
l AS (SELECT * FROM k WHERE root_id <> 3 AND size % 5 <> 0), u AS (SELECT 0 AS root_id, 'BUILDING/1996' AS p UNION ALL SELECT 1, 'MACHINERY' UNION ALL SELECT 2, 'HOUSEHOLD/1997/03/4' UNION ALL SELECT 2, 'HOUSE')
SELECT k.root_id, k.rel_path, CASE WHEN l.rel_path IS NULL THEN 'missing' WHEN k.status = 'missing' THEN 'restored' ELSE 'unchanged' END AS change FROM k LEFT JOIN l USING (root_id, rel_path)
WHERE l.rel_path IS NOT NULL OR (k.root_id <> 3 AND k.status NOT IN ('missing', 'trashed') AND NOT EXISTS (FROM u WHERE u.root_id = k.root_id AND (k.rel_path = p OR starts_with(k.rel_path, p || '/'))))"""
)
def s3_partial(lib: Library) -> DataFrame:
    k = F.col("id")
    path = F.concat_ws("/", "folder", (k % 7).cast("string"), "filename")
    known = lib.photos.select((k % 4).alias("root_id"), path.alias("rel_path"), "size", F.coalesce("taken_ts", F.lit(0.0)).alias("mtime"), F.when(k % 19 == 0, "trashed").otherwise(F.col("status")).alias("status"))
    listing = known.where((F.col("root_id") != 3) & (F.col("size") % 5 != 0)).drop("status")
    unread = lib.spark.createDataFrame([(0, "BUILDING/1996"), (1, "MACHINERY"), (2, "HOUSEHOLD/1997/03/4"), (2, "HOUSE")], "root_id long, rel_path string")
    return maintenance.snapshot_diff(known, listing, unread=unread)


@query(
    """SELECT (doc_id % 50)::VARCHAR || '/' || doc_id || '.txt' AS path, octet_length(encode(coalesce(text, ''))) AS bytes, sha256(coalesce(text, '')) AS sha256, CASE WHEN doc_id % 3 = 0 THEN 'equal' ELSE 'copied' END AS action FROM documents"""
)
def k7_export_texts(lib: Library) -> DataFrame:
    path = F.concat((F.col("doc_id") % 50).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    rows = lib.table("documents").select("doc_id", path.alias("path"), F.col("text").alias("content"))
    target = shared_path(lib.spark, "export")
    files.export_files(rows.where(F.col("doc_id") % 3 == 0), target)  # a part was exported before
    return files.export_files(rows, target)


@query(
    """, t AS MATERIALIZED (SELECT photo_id, tag, score FROM photo_tags),
u AS (SELECT photo_id, tag, score, CASE WHEN photo_id % 3 = 0 THEN 'user' ELSE 'semantic' END AS source, CASE WHEN photo_id % 3 = 0 THEN 2 ELSE 0 END AS r FROM t WHERE photo_id % 2 = 0
  UNION ALL SELECT photo_id, tag, score + 1, 'semantic', 1 FROM t WHERE photo_id % 5 <> 0)
SELECT photo_id, tag, arg_max(score, r) AS score, arg_max(source, r) AS source FROM u GROUP BY 1, 2"""
)
def k3_priority_upsert(lib: Library) -> DataFrame:
    old = lib.photo_tags.where(F.col("photo_id") % 2 == 0).withColumn("source", F.when(F.col("photo_id") % 3 == 0, "user").otherwise("semantic"))
    new = lib.photo_tags.where(F.col("photo_id") % 5 != 0).select("photo_id", "tag", (F.col("score") + 1).alias("score"), F.lit("semantic").alias("source"))
    return maintenance.upsert(old, new, ["photo_id", "tag"], F.when(F.col("source") == "user", 1).otherwise(0))


@query(
    """, o AS (SELECT id, rating, place_id FROM photos WHERE id % 9 <> 0), n AS (SELECT id, CASE WHEN id % 10 = 0 THEN rating + 1 ELSE rating END AS rating, place_id FROM photos WHERE id % 8 <> 0)
SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'delete' ELSE 'update' END AS change FROM o FULL JOIN n ON o.id = n.id
WHERE o.id IS NULL OR n.id IS NULL OR o.rating IS DISTINCT FROM n.rating OR o.place_id IS DISTINCT FROM n.place_id"""
)
def k5_diff(lib: Library) -> DataFrame:
    rows = lib.photos.select("id", "rating", "place_id")
    new = rows.where(F.col("id") % 8 != 0).withColumn("rating", F.when(F.col("id") % 10 == 0, F.col("rating") + 1).otherwise(F.col("rating")))
    return maintenance.changes(rows.where(F.col("id") % 9 != 0), new, ["id"], ["rating", "place_id"])


@query("SELECT m.id AS old_id, f.id AS new_id FROM photos m JOIN photos f ON m.sha256 = f.sha256 WHERE m.status = 'missing' AND f.status = 'ok'")
def k1_moved_files(lib: Library) -> DataFrame:
    return maintenance.moved_files(lib.photos.where(F.col("status") == "missing"), lib.photos.where(F.col("status") == "ok"))


@query(
    """SELECT id, round(least(6.0, greatest(0.2, CASE WHEN id % 4 IN (1, 3) THEN height / width ELSE width / height END)), 3) AS ratio, taken_ts AS ts, rating, CASE WHEN media_type = 'video' THEN duration::BIGINT END AS seconds,
  ((rating >= 5)::INT + 2 * (face_count > 0)::INT + 4 * (media_type = 'video')::INT + 8 * (live_video_id IS NOT NULL OR coalesce(motion_offset, 0) > 0)::INT + 16 * coalesce(stack_id = id, false)::INT)::INT AS flags FROM visible"""
)
def k6_columnar(lib: Library) -> DataFrame:
    return maintenance.grid_rows(visible(lib.photos).withColumn("rotation", F.col("id") % 4 * 90))


@query("SELECT id, CASE WHEN id % 6 = 0 THEN 1000.0::DOUBLE ELSE taken_ts END AS taken_ts, CASE WHEN id % 10 = 0 THEN 7 ELSE place_id END AS place_id FROM photos")
def c8_overrides(lib: Library) -> DataFrame:
    k = F.col("id")
    corrected = lib.photos.where((k % 6 == 0) | (k % 10 == 0)).select(k.alias("photo_id"), F.when(k % 6 == 0, 1000.0).alias("user_ts"), F.when(k % 10 == 0, 7).alias("user_place"))
    return maintenance.overrides(lib.photos, corrected)


@query(
    """, t AS (SELECT filename AS rel_path, CASE WHEN id % 7 = 0 THEN size + 1 ELSE size END AS size, taken_ts + CASE WHEN id % 5 = 0 THEN 9 WHEN id % 5 = 1 THEN -9 ELSE 1 END AS mtime FROM photos WHERE id % 4 <> 0 AND taken_ts IS NOT NULL)
SELECT filename AS rel_path, CASE WHEN t.size IS NULL THEN 'copy' WHEN p.size = t.size AND abs(taken_ts - t.mtime) <= 2 THEN 'equal' WHEN t.mtime > taken_ts + 2 THEN 'keep' ELSE 'copy' END AS action
FROM photos p LEFT JOIN t ON t.rel_path = filename WHERE taken_ts IS NOT NULL"""
)
def k10_backup_plan(lib: Library) -> DataFrame:
    k = F.col("id")
    files = lib.photos.where(F.col("taken_ts").isNotNull()).select("id", F.col("filename").alias("rel_path"), "size", F.col("taken_ts").alias("mtime"))
    shift = F.when(k % 5 == 0, 9).when(k % 5 == 1, -9).otherwise(1)
    target = files.where(k % 4 != 0).select("rel_path", F.when(k % 7 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), (F.col("mtime") + shift).alias("mtime"))
    return export.backup_plan(files, target)


@query("SELECT id, CASE WHEN id % 3 <> 0 THEN taken_ts - (id % 13 - 6) * 3600 ELSE taken_ts END AS utc FROM visible")
def j10_utc(lib: Library) -> DataFrame:
    offset = F.when(F.col("id") % 3 != 0, (F.col("id") % 13 - 6) * 60)
    return visible(lib.photos).select("id", export.utc_of(F.col("taken_ts"), offset).alias("utc"))


@query(
    """, n AS (SELECT photo_id, list_sort(list(DISTINCT name)) AS people FROM faces JOIN persons ON persons.id = person_id WHERE name IS NOT NULL GROUP BY 1)
SELECT folder || '/' || filename || '.xmp' AS path, '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:lr="http://ns.adobe.com/lightroom/1.0/" xmp:Rating="'
  || rating || '"><lr:hierarchicalSubject><rdf:Bag><rdf:li>' || camera_model || '</rdf:li>' || coalesce(array_to_string(list_transform(people, lambda p: '<rdf:li>People|' || p || '</rdf:li>'), ''), '')
  || '</rdf:Bag></lr:hierarchicalSubject><dc:description><rdf:Alt><rdf:li></rdf:li></rdf:Alt></dc:description></rdf:Description></rdf:RDF></x:xmpmeta>' AS xml FROM visible LEFT JOIN n ON photo_id = id"""
)
def k8_xmp_export(lib: Library) -> DataFrame:
    names = lib.faces.join(lib.persons.where(F.col("name").isNotNull()), F.col("person_id") == F.col("id")).groupBy("photo_id").agg(F.array_sort(F.collect_set("name")).alias("people"))  # one photo's names
    rows = visible(lib.photos).join(names, F.col("id") == F.col("photo_id"), "left").withColumn("keywords", F.array("camera_model")).withColumn("description", F.lit(None).cast("string"))
    return export.xmp_sidecars(rows)
