"""Registered queries over vectors, hashes, duplicates, clusters and places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactsheet.adapter import WITH, Library
from contactsheet.functions import vectors as vx
from contactsheet.operators import clustering, duplicates, faces, metric, neighbours, places, segments, visual
from contactsheet.operators.predicates import visible
from contactsheet.params import STACK_GAP
from contactsheet.plans import registry
from contactsheet.storage import materialise

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
query = registry(QUERIES, ORACLE_SQL, WITH)

_VECTORS = """, e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT vec_id, label, v, sqrt(list_inner_product(v, v)) AS l FROM e)
"""


def _vectors(lib: Library) -> DataFrame:
    return lib.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


@query(
    _VECTORS
    + """, k AS (SELECT q.vec_id AS query_id, r.vec_id AS id, round(list_inner_product(q.v, r.v) / (q.l * r.l), 6) AS cosine FROM u q JOIN u r ON q.vec_id % 10 = 0 AND q.vec_id <> r.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id)::INT AS rank, id, cosine FROM k QUALIFY rank <= 8"""
)
def j20_knn(lib: Library) -> DataFrame:
    rows = _vectors(lib)
    return neighbours.knn(rows.where(F.col("id") % 10 == 0).select(F.col("id").alias("query_id"), "vec"), rows, 8)


_QUARTER = "('0x' || substr(md5(substr(text, {i} * (length(text) // 4 + 1) + 1, length(text) // 4 + 1)), 1, 4))::BIGINT"
_HASHED = f""", h AS (SELECT doc_id AS id, {_QUARTER.format(i=0)} + {_QUARTER.format(i=1)} * 65536 + {_QUARTER.format(i=2)} * 4294967296 + ({_QUARTER.format(i=3)} % 32768) * 281474976710656 AS phash FROM documents WHERE text IS NOT NULL),
b AS (SELECT id, phash, i AS band, (phash >> (16 * i)::INT) & 65535 AS key FROM h, range(4) r(i)),
p AS (SELECT DISTINCT x.id AS a, y.id AS b, bit_count(xor(x.phash, y.phash))::INT AS bits FROM b x JOIN b y ON x.band = y.band AND x.key = y.key AND x.id < y.id
  WHERE bit_count(xor(x.phash, y.phash)) <= 16)
"""


def _hashed(lib: Library) -> DataFrame:
    """A hash of 64 bits of every whole text: 16 bits of each of its quarters."""
    size = F.floor(F.length("text") / 4).cast("int") + 1
    part = lambda i: F.conv(F.substring(F.md5(F.substring(F.col("text"), size * i + 1, size).cast("binary")), 1, 4), 16, 10).cast("long")
    return lib.table("documents").where(F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), (part(0) + part(1) * 65536 + part(2) * 4294967296 + (part(3) % 32768) * 281474976710656).alias("phash"))


@query(_HASHED + "SELECT * FROM p")
def j21_band_pairs(lib: Library) -> DataFrame:
    return duplicates.band_pairs(_hashed(lib))


@query("SELECT sha256(text) AS sha256, count(*) AS members, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1", )
def j22_exact_groups(lib: Library) -> DataFrame:
    return duplicates.exact_groups(lib.table("documents").select(F.col("doc_id").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256")))


@query(
    _HASHED
    + """, l AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT a AS node, a AS other FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.other)
SELECT node, min(other) AS root FROM r GROUP BY 1""",
    recursive=True,
)
def g5_components(lib: Library) -> DataFrame:
    return duplicates.components(duplicates.band_links(_hashed(lib)))


_PART = "('0x' || substr(md5({text}), {at}, 4))::BIGINT"
_BITS = lambda text: f"({_PART.format(text=text, at=1)} + {_PART.format(text=text, at=5)} * 65536 + {_PART.format(text=text, at=9)} * 4294967296 + ({_PART.format(text=text, at=13)} % 32768) * 281474976710656)"
_PAIRS = f""", fp AS (SELECT *, xor({_BITS("(id // 4)::VARCHAR")}, id % 4 * 11184799) AS phash, xor({_BITS("'d' || (id // 4)")}, id % 4 * 2396745) AS dhash FROM photos),
keyed AS (SELECT id, phash, i AS band, (phash >> (16 * i)::INT) & 65535 AS key FROM fp, range(4) r(i)),
cand AS (SELECT x.id AS a, y.id AS b FROM keyed x JOIN keyed y ON x.band = y.band AND x.key = y.key AND x.id < y.id WHERE bit_count(xor(x.phash, y.phash)) <= 16 UNION SELECT x.id, y.id FROM fp x JOIN fp y ON x.sha256 = y.sha256 AND x.id < y.id),
p AS (SELECT a.id AS a, b.id AS b, bit_count(xor(a.phash, b.phash)) AS ph, bit_count(xor(a.dhash, b.dhash)) AS dh, CASE WHEN a.id % 3 <> 0 THEN 0.92 + (a.id % 80) / 1000.0 END::DOUBLE AS sem,
  a.sha256 = b.sha256 AS same, coalesce(a.source_kind, '') AS ka, coalesce(b.source_kind, '') AS kb, a.width = b.width AND a.height = b.height AS eq, abs(a.taken_ts - b.taken_ts) AS dt
  FROM cand JOIN fp a ON a.id = cand.a JOIN fp b ON b.id = cand.b),
f AS (SELECT *, CASE WHEN same THEN 'exact' WHEN ka IN ('screenshot', 'download') AND kb IN ('screenshot', 'download') THEN
    CASE WHEN ph <= 2 AND dh <= 4 AND eq THEN 'near' WHEN sem >= 0.995 AND ph <= 6 THEN 'likely' END
  WHEN (ph <= 6 AND dh <= 10) OR (sem >= 0.985 AND ph <= 12) THEN 'near' WHEN sem >= 0.955 AND (ph <= 16 OR ka = 'screenshot' OR kb = 'screenshot') THEN 'likely' WHEN sem >= 0.93 THEN 'similar' END AS k FROM p),
c AS (SELECT a, b, CASE WHEN k IN ('near', 'likely') AND coalesce(dt >= 0.5 AND dt <= 180, false) AND ka IN ('camera', 'phone') AND kb IN ('camera', 'phone') THEN 'similar' ELSE k END AS kind FROM f)
"""


def _fingerprinted(lib: Library) -> DataFrame:
    """Photos with hashes: four ids in a row are shots of one scene, a few bits apart."""
    k = F.col("id")
    part = lambda text, at: F.conv(F.substring(F.md5(text.cast("binary")), at, 4), 16, 10).cast("long")
    bits = lambda text: part(text, 1) + part(text, 5) * 65536 + part(text, 9) * 4294967296 + (part(text, 13) % 32768) * 281474976710656
    scene = F.floor(k / 4).cast("string")
    return lib.photos.select("id", "sha256", "source_kind", "width", "height", "taken_ts", bits(scene).bitwiseXOR(k % 4 * 11184799).alias("phash"), bits(F.concat(F.lit("d"), scene)).bitwiseXOR(k % 4 * 2396745).alias("dhash"))


def _kind(same: Column) -> Column:
    """The kind of a pair of photos, whose columns end with _a and _b; ``same``: whether their content is equal."""
    a = F.col("id_a")
    return duplicates.classify(
        vx.hamming(F.col("phash_a"), F.col("phash_b")),
        vx.hamming(F.col("dhash_a"), F.col("dhash_b")),
        F.when(a % 3 != 0, 0.92 + (a % 80) / 1000.0),
        same,
        (F.coalesce("source_kind_a", F.lit("")), F.coalesce("source_kind_b", F.lit(""))),
        (F.col("width_a") == F.col("width_b")) & (F.col("height_a") == F.col("height_b")),
        F.lit(False),
        F.abs(F.col("taken_ts_a") - F.col("taken_ts_b")),
        F.lit(True),
    )


def _classified(lib: Library) -> DataFrame:
    """The kinds of all pairs that share a band of their hash or their content, wherever they lie."""
    rows = materialise(_fingerprinted(lib), "fingerprinted")
    # Copies of one content are two here; a library with large groups links them to the first.
    return duplicates.content_and_band_kinds(rows, _kind(F.col("sha256_a") == F.col("sha256_b")))


@query(
    _PAIRS
    + """, s AS (SELECT fp.*, 'c' || (id // 40 % 5) AS cam, id // 4 * 100 + id % 4 AS ts, coalesce(source_kind, '') NOT IN ('screenshot', 'download') AS ok FROM fp WHERE id % 9 <> 0),
g AS (SELECT *, ok AND lag(ok) OVER w AND ts - lag(ts) OVER w <= 1.5 AND bit_count(xor(phash, lag(phash) OVER w)) <= 18 AS joined FROM s WINDOW w AS (PARTITION BY cam ORDER BY ts, id)),
h AS (SELECT *, sum(CASE WHEN coalesce(joined, false) THEN 0 ELSE 1 END) OVER (PARTITION BY cam ORDER BY ts, id)::BIGINT AS burst FROM g)
SELECT cam, burst, arg_min(id, (ts, id)) AS first, count(*) AS n FROM h WHERE ok GROUP BY 1, 2 HAVING count(*) >= 2"""
)
def w4_stacks(lib: Library) -> DataFrame:
    k = F.col("id")
    rows = _fingerprinted(lib).where(k % 9 != 0).withColumn("cam", F.concat(F.lit("c"), (F.floor(k / 40) % 5).cast("string"))).withColumn("ts", F.floor(k / 4) * 100 + k % 4)
    return segments.bursts(rows, "cam", "ts", "id", STACK_GAP, ~F.coalesce("source_kind", F.lit("")).isin("screenshot", "download"), phash="phash")


@query(_PAIRS + "SELECT * FROM c WHERE kind IS NOT NULL")
def g13_classify(lib: Library) -> DataFrame:
    return _classified(lib)


_REACH = ", ".join(f"r{n} AS (SELECT a AS x, a AS y FROM e{n} UNION SELECT b, b FROM e{n} UNION SELECT r{n}.x, e.b FROM r{n} JOIN (SELECT a, b FROM e{n} UNION ALL SELECT b, a FROM e{n}) e ON e.a = r{n}.y), g{n} AS (SELECT x AS id, min(y) AS root FROM r{n} GROUP BY 1)" for n in range(4))
_EDGES = ", ".join(f"e{n} AS (SELECT a, b FROM c WHERE kind IN ({kinds}))" for n, kinds in enumerate(("'exact'", "'exact', 'near'", "'exact', 'near', 'likely'", "'exact', 'near', 'likely', 'similar'")))


@query(
    _PAIRS
    + f", {_EDGES}, {_REACH} SELECT 'exact' AS kind, root, id FROM g0"
    + "".join(
        f" UNION ALL SELECT '{kind}', root, id FROM g{n} WHERE root NOT IN (SELECT n.root FROM g{n} n LEFT JOIN g{n - 1} o ON o.id = n.id GROUP BY 1 HAVING count(DISTINCT coalesce(o.root, -1)) = 1 AND min(coalesce(o.root, -1)) <> -1)"
        for n, kind in ((1, "near"), (2, "likely"), (3, "similar"))
    ),
    recursive=True,
)
def g6_groups(lib: Library) -> DataFrame:
    rows = materialise(_fingerprinted(lib), "fingerprinted")
    # Photos of equal content are linked as exact, so that no weaker kind their hashes may give them matters.
    near = duplicates.band_kinds(rows.drop("sha256"), _kind(F.lit(False)))
    exact = duplicates.exact_links(rows).withColumn("kind", F.lit("exact"))
    return duplicates.groups(duplicates.spanning_links(near).unionAll(exact))


@query(
    """, m AS (SELECT sha256 AS grp, *, CASE source_kind WHEN 'camera' THEN 4 WHEN 'phone' THEN 4 WHEN 'download' THEN 1 WHEN 'whatsapp' THEN 0 WHEN 'screenshot' THEN -1 ELSE 1 END AS o FROM photos),
k AS (SELECT grp, arg_max(id, (o, width::BIGINT * height, size, -id)) AS keep, count(*) AS members, sum(size)::BIGINT AS total, arg_max(size, (o, width::BIGINT * height, size, -id)) AS kept FROM m GROUP BY 1)
SELECT grp, keep, members, total - kept AS reclaimable FROM k"""
)
def g14_keepers(lib: Library) -> DataFrame:
    return duplicates.keepers(lib.photos.withColumn("grp", F.col("sha256")))


@query(
    """SELECT sha256, arg_min(id, (id % 7 <> 3, id)) AS id FROM photos p WHERE status = 'ok' AND hidden = 0 AND sha256 IN (SELECT sha256 FROM photos WHERE id % 7 = 3) GROUP BY 1"""
)
def j15_content_substitute(lib: Library) -> DataFrame:
    members = lib.photos.where(F.col("id") % 7 == 3).select(F.col("id").alias("photo_id"))
    return duplicates.prefer_visible_copy(members, lib.photos)


@query("SELECT sha256 AS grp, substr(sha1('near:' || string_agg(id::VARCHAR, ',' ORDER BY id)), 1, 16) AS signature FROM visible GROUP BY 1")
def g12_signature(lib: Library) -> DataFrame:
    # Members are collected because the signature is over all of them: copies of one content.
    return visible(lib.photos).groupBy(F.col("sha256").alias("grp")).agg(duplicates.signature(F.lit("near"), F.collect_list("id")).alias("signature"))


@query("SELECT event_id, bit_count(xor(event_id * 2654435761, user_id * 40503))::INT AS bits FROM events")
def m6_hamming(lib: Library) -> DataFrame:
    return lib.table("events").select("event_id", vx.hamming(F.col("event_id") * 2654435761, F.col("user_id") * 40503).alias("bits"))


_SCORED = _VECTORS + """, x AS (SELECT r.vec_id AS id, 't' || q.vec_id AS tag, round(list_inner_product(q.v, r.v), 9) AS score FROM u r JOIN u q ON q.vec_id IN ({ids}))
"""


def _scored(lib: Library, ids: tuple[int, ...]) -> DataFrame:
    few = _vectors(lib).where(F.col("id").isin(*ids)).orderBy("id").collect()  # a fixed vocabulary: as many rows as ids
    return neighbours.scores(_vectors(lib), [r["vec"] for r in few], [f"t{r['id']}" for r in few])


@query(
    _SCORED.format(ids="0, 1, 2, 3, 4, 5")
    + """, m AS (SELECT tag, avg(score) AS mean, stddev_pop(score) + 1e-6 AS std FROM x GROUP BY 1), z AS (SELECT id, tag, (score - mean) / std AS zt FROM x JOIN m USING (tag)),
y AS (SELECT id, tag, round(least(zt, (zt - avg(zt) OVER (PARTITION BY id)) / (stddev_pop(zt) OVER (PARTITION BY id) + 1e-6)), 3) AS z FROM z)
SELECT id, tag, z FROM y WHERE z >= 1.5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY z DESC, tag) <= 12"""
)
def m10_tag_z(lib: Library) -> DataFrame:
    return neighbours.zero_shot_tags(_scored(lib, (0, 1, 2, 3, 4, 5)))


@query(
    _SCORED.format(ids="7")
    + """, f AS (SELECT avg(score) AS mu, stddev_pop(score) AS sd, count(*) AS n FROM x), h AS (SELECT avg(score) AS h FROM (SELECT score, row_number() OVER (ORDER BY score DESC, id) AS r FROM x) WHERE r <= (SELECT greatest(3, n // 200) FROM f)),
r AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS r FROM x)
SELECT id, score FROM r WHERE r <= 800 AND (r <= 40 OR score >= (SELECT greatest(mu + 1.6 * sd, mu + 0.6 * (h.h - mu)) FROM f, h))"""
)
def m14_cut(lib: Library) -> DataFrame:
    return neighbours.visual_cut(_scored(lib, (7,)).select("id", "score"))


_RANKED = _VECTORS + """, x AS (SELECT q.vec_id AS query_id, r.vec_id AS id, r.label = q.label AND (r.vec_id % 2 = 0 OR q.vec_id % 3 = 0) AND q.vec_id % 4 <> 1 AS candidate, q.vec_id % 20 = 0 AS structured, round(list_inner_product(q.v, r.v) / (q.l * r.l), 9) AS score FROM u q JOIN u r ON q.vec_id % 10 < 2),
m AS (SELECT query_id, avg(score) AS mu, stddev_pop(score) + 1e-6 AS sd FROM x GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, count(*) OVER (PARTITION BY query_id) AS n FROM x {where}),
h AS (SELECT query_id, avg(score) AS head FROM r WHERE rank <= greatest(3, n // 200) GROUP BY 1),
c AS (SELECT r.query_id, rank::INT AS rank, id, score, structured FROM r JOIN m USING (query_id) JOIN h USING (query_id) WHERE rank <= 800 AND (rank <= 40 OR score >= greatest(mu + 1.6 * sd, mu + 0.6 * (head - mu))))
"""


@query(_RANKED.format(where="") + "SELECT query_id, rank, id, score FROM c")
def m14_cuts(lib: Library) -> DataFrame:
    rows = _vectors(lib)
    return visual.visual_cuts(rows, rows.where(F.col("id") % 10 < 2).select(F.col("id").alias("query_id"), "vec"))


@query(
    _RANKED.format(where="WHERE candidate")
    + """, enough AS (SELECT query_id FROM c WHERE NOT structured AND rank <= 100 GROUP BY 1 HAVING count(*) >= 20),
r2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, count(*) OVER (PARTITION BY query_id) AS n FROM x WHERE NOT structured AND query_id NOT IN (SELECT query_id FROM enough)),
h2 AS (SELECT query_id, avg(score) AS head FROM r2 WHERE rank <= greatest(3, n // 200) GROUP BY 1)
SELECT query_id, rank::INT AS rank, id, score FROM r WHERE structured AND rank <= 100 UNION ALL SELECT query_id, rank, id, score FROM c WHERE query_id IN (SELECT query_id FROM enough) AND rank <= 100
UNION ALL SELECT r2.query_id, rank::INT, id, score FROM r2 JOIN m USING (query_id) JOIN h2 USING (query_id) WHERE rank <= 100 AND (rank <= 40 OR score >= greatest(mu + 1.6 * sd, mu + 0.6 * (head - mu)))"""
)
def o2_ranked_searches(lib: Library) -> DataFrame:
    rows = _vectors(lib)
    asked = rows.where(F.col("id") % 10 < 2).select(F.col("id").alias("query_id"), "vec", (F.col("id") % 20 == 0).alias("structured"), F.col("label").alias("of"))
    q = F.col("query_id")
    some = asked.join(rows.select("id", "label"), F.col("of") == F.col("label")).where(((F.col("id") % 2 == 0) | (q % 3 == 0)) & (q % 4 != 1)).select("query_id", "id")
    return visual.ranked_searches(rows, asked.drop("of"), some, 100)


@query(
    _VECTORS
    + """, n AS (SELECT r.vec_id AS id, list_transform(r.v, lambda x: x / r.l) AS v, row_number() OVER (ORDER BY round(list_inner_product(q.v, r.v) / (q.l * r.l), 6) DESC, r.vec_id) AS rk FROM u q JOIN u r ON q.vec_id = 0 AND r.vec_id <> 0 QUALIFY rk <= 150),
g AS (SELECT rk, id, [v] AS kept, true AS stays FROM n WHERE rk = 1 UNION ALL
  SELECT rk, id, CASE WHEN f THEN list_append(kept, v) ELSE kept END, f FROM (SELECT n.*, g.kept, len(g.kept) < 50 AND len(list_filter(list_slice(g.kept, greatest(1, len(g.kept) - 39), len(g.kept)), lambda k: list_inner_product(k, n.v) > 0.3)) = 0 AS f FROM g JOIN n ON n.rk = g.rk + 1))
SELECT row_number() OVER (ORDER BY rk)::INT AS place, id FROM g WHERE stays""",
    recursive=True,
)
def w6_diversify(lib: Library) -> DataFrame:
    near = neighbours.knn(_vectors(lib).where(F.col("id") == 0).select(F.col("id").alias("query_id"), "vec"), _vectors(lib), 150)
    return neighbours.diversify(near.select("rank", "id").join(_vectors(lib).select("id", "vec"), "id"), 50, cut=0.3)


@query()
def g7_chinese_whispers(lib: Library) -> DataFrame:
    rows = _vectors(lib)
    return clustering.of_size(clustering.chinese_whispers(rows, clustering.knn_edges(rows.select("id", "vec"), k=12, edge=0.25)))


@query(
    _VECTORS
    + """, k AS (SELECT q.vec_id AS q, r.vec_id AS m, r.label AS owner, round(list_inner_product(q.v, r.v) / (q.l * r.l), 6) AS c FROM u q JOIN u r ON q.vec_id % 2 = 1 AND r.vec_id % 2 = 0),
n AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY q ORDER BY c DESC, m) <= 12), t AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY q, owner ORDER BY c DESC, m) <= 3),
s AS (SELECT q AS id, owner, round(avg(c), 6) AS score FROM t GROUP BY 1, 2), w AS (SELECT *, lead(score) OVER x AS second, row_number() OVER x AS r FROM s WINDOW x AS (PARTITION BY id ORDER BY score DESC, owner))
SELECT id, owner, score FROM w WHERE r = 1 AND score >= 0.2 AND (second IS NULL OR score - second >= 0.04)"""
)
def j23_attach(lib: Library) -> DataFrame:
    rows = _vectors(lib)
    return clustering.attach(rows.where(F.col("id") % 2 == 1), rows.where(F.col("id") % 2 == 0).select("id", "vec", F.col("label").alias("owner")), least=0.2)


_OWNED = _VECTORS + """, x AS (SELECT vec_id, label * 10 + vec_id % 10 AS owner, v, l FROM u), p AS (SELECT owner, i, avg(v[i]) AS x FROM x, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS i) GROUP BY 1, 2),
c AS (SELECT owner, list(x ORDER BY i) AS v FROM p GROUP BY 1), n AS (SELECT q.owner AS q, r.owner AS r, round(list_inner_product(q.v, r.v) / sqrt(list_inner_product(q.v, q.v)) / sqrt(list_inner_product(r.v, r.v)), 6) AS cosine FROM c q JOIN c r ON q.owner <> r.owner),
k AS (SELECT * FROM n WHERE cosine >= {gate} QUALIFY row_number() OVER (PARTITION BY q ORDER BY cosine DESC, r) <= {k}), ab AS (SELECT DISTINCT least(q, r) AS a, greatest(q, r) AS b FROM k),
m AS (SELECT a, b, list_inner_product(x.v, y.v) / (x.l * y.l) AS s FROM ab JOIN x ON x.owner = a JOIN x y ON y.owner = b),
t AS (SELECT a, b, s, row_number() OVER (PARTITION BY a, b ORDER BY s DESC) AS r FROM m),
g AS (SELECT a, b, round(avg(s) FILTER (r <= 3), 6) AS mean, count(*) FILTER (s >= {median}) / count(*) AS share FROM t GROUP BY 1, 2)
"""


def _owned(lib: Library) -> DataFrame:
    return _vectors(lib).select("id", "vec", (F.col("label") * 10 + F.col("id") % 10).cast("long").alias("owner"))


@query(_OWNED.format(gate=0.0, k=6, median=0.5) + "SELECT a, b, mean AS cosine FROM g WHERE mean >= 0.1")
def j24_merge_candidates(lib: Library) -> DataFrame:
    return clustering.merge_candidates(_owned(lib), least=0.1)


@query(
    _OWNED.format(gate=0.03, k=8, median=0.0)
    + """, near AS (SELECT a, b FROM g WHERE mean >= 0.15 AND share >= 0.5), y AS (SELECT a, b FROM near UNION SELECT b, a FROM near), z AS (SELECT owner, owner AS o FROM c UNION SELECT z.owner, y.b FROM z JOIN y ON y.a = z.o)
SELECT owner, min(o) AS merged FROM z GROUP BY 1""",
    recursive=True,
)
def g8_merge_close(lib: Library) -> DataFrame:
    return clustering.merge_close(_owned(lib), least=0.15, median=0.0)


_REPS = _VECTORS + """, d AS (SELECT min(vec_id) AS rep, v, sqrt(list_inner_product(v, v)) AS l FROM e GROUP BY v)
"""


def _closed(n: int, edges: str, of: str) -> str:
    """Common table expressions r{n} (node, root) over the ``edges`` (a, b) among the nodes ``of`` (node)."""
    return f""", y{n} AS (SELECT a, b FROM ({edges}) UNION SELECT b, a FROM ({edges})), z{n} AS (SELECT node, node AS o FROM {of} UNION SELECT z{n}.node, y{n}.b FROM z{n} JOIN y{n} ON y{n}.a = z{n}.o),
r{n} AS (SELECT node, min(o) AS root FROM z{n} GROUP BY 1)"""


@query(
    _REPS
    + """, k AS (SELECT x.rep AS a, y.rep AS b, round(list_inner_product(x.v, y.v) / (x.l * y.l), 6) AS w FROM d x JOIN d y ON x.rep < y.rep), links AS MATERIALIZED (SELECT * FROM k WHERE w >= 0.3),
n0 AS (SELECT a AS node FROM links UNION SELECT b FROM links), p AS (SELECT node AS a, node + 7 AS b FROM n0 WHERE node % 5 = 0 UNION ALL SELECT node, node + 10 FROM n0 WHERE node % 3 = 0)"""
    + _closed(1, "SELECT a, b FROM links WHERE w >= 0.6", "n0")
    + """, b1 AS (SELECT x.root FROM p JOIN r1 x ON x.node = p.a JOIN r1 y ON y.node = p.b WHERE x.root = y.root),
m1 AS (SELECT node, CASE WHEN root IN (SELECT root FROM b1) THEN node ELSE root END AS root FROM r1), n1 AS (SELECT DISTINCT root AS node FROM m1), e1 AS (SELECT x.root AS a, y.root AS b FROM links JOIN m1 x ON x.node = links.a JOIN m1 y ON y.node = links.b WHERE x.root <> y.root)"""
    + _closed(2, "SELECT a, b FROM e1", "n1")
    + """, t AS (SELECT m1.node, m1.root AS was, r2.root FROM m1 JOIN r2 ON r2.node = m1.root), b2 AS (SELECT x.root FROM p JOIN t x ON x.node = p.a JOIN t y ON y.node = p.b WHERE x.root = y.root)
SELECT node, CASE WHEN root IN (SELECT root FROM b2) THEN was ELSE root END AS root FROM t""",
    recursive=True,
)
def g8_components_apart(lib: Library) -> DataFrame:
    edges = metric.similar_pairs(_vectors(lib), 0.3).where("a <> b").select("a", "b", F.col("cosine").alias("weight"))
    nodes = edges.select("a").union(edges.select("b")).distinct()
    apart = nodes.where("a % 5 = 0").select("a", (F.col("a") + 7).alias("b")).unionAll(nodes.where("a % 3 = 0").select("a", (F.col("a") + 10).alias("b")))
    return clustering.components_apart(edges, apart, [0.6, 0.3])


@query(
    _VECTORS
    + """, k AS (SELECT q.vec_id AS q, list_inner_product(q.v, r.v) / (q.l * r.l) AS c FROM u q JOIN u r ON q.label = r.label AND q.vec_id <> r.vec_id),
n AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY q ORDER BY c DESC) <= 5), m AS (SELECT q, avg(c) AS mean FROM n GROUP BY 1)
SELECT vec_id AS id, coalesce(round(least(1.0, greatest(0.0, mean)), 6), 0.5) AS confidence FROM u LEFT JOIN m ON q = vec_id"""
)
def g9_confidences(lib: Library) -> DataFrame:
    return clustering.confidences(_vectors(lib))


@query(
    _REPS
    + """, k AS (SELECT x.rep AS a, y.rep AS b, round(list_inner_product(x.v, y.v) / (x.l * y.l), 6) AS cosine FROM d x JOIN d y ON x.rep < y.rep)
SELECT * FROM k WHERE cosine >= 0.25 UNION ALL SELECT rep, vec_id, 1.0 FROM e JOIN d USING (v) WHERE vec_id <> rep"""
)
def j20_threshold_join(lib: Library) -> DataFrame:
    return metric.similar_pairs(_vectors(lib), 0.25)


@query(
    _VECTORS
    + """, k AS (SELECT q.vec_id AS query_id, r.vec_id AS id, round(list_inner_product(q.v, r.v) / (q.l * r.l), 6) AS cosine FROM u q JOIN u r ON q.vec_id <> r.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id)::INT AS rank, id, cosine FROM k WHERE cosine >= 0.3 QUALIFY rank <= 12"""
)
def j20_nearest_above(lib: Library) -> DataFrame:
    return metric.nearest_above(_vectors(lib), 12, 0.3)


@query(
    _VECTORS
    + """, k AS (SELECT q.vec_id AS q, r.vec_id AS m, r.label AS owner, round(list_inner_product(q.v, r.v) / (q.l * r.l), 6) AS c FROM u q JOIN u r ON q.vec_id % 2 = 1 AND r.vec_id % 2 = 0),
n AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY q ORDER BY c DESC, m) <= 12), t AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY q, owner ORDER BY c DESC, m) <= 3),
s AS (SELECT q AS id, owner, round(avg(c), 6) AS score, (q % 3 = 0 AND owner % 2 = q % 4 // 2) AS no FROM t GROUP BY 1, 2), f AS (SELECT *, first_value(no) OVER (PARTITION BY id ORDER BY score DESC, owner) AS first_no FROM s),
w AS (SELECT *, lead(score) OVER x AS second, row_number() OVER x AS r FROM f WHERE NOT (no AND first_no) WINDOW x AS (PARTITION BY id ORDER BY score DESC, owner))
SELECT id, owner, score FROM w WHERE r = 1 AND score >= 0.2 AND (second IS NULL OR score - second >= 0.04)"""
)
def j23_with_rejections(lib: Library) -> DataFrame:
    rows = _vectors(lib)
    asked, known = rows.where(F.col("id") % 2 == 1), rows.where(F.col("id") % 2 == 0).select("id", "vec", F.col("label").alias("owner"))
    owners = known.select("owner").distinct()
    said = asked.where(F.col("id") % 3 == 0).join(owners, F.col("owner") % 2 == F.floor(F.col("id") % 4 / 2)).select("id", "owner")
    return clustering.attach(asked, known, least=0.2, rejected=said)


@query()
def g10_identify(lib: Library) -> DataFrame:
    rows = _vectors(lib)
    known = rows.where(F.col("id") % 2 == 0).select("id", "vec", F.col("label").cast("long").alias("owner"))
    return clustering.identify(rows.where(F.col("id") % 2 == 1).select("id", "vec"), known, least=0.2, edge=0.2)


@query(
    """, o AS (SELECT l_orderkey AS photo, l_linenumber AS old, l_linenumber % 3 AS owner, l_linenumber % 2 = 0 AS locked FROM lineitem), q AS (SELECT DISTINCT photo, old, owner, locked FROM o WHERE old < 7)
SELECT photo * 10 + old + 1 AS id, owner, locked FROM q"""
)
def k2_carry_over(lib: Library) -> DataFrame:
    old = lib.table("lineitem").where(F.col("l_linenumber") < 7).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_linenumber") % 3).alias("owner"), (F.col("l_linenumber") % 2 == 0).alias("locked")).distinct()
    return clustering.carry_over(old.select(F.col("id").alias("old"), (F.col("id") + 1).alias("new")), old)


_BOXES = """, b AS (SELECT l_orderkey AS photo_id, l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS id, (l_partkey % 60)::DOUBLE AS x1, (l_suppkey % 40)::DOUBLE AS y1, l_partkey % 60 + 30 + l_linenumber * 2.0::DOUBLE AS x2, l_suppkey % 40 + 35 + l_linenumber * 3.0::DOUBLE AS y2, l_discount AS score FROM lineitem)
"""


def _boxes(lib: Library) -> DataFrame:
    p, s, n = F.col("l_partkey") % 60, F.col("l_suppkey") % 40, F.col("l_linenumber")
    corners = [p.cast("double").alias("x1"), s.cast("double").alias("y1"), (p + 30 + n * 2.0).alias("x2"), (s + 35 + n * 3.0).alias("y2")]
    return lib.table("lineitem").select(F.col("l_orderkey").alias("photo_id"), (F.col("l_partkey") * 100_000 + F.col("l_suppkey") * 10 + n).alias("id"), *corners, F.col("l_discount").alias("score"))


@query(
    _BOXES
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY score DESC, id) AS r FROM b),
k AS (SELECT photo_id, r, id, [{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}] AS kept, true AS stays FROM o WHERE r = 1 UNION ALL
  SELECT o.photo_id, o.r, o.id, CASE WHEN fits THEN list_append(kept, {'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}) ELSE kept END, fits FROM (
    SELECT o.*, k.kept, len(list_filter(k.kept, lambda q: greatest(0, least(q.x2, o.x2) - greatest(q.x1, o.x1) + 1) * greatest(0, least(q.y2, o.y2) - greatest(q.y1, o.y1) + 1)
      > 0.4 * ((q.x2 - q.x1 + 1) * (q.y2 - q.y1 + 1) + (o.x2 - o.x1 + 1) * (o.y2 - o.y1 + 1) - greatest(0, least(q.x2, o.x2) - greatest(q.x1, o.x1) + 1) * greatest(0, least(q.y2, o.y2) - greatest(q.y1, o.y1) + 1)))) = 0 AS fits
    FROM k JOIN o ON o.photo_id = k.photo_id AND o.r = k.r + 1) o)
SELECT photo_id, id FROM k WHERE stays""",
    recursive=True,
)
def m18_suppress(lib: Library) -> DataFrame:
    return faces.suppress(_boxes(lib)).select("photo_id", "id")


@query(
    _BOXES
    + """, p AS (SELECT photo_id, id, x1 AS lx, y1 + score * 10 AS ly, x2 AS rx, y1 AS ry, (x1 + x2) / 2 + score * 40 AS nx, (y1 + y2) / 2 AS ny FROM b),
m AS (SELECT *, (lx + rx + nx) / 3 AS mx, (ly + ry + ny) / 3 AS my FROM p), c AS (SELECT *, (lx - mx) * -35 + (ly - my) * -14 + (rx - mx) * 35 + (ry - my) * -14 + (nx - mx) * 0 + (ny - my) * 28 AS ca,
  (lx - mx) * -14 - (ly - my) * -35 + (rx - mx) * -14 - (ry - my) * 35 + (nx - mx) * 28 - (ny - my) * 0 AS cb, pow(lx - mx, 2) + pow(ly - my, 2) + pow(rx - mx, 2) + pow(ry - my, 2) + pow(nx - mx, 2) + pow(ny - my, 2) AS v FROM m)
SELECT photo_id, id, round(ca / v, 6) AS a, round(cb / v, 6) AS b, round(greatest(-1.5, least(1.5, (nx - (lx + rx) / 2) / sqrt(pow(rx - lx, 2) + pow(ry - ly, 2)))), 6) AS yaw FROM c"""
)
def m18_alignment(lib: Library) -> DataFrame:
    x1, y1, x2, y2, s = (F.col(c) for c in ("x1", "y1", "x2", "y2", "score"))
    left, right, nose = (x1, y1 + s * 10), (x2, y1), ((x1 + x2) / 2 + s * 40, (y1 + y2) / 2)
    found = _boxes(lib).select("photo_id", "id", faces.similarity([left, right, nose], [(20.0, 20.0), (90.0, 20.0), (55.0, 62.0)]).alias("t"), faces.yaw(left, right, nose).alias("yaw"))
    return found.select("photo_id", "id", F.round("t.a", 6).alias("a"), F.round("t.b", 6).alias("b"), F.round("yaw", 6).alias("yaw"))


@query(
    """, b AS (SELECT l_orderkey AS k, l_linenumber AS n, (l_partkey * 3 % 50) / 100.0::DOUBLE AS ax, (l_partkey * 5 % 50) / 100.0::DOUBLE AS ay, (l_partkey * 7 % 50) / 100.0::DOUBLE + 0.5 AS au, (l_partkey * 11 % 50) / 100.0::DOUBLE + 0.5 AS av,
  ((l_partkey * 3 + 4) % 50) / 100.0::DOUBLE AS bx, ((l_partkey * 5 + 4) % 50) / 100.0::DOUBLE AS by_, ((l_partkey * 7 + 4) % 50) / 100.0::DOUBLE + 0.5 AS bu, ((l_partkey * 11 + 4) % 50) / 100.0::DOUBLE + 0.5 AS bv FROM lineitem),
p AS (SELECT x.k, x.n AS old, y.n AS new, greatest(0, least(x.au, y.bu) - greatest(x.ax, y.bx)) * greatest(0, least(x.av, y.bv) - greatest(x.ay, y.by_)) AS met, (x.au - x.ax) * (x.av - x.ay) + (y.bu - y.bx) * (y.bv - y.by_) AS total FROM b x JOIN b y USING (k)),
o AS (SELECT k, old, new, round(met / (total - met), 6) AS iou, row_number() OVER (PARTITION BY k ORDER BY round(met / (total - met), 6) DESC, old, new) AS r FROM p WHERE round(met / (total - met), 6) > 0.5),
g AS (SELECT k, r, old, new, iou, [old] AS l, [new] AS n, true AS kept FROM o WHERE r = 1 UNION ALL
  SELECT k, r, old, new, iou, CASE WHEN f THEN list_append(l, old) ELSE l END, CASE WHEN f THEN list_append(n, new) ELSE n END, f FROM (SELECT o.*, g.l, g.n, NOT list_contains(g.l, o.old) AND NOT list_contains(g.n, o.new) AS f FROM g JOIN o ON o.k = g.k AND o.r = g.r + 1))
SELECT k AS l_orderkey, old, new, iou FROM g WHERE kept""",
    recursive=True,
)
def j14_greedy_iou(lib: Library) -> DataFrame:
    box = lambda shift: tuple(((F.col("l_partkey") * n + shift) % 50).cast("double") / 100 + (0.5 if i > 1 else 0.0) for i, n in enumerate((3, 5, 7, 11)))
    rows = lib.table("lineitem").select("l_orderkey", "l_linenumber", F.array(*box(0)).alias("a"), F.array(*box(4)).alias("b"))
    left, right = rows.select("l_orderkey", F.col("l_linenumber").alias("old"), "a"), rows.select("l_orderkey", F.col("l_linenumber").alias("new"), "b")
    corner = lambda c: tuple(F.col(c)[i] for i in range(4))
    rated = left.join(right, "l_orderkey").select("l_orderkey", "old", "new", F.round(vx.iou(corner("a"), corner("b")), 6).alias("iou")).where(F.col("iou") > 0.5)
    return clustering.greedy_pairs(rated, "l_orderkey", "old", "new", "iou")


@query(
    """, q AS (SELECT s_suppkey AS id, (abs(s_acctbal) % 170) - 80 AS lat, (s_suppkey * 37 % 360) - 180::DOUBLE AS lon FROM supplier),
d AS (SELECT q.id, p.id AS place_id, round(2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(p.lat - q.lat) / 2), 2) + cos(radians(q.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - q.lon) / 2), 2)))), 6) AS km FROM q, places p)
SELECT id, place_id, km, row_number() OVER (PARTITION BY id ORDER BY km, place_id)::INT AS rank FROM d WHERE km <= 1500 QUALIFY rank <= 2"""
)
def j26_spatial(lib: Library) -> DataFrame:
    points = lib.table("supplier").select(F.col("s_suppkey").alias("id"), ((F.abs("s_acctbal") % 170) - 80).alias("lat"), ((F.col("s_suppkey") * 37 % 360) - 180).cast("double").alias("lon"))
    return places.nearest_within(points, lib.places.select(F.col("id").alias("place_id"), "lat", "lon"), 1500, most=2)
