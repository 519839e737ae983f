"""Operators on small tables with known answers: sources, dates, scores, folds, streams, graphs."""

import json
from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactsheet.functions import text
from contactsheet.functions import vectors as vx
from contactsheet.operators import clustering, duplicates, keywords, library, maintenance, neighbours, places, predicates, segments
from contactsheet.sources import evidence, export, listing, media
from contactsheet.streaming import incremental


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# ---- predicates


def test_epoch_range():
    assert predicates.epoch_range(1970) == (0, 365 * 86400)
    assert predicates.epoch_range(1970, 12) == (334 * 86400, 365 * 86400)
    for bad in ((1700, None), (2000, 13)):
        with pytest.raises(ValueError):
            predicates.epoch_range(*bad)
    with pytest.raises(ValueError):
        predicates.GridFilter(month=3).columns()


def test_folder_has_no_wildcards(spark):
    rows = spark.createDataFrame([("a_b",), ("axb",), ("a_b/c",), ("a_bc",)], "folder string")
    assert sorted(r.folder for r in rows.where(predicates.in_folder("a_b")).collect()) == ["a_b", "a_b/c"]
    assert [r.folder for r in rows.where(predicates.in_folder("a_b", exact=True)).collect()] == ["a_b"]


# ---- text and dates


@pytest.mark.parametrize(
    ("name", "ts", "precision"),
    [
        ("Screenshot_20250812-143012.png", "2025-08-12 14:30:12", "datetime"),
        ("photo_2025-08-12_14-30-12.jpg", "2025-08-12 14:30:12", "datetime"),
        ("signal-2025-08-12-143012.jpg", "2025-08-12 14:30:12", "datetime"),
        ("PXL_20250812_143012345.jpg", "2025-08-12 14:30:12", "datetime"),
        ("2025-08-12 14.30.12.jpg", "2025-08-12 14:30:12", "datetime"),
        ("IMG-20250812-WA0001.jpg", "2025-08-12 12:00:00", "date"),
        ("trip 2025-08-12.jpg", "2025-08-12 12:00:00", "date"),
        ("20251399.jpg", None, None),
        ("IMG_0001.jpg", None, None),
        ("", None, None),
    ],
)
def test_date_from_filename(spark, name, ts, precision):
    found = one(spark, text.date_from_filename(F.lit(name)))
    assert (found and str(found.ts), found and found.precision) == (ts, precision)


def test_capture_date_prefers_what_is_sure(spark):
    none = F.lit(None).cast("timestamp")
    at = lambda s: F.lit(s).cast("timestamp")
    named = text.date_from_filename(F.lit("IMG_20200102_030405.jpg"))
    pick = lambda exif, mod: one(spark, evidence.capture_date(exif, none, none, named, mod, none, at("2021-01-01"), at("2019-01-01")))
    assert (pick(at("2018-05-05"), none).source, pick(none, at("2022-01-01")).source) == ("exif", "filename")
    nameless = text.date_from_filename(F.lit("x.jpg"))
    last = one(spark, evidence.capture_date(none, none, none, nameless, none, none, at("2021-01-01"), at("2019-01-01")))
    assert (last.source, str(last.ts)[:10], last.confidence) == ("mtime", "2019-01-01", "low")


def test_labels_and_ages(spark):
    label = lambda a, b: one(spark, text.date_range_label(F.lit(a).cast("timestamp"), F.lit(b).cast("timestamp")))
    assert label("2020-07-04", "2020-07-04") == "4 July 2020"
    assert label("2020-07-04", "2020-07-06") == "4–6 July 2020"
    assert label("2020-07-30", "2020-08-02") == "30 Jul – 2 Aug 2020"
    assert label("2019-12-30", "2020-01-02") == "Dec 2019 – Jan 2020"
    age = lambda b, d: one(spark, text.age_on(F.lit(b).cast("date"), F.lit(d).cast("date")))
    assert (age("2000-02-29", "2001-02-28"), age("2000-02-29", "2001-03-01"), age("2000-01-01", "1999-01-01"), age(None, "2001-01-01")) == (0, 1, None, None)


@pytest.mark.parametrize(
    ("folder", "ts", "precision"),
    [("2019/2019-08-12 Goa", "2019-08-12", "date"), ("Wedding Jan 2026", "2026-01-15", "month"), ("2018/March 2019/pics", "2019-03-15", "month"), ("2019-05", "2019-05-15", "month"), ("2017/pics", "2017-07-01", "year"), ("pics", None, None), ("", None, None)],
)
def test_date_from_folder(spark, folder, ts, precision):
    found = one(spark, text.date_from_folder(F.lit(folder)))
    assert (found and str(found.ts)[:10], found and found.precision) == (ts, precision)


def test_small_text_functions(spark):
    offset = lambda x: one(spark, text.offset_minutes(F.lit(x)))
    assert [offset(x) for x in ("+05:30", "-0800", "+00:00", "+15:00", "+05:70", "x", None)] == [330, -480, 0, None, None, None, None]
    names = lambda *x: one(spark, text.joined_names(F.array(*map(F.lit, x)).cast("array<string>")))
    assert [names(), names("a"), names("a", "", "b"), names("a", "b", "c")] == ["", "a", "a and b", "a, b and c"]
    at = F.lit("2020-07-04").cast("timestamp")
    title = lambda *x: one(spark, text.event_title(*[F.lit(v).cast("string") for v in x], at))
    assert [title("Wedding", "Goa", "H"), title("Wedding", None, "H"), title(None, "Goa", "H"), title(None, "Goa", None), title(None, None, None)] == ["Wedding in Goa", "Wedding", "H", "Goa", "July 2020"]
    assert one(spark, text.place_label(F.lit("Goa"), F.lit("Goa"), F.lit("India"))) == "Goa, India"
    assert [one(spark, text.safe_name(F.lit(x))) for x in ("a/b: c?.", "...", None)] == ["a b c", "untitled", "untitled"]
    assert one(spark, text.folder_tokens(F.lit("2019_Goa-Trip 12 v2"))) == ["goa", "trip", "v2"]


def test_fold_tokens_and_search(spark):
    rows = spark.createDataFrame([(1, "Kandukūr Café"), (2, "cafe at kandukur"), (3, None), (4, "")], "id long, t string")
    assert [r.id for r in keywords.search_all(rows, "t", ["kandukur", "cafe"]).orderBy("id").collect()] == [1, 2]
    assert [r.id for r in keywords.search_phrase(rows, "t", ["kandukur", "cafe"]).collect()] == [1]
    assert [r.id for r in keywords.bm25(rows, "id", "t", ["cafe"]).collect()] == [1, 2]


# ---- segments


def test_segments_split_on_gap_and_travel(spark):
    rows = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0), (1, 2, 3000.0, 0.0, 0.1), (1, 3, 6000.0, 0.0, 0.5), (1, 4, 20000.0, 0.0, 0.5), (1, 5, 20600.0, 0.0, 9.0)], "k int, id int, ts double, lat double, lon double")
    found = segments.numbered_segments(rows, "k", "ts", "id", position=("lat", "lon")).orderBy("id").collect()
    assert [r.segment for r in found] == [0, 0, 1, 2, 2]


def test_merge_chain_is_safe_on_cycles(spark):
    merged = spark.createDataFrame([(1, 2), (2, 3), (3, None), (4, 5), (5, 4)], "id long, merged_into long")
    found = {r.id: r.survivor for r in segments.survivors(merged, rounds=6).collect()}
    assert (found[1], found[2], found[3]) == (3, 3, 3) and {found[4], found[5]} <= {4, 5}


def test_match_by_overlap_uses_each_once(spark):
    new = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 4), ("c", 9)], "g string, m long")
    old = spark.createDataFrame([(10, 1), (10, 2), (10, 3), (11, 3), (11, 4), (12, 7)], "g long, m long")
    assert {(r.new_grp, r.old_grp) for r in segments.match_by_overlap(new, old).collect()} == {("a", 10), ("b", 11)}


# ---- vectors, duplicates, clusters, places


def test_knn_excludes_self_and_orders_ties(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [3.0, 0.0]), (4, [0.0, 1.0]), (5, None)], "id long, vec array<double>")
    found = neighbours.knn(rows.where("id <= 2").select(F.col("id").alias("query_id"), "vec"), rows, 2, block=2, query_block=1).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id, r.cosine) for r in found] == [(1, 2, 1.0), (1, 3, 1.0), (2, 1, 1.0), (2, 3, 1.0)]


def test_diversify_drops_near_copies(spark):
    rows = spark.createDataFrame([(1, 10, [1.0, 0.0]), (2, 11, [1.0, 0.01]), (3, 12, [0.0, 1.0])], "rank int, id long, vec array<double>")
    assert [r.id for r in neighbours.diversify(rows, 5).orderBy("place").collect()] == [10, 12]


def test_hashes_and_boxes(spark):
    assert one(spark, vx.hamming(F.lit(-1).cast("long"), F.lit(0).cast("long"))) == 64
    box = lambda *v: tuple(F.lit(float(x)) for x in v)
    assert one(spark, vx.iou(box(0, 0, 2, 2), box(1, 1, 3, 3))) == pytest.approx(1 / 7)
    assert one(spark, vx.iou(box(0, 0, 1, 1), box(2, 2, 3, 3))) == 0
    rows = spark.createDataFrame([(1, 5), (2, 5), (3, 4), (4, None), (5, -1)], "id long, phash long")
    assert {(r.a, r.b, r.bits) for r in duplicates.band_pairs(rows).collect()} == {(1, 2, 0), (1, 3, 1), (2, 3, 1)}
    assert duplicates.band_pairs(rows, max_bucket=2).where("a = 1 and b = 2").count() == 1


def test_large_buckets_are_compared_whole(spark):
    r = np.random.default_rng(5)
    hashes = [7] * 500 + [int(x) << 16 | 7 for x in r.integers(0, 1 << 10, 300)] + [int(x) << 16 | 9 for x in r.integers(0, 1 << 47, 450)]
    rows = spark.createDataFrame(list(enumerate(hashes)), "id long, phash long")
    band = lambda h, i: h >> 16 * i & 0xFFFF
    near = lambda x, y: (x ^ y).bit_count() <= 16 and any(band(x, i) == band(y, i) for i in range(4))
    wanted = {(a, b, (x ^ hashes[b]).bit_count()) for a, x in enumerate(hashes) for b in range(a + 1, len(hashes)) if near(x, hashes[b])}
    found = [(x.a, x.b, x.bits) for x in duplicates.band_pairs(rows, cell=40).collect()]
    assert set(found) == wanted and len(found) == len(wanted)
    roots = lambda edges: {x.node: x.root for x in duplicates.components(edges).collect()}
    assert roots(duplicates.band_links(rows, cell=40)) == roots(spark.createDataFrame([x[:2] for x in wanted], "a long, b long"))
    assert duplicates.band_links(rows).where("a = 0 and b < 500").count() == 499
    assert duplicates.band_pairs(rows, max_bucket=400).where("b < 500").count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (100, 100)], "a long, b long")
    found = {r.node: r.root for r in duplicates.components(edges).collect()}
    assert set(found.values()) == {1, 100} and len(found) == 62


def test_links_of_near_hashes_grow_with_the_rows_not_their_pairs(spark):
    r = np.random.default_rng(3)
    data = [(i, int(r.integers(0, 256)) << 16 | int(r.integers(0, 4)), int(r.integers(0, 9))) for i in range(400)]
    rows = spark.createDataFrame(data, "id long, phash long, w long")
    kind = F.element_at(F.array(*map(F.lit, ("exact", "near", "likely", "similar", None))), (((F.col("w_a") + F.col("w_b")) % 5) + 1).cast("int"))
    wanted = {}
    for i, x, v in data:
        for j, y, w in data:
            if i < j and bin(x ^ y).count("1") <= 16 and (v + w) % 5 < 4:
                wanted[i, j] = ("exact", "near", "likely", "similar")[(v + w) % 5]
    pairs = duplicates.band_kinds(rows, kind, cell=90)
    found = pairs.collect()
    assert {(p.a, p.b): p.kind for p in found} == wanted and len(found) == len(wanted) > 50_000
    links = duplicates.spanning_links(pairs.coalesce(1), most=5000).collect()
    assert len(links) < 2 * len(data) and all(wanted[x.a, x.b] == x.kind for x in links)

    def roots(edges, kinds):
        root = list(range(400))
        for a, b, k in edges:
            if k in kinds and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
        return root

    for n in range(1, 5):
        kinds = ("exact", "near", "likely", "similar")[:n]
        assert roots([(x.a, x.b, x.kind) for x in links], kinds) == roots([(a, b, k) for (a, b), k in wanted.items()], kinds)


def test_groups_of_weaker_kinds_join_groups_and_rows(spark):
    pairs = spark.createDataFrame([(5, 6, "exact"), (6, 9, "near"), (2, 9, "likely"), (3, 4, "exact"), (3, 4, "near"), (4, 5, "similar"), (11, 12, "near"), (11, 12, "similar"), (20, 21, None)], "a long, b long, kind string")
    found = {}
    for r in duplicates.groups(pairs).collect():
        found.setdefault((r.kind, r.root), []).append(r.id)
    assert {k: sorted(v) for k, v in found.items()} == {("exact", 5): [5, 6], ("exact", 3): [3, 4], ("near", 5): [5, 6, 9], ("near", 11): [11, 12], ("likely", 2): [2, 5, 6, 9], ("similar", 2): [2, 3, 4, 5, 6, 9]}


def test_groups_keep_the_strongest(spark):
    pairs = spark.createDataFrame([(1, 2, "exact"), (2, 3, "near"), (5, 6, "exact"), (8, 9, "similar")], "a long, b long, kind string")
    found = {}
    for r in duplicates.groups(pairs).collect():
        found.setdefault((r.kind, r.root), set()).add(r.id)
    assert found == {("exact", 1): {1, 2}, ("exact", 5): {5, 6}, ("near", 1): {1, 2, 3}, ("similar", 8): {8, 9}}


def test_clusters_are_pure_and_strangers_stay_out(spark):
    r = np.random.default_rng(0)
    centres = r.standard_normal((5, 64))
    data = [(c * 100 + i, (centres[c] + 0.5 * r.standard_normal(64)).tolist()) for c in range(5) for i in range(12)] + [(900 + i, r.standard_normal(64).tolist()) for i in range(6)]
    rows = spark.createDataFrame(data, "id long, vec array<double>")
    labels = clustering.of_size(clustering.chinese_whispers(rows, clustering.knn_edges(rows))).collect()
    of = {}
    for x in labels:
        of.setdefault(x.label, set()).add(x.id // 100)
    assert all(len(v) == 1 for v in of.values()) and set().union(*of.values()) == {0, 1, 2, 3, 4} and len(of) == 5


def test_merging_clusters(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0, 0.0], 10), (2, [1.0, 0.1, 0.0], 11), (3, [0.0, 0.0, 1.0], 12), (4, [1.0, 0.2, 0.0], 13)], "id long, vec array<double>, owner long")
    assert {r.owner: r.merged for r in clustering.merge_close(rows, least=0.9).collect()} == {10: 10, 11: 10, 12: 12, 13: 10}
    # Three members alike are not enough when most of the others are not.
    mixed = rows.unionAll(spark.createDataFrame([(20 + i, [0.0, 1.0, float(i % 2)], 11) for i in range(9)], rows.schema))
    assert {r.owner: r.merged for r in clustering.merge_close(mixed, least=0.3, gate=0.3, best=1).collect()}[11] == 11
    pairs = clustering.merge_candidates(rows, least=0.9)
    said = spark.createDataFrame([(11, 10)], "a long, b long")
    assert {(r.a, r.b) for r in clustering.undismissed(pairs, said, 9).collect()} == {(10, 13), (11, 13)}


def test_merge_candidates_go_by_members(spark):
    r = np.random.default_rng(8)
    data = [(i, (r.standard_normal(6) + 1.5 * np.eye(6)[i % 7 % 6]).tolist(), i % 7) for i in range(200)]
    rows = spark.createDataFrame(data, "id long, vec array<double>, owner long")
    centres = {o: np.mean([v for _, v, w in data if w == o], axis=0) for o in range(7)}
    cosine = lambda x, y: float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))
    wanted, below = {}, 0
    for a in range(7):
        for b in range(a + 1, 7):
            score = float(np.mean(sorted(cosine(x, y) for _, x, o in data if o == a for _, y, w in data if w == b)[-3:]))
            if cosine(centres[a], centres[b]) >= 0.3 and score >= 0.93:
                wanted[a, b] = round(score, 6)
                below += cosine(centres[a], centres[b]) < 0.93
    assert wanted and below
    found = {(x.a, x.b): x.cosine for x in clustering.merge_candidates(rows, least=0.93, gate=0.63, block=9).collect()}
    assert found == pytest.approx(wanted, abs=2e-6)


def test_nearest_within_matches_brute_force(spark):
    r = np.random.default_rng(2)
    points = [(i, float(r.uniform(-90, 90)), float(r.uniform(-180, 180))) for i in range(150)] + [(500, 89.9, 10.0), (501, 0.0, 179.99), (502, None, 1.0)]
    spots = [(i, float(r.uniform(-90, 90)), float(r.uniform(-180, 180))) for i in range(120)] + [(300, 89.9, -170.0), (301, 0.0, -179.99)]
    for km in (50.0, 900.0, 4000.0):
        found = places.nearest_within(spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(spots, "place_id long, lat double, lon double"), km, most=1000)

        def far(a, b, c, d):
            a, b, c, d = map(np.radians, (a, b, c, d))
            return 2 * 6371.0088 * np.arcsin(min(1.0, np.sqrt(np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2)))

        want = {(i, j) for i, a, b in points if a is not None for j, c, d in spots if round(far(a, b, c, d), 6) <= km}
        assert {(x.id, x.place_id) for x in found.collect()} == want


def test_city_of(spark):
    gazetteer = [(1, 0.0, 0.0, 1_000_000, "PPLA"), (2, 0.0, 0.05, 4_000, "PPL"), (3, 0.0, 0.16, 5_000, "PPL"), (4, 10.0, 10.0, 300, "PPL"), (5, 10.0, 10.02, 9_000, "PPL"), (6, 30.0, 30.0, 10, "PPL")]
    points = [(1, 0.0, 0.04), (2, 10.0, 10.005), (3, 30.0, 30.3), (4, 60.0, 60.0), (5, 0.0, 0.16)]
    found = places.city_of(spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(gazetteer, "geonameid long, lat double, lon double, population long, fcode string"))
    assert {r.id: (r.city_id, r.locality_id) for r in found.collect()} == {1: (1, 2), 2: (4, 4), 3: (6, None), 5: (3, 3)}


def test_names_in_path_take_the_longest_clear_name(spark):
    paths = spark.createDataFrame([(1, "2019/New York trip"), (2, "York 2020"), (3, "Springfield"), (4, "")], "id long, folder string")
    cities = spark.createDataFrame([(10, "New York", 8_000_000), (11, "York", 150_000), (12, "Springfield", 160_000), (13, "Springfield", 150_000), (14, "trip", 10)], "place_id long, name string, population long")
    assert {(r.id, r.place_id) for r in places.names_in_path(paths, cities).collect()} == {(1, 10), (2, 11)}


def test_one_to_one_is_the_greedy_walk(spark):
    r = np.random.default_rng(5)
    rated = [(int(a), f"n{b}", round(float(s), 3)) for a, b, s in zip(r.integers(0, 9, 40), r.integers(0, 9, 40), r.random(40), strict=True)]
    rated = list({(a, b): (a, b, s) for a, b, s in rated}.values())
    used, want = set(), set()
    for a, b, s in sorted(rated, key=lambda x: (-x[2], x[0], x[1])):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    assert {(x.a, x.b) for x in library.one_to_one(spark.createDataFrame(rated, "a long, b string, s double"), "a", "b", "s").collect()} == want


# ---- maintenance, sources, streams


def test_snapshot_guards(spark):
    known = spark.createDataFrame([(1, "a", 1, 10.0, "ok"), (1, "b", 1, 10.0, "missing"), (2, "c", 1, 10.0, "ok")], "root_id long, rel_path string, size long, mtime double, status string")
    now = spark.createDataFrame([(1, "b", 1, 10.0), (1, "d", 1, 10.0)], "root_id long, rel_path string, size long, mtime double")
    diff = lambda **k: {(r.root_id, r.rel_path, r.change) for r in maintenance.snapshot_diff(known, now, **k).collect()}
    assert diff() == {(1, "a", "missing"), (1, "b", "restored"), (1, "d", "new")}  # an empty root tells nothing
    assert diff(complete=False) == {(1, "b", "restored"), (1, "d", "new")}


def test_listing_reads_and_filters(spark, tmp_path):
    for name, size in (("a/IMG_1.JPG", 5), ("a/empty.jpg", 0), ("a/@eaDir/x.jpg", 5), ("b/._y.jpg", 5), ("b/z.txt", 5), ("c.nef", 5), ("d/m.mp4", 5)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    found = listing.media(listing.read_listing(spark, str(tmp_path))).collect()
    assert {(r.rel_path, r.folder, r.stem, r.media_type) for r in found} == {("a/IMG_1.JPG", "a", "img_1", "image"), ("c.nef", "", "c", "raw"), ("d/m.mp4", "d", "m", "video")}


def test_takeout(spark, tmp_path):
    full = {"title": "a.jpg", "photoTakenTime": {"timestamp": "1500000000"}, "geoData": {"latitude": 17.4, "longitude": 78.5}, "description": " hi ", "people": [{"name": "Ben"}, {"name": " Ana "}, {"name": ""}, {"name": "Ben"}], "favorited": True}
    lost = {"photoTakenTime": {"timestamp": "-5"}, "geoData": {"latitude": 0.0, "longitude": 0.0}}
    for name, body in (("a.json", json.dumps(full)), ("b.json", json.dumps(lost)), ("c.json", "not json")):
        (tmp_path / name).write_text(body)
    found = {r.path[-6:]: r for r in evidence.read_takeout(spark, str(tmp_path)).collect()}
    a, b, c = found["a.json"], found["b.json"], found["c.json"]
    assert (a.taken_ts, a.lat, a.lon, a.description, a.people, a.favorited, a.archived) == (1.5e9, 17.4, 78.5, "hi", ["Ana", "Ben"], True, False)
    assert (b.taken_ts, b.lat, b.people) == (None, None, []) and (c.taken_ts, c.title) == (None, None)


def test_sidecar_names(spark):
    media = [(1, "IMG.jpg"), (2, "IMG(1).jpg"), (3, "IMG-edited.jpg"), (4, "a_very_long_name_of_a_picture_from_the_mountains.jpg"), (5, "scan.png"), (6, "none.jpg")]
    names = ["IMG.jpg.json", "IMG.jpg.supplemental-metadata.json", "IMG.jpg(1).json", "a_very_long_name_of_a_picture_from_the_mounta.json", "scan.json"]
    found = evidence.match_sidecars(spark.createDataFrame([(i, "f", n) for i, n in media], "id long, folder string, filename string"), spark.createDataFrame([("f", n) for n in names], "folder string, sidecar string"))
    assert {r.id: r.sidecar for r in found.collect()} == {1: "IMG.jpg.json", 2: "IMG.jpg(1).json", 3: "IMG.jpg.json", 4: names[3], 5: "scan.json"}


def test_gpx_and_xmp(spark, tmp_path):
    (tmp_path / "t.gpx").write_text('<gpx xmlns="http://x"><trk><name> Walk </name><trkseg><trkpt lat="1.5" lon="2.5"><time>2020-01-01T00:00:00Z</time></trkpt><trkpt lat="0" lon="0"><time>2020-01-01T00:01:00Z</time></trkpt><trkpt lat="1" lon="2"/></trkseg></trk></gpx>')
    (tmp_path / "bad.gpx").write_text("<gpx")
    assert [(r.track, r.ts, r.lat, r.lon) for r in evidence.read_gpx(spark, str(tmp_path)).collect()] == [("Walk", datetime(2020, 1, 1, tzinfo=UTC).timestamp(), 1.5, 2.5)]
    (tmp_path / "p.xmp").write_text(
        '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/" '
        'xmlns:lr="http://ns.adobe.com/lightroom/1.0/" xmp:Rating="7"><dc:subject><rdf:Bag><rdf:li>beach</rdf:li><rdf:li>Priya</rdf:li></rdf:Bag></dc:subject><lr:hierarchicalSubject><rdf:Bag><rdf:li>People|Priya</rdf:li></rdf:Bag></lr:hierarchicalSubject>'
        "<dc:description><rdf:Alt><rdf:li>At sea</rdf:li></rdf:Alt></dc:description></rdf:Description></rdf:RDF></x:xmpmeta>"
    )
    x = evidence.read_xmp(spark, str(tmp_path)).collect()[0]
    assert (x.rating, x.keywords, x.description, x.people) == (5, ["beach"], "At sea", ["Priya"])


def test_xmp_names_prefer_raw(spark):
    media = spark.createDataFrame([(1, "f", "a.jpg", "a", "image"), (2, "f", "a.nef", "a", "raw"), (3, "f", "b.jpg", "b", "image")], "id long, folder string, filename string, stem string, media_type string")
    names = spark.createDataFrame([("f", "a.xmp"), ("f", "b.jpg.xmp"), ("f", "b.xmp")], "folder string, xmp string")
    assert {r.id: r.xmp for r in evidence.match_xmp(media, names).collect()} == {2: "a.xmp", 3: "b.jpg.xmp"}


def test_icloud_and_gazetteer(spark, tmp_path):
    (tmp_path / "d.csv").write_text('imgName,fileChecksum,favorite\nIMG_1.HEIC,x,"Saturday June 26,2021 10:25 AM GMT",yes,no,no\nIMG_2.HEIC,x,no date,no,no,no\n')
    found = {r.img_name: r for r in evidence.read_icloud(spark, str(tmp_path / "d.csv")).collect()}
    assert found["IMG_1.HEIC"].created_ts == datetime(2021, 6, 26, 10, 25, tzinfo=UTC).timestamp() and found["IMG_1.HEIC"].favorite
    assert found["IMG_2.HEIC"].created_ts is None
    line = lambda i, fclass, code: "\t".join([str(i), f"N{i}", "", "", "1.5", "2.5", fclass, code, "FR", "", "A", "", "", "", "1000", "", "", "", ""])
    (tmp_path / "g.txt").write_text("\n".join([line(1, "P", "PPL"), line(1, "P", "PPL"), line(2, "P", "PPLH"), line(3, "A", "ADM1")]))
    assert [(r.geonameid, r.name, r.population) for r in evidence.read_gazetteer(spark, str(tmp_path / "g.txt")).collect()] == [(1, "N1", 1000)]


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = incremental.stream_of(spark, str(tmp_path / "in"), events.schema)
    query = incremental.activity(stream).writeStream.format("memory").queryName("activity").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    key = lambda df: sorted((r.start, r.event_type, r.n, r.total) for r in df.collect())
    assert key(spark.table("activity")) == key(incremental.activity(events))


def test_listings_fold_into_versions(spark, tmp_path):
    schema = "root_id int, rel_path string, size long, mtime double"
    for rows in ([(1, "a", 1, 1.0), (1, "b", 1, 1.0)], [(1, "a", 2, 9.0), (1, "c", 1, 1.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = incremental.stream_of(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    query = incremental.fold_listings(stream, str(tmp_path / "table"), str(tmp_path / "ck"))
    query.awaitTermination(90)
    assert query.exception() is None
    found = {r.rel_path: r["size"] for r in incremental.listed_files(spark, str(tmp_path / "table")).collect()}
    assert found == {"a": 2, "b": 1, "c": 1}
    assert [spark.read.parquet(str(tmp_path / "table" / f"batch={i}")).count() for i in (0, 1)] == [2, 2]  # a batch writes its changes only


def test_sidecars_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("f", "a.jpg", 4, ["sea & sun"], ["Ana"], "<hi>"), ("", "b.jpg", 0, None, None, None)], "folder string, filename string, rating int, keywords array<string>, people array<string>, description string")
    made = {r.path: r.xml for r in export.xmp_sidecars(rows).collect()}
    assert set(made) == {"f/a.jpg.xmp"}
    (tmp_path / "a.xmp").write_text(made["f/a.jpg.xmp"])
    x = evidence.read_xmp(spark, str(tmp_path)).collect()[0]
    assert (x.rating, x.description, x.people) == (4, "<hi>", ["Ana"])


def test_audit_and_utc(spark):
    rows = spark.createDataFrame([(1, 5)], "id long, rating int")
    assert [tuple(r) for r in export.audit_rows(rows, "rate", "photo", "id", "me").collect()] == [("rate", "photo", 1, '{"id":1,"rating":5}', "me")]
    noon = F.lit(43_200.0)
    assert one(spark, export.utc_of(noon, F.lit(None).cast("int"), "Asia/Kolkata")) == 43_200 - 19_800
    assert one(spark, export.utc_of(noon, F.lit(-60))) == 46_800


def test_as_of_joins_of_one_large_key(spark):
    n = 300_000
    stream = spark.range(n).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("ts"), "id")
    last = segments.inherit_nearest(stream.withColumn("v", F.when(F.col("id") == n - 1, 5.0)), "k", "ts", "id", "v", within=10.0)
    assert last.where("inherited = 5").count() == 11
    points = stream.where(F.col("id").isin(0, n - 1)).select("k", "ts", F.col("id").cast("double").alias("x"))
    found = segments.interpolate(points, stream.select("k", "ts", "id"), "k", "ts", within=1e9)
    assert found.where(F.abs(F.col("x") - F.col("id")) < 1e-6).count() == n


def test_merge_fold_of_a_null_key(spark):
    rows = spark.createDataFrame([(None, i, i * 3600.0, i * 3600.0 + 60, "a") for i in range(3)], "k long, segment long, start_ts double, end_ts double, top string")
    assert [r.event for r in segments.merge_sessions(rows, "k").orderBy("segment").collect()] == [0, 0, 0]


def test_dates_and_positions_of_containers(spark):
    value = lambda c: one(spark, c)
    text_ = lambda x: F.lit(x).cast("string")
    stamp = lambda c: (lambda v: v and str(v))(value(c))
    assert [stamp(media.exif_date(text_(x), 2030)) for x in ("2020:01:02 03:04:05", "2020-01-02", "0000:00:00 00:00:00", "1970:01:01 00:00:00", "x", None)] == ["2020-01-02 03:04:05", "2020-01-02 00:00:00", None, None, None, None]
    assert stamp(media.xmp_date(text_('<x xmp:CreateDate="2021-05-06T07:08:09"/>'), 2030)) == "2021-05-06 07:08:09"
    assert stamp(media.container_date(text_("2024-03-09T11:00:00+0530"), 2030)) == "2024-03-09 11:00:00"
    assert stamp(media.container_date(text_("1904-01-01T00:00:00"), 2030)) is None
    at = datetime(2021, 6, 26, 10, 25, tzinfo=UTC).timestamp()
    assert [value(media.cloud_date(text_(x))) for x in ("Saturday June 26,2021 10:25 AM GMT", "June 26 2021 10:25", "2021-06-26T10:25:00Z", "never", None)] == [at, at, at, None, None]
    assert value(media.cloud_date(text_("June 26,2021 12:05 AM"))) == at - 37_200
    deg = lambda parts, ref: value(media.degrees(F.array(*map(F.lit, parts)).cast("array<double>"), F.lit(ref)))
    assert [deg((17.0, 30.0, 0.0), "N"), deg((17.0, 30.0), "S"), deg((17.0, 90.0, 0.0), "N"), deg((-1.0, 0.0, 0.0), "N")] == [17.5, -17.5, None, None]
    p = value(media.position(text_("+17.3850+078.4867+500.0/")))
    assert (p.lat, p.lon, p.alt) == (17.385, 78.4867, 500.0) and value(media.position(text_("+00.0+000.0/"))) is None and value(media.position(text_("+95.0+010.0/"))) is None


def test_video_records(spark):
    none = None
    rows = [
        (1, "VID_20200102_030405.mp4", "x", none, "2020-01-02T00:00:00Z", none, "Apple", "Apple iPhone 9", none),
        (2, "a.mov", "x", "2021-02-03T04:05:06+0100", "2020-01-02T00:00:00Z", "+10.5-020.25/", none, none, none),
        (3, "clip.mp4", "2019-08-12 Goa", none, "1970-01-01T00:00:00Z", none, none, none, none),
        (4, "Screen Recording 7.mp4", "x", none, none, none, none, none, none),
    ]
    films = spark.createDataFrame(rows, "id long, filename string, folder string, local_date string, utc_date string, location string, make string, model string, software string")
    films = films.withColumn("width", F.lit(100)).withColumn("height", F.lit(100)).withColumn("modified", F.lit("2022-01-01").cast("timestamp"))
    found = {r.id: r for r in media.video_records(films, 2030).collect()}
    short = lambda r: (str(r.taken), r.date_source, r.date_confidence, r.source_kind, r.model)
    assert short(found[1]) == ("2020-01-02 03:04:05", "filename", "high", "phone", "iPhone 9")
    assert short(found[2]) == ("2021-02-03 04:05:06", "container", "high", "unknown", None) and (found[2].lat, found[2].lon) == (10.5, -20.25)
    assert short(found[3])[:3] == ("2019-08-12 00:00:00", "folder", "low") or short(found[3])[1] == "folder"
    assert short(found[4])[1:4] == ("mtime", "low", "screenshot")


def test_motion_offset_and_albums(spark):
    body = b"\xff\xd8abc" + b"\x00\x00\x00\x18ftypmp42" + b"rest"
    rows = spark.createDataFrame([(1, bytearray(body)), (2, bytearray(b"\xff\xd8 plain")), (3, None)], "id long, content binary")
    assert {r.id: r.o for r in rows.select("id", media.motion_offset(F.col("content")).alias("o")).collect()} == {1: body.index(b"ftyp") - 4, 2: None, 3: None}
    lines = spark.createDataFrame([("f:/a/Summer.csv", "Images"), ("f:/a/Summer.csv", '"IMG_1.JPG"'), ("f:/a/Summer.csv", "")], "path string, value string")
    assert [tuple(r) for r in media.album_members(lines).collect()] == [("Summer", "IMG_1.JPG")]


def test_hidden_folders_and_trash_are_no_media(spark):
    names = ["a.jpg", ".hidden/b.jpg", "x/.trashed-1-c.jpg", "x/d.jpg", "x/._e.jpg"]
    rows = spark.createDataFrame([(0, n, 5, 0.0) for n in names], "root_id int, rel_path string, size long, mtime double")
    assert sorted(r.rel_path for r in listing.media(rows).collect()) == ["a.jpg", "x/d.jpg"]


def test_visual_cut_of_many_rows(spark):
    r = np.random.default_rng(5)
    scores = np.round(np.concatenate([r.standard_normal(20_000), r.standard_normal(300) + 6, [6.5] * 50]), 9)
    found = {x.id: x.score for x in neighbours.visual_cut(spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "id long, score double")).collect()}
    head = np.sort(scores)[::-1][: len(scores) // 200].mean()
    cut = max(scores.mean() + 1.6 * scores.std(), scores.mean() + 0.6 * (head - scores.mean()))
    order = sorted(range(len(scores)), key=lambda i: (-scores[i], i))[:800]
    assert set(found) == {i for n, i in enumerate(order) if scores[i] >= cut or n < 40}


def test_identities_go_on_and_begin(spark):
    r = np.random.default_rng(2)
    centres = r.standard_normal((3, 32)) * 3
    make = lambda c, n, base: [(base + i, (centres[c] + 0.4 * r.standard_normal(32)).tolist()) for i in range(n)]
    members = spark.createDataFrame([(i, v, 7) for i, v in make(0, 6, 0)], "id long, vec array<double>, owner long")
    new = spark.createDataFrame(make(0, 4, 100) + make(1, 8, 200) + make(2, 1, 300), "id long, vec array<double>")
    found = {x.id: (x.owner, x.how) for x in clustering.identify(new, members).collect()}
    assert all(found[i] == (7, "attached") for i in range(100, 104)) and len({found[i][0] for i in range(200, 208)}) == 1 and found[200][0] < 0 and 300 not in found


def test_free_names(spark):
    assert [one(spark, text.free_name(F.lit("a.b.jpg"), F.lit(n))) for n in (1, 2)] == ["a.b.jpg", "a.b (2).jpg"]


def test_unknown_positions_part_nothing(spark):
    rows = spark.createDataFrame([(1, 1, 0.0, None, None), (2, 1, 3000.0, 1.0, 1.0), (3, 1, 6000.0, None, 2.0), (4, 1, 9000.0, 50.0, 1.0), (5, 1, 12000.0, 0.0, 0.0)], "id int, k int, ts double, lat double, lon double")
    found = segments.numbered_segments(rows, "k", "ts", "id", position=("lat", "lon")).orderBy("id").collect()
    assert [r.segment for r in found] == [0, 0, 0, 0, 1]


def test_sidecars_of_a_large_folder_meet_by_whole_names(spark):
    import time

    ids = spark.range(20_000)
    stem = F.concat(F.lit("photo of the day number "), F.col("id").cast("string"))
    media = ids.select("id", F.lit("f").alias("folder"), F.concat(stem, F.lit(".jpg")).alias("filename"))
    ends = F.array(*map(F.lit, (".jpg.supplemental-metadata.json", ".jpg.suppl.json", ".jp.json", ".json", ".JPG.json")))
    sidecars = ids.where("id % 7 <> 6").select(F.lit("f").alias("folder"), F.concat(stem, F.get(ends, (F.col("id") % 7).cast("int"))).alias("sidecar")).where("sidecar is not null")
    before = time.monotonic()
    found = {r.id: r.sidecar for r in evidence.match_sidecars(media, sidecars).collect()}
    assert time.monotonic() - before < 60  # all pairs of the folder, 2.9e8, take longer
    expected = {}
    for r in sidecars.collect():
        i = int(r.sidecar[24:].split(".")[0])
        if i % 7 != 2 or len(f"photo of the day number {i}.jp") >= evidence.SHORTEST_CUT:
            expected[i] = r.sidecar
    assert found == expected


def test_sidecars_that_name_a_photo_whole_are_no_cut_names(spark):
    stem = "photo of the day number 123456"  # 30 characters, so it could be a cut name
    media = [(1, f"{stem}.jpg"), (2, f"{stem}7.jpg"), (3, f"{stem}8.jpg"), (4, f"{stem}9(2).jpg"), (5, f"a {stem}.jpg"), (6, f"a {stem}7.jpg")]
    names = [f"{stem}.json", f"{stem}8.jpg.json", f"{stem}(2).json", f"a {stem[:-1]}.json", f"a {stem}.json"]
    found = evidence.match_sidecars(spark.createDataFrame([(i, "f", n) for i, n in media], "id long, folder string, filename string"), spark.createDataFrame([("f", n) for n in names], "folder string, sidecar string"))
    # 4: no photo has the stem and (2); 5: its own stem before a shorter cut; 6: what is another's stem is not its own.
    assert {r.id: r.sidecar for r in found.collect()} == {1: names[0], 3: names[1], 4: names[2], 5: names[4], 6: names[3]}


def test_date_from_filename_states_each_pattern_a_few_times(spark):
    plan = spark.range(1).select(text.date_from_filename(F.concat(F.lit("IMG_"), F.col("id").cast("string"))).alias("d"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(") == 1 and plan.count("regexp_extract(") < 100
