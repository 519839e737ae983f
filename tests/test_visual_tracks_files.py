"""Ranking of many searches, tracks, partial listings, sinks of files, boxes of faces, names, parted components, streams."""

import os
from datetime import UTC, datetime
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactsheet.operators import clustering, faces, maintenance, searches, segments, tracks, visual
from contactsheet.sources import files, walk
from contactsheet.streaming import incremental

# ---- visual ranking


def plain_cut(scores, of=None):
    """Ids of a search's rows that stand out: ``scores`` of all rows, ``of`` the candidates."""
    ids = list(range(len(scores))) if of is None else sorted(of)
    mine = sorted(ids, key=lambda i: (-scores[i], i))
    head = np.mean([scores[i] for i in mine[: max(3, len(mine) // 200)]])
    mu, sd = scores.mean(), scores.std() + 1e-6
    cut = max(mu + 1.6 * sd, mu + 0.6 * (head - mu))
    return [i for n, i in enumerate(mine[:800]) if scores[i] >= cut or n < 40]


def vectors(n, seed=1):
    r = np.random.default_rng(seed)
    m = r.standard_normal((n, 12))
    m[: n // 10] = m[:3][r.integers(0, 3, n // 10)] + 0.2 * r.standard_normal((n // 10, 12))
    m[n // 2 : n // 2 + 30] = m[n // 2]  # equal scores
    return m


def frames(spark, m, asked):
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(len(m) + 5, None)], "id long, vec array<double>").repartition(5)
    return rows, spark.createDataFrame([(q, [float(x) for x in m[q]], q % 2 == 0) for q in asked], "query_id long, vec array<double>, structured boolean")


def test_cuts_of_many_searches(spark, monkeypatch):
    monkeypatch.setattr(visual, "SEARCHES", 3)
    m = vectors(1500)
    rows, queries = frames(spark, m, [0, 1, 2, 5, 700, 750, 1499])
    u = m / np.linalg.norm(m, axis=1)[:, None]
    found = {}
    for r in visual.visual_cuts(rows, queries).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.id)
    assert found == {q: plain_cut(np.round(u @ u[q], 9)) for q in [0, 1, 2, 5, 700, 750, 1499]}
    assert visual.visual_cuts(rows, queries.limit(0)).count() == 0


def test_searches_fall_back_to_the_library(spark):
    m = vectors(900, 3)
    asked = [0, 1, 2, 3, 5]
    rows, queries = frames(spark, m, asked)
    of = {0: list(range(0, 300)), 1: list(range(0, 90)), 2: [], 3: list(range(100, 110)), 5: []}
    candidates = spark.createDataFrame([(q, i) for q, ids in of.items() for i in ids], "query_id long, id long")
    u = m / np.linalg.norm(m, axis=1)[:, None]
    found = {}
    for r in visual.ranked_searches(rows, queries, candidates, 60).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.id)
    want = {}
    for q in asked:
        s = np.round(u @ u[q], 9)
        if q % 2 == 0:
            want[q] = sorted(of[q], key=lambda i: (-s[i], i))[:60]
        else:
            some = plain_cut(s, of[q])[:60] if of[q] else []
            want[q] = some if len(some) >= 20 else plain_cut(s)[:60]
    assert found == {q: ids for q, ids in want.items() if ids}


def test_many_searches_are_few_passes_and_one_table(spark, monkeypatch):
    r = np.random.default_rng(8)
    m = r.normal(size=(300, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<double>")
    queries = rows.where("id % 2 = 0").select(F.col("id").alias("query_id"), "vec", (F.col("id") % 3 == 0).alias("structured"))
    candidates = queries.select("query_id").crossJoin(rows.where("id % 5 = 0").select("id")).where("(query_id + id) % 4 < 2")
    plain = [[tuple(x) for x in df.orderBy("query_id", "rank").collect()] for df in (visual.visual_cuts(rows, queries), visual.ranked_searches(rows, queries, candidates, 30))]
    monkeypatch.setattr(visual, "SEARCHES", 80)
    made = visual.visual_cuts(rows, queries), visual.ranked_searches(rows, queries, candidates, 30)
    # The plan does not grow with the number of passes.
    assert all(df._jdf.queryExecution().analyzed().toString().count("Relation") <= 2 for df in made)
    assert [[tuple(x) for x in df.orderBy("query_id", "rank").collect()] for df in made] == plain and min(map(len, plain)) > 1000


# ---- tracks


def plain_position(data, utc, within):
    for _, points in sorted(data.items(), key=lambda x: (x[1][0][0], x[0])):
        before = [p for p in points if p[0] < utc]
        after = [p for p in points if p[0] >= utc]
        if before and after:
            (b, a) = before[-1], after[0]
            if utc - b[0] > within or a[0] - utc > within:
                continue
            f = (utc - b[0]) / (a[0] - b[0])
            return round(b[1] + f * (a[1] - b[1]), 7), round(b[2] + f * (a[2] - b[2]), 7)
        near = before[-1] if before else after[0]
        if abs(near[0] - utc) <= within:
            return round(near[1], 7), round(near[2], 7)
    return None


def test_positions_from_tracks_that_overlap(spark):
    r = np.random.default_rng(4)
    data = {}
    for t in range(12):
        start = float(r.integers(0, 5000))
        times = start + np.cumsum(r.choice([20, 100, 290, 700], int(r.integers(1, 30))))
        data[t] = [(float(x), float(r.uniform(-80, 80)), float(r.uniform(-170, 170))) for x in times]
    points = spark.createDataFrame([(t, *p) for t, ps in data.items() for p in ps] + [(3, None, 1.0, 1.0), (4, 100.0, None, 1.0)], "track long, ts double, lat double, lon double")
    asked = [(i, float(r.integers(-500, 16_000))) for i in range(400)] + [(400 + i, p[0]) for i, p in enumerate(data[5])]
    found = {x.id: (x.lat, x.lon) for x in tracks.positions(points, spark.createDataFrame([*asked, (9999, None)], "id long, utc double")).collect()}
    want = {i: at for i, utc in asked if (at := plain_position(data, utc, 300.0)) is not None}
    assert set(found) == set(want) and all(np.allclose(found[i], want[i], atol=2e-7) for i in want) and 50 < len(want) < 400


def test_positions_in_narrow_bins_and_without_a_row_for_each_track(spark):
    r = np.random.default_rng(5)
    data = {f"t{t}": [(float(r.integers(0, 6000)) / 2, float(r.uniform(-80, 80)), float(r.uniform(-170, 170))) for _ in range(int(r.integers(1, 60)))] for t in range(25)}
    data["t3"] += [(1000.0, 5.0, 6.0), (1000.0, 5.0, 4.0), (1000.0, 2.0, 9.0)]
    data = {t: sorted(ps) for t, ps in data.items()}
    points = spark.createDataFrame([(t, *p) for t, ps in data.items() for p in ps], "track string, ts double, lat double, lon double")
    asked = [(i, float(r.integers(-600, 4000))) for i in range(300)] + [(1000 + i, float(t)) for i, t in enumerate((999, 1000, 1001))]
    want = {i: at for i, utc in asked if (at := plain_position(data, utc, 300.0)) is not None}
    for most in (7, 100_000):
        told = tracks.positions(points, spark.createDataFrame(asked, "id int, utc double"), within=300.0, most=most)
        # Nothing is shuffled by question: each is answered where it meets the points of its time.
        assert "hashpartitioning(id" not in told._jdf.queryExecution().executedPlan().toString()
        found = {x.id: (x.lat, x.lon) for x in told.collect()}
        assert set(found) == set(want) and all(np.allclose(found[i], want[i], atol=2e-7) for i in want)


# ---- listings


def test_walk_skips_and_tells_what_it_could_not_read(spark, tmp_path):
    for rel in ("a.jpg", "x/b.jpg", "x/y/c.jpg", ".git/d.jpg", "x/@eaDir/e.jpg", "locked/f.jpg", "x/locked2/g.jpg", "node_modules/deep/h.jpg"):
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_bytes(b"1234")
    entered = str(tmp_path / "entered.log")

    def list_folder(folder):
        with open(entered, "a") as f:
            f.write(folder + "\n")
        if os.path.basename(folder).startswith("locked"):
            raise PermissionError(folder)
        return list(walk.entries(folder))

    found, unread = walk.walk(spark, str(tmp_path), 3, list_folder=list_folder)
    assert sorted(r.rel_path for r in found.where("rel_path <> 'entered.log'").collect()) == ["a.jpg", "x/b.jpg", "x/y/c.jpg"]
    assert sorted(r.rel_path for r in unread.collect()) == ["locked", "x/locked2"]
    seen = open(entered).read()
    assert ".git" not in seen and "@eaDir" not in seen and "node_modules" not in seen
    gone, missing = walk.walk(spark, str(tmp_path / "nothing"))
    assert gone.count() == 0 and [r.rel_path for r in missing.collect()] == [""]


def test_unread_folders_hide_what_is_below(spark):
    names = ["a/1", "a/b/2", "ab/3", "c", "d/4", "t/5"]
    known = spark.createDataFrame([(1, n, 1, 1.0, "trashed" if n == "t/5" else "ok") for n in names], "root_id int, rel_path string, size long, mtime double, status string")
    listing = spark.createDataFrame([(1, "z", 1, 1.0)], "root_id int, rel_path string, size long, mtime double")

    def missing(*unread):
        rows = spark.createDataFrame([(1, u) for u in unread], "root_id int, rel_path string")
        return sorted(r.rel_path for r in maintenance.snapshot_diff(known, listing, unread=rows).where("change = 'missing'").collect())

    assert missing() == ["a/1", "a/b/2", "ab/3", "c", "d/4"]
    assert missing("a") == ["ab/3", "c", "d/4"] and missing("a/b", "c") == ["a/1", "ab/3", "d/4"] and missing("") == []


# ---- sinks


def test_export_is_whole_and_repeatable(spark, tmp_path):
    rows = spark.createDataFrame([("x/a.txt", "höher"), ("b.txt", None), ("../out.txt", "no"), ("/etc/out.txt", "no"), ("", "no")], "path string, content string").repartition(3)
    target = str(tmp_path / "out")
    done = {r.path: r.action for r in files.export_files(rows, target).collect()}
    assert done == {"x/a.txt": "copied", "b.txt": "copied", "../out.txt": "refused", "/etc/out.txt": "refused", "": "refused"}
    assert (tmp_path / "out/x/a.txt").read_text() == "höher" and not (tmp_path / "out.txt").exists()
    stamp = os.stat(tmp_path / "out/x/a.txt").st_mtime_ns
    again = files.export_files(rows, target)
    assert again.where("action = 'copied'").count() == 0 and os.stat(tmp_path / "out/x/a.txt").st_mtime_ns == stamp
    (tmp_path / "out/x/a.txt").write_text("hoher!")  # of the same size
    assert files.export_files(rows, target).where("action = 'copied'").count() == 1 and (tmp_path / "out/x/a.txt").read_text() == "höher"
    with pytest.raises(ValueError):
        files.export_files(rows, "viewfs://x/y")


def test_a_failed_export_leaves_nothing_half_written(spark, tmp_path):
    flag = tmp_path / "flag"

    @F.udf("string")
    def body(i):
        if i == 7 and not os.path.exists(str(flag)):
            raise RuntimeError("lost")
        return "text " * i

    rows = spark.range(10).select(F.concat(F.col("id").cast("string"), F.lit(".txt")).alias("path"), body("id").alias("content"))
    with pytest.raises(Exception, match="lost"):
        files.export_files(rows, str(tmp_path / "out"))
    left = list((tmp_path / "out").glob("*")) if (tmp_path / "out").exists() else []
    assert all(p.read_text() == "text " * int(p.stem) for p in left if p.suffix == ".txt") and not [p for p in left if p.suffix == ".part"]
    flag.touch()
    files.export_files(rows, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(f"{i}.txt" for i in range(10))


def test_backup_is_carried_out(spark, tmp_path):
    source, target = tmp_path / "s", tmp_path / "t"
    for rel, body in (("a/1.jpg", b"one"), ("2.jpg", b"two"), ("3.jpg", b"three")):
        (source / rel).parent.mkdir(parents=True, exist_ok=True)
        (source / rel).write_bytes(body)
        os.utime(source / rel, (1000, 1000))
    schema = "rel_path string, size long, mtime double"
    have = spark.createDataFrame([("a/1.jpg", 3, 1000.0), ("2.jpg", 3, 1000.0), ("3.jpg", 5, 1000.0), ("lost.jpg", 9, 1000.0)], schema)
    there = spark.createDataFrame([("2.jpg", 3, 1001.0), ("3.jpg", 4, 5000.0)], schema)
    done = {r.rel_path: r.action for r in files.run_backup(have, str(source), str(target), there).collect()}
    assert done == {"a/1.jpg": "copied", "2.jpg": "equal", "3.jpg": "keep", "lost.jpg": "failed"}
    assert (target / "a/1.jpg").read_bytes() == b"one" and os.stat(target / "a/1.jpg").st_mtime == 1000 and not (target / "2.jpg").exists()
    now, _ = walk.walk(spark, str(target))
    again = files.run_backup(have.where("rel_path = 'a/1.jpg'"), str(source), str(target), now.drop("root_id"))
    assert [r.action for r in again.collect()] == ["equal"]


# ---- faces


def test_suppression_against_a_plain_version(spark):
    r = np.random.default_rng(3)
    rows = [(int(p), i, *map(float, (x, y, x + w, y + w)), round(float(s), 2)) for i, (p, x, y, w, s) in enumerate(zip(r.integers(0, 9, 300), r.integers(0, 60, 300), r.integers(0, 60, 300), r.integers(10, 60, 300), r.random(300), strict=True))]
    found = {x.id for x in faces.suppress(spark.createDataFrame(rows, "photo_id int, id int, x1 double, y1 double, x2 double, y2 double, score double").repartition(4)).collect()}
    want = set()
    for photo in range(9):
        kept = []
        for b in sorted((x for x in rows if x[0] == photo), key=lambda x: (-x[6], x[1])):
            area = lambda q: (q[4] - q[2] + 1) * (q[5] - q[3] + 1)
            both = lambda q: max(0, min(q[4], b[4]) - max(q[2], b[2]) + 1) * max(0, min(q[5], b[5]) - max(q[3], b[3]) + 1)  # noqa: B023, E731
            if all(both(q) / (area(q) + area(b) - both(q)) <= 0.4 for q in kept):
                kept.append(b)
        want |= {b[1] for b in kept}
    assert found == want and len(want) < 300


def test_alignment_is_the_least_squares_similarity(spark):
    r = np.random.default_rng(5)
    wanted = [(38.0, 51.0), (73.0, 51.0), (56.0, 71.0), (41.0, 92.0), (70.0, 92.0)]
    for _ in range(5):
        src = r.uniform(0, 200, (5, 2))
        t = spark.range(1).select(faces.similarity([(F.lit(float(x)), F.lit(float(y))) for x, y in src], wanted).alias("t")).first().t
        design = np.concatenate([np.stack([src[:, 0], -src[:, 1], np.ones(5), np.zeros(5)], 1), np.stack([src[:, 1], src[:, 0], np.zeros(5), np.ones(5)], 1)])
        best, *_ = np.linalg.lstsq(design, np.array(wanted).T.ravel(), rcond=None)
        assert np.allclose([t.a, t.b, t.tx, t.ty], best)
    point = lambda x, y: (F.lit(float(x)), F.lit(float(y)))
    turned = spark.range(1).select(faces.yaw(point(0, 0), point(10, 0), point(8, 5)).alias("y"), faces.yaw(point(1, 1), point(1, 1), point(0, 0)).alias("z"), faces.quality(F.lit(0.9), F.lit(80.0), F.lit(400.0), F.lit(0.0), F.lit(22.0)).alias("q")).first()
    assert (round(turned.y, 6), turned.z, turned.q) == (0.3, 1.0, 1.0)


# ---- names, components, identity of events


def test_close_names_are_found_from_few_candidates(spark):
    r = np.random.default_rng(6)
    make = lambda: "".join(r.choice([*"abcdefghijklmnopqrst"], int(r.integers(4, 11))))
    names = [(make(), i) for i in range(400)]
    words = [n[: len(n) // 2] + n[len(n) // 2 + 1 :] for n, _ in names[:40]] + [make() for _ in range(60)] + ["abc"]
    w, n = spark.createDataFrame([(x,) for x in words], "word string"), spark.createDataFrame(names, "name string, entity long")
    best = {}
    for word in {x for x in words if len(x) >= 4}:
        rated = [(-SequenceMatcher(None, name, word).ratio(), name, i) for name, i in names if abs(len(name) - len(word)) <= 3]
        if rated and -min(rated)[0] > 0.84:
            best[word] = (min(rated)[2], round(-min(rated)[0], 6))
    found = {x.word: (x.entity, x.ratio) for x in searches.closest_names(w, n).collect()}
    assert found == best and len(best) > 10
    assert searches.name_candidates(w, n).count() < 0.02 * len(words) * len(names)


def plain_apart(edges, apart, levels):
    root = {x: x for e in edges for x in e[:2]}
    for level in sorted(levels, reverse=True):
        into = dict(root)

        def find(x):
            while into[x] != x:
                x = into[x]
            return x

        for a, b, weight in edges:
            if weight >= level:
                x, y = sorted((find(root[a]), find(root[b])))
                into[y] = x
        barred = {find(root[a]) for a, b in apart if a in root and b in root and find(root[a]) == find(root[b])}
        root = {x: (v if find(v) in barred else find(v)) for x, v in root.items()}
    return root


def test_components_keep_pairs_apart(spark):
    r = np.random.default_rng(7)
    edges = [(int(a), int(b), round(float(w), 2)) for a, b, w in zip(r.integers(0, 60, 90), r.integers(0, 60, 90), r.random(90), strict=True) if a != b]
    apart = [(int(a), int(b)) for a, b in r.integers(0, 60, (12, 2)) if a != b]
    levels = [0.8, 0.5, 0.2]
    found = {x.node: x.root for x in clustering.components_apart(spark.createDataFrame(edges, "a long, b long, weight double"), spark.createDataFrame(apart, "a long, b long"), levels).collect()}
    want = plain_apart(edges, apart, levels)
    groups = lambda roots: sorted(sorted(x for x in roots if roots[x] == r) for r in set(roots.values()))
    assert groups(found) == groups(want)
    assert all(found[a] != found[b] for a, b in apart if a in found and b in found)


def test_merging_leaves_owners_apart(spark):
    rows = [(i, [1.0, 0.01 * i], i // 3) for i in range(9)]
    members = spark.createDataFrame(rows, "id long, vec array<double>, owner long")
    assert {x.merged for x in clustering.merge_close(members, least=0.9).collect()} == {0}
    apart = spark.createDataFrame([(2, 0)], "a long, b long")
    found = {x.owner: x.merged for x in clustering.merge_close(members, least=0.9, apart=apart).collect()}
    assert found[0] != found[2]


def test_nothing_new_takes_no_work(spark):
    members = spark.createDataFrame([(1, [1.0, 0.0], 5)], "id long, vec array<double>, owner long")
    none = members.select("id", "vec").limit(0)
    assert clustering.identify(none, members.select("*", F.raise_error(F.lit("read")).alias("x"))).count() == 0  # members are not read


def test_second_best_when_the_best_is_taken(spark):
    new = [("a", i) for i in range(4)] + [("b", i) for i in range(4, 8)]
    old = [("p", 0), ("p", 1), ("p", 4), ("p", 5), ("q", 2), ("q", 3), ("r", 6), ("r", 7)]
    frame = lambda rows: spark.createDataFrame(rows, "g string, m long")
    found = {(x.new_grp, x.old_grp) for x in segments.match_by_overlap(frame(new), frame(old), least=0.3).collect()}
    assert found == {("a", "q"), ("b", "r")}  # both are nearer to these than to p
    new, old = [("a", 0), ("a", 1), ("b", 2), ("b", 3)], [("p", 0), ("p", 1), ("p", 2), ("q", 3)]
    found = {(x.new_grp, x.old_grp) for x in segments.match_by_overlap(frame(new), frame(old), least=0.2).collect()}
    assert found == {("a", "p"), ("b", "q")}
    new, old = [("a", 0), ("a", 1), ("b", 2), ("b", 3), ("b", 4)], [("p", 0), ("p", 2), ("p", 3), ("q", 4)]
    found = {(x.new_grp, x.old_grp) for x in segments.match_by_overlap(frame(new), frame(old), least=0.2).collect()}
    assert found == {("a", "p"), ("b", "q")}  # b is nearer to p, which a chose before it


# ---- streams


@pytest.mark.parametrize("seed", [1, 2])
def test_segments_of_a_stream_in_any_order(spark, tmp_path, seed):
    r = np.random.default_rng(seed)
    stamp = lambda s: datetime.fromtimestamp(1.6e9 + s, UTC).replace(tzinfo=None)
    rows = [(f"cam{r.integers(0, 3)}", stamp(float(s))) for s in np.cumsum(r.choice([60, 3000, 9500, 20_000], 120))]
    order = r.permutation(len(rows))
    schema = "key string, ts timestamp"
    for part in np.array_split(order, 6):
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for i, p in enumerate(sorted((tmp_path / "in").glob("*.parquet"))):
        os.utime(p, (1000 + i, 1000 + i))
    stream = incremental.stream_of(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    table = str(tmp_path / "table")
    query = incremental.fold_segments(incremental.segment_changes(stream), table, str(tmp_path / "ck"))
    query.awaitTermination(180)
    assert query.exception() is None
    found = sorted((x.key, round(x.start), round(x.end), x.n) for x in incremental.segments_in_force(spark, table).collect())
    want = []
    for key in {k for k, _ in rows}:
        times = sorted(t.replace(tzinfo=UTC).timestamp() for k, t in rows if k == key)
        cuts = [0, *(i for i in range(1, len(times)) if times[i] - times[i - 1] > 9000), len(times)]
        want += [(key, round(times[a]), round(times[b - 1]), b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    assert found == sorted(want)
    late = [("cam9", stamp(0.0)), ("cam9", stamp(50_000.0)), ("cam9", stamp(50_060.0))]
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([("cam9", stamp(50_030.0))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "more"))
    for source in ("in", "more"):
        stream = incremental.stream_of(spark, str(tmp_path / source), spark.createDataFrame([], schema).schema)
    moved = sorted((tmp_path / "more").glob("*.parquet"))[0]
    incremental.fold_segments(incremental.segment_changes(incremental.stream_of(spark, str(tmp_path / "in"), stream.schema)), table, str(tmp_path / "ck")).awaitTermination(180)
    os.rename(moved, tmp_path / "in" / "zz.parquet")
    incremental.fold_segments(incremental.segment_changes(incremental.stream_of(spark, str(tmp_path / "in"), stream.schema)), table, str(tmp_path / "ck")).awaitTermination(180)
    batches = sorted((int(p.name.split("=")[1]) for p in (tmp_path / "table").glob("batch=*")))
    written = [n for b in batches if (n := spark.read.schema("key string, start double, end double, n long, there boolean").parquet(f"{table}/batch={b}").count())]
    assert written[-1] == 1  # the late photo reopened one range only
    assert {x.n for x in incremental.segments_in_force(spark, table).where("key = 'cam9'").collect()} == {1, 3}
