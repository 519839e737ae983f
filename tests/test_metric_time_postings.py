"""Similarity joins by metric partitioning, scans of a whole library in time, and the positional index."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactsheet import plans
from contactsheet.operators import clustering, duplicates, events, library_time, metric, neighbours, postings, segments


def clustered(n, groups=None, dim=24, seed=1, spread=0.12):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((groups or max(1, n // 25), dim))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    return centres[r.integers(0, len(centres), n)] + spread * r.standard_normal((n, dim)) / np.sqrt(dim) * 3


def table(spark, m):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(m)], "id long, vec array<double>")


def plain_pairs(m, least):
    """Pairs under the rule of copies: different vectors by their first rows, copies with the first."""
    ids = [i for i, v in enumerate(m) if v is not None and np.linalg.norm(v) >= 1e-8]
    first = {}
    for i in ids:
        first.setdefault(tuple(m[i]), i)
    out = {(first[tuple(m[i])], i, 1.0) for i in ids if first[tuple(m[i])] != i}
    reps = sorted(first.values())
    u = {i: np.array(m[i]) / np.linalg.norm(m[i]) for i in reps}
    return out | {(a, b, round(float(u[a] @ u[b]), 6)) for a, b in itertools.combinations(reps, 2) if round(float(u[a] @ u[b]), 6) >= least}


@pytest.mark.parametrize("least", [0.95, 0.6, 0.1])
def test_similar_pairs_match_brute_force(spark, least):
    m = list(clustered(300))
    m += [m[5], m[5], m[7], None, np.zeros(24), 2 * m[9], -m[3]]
    found = {(r.a, r.b): r.cosine for r in metric.similar_pairs(table(spark, m), least, part=30, lane=50).collect()}
    want = {(a, b): c for a, b, c in plain_pairs(m, least)}
    assert set(found) == set(want) and all(abs(c - want[p]) < 2e-6 for p, c in found.items())
    assert metric.similar_pairs(table(spark, [None]), 0.5).count() == 0


@pytest.mark.parametrize("k,least", [(3, 0.5), (12, -0.2)])
def test_nearest_above_is_knn(spark, k, least):
    m = list(clustered(250, seed=3))
    m += [m[5]] * 20 + [m[7], None]
    rows = table(spark, m)
    want = neighbours.knn(rows.select(F.col("id").alias("query_id"), "vec"), rows, k, least=least)
    found = metric.nearest_above(rows, k, least, cell=5, part=30, lane=50)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_few_pairs_are_compared(spark):
    counts = {}
    for n in (1000, 4000):
        compared = spark.sparkContext.accumulator(0)
        metric.similar_pairs(table(spark, clustered(n)), 0.9, compared=compared).count()
        counts[n] = compared.value
        assert 0 < compared.value < n * (n - 1) / 2 / 5
    assert counts[4000] < 8 * counts[1000]  # all pairs are 16 times as many


@pytest.mark.parametrize("copy", [0, 10**9])
def test_any_number_of_pivots_gives_the_same_pairs(spark, monkeypatch, copy):
    monkeypatch.setattr(metric, "COPY", copy)
    r = np.random.default_rng(2)
    m = [*r.standard_normal((150, 6)), *clustered(80, dim=6)]
    pairs = metric.similar_pairs(table(spark, m), 0.5, cell=4)
    assert {(x.a, x.b) for x in pairs.collect()} == {p[:2] for p in plain_pairs(m, 0.5)}


def test_confidences_by_hand(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 7), (2, [1.0, 0.0], 7), (3, [0.0, 1.0], 7), (4, [1.0, 1.0], 8), (5, None, 8), (6, [-1.0, 0.0], 9), (7, [1.0, 0.0], 9)], "id long, vec array<double>, label long")
    found = {r.id: r.confidence for r in clustering.confidences(rows, block=2).collect()}
    assert found == {1: 0.5, 2: 0.5, 3: 0.0, 4: 0.5, 6: 0.0, 7: 0.0}


def test_attach_leaves_rejected_out(spark):
    members = spark.createDataFrame([(10, [1.0, 0.0], 1), (11, [0.8, 0.6], 2), (12, [0.0, 1.0], 3)], "id long, vec array<double>, owner long")
    rows = spark.createDataFrame([(1, [1.0, 0.05])], "id long, vec array<double>")
    owner = lambda said: [r.owner for r in clustering.attach(rows, members, rejected=spark.createDataFrame(said, "id long, owner long")).collect()]
    assert owner([]) == [1] and owner([(1, 3)]) == [1] and owner([(1, 1)]) == [2] and owner([(2, 1)]) == [1]
    assert owner([(1, 1), (1, 2)]) == [] and owner([(1, 2)]) == [1]


# ---- time


def shots(spark, n, seed, parts=6):
    r = np.random.default_rng(seed)
    gaps = r.choice([5, 60, 600, 1500, 3000, 9500, 20_000, 40_000, 90_000], n, p=[0.3, 0.3, 0.15, 0.08, 0.06, 0.04, 0.03, 0.02, 0.02])
    ts = 1e9 + np.cumsum(gaps * (r.random(n) > 0.2))
    place = np.repeat(r.integers(0, 6, n // 7 + 1), 7)[:n]
    rows = []
    for i in range(n):
        p = None if r.random() < 0.2 else int(place[i])
        at = (float(place[i]) * 3, float(place[i]) * 2) if r.random() < 0.4 else (None, None)
        rows.append((int(r.integers(0, 10**6)) * 1000 + i, None if r.random() < 0.02 else float(ts[i]), p, None if p is None or p > 3 else f"city{p // 2}", f"f{i // 40 % 3}" if r.random() < 0.9 else None, *at, 1))
    return spark.createDataFrame(rows, "id long, taken_ts double, place_id int, city string, folder string, lat double, lon double, one int").repartition(parts)


@pytest.mark.parametrize("seed,cap", [(1, 1200), (2, 30), (3, 12)])
def test_events_of_a_library_are_those_of_one_key(spark, seed, cap):
    rows = shots(spark, 900, seed)
    named = {r.id: r for r in library_time.event_names(rows, cap=cap).collect()}
    walked = events.event_numbers(rows, "one", "id", cap=cap).collect()
    assert {r.id for r in walked} == set(named)
    for what in ("segment", "session", "event"):
        pairs = {(getattr(r, what), getattr(named[r.id], what)) for r in walked}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) > 3
        order = {r.id: (r.taken_ts, r.id) for r in rows.where("taken_ts is not null").collect()}
        heads = {}
        for r in walked:
            heads[getattr(r, what)] = min(heads.get(getattr(r, what), (9e18, 0)), order[r.id])
        assert all(named[r.id][what] == heads[getattr(r, what)][1] for r in walked)
    assert library_time.event_rows(library_time.event_names(rows, cap=cap), rows).agg(F.sum("photos")).first()[0] == len(named)


def test_scans_do_not_depend_on_slices(spark):
    rows = shots(spark, 400, 5).where("taken_ts is not null")
    want = {r.id: r.inherited for r in segments.inherit_nearest(rows, "one", "taken_ts", "id", "place_id", within=5000).collect()}
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        found = set()
        for parts in (1, 3, 40):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            assert {r.id: r.inherited for r in library_time.inherit_nearest(rows, ["taken_ts", "id"], "place_id", within=5000).collect()} == want
            found.add(tuple(sorted((r.id, r.segment) for r in library_time.event_names(rows, cap=20).collect())))
        assert len(found) == 1
        sliced = library_time.in_slices(rows, ["taken_ts", "id"])
        assert sliced.groupBy(library_time.SLICE).count().agg(F.max("count")).first()[0] < 60  # no task has much more than its share
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scans_of_nothing(spark):
    none = shots(spark, 20, 1).where("id < 0")
    assert library_time.event_names(none).count() == 0
    assert library_time.inherit_nearest(none, ["taken_ts", "id"], "place_id").count() == 0


# ---- postings


def searches(spark, asked):
    return spark.createDataFrame(list(enumerate(asked)), "query_id long, terms array<string>")


def texts(seed, n):
    r = np.random.default_rng(seed)
    words = [*"abcdefghij", "licence", "license"]
    return {i: " ".join(r.choice(words, int(r.integers(0, 40)), p=[0.2, 0.15, 0.1, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05])) for i in range(n)}


def frame(spark, data):
    return spark.createDataFrame(list(data.items()), "k long, text string")


ASKED = [["a"], ["a", "b"], ["license", "j", "i"], ["nothing"], ["a", "nothing"], ["b", "a", "b"], []]


def plain_all(data, terms):
    return {k for k, t in data.items() if terms and set(terms) <= set(t.split())}


def plain_phrase(data, terms):
    return {k for k, t in data.items() if terms and f" {' '.join(terms)} " in f" {t} "}


def check_index(spark, index, data):
    asked = searches(spark, ASKED)
    found, phrases = {}, {}
    for r in postings.search_all(index, asked).collect():
        found.setdefault(r.query_id, set()).add(r.key)
    for r in postings.search_phrase(index, asked).collect():
        phrases.setdefault(r.query_id, set()).add(r.key)
        assert data[r.key].split()[r.at :][: len(ASKED[r.query_id])] == ASKED[r.query_id]
    assert found == {q: s for q, t in enumerate(ASKED) if (s := plain_all(data, t))}
    assert phrases == {q: s for q, t in enumerate(ASKED) if (s := plain_phrase(data, t))}


def plain_bm25(data, terms, limit):
    n, mean = len(data), np.mean([len(t.split()) for t in data.values()])
    df = {x: sum(x in t.split() for t in data.values()) for x in terms}
    gain = lambda x, w: np.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / mean))
    scored = [(-round(float(sum(gain(x, data[k].split()) for x in set(terms))), 6), k) for k in plain_all(data, terms)]
    return [(k, -s) for s, k in sorted(scored)[:limit]]


def test_index_is_kept_from_differences(spark):
    old = texts(1, 300)
    index = postings.build(frame(spark, old), "k", "text", block_docs=16)
    check_index(spark, index, old)
    assert postings.update(index, frame(spark, old), "k", "text") == index  # nothing to do, nothing written
    new = {k: t for k, t in old.items() if k % 10 != 3} | {k: f"a license {t}" for k, t in old.items() if k % 20 == 5} | {1000: "a b c", 1001: ""}
    later = postings.update(index, frame(spark, new), "k", "text")
    check_index(spark, later, new)
    written = later.table("postings").where(f"generation = {later.generation}").select(F.explode("entries.key").alias("k")).distinct().collect()
    changed = {k for k, t in new.items() if old.get(k) != t and t}
    assert {r.k for r in written} == changed  # only their own postings
    again = postings.update(later, frame(spark, old), "k", "text")
    check_index(spark, again, old)
    packed = postings.compact(again)
    check_index(spark, packed, old)
    assert packed.table("dead").count() == 0 and packed.table("postings").select("term", "block").distinct().count() == packed.table("postings").count()


def test_bm25_from_block_maxima(spark):
    data = texts(2, 600)
    data |= {k: "x " * (50 + k % 9) + "a b license j i" for k in data if k % 60 != 7}  # a few short ones are the best
    stale = {k: (t if k % 5 else "x b " + t) for k, t in data.items()}
    index = postings.update(postings.build(frame(spark, stale), "k", "text", block_docs=8), frame(spark, data), "k", "text")
    for limit in (3, 1000):
        scored: list = []
        found: dict = {}
        for r in postings.bm25(index, searches(spark, ASKED), limit, scored=scored).orderBy("query_id", "rank").collect():
            found.setdefault(r.query_id, []).append((r.key, r.score))
        for q, terms in enumerate(ASKED):
            want = plain_bm25(data, terms, limit)
            assert [k for k, _ in found.get(q, [])] == [k for k, _ in want]
            assert np.allclose([s for _, s in found.get(q, [])], [s for _, s in want], atol=2e-6)
        met, done = scored[0]
        assert done < 0.8 * met if limit == 3 else done == met, (met, done)




def test_common_words_do_not_go_with_every_search(spark):
    docs = spark.createDataFrame([(i, " ".join(["common word"] * 150 + [f"rare{i}", "common", "end"])) for i in range(200)], "k long, t string")
    index = postings.build(docs, "k", "t", block_docs=20)
    asked = spark.createDataFrame([(i, [f"rare{i}", "common", "end"]) for i in range(100)] + [(500, ["common", f"rare{7}"]), (501, ["end"]), (502, ["none", "common"]), (503, ["rare1", "end"])], "query_id long, terms array<string>")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    found = {(r.query_id, r.key, r.at) for r in postings.search_phrase(index, asked).collect()}
    assert found == {(i, i, 300) for i in range(100)} | {(501, i, 302) for i in range(200)}
    every = {(r.query_id, r.key) for r in postings.search_all(index, asked).collect()}
    assert every == {(i, i) for i in range(100)} | {(500, 7), (503, 1)} | {(501, i) for i in range(200)}
    assert written() - before < 2_000_000  # the places of "common", 60 KB, a hundred times


def test_kinds_of_contents_and_bands_are_told_where_pairs_meet(spark):
    r = np.random.default_rng(12)
    base = [int(x) for x in r.integers(0, 2**62, 12)]
    data = [(i, None if i % 17 == 0 else base[i % 12] ^ int(sum(1 << int(b) for b in r.integers(0, 62, i % 5))), None if i % 7 == 0 else f"c{i % 40}") for i in range(150)]
    rows = spark.createDataFrame(data, "id long, phash long, sha256 string")
    kind = F.when(F.col("sha256_a") == F.col("sha256_b"), "exact").when((F.col("id_a") + F.col("id_b")) % 3 > 0, "near")
    made = duplicates.content_and_band_kinds(rows, kind)
    assert "hashpartitioning(a#" not in made._jdf.queryExecution().executedPlan().toString()
    found = [(x.a, x.b, x.kind) for x in made.collect()]
    first = {}
    want = set()
    for (i, p, c), (j, q, d) in itertools.combinations(data, 2):
        if c is not None:
            first.setdefault(c, i)
        x = None if p is None or q is None else p ^ q
        banded = x is not None and x.bit_count() <= 16 and any(x >> 16 * k & 0xFFFF == 0 for k in range(4))
        same = c is not None and c == d
        if banded and (same or (i + j) % 3):
            want.add((i, j, "exact" if same else "near"))
        elif same and not banded and first[c] == i:
            want.add((i, j, "exact"))
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 300


def test_classified_pairs_are_not_joined_with_their_rows(spark):
    plan = plans.queries()["g13_classify"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a#" not in plan


def test_knn_multiplies_a_bounded_number_at_a_time(spark, monkeypatch):
    rows = table(spark, clustered(300))
    asked = rows.where("id % 3 = 0").select(F.col("id").alias("query_id"), "vec")
    want = {(r.query_id, r.rank): (r.id, r.cosine) for r in neighbours.knn(asked, rows, 5).collect()}
    monkeypatch.setattr(neighbours, "PRODUCTS", 700)  # two searches at a time
    assert {(r.query_id, r.rank): (r.id, r.cosine) for r in neighbours.knn(asked, rows, 5).collect()} == want and len(want) == 500
