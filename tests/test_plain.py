"""Queries that SQL does not express, against plain versions over the same rows."""

import numpy as np
from pyspark.sql import functions as F

from contactsheet import plans
from contactsheet.adapter import Library
from contactsheet.functions import vectors as vx
from contactsheet.operators import clustering, library, neighbours

SF = "/root/testdata/sf0.001"


def test_greedy_pairs(spark):
    found = plans.queries()["j14_greedy_iou"](spark, SF)
    box = lambda shift: tuple(((F.col("l_partkey") * n + shift) % 50).cast("double") / 100 + (0.5 if i > 1 else 0.0) for i, n in enumerate((3, 5, 7, 11)))
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.array(*box(0)).alias("a"), F.array(*box(4)).alias("b"))
    by_key = {}
    for r in lines.collect():
        by_key.setdefault(r.l_orderkey, []).append(r)

    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        both = max(w, 0) * max(h, 0)
        area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
        return round(both / (area(a) + area(b) - both), 6) if area(a) + area(b) - both > 0 else 0.0

    want = []
    for key, own in by_key.items():
        used_old, used_new = {}, {}
        rated = sorted((-iou(x.a, y.b), x.l_linenumber, y.l_linenumber) for x in own for y in own if iou(x.a, y.b) > 0.5)
        for score, old, new in rated:
            if old not in used_old and new not in used_new:
                used_old[old] = used_new[new] = True
                want.append((key, old, new, -score))
    got = sorted((r.l_orderkey, r.old, r.new, r.iou) for r in found.collect())
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)] and got
    assert isinstance(vx.iou, object)


def test_diversify(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    vectors = {r.vec_id: np.array(r.embedding, float) / np.linalg.norm(np.array(r.embedding, float)) for r in rows}
    near = sorted(((-round(float(vectors[0] @ v), 6), i) for i, v in vectors.items() if i != 0))[:150]
    kept = []
    for _, i in near[: 3 * 50]:
        if not any(float(vectors[i] @ vectors[j]) > 0.3 for j in kept[-40:]):
            kept.append(i)
        if len(kept) == 50:
            break
    found = plans.queries()["w6_diversify"](spark, SF).orderBy("place").collect()
    assert [r.id for r in found] == kept


def test_chinese_whispers(spark):
    lib = Library(spark, SF)
    rows = lib.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    edges = clustering.knn_edges(rows, k=6, edge=0.1)
    heard = {}
    for r in edges.collect():
        heard.setdefault(r.src, []).append((r.dst, r.weight))
    now = {r.id: r.id for r in rows.collect()}
    for n in range(12):
        moves = {r.id: r.m != 0 or n == 11 for r in rows.select("id", F.pmod(F.xxhash64("id", F.lit(17), F.lit(n)), F.lit(4)).alias("m")).collect()}
        after = {}
        for i, label in now.items():
            votes = {}
            for j, w in heard.get(i, []):
                votes[now[j]] = votes.get(now[j], 0.0) + w
            best = min(votes, key=lambda x: (-round(votes[x], 6), x)) if votes and moves[i] else label
            after[i] = best
        changed, now = after != now, after
        if not changed and n:
            break
    assert {r.id: r.label for r in clustering.chinese_whispers(rows.select("id"), edges).collect()} == now


def test_one_to_one_is_the_greedy_walk(spark):
    r = np.random.default_rng(1)
    rated = sorted({(int(a), int(b)): round(float(s), 3) for a, b, s in zip(r.integers(30, size=60), r.integers(30, size=60), r.random(60), strict=True)}.items())
    left, right, want = set(), set(), []
    for (a, b), s in sorted(rated, key=lambda x: (-x[1], x[0])):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            want.append((a, b, s))
    found = library.one_to_one(spark.createDataFrame([(a, b, s) for (a, b), s in rated], "l long, r long, s double"), "l", "r", "s")
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_identify_partitions_the_rows(spark):
    found = plans.queries()["g10_identify"](spark, SF).collect()
    ids = [r.id for r in found]
    assert len(ids) == len(set(ids)) and all(i % 2 for i in ids) and {r.how for r in found} <= {"attached", "clustered"}
    assert neighbours.unit is not None


def test_closest_names_are_those_of_difflib(spark):
    from difflib import SequenceMatcher

    from contactsheet.operators import searches

    names = ["supplier", "supply", "suppliers", "applier", "anna", "hanna", "joe"]
    words = ["suplier", "anna", "hana", "joe", "zzzz"]
    found = searches.closest_names(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, entity int"))
    want = {}
    for w in words:
        rated = [(SequenceMatcher(None, n, w).ratio(), n) for n in names if abs(len(n) - len(w)) <= 3]
        good = [x for x in rated if x[0] > 0.84]
        if len(w) >= 4 and good:
            want[w] = min(good, key=lambda x: (-x[0], x[1]))[1]
    assert {r.word: names[r.entity] for r in found.collect()} == want


def test_equal_searches_are_matched_once(spark, monkeypatch):
    from contactsheet.adapter import Library
    from contactsheet.operators.predicates import visible
    from contactsheet.operators import searches
    from contactsheet.plans import searches as plan

    lib, sizes, real = Library(spark, "/root/testdata/sf0.001"), {}, searches.materialise

    def counted(df, name):
        out = real(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(searches, "materialise", counted)
    texts = spark.range(40).selectExpr("id AS search_id", "CASE WHEN id % 2 = 0 THEN 'photos in NATION_3' ELSE 'photos not in NATION_3' END AS text")
    named = searches.mentions(texts, plan._vocabulary(lib))
    found = {}
    for r in searches.found(searches.clauses(texts, named, plan.NOW), named, visible(lib.photos), lib.faces, lib.photo_tags, lib.places).collect():
        found.setdefault(r.search_id, set()).add(r.id)
    every = {r.id: r.place_id for r in visible(lib.photos).select("id", "place_id").collect()}
    here = {i for i, p in every.items() if p == 3}
    assert here and all(found[k] == (here if k % 2 == 0 else set(every) - here) for k in range(40))
    assert sizes["hits"] == 2 * len(here)


def test_words_one_letter_off_are_settled_by_a_join(spark, monkeypatch):
    from contactsheet.operators import searches

    rest, real = [], searches.name_candidates
    monkeypatch.setattr(searches, "name_candidates", lambda words, names, **more: (rest.extend(r.word for r in words.collect()), real(words, names, **more))[1])
    names = spark.createDataFrame([("supplier#12", 2), ("supplier#12", 1), ("supplier#21", 3)], "name string, entity int")
    words = spark.createDataFrame([("suplier#12",), ("supplier#21",), ("supplixr#21",)], "word string")
    assert {r.word: r.entity for r in searches.closest_names(words, names).collect()} == {"suplier#12": 1, "supplier#21": 3, "supplixr#21": 3}
    assert rest == ["supplixr#21"]
