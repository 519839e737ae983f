"""Periodic runs, lexical search and exact duplicates against brute-force versions, and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactsheet.llm import exact_dedup, lexical, queries, runs
from contactsheet.llm._common import parts_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash string, norm string, row string, n string"


def rows(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z", "w") for i, t in zip(ids, texts, strict=True)], DOCS)


ODD = [None, "", " ", "\t\n\x0b\x0c\r", "a", "a b", "Zürich, 東京 😀 \x00 end", "x" * 50_000, "word " * 20_000, "one two " * 9, "one two " * 9, "\x1c \x85   　"]


# ---- periodic runs


def plain_runs(words):
    """Every (start, length, period) by trying all periods at all places."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and not any(all(words[i + x] == words[i + x + d] for x in range(length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(r, n):
    """Words of a small alphabet with repeated stretches in them."""
    words = [bytes([97 + x]) for x in r.integers(0, r.integers(1, 5), n)]
    for _ in range(int(r.integers(0, 5))):
        a, q = int(r.integers(0, max(1, n))), int(r.integers(1, 9))
        words[a:a] = words[a : a + q] * int(r.integers(2, 8))
    return words


def test_runs_match_brute_force():
    r = np.random.default_rng(5)
    texts = [random_words(r, int(r.integers(0, 70))) for _ in range(1500)]
    texts += [[b"a"] * n for n in range(12)] + [[b"a", b"b"] * n for n in range(9)] + [[]]
    found = runs.runs_of(texts)
    assert found == [plain_runs(words) for words in texts]
    assert sum(map(len, found)) > 1000
    assert found == [runs.runs_of([words])[0] for words in texts]  # neighbours in a batch have no say


def test_long_periods_are_found():
    period = [str(i).encode() for i in range(5000)]
    words = [b"x", b"y", *period * 4, *period[:123], b"z"]
    assert runs.runs_of([words]) == [[(2, 20_123, 5000)]]
    assert runs.runs_of([[b"w", *[b"a", b"b", b"a", b"a", b"b"] * 3000]]) == [[(1, 15_000, 5)]]
    assert runs.runs_of([period * 3]) == [[]]


def plain_row(doc_id, text):
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else None
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (doc_id, len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_op11_against_a_plain_version(spark, tmp_path):
    r = np.random.default_rng(6)
    texts = [None, "", " \t", "é é é é é é é", *(" \n".join(w.decode() for w in random_words(r, int(r.integers(0, 90)))) for _ in range(300))]
    rows(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    found = sorted(map(tuple, queries.op11_periodic_runs(spark, str(tmp_path)).collect()))
    assert found == [plain_row(i, t) for i, t in enumerate(texts)]


def test_runs_of_odd_rows(spark):
    found = {r.doc_id: r for r in runs.periodic_runs(rows(spark, ODD)).collect()}
    assert len(found) == len(ODD)
    assert [found[i].runs for i in range(5)] == [[]] * 5 and found[0].collapsed == "" and found[0].strongest is None
    assert [tuple(x) for x in found[8].runs] == [(0, 20_000, 1)] and found[8].collapsed == "word"
    assert [tuple(x) for x in found[9].runs] == [(0, 18, 2)] and found[9].collapsed == "one two"
    assert found[6].collapsed == "Zürich, 東京 😀 \x00 end"
    assert runs.periodic_runs(rows(spark, [])).count() == 0
    twice = runs.periodic_runs(rows(spark, ["a a a a a a a", "b"], [None, None])).collect()
    assert sorted(len(r.runs) for r in twice) == [0, 1]


def test_parts_are_bounded_by_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["aaaa", None, "é" * 50, "", "b", "c" * 9, "d"])], ["i", "t"])
    sizes = [part.num_rows for part in parts_of([batch], 1, size=10)]
    assert sizes == [2, 1, 3, 1] and sum(sizes) == 7
    assert [part.num_rows for part in parts_of([batch], 1, rows=3)] == [3, 3, 1]


# ---- lexical search


def plain_search(docs, items, k):
    """(item_id, rank, doc_id, score) by counting every term of every text."""
    split = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(lexical.TERM, t or "")]
    counted = [(i, Counter(split(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(split(text))
    out = []
    for item, terms in wanted.items():
        scored = []
        for i, c in counted:
            n = sum(c.values())
            m = 50 + (50 * n * n_docs) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, i))
        out += [(item, at + 1, i, -s) for at, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def search_tables(seed=3, n=400):
    r = np.random.default_rng(seed)
    words = [*"abcdefgh", "Ab", "aB", "ab", "über", "Über", "東京", "x1", "1", "11", "a😀b"]
    text = lambda: "".join(w + " .-_\n\t\x00"[r.integers(0, 7)] for w in r.choice(words, int(r.integers(0, 30))))
    return [(i, text()) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "--"), (n + 3, "ab " * 5000)], [(j, text()) for j in range(25)] + [(25, None), (26, "nobody-has-this"), (3, "extra über")]


@pytest.mark.parametrize("block_terms", [100_000, 20])
def test_search_matches_brute_force(spark, block_terms):
    docs, items = search_tables()
    table = spark.createDataFrame([(i, t, "n", "tf") for i, t in docs], "doc_id long, text string, n string, terms string").repartition(7)
    asked = spark.createDataFrame([(j, t, "x") for j, t in items], "item_id long, text string, doc_id string")
    for k in (3, 50):
        found = sorted(map(tuple, lexical.top_documents(table, asked, k, block_terms=block_terms).collect()))
        assert found == plain_search(docs, items, k)


def test_search_prunes_without_loss(spark):
    docs = [(i, "a " * (i % 13 + 1) + "b " * (i % 7)) for i in range(4000)]
    items = [(0, "a b"), (1, "b")]
    table = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    found = lexical.top_documents(table, spark.createDataFrame(items, "item_id long, text string"), 5)
    assert sorted(map(tuple, found.collect())) == plain_search(docs, items, 5)


def test_search_of_odd_rows(spark):
    docs = rows(spark, [*ODD, "a b"], [*range(len(ODD)), None])
    items = spark.createDataFrame([(1, "A, b!"), (2, None), (None, "word")], "item_id long, text string")
    found = lexical.top_documents(docs, items).collect()
    of = lambda item: [r.doc_id for r in sorted((r for r in found if r.item_id == item), key=lambda r: r["rank"])]
    assert of(1) == [5, None, 4] and of(2) == [] and of(None) == [8]
    none = docs.limit(0)
    assert lexical.top_documents(none, items).count() == 0 and lexical.top_documents(docs, items.limit(0)).count() == 0


def test_guarded_terms_are_the_pattern_s():
    text = "Foo_bar-Baz9 Été\x7fÀ\x80 @[`{ 東 京"
    plain = lexical.guarded(text.encode()).decode()
    assert plain.split(" ") == [t for t in plain.split(" ")] and [t for t in plain.split(" ") if t] == [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(lexical.TERM, text)]
    assert [n for _, n in lexical.automaton([(1, "a"), (2, "aa"), (3, "b")]).iter(" a a aa b ab ")] == [1, 1, 2, 3]


# ---- exact duplicates


def plain_groups(docs):
    """{doc_id: (keep_id, group_size, kept, sha)} for distinct ids."""
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in docs}
    groups = {}
    for i, t in docs:
        groups.setdefault(norm[i], []).append((-len(t or ""), i))
    out = []
    for text, members in groups.items():
        keep = min(members)[1]
        out += [(i, keep, len(members), i == keep, hashlib.sha256(text.encode()).hexdigest()) for _, i in members]
    return sorted(out)


def copies(seed=2, n=500):
    r = np.random.default_rng(seed)
    texts = ["".join(r.choice([*"abé ", "\t", "\n", "\x0b", "\x1f", " "], int(r.integers(0, 7)))) for _ in range(n)]
    return list(enumerate([*ODD, *texts, *["one hot text\n" * (1 + i % 3) if i % 5 else "one hot text" for i in range(200)]]))


@pytest.mark.parametrize("bits", [128, 3, 0])
def test_duplicates_match_brute_force(spark, bits):
    docs = copies()
    if bits < 128:
        docs = docs[:36]  # a hash of so few bits takes a round for each text under it
    short = lambda text: exact_dedup.content_hash(text) if bits == 128 else F.substring(F.conv(F.substring(F.md5(text.cast("binary")), 1, 1), 16, 2), 1, bits).cast("binary")
    table = rows(spark, [t for _, t in docs], [i for i, _ in docs]).repartition(5)
    if bits == 0:
        table = table.where("doc_id in (1, 2, 4, 5, 9, 10, 12)")
        docs = [d for d in docs if d[0] in (1, 2, 4, 5, 9, 10, 12)]
    found = sorted(map(tuple, exact_dedup.duplicates(table, hash_of=short).collect()))
    assert found == plain_groups(docs)


def test_duplicates_of_repeated_and_null_ids(spark):
    docs = rows(spark, ["a b", "a b", "ab", "c", None, " ", "d", "d"], [1, 1, None, None, 5, 5, None, None])
    found = exact_dedup.duplicates(docs).collect()
    assert len(found) == 8
    by_text = {}
    for r in found:
        by_text.setdefault(r.text_sha256, []).append(r)
    for group in by_text.values():
        assert sum(r.kept for r in group) == 1 and all(r.group_size == len(group) for r in group)
    of = lambda t: by_text[hashlib.sha256(t.encode()).hexdigest()]
    assert {r.keep_id for r in of("ab")} == {1} and {r.keep_id for r in of("")} == {5} and {r.keep_id for r in of("d")} == {None}
    left = exact_dedup.drop_duplicates(docs)
    assert left.columns == docs.columns and sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, "c"), (0, "d"), (1, "a b"), (5, " ")]


def test_duplicates_empty(spark):
    assert exact_dedup.duplicates(rows(spark, [])).count() == 0
    assert exact_dedup.drop_duplicates(rows(spark, [])).count() == 0
