"""Toxicity and the pipeline against plain versions over the same rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from contactsheet.llm import langid, packing, pii, queries, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __terms string, __counts string, __lang string, bucket string, length string, k string"
VILE = ["idiot", "vile", "scum", "moron", "idiots"]


def fixture(seed=3, n=160):
    """Texts of two topics, some with vile words, with copies, empty ones, nulls and repeated ids."""
    r = np.random.default_rng(seed)
    name = lambda word, i: f"{word}{chr(97 + i // 10)}{chr(97 + i % 10)}"
    sea, town = [f"{name('wave', i)} {name('shore', i)}" for i in range(90)], [f"{name('street', i)} {name('tower', i)}" for i in range(90)]
    texts = []
    for i in range(n):
        words = list(r.choice(sea if i % 2 else town, int(r.integers(6, 30))))
        if i % 5 == 0:
            for _ in range(int(r.integers(1, 6))):
                words.insert(int(r.integers(0, len(words) + 1)), str(r.choice(VILE)))
        texts.append("the and of " + " ".join(words))
    texts[7], texts[9], texts[12] = None, "", "the of and"
    texts[31] = texts[33] = texts[37] = texts[37] + " " + texts[36]
    texts[36] = texts[37] + " end"
    texts[40] = texts[45]
    texts[52] = "Write to jane.doe@example.com or jane at example dot org, " + (texts[52] or "")
    ids = list(range(n))
    ids[150] = ids[151]
    known = {i: int(i % 5 == 0) for i in ids if i % 3 != 2}
    return ids, texts, known


def tables(spark, ids, texts, known):
    rows = [(i, t, "en" if (i // 2) % 2 else "xx", "s", len(t or ""), "a", "b", "c", "d", "e", "f") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, y, y) for i, y in known.items()], "doc_id long, quality int, toxic int")


def plain_features(text, terms, words):
    """({feature: count}, whether it has a toxic term) of a text."""
    tokens = re.findall(r"[^\W\d_]+", (text or "").lower())
    held = lambda w: [t for t in terms if (t == w or (t[0] == "^" and w.startswith(t[1:])))]
    out, hits = Counter(), 0
    for w in tokens:
        own = held(w)
        hits += bool(own)
        out.update(own)
    if not hits:
        return Counter(w for w in tokens if w in words), False
    out["density", min(19, int(2 * math.log2(len(tokens) / hits)))] = 1
    return out, True


def plain_isotonic(x, y):
    """The rising step function nearest to (x, y), at the distinct x: the greatest over starts of the least over ends of means."""
    knots = sorted(set(x))
    sums = [(sum(b for a, b in zip(x, y, strict=True) if a == k), sum(a == k for a in x)) for k in knots]
    mean = lambda i, j: sum(s for s, _ in sums[i : j + 1]) / sum(n for _, n in sums[i : j + 1])
    return knots, [max(min(mean(i, j) for j in range(at, len(knots))) for i in range(at + 1)) for at in range(len(knots))]


def plain_scores(ids, texts, known, model):
    """Each row's score, by comparing every text with every example."""
    terms, words = model.vocabulary.terms, set(model.vocabulary.words)
    rows = [plain_features(t, terms, words) for t in texts]
    df = Counter(f for counts, _ in rows for f in counts)
    idf = lambda f: math.log((1 + len(rows)) / (1 + df[f])) + 1

    def unit(counts):
        w = {f: (1 + math.log(n)) * idf(f) for f, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        return {f: v / norm for f, v in w.items()} if norm else {}

    of = {i: t for i, t in zip(ids, texts, strict=True) if t is not None}
    examples = [(of[i], known[i]) for i in model.ids]
    toxic = [unit(c) if has else {} for c, has in (plain_features(t, terms, words) for t, _ in examples)]
    other = [unit(Counter(w for w in re.findall(r"[^\W\d_]+", t.lower()) if w in words)) for t, _ in examples]
    y = [label for _, label in examples]

    def vote(v, among, without=None):
        near = sorted((-min(1.0, sum(x * e[f] for f, x in v.items() if f in e)), i) for i, e in enumerate(among) if i != without and any(f in e for f in v))[: toxicity.NEIGHBOURS]
        say = [-c / (1.05 + c) for c, _ in near]
        return sum(s * y[i] for s, (_, i) in zip(say, near, strict=True)) / sum(say) if near else None

    has = [bool(e) for e in toxic]
    left_out = [vote(toxic[i], toxic, i) if has[i] else vote(other[i], other, i) for i in range(len(y))]
    knots = {}
    for kind in (True, False):
        on = [i for i in range(len(y)) if has[i] == kind and left_out[i] is not None]
        knots[kind] = plain_isotonic([left_out[i] for i in on], [y[i] for i in on])
    none = [y[i] for i in range(len(y)) if not has[i]]
    base = sum(none) / len(none)
    out = []
    for counts, kind in rows:
        raw = vote(unit(counts), toxic if kind else other)
        out.append(base if raw is None else float(np.clip(np.interp(raw, *knots[kind]), 0, 1)))
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_toxicity_against_every_pair(spark, seed):
    ids, texts, known = fixture(seed)
    docs, labels = tables(spark, ids, texts, known)
    model, vectors = toxicity.learn(docs, labels, keep=docs.columns)
    assert vectors.columns[:-2] == docs.columns and set(docs.columns).isdisjoint(vectors.columns[-2:])  # clashing names are kept
    assert model.vocabulary.terms and set(model.ids) == {i for i in known if zlib.crc32(str(i).encode()) % 3 != 1 and texts[ids.index(i)] is not None}
    want = sorted(zip(ids, [round(s, 9) for s in plain_scores(ids, texts, known, model)], strict=True))
    found = sorted((r.doc_id, round(r.score, 9)) for r in toxicity.score(model, vectors).collect())
    assert [i for i, _ in found] == [i for i, _ in want]
    assert np.allclose([s for _, s in found], [s for _, s in want], atol=1e-7)
    for r in toxicity.score(model, vectors).collect():
        assert (r.predicted == 1) == (r.score >= 0.7)
    evidence = {r.doc_id: r.evidence for r in toxicity.score(model, vectors).collect()}
    assert evidence[9] == [] and evidence[7] == [] and len(evidence[1]) == 3


def plain_near_duplicates(rows):
    """Rows (id, text) with one of each group that five-word shingles link; a repeated (id, text) once."""
    sets = []
    for _, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    kept = [min((x for x in range(len(rows)) if root[x] == r), key=lambda x: rows[x][0]) for r in set(root)]
    return sorted(rows[x] for x in kept)


def test_pipeline_against_plain_stages(spark, tmp_path):
    import corpus_pipeline

    ids, texts, known = fixture(5)
    ids[150] = 150
    docs, labels = tables(spark, ids, texts, known)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    # Language: learned and judged by the profiles, whose distances have a plain version of their own; the bound is plain here.
    train = [i for i, t in zip(ids, texts, strict=True) if zlib.crc32(str(i).encode()) % 4 != 2 and t is not None]
    profiles = langid.learn(docs, corpus_pipeline.crc_mod("doc_id", 4) != 2)
    judged = {i: profiles.predict(t) for i, t in zip(ids, texts, strict=True)}
    own = {lang: sorted(judged[i][1] for i in train if judged[i][0] == lang == ("en" if (i // 2) % 2 else "xx")) for lang in ("en", "xx")}
    known_texts = [(i, t) for i, t in zip(ids, texts, strict=True) if judged[i][0] != "und" and (not own[judged[i][0]] or judged[i][1] >= 0.8 * own[judged[i][0]][0] - 1e-12)]
    # Toxicity, learned from what the first stage kept.
    rest, _ = tables(spark, [i for i, _ in known_texts], [t for _, t in known_texts], known)
    model, _ = toxicity.learn(rest, labels)
    scores = plain_scores([i for i, _ in known_texts], [t for _, t in known_texts], known, model)
    clean = [row for row, s in zip(known_texts, scores, strict=True) if s < 0.7]
    assert 0 < len(clean) < len(known_texts) < len(ids)
    unique = plain_near_duplicates(clean)
    assert len(unique) < len(clean)
    left = {i: pii.redact_text(t) for i, t in unique}
    assert any("[EMAIL]" in t for t in left.values())
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(left)
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in left.items():
        tokens = np.append(packing.text_ids(text, queries.TOKENIZER, queries.RANKS, queries.PATTERN), 1).astype("<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(tokens[at : at + r.length].tobytes()) and r.doc_tokens == len(tokens)
            at += r.length
        assert at == len(tokens)
    for own_pieces in by_sequence.values():
        at = 0
        for r in sorted(own_pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
