"""The operators of the subpackage against brute-force versions, and on odd rows."""

import hashlib
import json
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from contactsheet.llm import attention_mil, langid, ngram_join, norm_topk, packing, pii, queries, shingles, tokens, toxicity, training_order, vamana
from contactsheet.llm._common import usable_vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, held_out string"
RANKS, JSON, PATTERN = queries.RANKS, queries.TOKENIZER, queries.PATTERN


def rows(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y") for i, t in zip(ids, texts, strict=True)], DOCS)


ODD = [None, "", " ", "\n\n", "a", "Zürich, 東京 😀 \x00 end", "word " * 30_000, "x" * 50_000, "don't   stop\t\n 12345 !!", "the <|endoftext|> mark", "the <|endoftext|> mark"]


# ---- op5, op1, op7


def test_encode_decode_round_trip(spark):
    encoded = tokens.encode(rows(spark, ODD), RANKS, PATTERN)
    coder = tokens.encoder(RANKS, PATTERN)
    for r in tokens.decode(encoded, RANKS, PATTERN).collect():
        text = ODD[r.doc_id] or ""
        assert r.ids == coder.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()


def test_safe_pieces_keep_ids():
    coder = tokens.encoder(RANKS, PATTERN)
    text = "  one two\n\nthree's   four  \n five, six!  \t seven " * 20
    for limit in (1, 2, 3, 7, 50):
        pieces = list(tokens.safe_pieces(text, limit))
        assert "".join(pieces) == text
        assert [i for p in pieces for i in coder.encode_ordinary(p)] == coder.encode_ordinary(text)


def test_packing_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    for text in ODD:
        assert packing.text_ids(text, JSON, RANKS, PATTERN).tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


RUNS = [a + c * n + b for c, n in ((" ", 2_000_000), ("\t", 2_000_000), ("\n", 2_000_000), (" \n\u3000", 700_000)) for a, b in (("", ""), ("word", "word"), ("two words", " 7"))]


def test_long_white_space_has_the_ids_of_the_tokenizers():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    coder = tokens.encoder(RANKS, PATTERN)
    for text in RUNS:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert tokens.encode_text(text, coder).tolist() == want == packing.text_ids(text, JSON, RANKS, PATTERN).tolist()
        assert coder.decode_bytes(want).decode() == text


def test_ids_are_the_tokenizers_on_random_text():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    coder = tokens.encoder(RANKS, PATTERN)
    r = np.random.default_rng(11)
    pools = ["ab'stdmrevl  \n\t ", "aé日😀\x1c\x85\xa0\u2003\u3000 1٣.!", " \t\n\r\x0b\x0c\u2028x", "".join(map(chr, range(33, 0x3000)))]
    for n in range(1500):
        pool = pools[n % 4]
        text = "".join(pool[i] for i in r.integers(len(pool), size=r.integers(1, 60)))
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert packing.text_ids(text, JSON, RANKS, PATTERN).tolist() == want
        # The same text among long runs, where encoding splits it.
        long = text + " " * 6000 + text + "\n" * 21_000 + text
        assert tokens.encode_text(long, coder).tolist() == coder.encode_ordinary(long)


def test_long_blanks_in_spark(spark):
    docs = rows(spark, [RUNS[1], "short", RUNS[7]])
    found = {r.doc_id: r.n for r in tokens.encode(docs, RANKS, PATTERN).select("doc_id", F.size("ids").alias("n")).collect()}
    pieces = packing.pack(docs, JSON, RANKS, PATTERN).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n - 1 for r in pieces} == found


def check_packing(pieces, docs, capacity):
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in docs.items():
        ids = np.append(packing.text_ids(text, JSON, RANKS, PATTERN), 1).astype("<u4")
        own = sorted(by_doc[i], key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert sum(r.length for r in own) == len(ids) == own[0].doc_tokens
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    for sequence in by_sequence.values():
        sequence.sort(key=lambda r: r.offset)
        assert [r.offset for r in sequence] == np.cumsum([0, *(r.length for r in sequence)])[:-1].tolist()
        size = sum(r.length for r in sequence)
        assert size <= capacity and size & (size - 1) == 0  # a power of two: nothing is padded
    assert sorted(by_sequence) == list(range(len(by_sequence)))


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing_is_whole_and_gapless(spark, capacity):
    texts = [*ODD, *("some words of a text " * n for n in range(60))]
    found = packing.pack(rows(spark, texts), JSON, RANKS, PATTERN, capacity=capacity).collect()
    check_packing(found, dict(enumerate(texts)), capacity)


def test_packing_empty_and_null_ids(spark):
    assert packing.pack(rows(spark, []), JSON, RANKS, PATTERN).count() == 0
    found = packing.pack(rows(spark, ["a b", "a b"], [None, None]), JSON, RANKS, PATTERN).collect()
    assert sum(r.length for r in found) == 6


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        assert sorted(training_order.feistel(np.arange(n), n, 42).tolist()) == list(range(n))
    assert training_order.feistel(np.arange(1000), 1000, 1).tolist() != training_order.feistel(np.arange(1000), 1000, 2).tolist()


def test_training_order_shards_read_back(spark, tmp_path):
    texts = [*ODD, *("words in order " * (n * 7) for n in range(40))]
    rows(spark, texts).write.parquet(str(tmp_path / "docs"))
    folder, index = training_order.write_in_training_order(spark.read.parquet(str(tmp_path / "docs")), RANKS, PATTERN, folder=f"file://{tmp_path}/out", seq_len=32, shard_mb=1)
    index = index.collect()
    assert sorted(r.slot for r in index) == list(range(len(index)))
    coder = tokens.encoder(RANKS, PATTERN)
    got = {}
    for r in index:
        record = training_order.read_shard(folder, r.shard, 32, r.position, 1)[0]
        assert zlib.crc32(record[: r.n_tokens].tobytes()) == r.ids_crc32 and not record[r.n_tokens :].any()
        got.setdefault(r.doc_id, {})[r.part] = record[: r.n_tokens].tolist()
    for i, text in enumerate(texts):
        assert [t for p in sorted(got[i]) for t in got[i][p]] == [*coder.encode_ordinary(text or ""), 50256]
    slots = [r.slot for r in sorted(index, key=lambda r: (r.doc_id, r.part))]
    assert slots != sorted(slots)
    whole = training_order.read_slots(folder, 32, 0, len(index) + 5)
    assert len(whole) == len(index) and (training_order.read_slots(folder, 32, 7, 40) == whole[7:47]).all()
    assert all(zlib.crc32(whole[r.slot][: r.n_tokens].tobytes()) == r.ids_crc32 for r in index)


def test_training_order_refuses_wide_ids(spark, tmp_path):
    rows(spark, ["a b"]).write.parquet(str(tmp_path / "docs"))
    with pytest.raises(Exception, match="more than two bytes"):
        training_order.write_in_training_order(spark.read.parquet(str(tmp_path / "docs")), RANKS, PATTERN, end_id=70_000)


def test_training_order_of_repeated_ids_and_clashing_columns(spark, tmp_path):
    docs = rows(spark, ["a b", "a b", "c"], [5, 5, None]).withColumn("shard", F.lit("x")).withColumn("place", F.lit(1)).withColumn("tokens", F.lit(2))
    docs.write.parquet(str(tmp_path / "docs"))
    found = training_order.write_in_training_order(spark.read.parquet(str(tmp_path / "docs")), RANKS, PATTERN)[1].collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in found) == [(False, 3), (False, 3), (True, 2)] and sorted(r.slot for r in found) == [0, 1, 2]


def test_training_order_empty(spark, tmp_path):
    rows(spark, []).write.parquet(str(tmp_path / "docs"))
    assert training_order.write_in_training_order(spark.read.parquet(str(tmp_path / "docs")), RANKS, PATTERN)[1].count() == 0


def test_round_trip_is_decode_of_encode(spark):
    docs = rows(spark, ODD)
    both = tokens.decode(tokens.encode(docs, RANKS, PATTERN), RANKS, PATTERN)
    assert sorted(map(repr, tokens.round_trip(docs, RANKS, PATTERN).collect())) == sorted(map(repr, both.collect()))


# ---- op2, op8


def vectors(spark, n=600, dim=8, seed=3, scale=1.0):
    r = np.random.default_rng(seed)
    data = (r.standard_normal((n, dim)) * r.uniform(0.2, 2, n)[:, None] * scale).tolist()
    data[5] = data[6]
    odd = [(n, None), (n + 1, [1.0, None] + [0.0] * (dim - 2)), (n + 2, [math.nan] * dim), (n + 3, [math.inf] * dim), (n + 4, [0.0] * dim), (n + 5, [1.0, 2.0]), (None, [1.0] * dim), (7, data[7])]
    return spark.createDataFrame([*enumerate(data), *odd], "vec_id long, embedding array<double>")


def brute(pairs, k):
    out = {}
    for q, i, s in pairs:
        out.setdefault(q, []).append((-s, i))
    return {q: [(i, -s) for s, i in sorted(v)[:k]] for q, v in out.items()}


@pytest.mark.parametrize("scale", [1.0, 40.0])
def test_norm_topk_is_exact(spark, scale):
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x).cast("double"))
    held = usable_vectors(vectors(spark, scale=scale)).select("vec_id", whole.alias("v")).cache()
    asked = held.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    found = {}
    for r in norm_topk.top_k(asked, held, 5, classes=4, block=64, query_block=8).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    data = {r.vec_id: [int(x) for x in r.v] for r in held.collect()}
    assert 604 in data and not {600, 601, 602, 603} & set(data)
    pairs = [(q, i, sum(a * b for a, b in zip(data[q], data[i], strict=True))) for q in data if q % 20 == 0 for i in data if i != q and len(data[i]) == len(data[q])]
    assert found == brute(pairs, 5)


def test_norm_topk_empty(spark):
    none = spark.createDataFrame([], "vec_id long, v array<double>")
    assert norm_topk.top_k(none.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), none, 5).count() == 0


def test_vamana_recall_and_scores(spark):
    held = usable_vectors(vectors(spark), drop_zero=True).select("vec_id", F.col("embedding").alias("v")).cache()
    asked = held.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    found = {}
    for r in vamana.nearest(held, asked, 20, shard_size=200).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    data = {r.vec_id: r.v for r in held.collect()}
    assert 604 not in data
    pairs = [(q, i, float(np.dot(data[q], data[i]))) for q in data if q % 20 == 0 for i in data if i != q and len(data[i]) == len(data[q])]
    best = brute(pairs, 20)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in best[q]}) for q in best)
    assert set(found) == set(best) and hits >= 0.95 * sum(map(len, best.values()))
    assert all(abs(s - np.dot(data[q], data[i])) < 1e-9 and i != q for q, v in found.items() for i, s in v)
    assert all(v == sorted(v, key=lambda x: (-x[1], x[0])) for v in found.values())


def test_searches_take_every_row_of_a_repeated_id(spark):
    data = [(0, [2.0, 1.0]), (1, [3.0, 0.0]), (1, [3.0, 0.0]), (1, [0.0, 7.0]), (2, [2.0, 1.0]), (3, [2.0, 1.0])]
    held = spark.createDataFrame(data, "vec_id long, v array<double>")
    asked = held.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    want = sorted(((-sum(x * y for x, y in zip(v, (2.0, 1.0), strict=True)), i) for i, v in data if i), key=lambda x: x)
    for found in (norm_topk.top_k(asked, held, 5), vamana.nearest(held, asked, 5)):
        assert [(-x.score, x.vec_id) for x in found.orderBy("rank").collect()] == want  # ties to the smaller id


def test_vamana_recall_on_a_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    made = {}
    for x in queries.op2_vamana(spark, "/root/testdata/sf0.01").collect():
        made.setdefault(x.query_id, set()).add(x.vec_id)
    rows_ = usable_vectors(table, drop_zero=True).collect()
    ids, m = np.array([x.vec_id for x in rows_]), np.array([x.embedding for x in rows_])
    met = total = 0
    for q in ids[ids % 20 == 0]:
        s = m @ m[ids == q][0]
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        met, total = met + len(made[q] & set(best.tolist())), total + len(best)
    assert met / total >= 0.95


def test_vamana_returns_all_of_a_few(spark):
    held = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "vec_id long, v array<double>")
    asked = held.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    found = vamana.nearest(held, asked, 20).collect()
    assert len(found) == 90 and {(r.query_id, r.vec_id) for r in found} == {(a, b) for a in range(10) for b in range(10) if a != b}
    assert vamana.nearest(held.limit(0), asked.limit(0), 20).count() == 0


# ---- op4

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


def test_plain_spans_match_the_patterns():
    r = np.random.default_rng(1)
    alphabet = list("aZ09.@+-% ()_") + ["1", "2", ".", "@"]
    for _ in range(3000):
        text = "".join(r.choice(alphabet, r.integers(0, 40)))
        assert pii.find_plain(text) == base_spans(text), text
    for text in ("a@b.c@d.e", "x@@y.z", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.255", "4111 1111 1111 1111", "+1 (415) 555-0199.", "é4111111111111111é", "a" * 20_000, "1." * 20_000):
        assert pii.find_plain(text) == base_spans(text)


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("mail john.doe (at) example (dot) com now", "email", "john.doe (at) example (dot) com"),
        ("jane at corp dot example dot org please", "email", "jane at corp dot example dot org"),
        ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("😀 раul@exаmple.com x", "email", "раul@exаmple.com"),
        ("j​oe@ex​ample.org", "email", "j​oe@ex​ample.org"),
        ("call plus one four one five five five five zero one nine nine", "phone", "plus one four one five five five five zero one nine nine"),
        ("host one nine two dot one six eight dot one dot two five.", "ip", "one nine two dot one six eight dot one dot two five"),
        ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
    ],
)
def test_disguised_spans_map_back(text, kind, part):
    assert [(k, text[s:e], p) for k, s, e, p in pii.find(text)] == [(kind, part, False)]
    assert pii.redact_text(text) == text.replace(part, f"[{kind.upper()}]")


@pytest.mark.parametrize(
    ("part", "kind"),
    [
        ("jane.doe at example.com", "email"),
        ("jane.doe at mail.example.co.uk", "email"),
        ("10 dot 0 dot 0 dot 1", "ip"),
        *[(f"jane at corp dot example dot {x}", "email") for x in ("dev", "jp", "ru", "pl", "ai")],
        ("jane at example (dot) dev", "email"),
    ],
)
def test_bare_disguises_are_found_alone(part, kind):
    for text in (part, f"write {part} soon", f"write {part}, dot it"):
        start = text.index(part)
        assert pii.find(text) == [(kind, start, start + len(part), False)], text


def test_hint_never_rejects_what_rules_rewrite():
    r = np.random.default_rng(11)
    parts = ["at", "AT", "@", "dot", "Dot", "point", "(at)", "[ at ]", "( dot )", "<.>", "example.com", "x", "one", "fıve", "SİX", "oh", "plus", "7", "dev", "the", "ſix"]
    gaps = [" ", "", "  ", ".", "-", "\n"]
    for _ in range(20_000):
        text = "".join(str(r.choice(parts)) + str(r.choice(gaps, p=[0.6, 0.1, 0.1, 0.1, 0.05, 0.05])) for _ in range(r.integers(2, 9)))
        text = (pii.Rewritten(text, edits).text if (edits := pii._glyph_edits(text)) else text)
        assert not pii._word_edits(text) or pii._HINT.search(text.lower()), text


@pytest.mark.parametrize(
    ("part", "kind", "fragment"),
    [
        ("jоhn@mail.com", "email", "hn@mail.com"),
        ("john@mail.cоm", "email", "john@mail.c"),
        ("john@mail (dot) example.com", "email", None),
        ("192.168.1.1０", "ip", "192.168.1.1"),
        ("+44 20 7946 0９58", "phone", "+44 20 7946 0"),
        ("+44 20 7946 09 five eight", "phone", "+44 20 7946 09"),
    ],
)
def test_partly_disguised_spans_are_whole(part, kind, fragment):
    text = f"x {part}, y a@b.co"
    found = {(k, text[s:e], p) for k, s, e, p in pii.find(text)}
    assert found == {(kind, part, False), ("email", "a@b.co", True)} | ({(kind, fragment, True)} if fragment else set())
    assert pii.redact_text(text) == f"x [{kind.upper()}], y [EMAIL]"


def test_prose_is_left_alone():
    for text in ("look at the dot product of one two", "we met at noon at home", "ten to one, two to four", "Straße à São Paulo"):
        assert pii.find(text) == []


def test_pii_rows_and_redaction(spark):
    docs = rows(spark, [None, "", "write a@b.co", "write a@b.co", "x" * 300_000])
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find_spans(docs).collect()}
    assert found == {0: [], 1: [], 2: [("email", 6, 12, True)], 3: [("email", 6, 12, True)], 4: []}
    out = pii.redact(docs)
    assert out.columns == docs.columns and [r.text for r in out.orderBy("doc_id").limit(3).collect()] == [None, "", "write [EMAIL]"]


def test_op4_digests(spark, tmp_path):
    texts = ["a@b.co 10.0.0.1", None, "x (at) y (dot) com a@b.co"]
    rows(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in queries.op4_pii_offsets(spark, str(tmp_path)).collect()}
    assert (found[0].n_email, found[0].n_ip, found[0].spans) == (1, 1, "email:0:6,ip:7:15")
    assert found[0].base_sha256 == hashlib.sha256(b"email:0:6,ip:7:15").hexdigest()
    assert (found[1].n_email, found[1].spans, found[1].base_sha256) == (0, "", hashlib.sha256(b"").hexdigest())
    assert found[2].n_email == 1 and found[2].base_sha256 == hashlib.sha256(b"email:19:25").hexdigest() and found[2].spans == "email:0:18,email:19:25"


def gram_key(gram):
    key = 0
    for c in gram:
        key = (key << 21) | ord(c)
    return key


def test_language_against_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").limit(120)
    rows_ = docs.collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    profiles = langid.learn(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2, size=60)
    plain = {}
    for lang, text in [(r.lang, r.text) for r in rows_ if r.lang and not held(r.doc_id)]:
        counts = plain.setdefault(lang, {})
        for gram, n in gram_counts(text).items():
            counts[gram] = counts.get(gram, 0) + n
    ranked = {lang: sorted(c, key=lambda g: (-c[g], g))[:60] for lang, c in plain.items()}
    for r in langid.identify(docs, profiles).collect():
        own = gram_counts(r.text)
        own = sorted(own, key=lambda g: (-own[g], g))[:60]
        if not own:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        far = {lang: sum(min(abs(p.index(g) - i), 60) if g in p else 60 for i, g in enumerate(own)) for lang, p in ranked.items()}
        best = min(sorted(far), key=far.get)
        assert r.lang_pred == best and r.score == pytest.approx(1 - far[best] / (60 * len(own)))


def gram_counts(text):
    """Letter n-grams of 1 to 3 with a blank around each word, by their keys, counted one by one."""
    chars = [c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text]
    words, out = "".join(chars).split(), {}
    line = " " + "".join(w + " " for w in words)
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            gram = line[i : i + n]
            if words and not (n == 1 and gram == " ") and not (n == 3 and gram[1] == " "):
                out[gram_key(gram)] = out.get(gram_key(gram), 0) + 1
    return out


def test_a_language_of_equal_rows_is_learned(spark):
    docs = spark.createDataFrame([(5, "the same text", "en")] * 50 + [(i, f"der text {i}", "de") for i in range(50)], "doc_id long, text string, lang string")
    for fit in (1, 3):
        assert langid.learn(docs, F.lit(True), fit_documents=fit).langs == ["de", "en"]


def test_languages_and_their_low_scores_are_of_all_rows(spark):
    texts = [f"{'the cat' if i % 2 else 'a dog'} {chr(97 + i % 26) * (1 + i % 7)} {chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(6000)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    profiles = langid.learn(docs, F.lit(True), size=30)
    counts = {}
    for text in texts:
        for gram, n in gram_counts(text).items():
            counts[gram] = counts.get(gram, 0) + n
    plain = langid.Profiles({"en": sorted(counts, key=lambda g: (-counts[g], g))[:30]}, 30)
    scores = sorted(plain.predict(t)[1] for t in texts)
    assert [profiles.predict(t) for t in texts[:500]] == [plain.predict(t) for t in texts[:500]]
    for share, rank in ((0.001, 6), (0.00001, 1), (0.25, 1500), (1.0, 6000)):
        assert langid.low_scores(docs, F.lit(True), profiles, share) == {"en": scores[rank - 1]}
    assert langid.low_scores(docs.limit(0), F.lit(True), profiles) == {}


# ---- op6


def test_ngram_counts_by_hand():
    keys, counts = langid.ngram_counts("Ab, ab!")
    plain = {}
    for k, n in zip(keys.tolist(), counts.tolist(), strict=True):
        s = ""
        while k:
            s, k = chr(k & 0x1FFFFF) + s, k >> 21
        plain[s] = n
    assert plain == {"a": 2, "b": 2, " a": 2, "ab": 2, "b ": 2, " ab": 2, "ab ": 2}
    assert len(langid.ngram_counts("12 !?")[0]) == 0


def test_profile_distance_by_hand():
    profiles = langid.Profiles({"xx": [97, 98, 99], "yy": [98, 97]}, size=4)
    own = langid.ranking(*langid.ngram_counts("b"), 4)
    place = {k: i for i, k in enumerate(own.tolist())}
    far = lambda ranked: sum(min(abs(ranked.index(k) - i), 4) if k in ranked else 4 for k, i in place.items())
    lang, score = profiles.predict("b")
    assert lang == ("yy" if far([98, 97]) < far([97, 98, 99]) else "xx") and score == pytest.approx(1 - min(far([98, 97]), far([97, 98, 99])) / (4 * len(own)))


def test_language_rows(spark):
    texts = ["the cat and the dog", "der hund und die katze", "the house on the hill", "die maus und das haus"] * 5 + [None, "", "123 !!", "the " * 50_000]
    docs = spark.createDataFrame([(i, t, None if t is None else ("en" if t[:3] == "the" else "de")) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    profiles = langid.learn(docs.where("text is null or length(text) > 6"), F.col("doc_id") % 4 != 2)
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, profiles).collect()}
    assert all(found[i][0] == ("en" if t[:3] == "the" else "de") for i, t in enumerate(texts) if t and len(t) > 6)
    assert {found[i] for i in (20, 21, 22)} == {("und", 0.0)}
    none = langid.learn(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"} and langid.identify(docs.limit(0), none).count() == 0


# ---- op3, op10


def test_scores_held_by_a_task_are_bounded_by_their_terms():
    class Fixed:
        def score(self, counts):
            return float(sum(counts)), np.zeros(0, np.int64), np.zeros(0)

    memo = toxicity._Memo(Fixed(), 1000)
    for i in range(300):
        terms = list(range(i, i + 100))
        assert memo(terms, [1] * 100)[0] == float(sum(terms)) == memo(terms, [1] * 100)[0]
        assert sum(map(len, memo.known)) <= 1300
    assert memo.known


def test_mil_gradient_matches_differences():
    r = np.random.default_rng(0)
    model = attention_mil.Model.start(1)
    x, starts, y, w = r.standard_normal((9, attention_mil.FEATURES)), np.array([0, 2, 5]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])
    loss = lambda: float(-(w * (y * np.log(model.forward(x, starts)[0]) + (1 - y) * np.log(1 - model.forward(x, starts)[0]))).sum() / w.sum())
    found = model.gradients(x, starts, y, w)
    for key in ("we", "be", "v", "u", "wa", "wo", "bo"):
        part = model.parts[key]
        at = np.unravel_index(np.abs(found[key]).argmax(), part.shape)
        kept, eps = part[at], 1e-6
        part[at] = kept + eps
        up = loss()
        part[at] = kept - eps
        assert (up - loss()) / (2 * eps) == pytest.approx(found[key][at], rel=1e-3, abs=1e-7)
        part[at] = kept


def test_mil_scores_against_a_loop_over_passages(spark):
    r = np.random.default_rng(3)
    model = attention_mil.Model.start(2)
    model.parts["mean"], model.parts["wo"] = r.standard_normal(attention_mil.FEATURES) * 0.1, r.standard_normal(model.HIDDEN)
    texts = [None, "", "one", *("Some words, of a text! 12 " * n for n in (1, 30, 200))]
    p = model.parts
    found = {x.doc_id: x for x in attention_mil.score(rows(spark, texts), model).collect()}
    for i, text in enumerate(texts):
        encoded, logits = [], []
        for passage in attention_mil.passages(text).astype(float):
            h = np.maximum((passage - p["mean"]) * p["scale"] @ p["we"] + p["be"], 0)
            gate = np.tanh(h @ p["v"]) / (1 + np.exp(-(h @ p["u"])))
            encoded.append(h)
            logits.append(float(gate @ p["wa"]))
        weights = np.exp(np.array(logits) - max(logits))
        weights /= weights.sum()
        score = 1 / (1 + np.exp(-float(sum(w * h for w, h in zip(weights, encoded, strict=True)) @ p["wo"] + p["bo"][0])))
        assert found[i].score == pytest.approx(score) and found[i].top_weight == pytest.approx(weights.max()) and found[i].passages == len(encoded)


def test_long_documents_are_fitted_by_passages_of_all_of_it(spark):
    bag = np.arange(1000)[:, None]
    few = attention_mil.pooled(bag, 64)
    assert len(few) == 64 and (np.diff(few[:, 0]) > 0).all() and attention_mil.pooled(bag[:5], 64) is not None
    edges = np.linspace(0, 1000, 65).round().astype(int)
    assert np.allclose(few[:, 0], [np.arange(a, b).mean() for a, b in zip(edges[:-1], edges[1:], strict=True)])  # every row has a part in it
    texts = ["good words here. " * 8000, "bad | junk || " * 8000] * 4
    docs = rows(spark, texts)
    known = spark.createDataFrame([(i, 1 - i % 2) for i in range(8)], "doc_id long, quality int")
    model = attention_mil.learn(docs, known)
    got = {x.doc_id: x.score for x in attention_mil.score(docs, model).collect()}
    assert min(got[0], got[2]) > 0.5 > max(got[1], got[3])


def test_toxicity_of_string_ids_and_clean_rows(spark):
    texts = ["you vile idiot", "vile idiot go", "idiot vile vile", "fine day", "a fine walk", "the day is fine"] * 8
    texts = [f"{t} q{chr(97 + i % 26)}{chr(97 + i // 26)}" for i, t in enumerate(texts)]  # equal texts would count once
    docs = spark.createDataFrame([(f"id{i}", t, "x") for i, t in enumerate(texts)], "doc_id string, text string, terms string")
    known = spark.createDataFrame([(f"id{i}", int(i % 6 < 3)) for i in range(len(texts))], "doc_id string, toxic int")
    model, all_vectors = toxicity.learn(docs, known, keep=docs.columns)
    scored = {x.doc_id: x for x in toxicity.score(model, all_vectors).collect()}
    assert all((x.predicted == 1) == (int(i[2:]) % 6 < 3) for i, x in scored.items())
    assert {type(e.doc_id) for x in scored.values() for e in x.evidence} == {str}
    stays = toxicity.clean(model, all_vectors)
    assert stays.columns == ["doc_id", "text", "terms"] and sorted(x.doc_id for x in stays.collect()) == sorted(i for i, x in scored.items() if x.predicted == 0)


@pytest.fixture(scope="module")
def sf(spark):
    return "/root/testdata/sf0.01"


def held_out_accuracy(spark, sf, found, label):
    rows = found.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("predicted", label).collect()
    return sum(r[0] == r[1] for r in rows) / len(rows)


def test_quality_on_held_out_rows(spark, sf):
    found = queries.op3_attention_mil(spark, sf)
    assert held_out_accuracy(spark, sf, found, "quality") >= 0.93
    assert found.count() == 1000 and found.where("score < 0 or score > 1 or score is null").count() == 0


def test_toxicity_on_held_out_rows(spark, sf):
    found = queries.op10_nearest_toxicity(spark, sf)
    assert held_out_accuracy(spark, sf, found, "toxic") >= 0.9
    assert found.count() == 1000 and found.where("score < 0 or score > 1 or score is null").count() == 0


@pytest.mark.parametrize("label", ["quality", "toxic"])
def test_classifiers_on_odd_rows(spark, label):
    docs = rows(spark, [None, "", "word " * 40_000, "fine words", "fine words"], [None, 1, 2, 3, 3])
    for labels in ([], [(3, 1)], [(3, 1), (2, 0), (2, 0), (None, 1), (9, None)]):
        known = spark.createDataFrame([(i, x, x) for i, x in labels], "doc_id long, quality int, toxic int")
        out = attention_mil.score(docs, attention_mil.learn(docs, known)) if label == "quality" else toxicity.score(*toxicity.learn(docs, known))
        got = out.collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 and not r.held_out == (r.doc_id is None) or r.doc_id is not None for r in got)
    empty = attention_mil.score(docs.limit(0), attention_mil.learn(docs.limit(0), known)) if label == "quality" else toxicity.score(*toxicity.learn(docs.limit(0), known))
    assert empty.count() == 0


def test_block_max_search_is_exact():
    r = np.random.default_rng(4)
    terms, made = 40, []
    for _ in range(300):
        t = np.sort(r.choice(terms, r.integers(0, 6), replace=False))
        w = r.uniform(0.1, 1, len(t))
        made.append((t, w / np.linalg.norm(w) if len(w) else w))
    index = toxicity.BlockMaxIndex(made, terms)
    dense = np.zeros((300, terms))
    for i, (t, w) in enumerate(made):
        dense[i, t] = w
    for q in range(60):
        without = q if q % 2 else -1
        docs, cosines = index.nearest(*made[q], 7, without)
        cos = dense @ dense[q]
        best = [i for i in np.lexsort((np.arange(300), -np.round(cos, 12))) if cos[i] > 0 and i != without][:7]
        assert np.allclose(cosines, cos[best]) and len(docs) == len(best)


def test_isotonic():
    x, v = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4))
    assert x.tolist() == [0.1, 0.2, 0.3, 0.4] and v.tolist() == [0.0, 0.5, 0.5, 1.0]


# ---- op9


def plain_sets(texts):
    out = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return out


def plain_components(texts):
    sets = plain_sets(texts)
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * o >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return [(len(s), r) for s, r in zip(sets, root, strict=True)]


def noisy_texts(seed, n):
    r = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = " ".join(r.choice(vocabulary, 60))
    texts = [None, "", "\t\n", "One", "one", "one two", "a b c d e", "a b c d e f", "A b c d E", "x " * 3000]
    while len(texts) < n:
        words = list(r.choice(vocabulary, r.integers(3, 150)))
        base = " ".join(words) + (" " + shared if r.random() < 0.4 else "")
        for _ in range(r.integers(1, 6)):
            own = base.split()
            for _ in range(r.integers(0, 4)):
                own[r.integers(len(own))] = str(r.choice(vocabulary))
            texts.append(" ".join(own))
    return texts[:n]


def test_shingle_sets_have_the_right_sizes():
    texts = noisy_texts(1, 200)
    assert [len(shingles.shingle_hashes(t)) for t in texts] == [len(s) for s in plain_sets(texts)]
    assert shingles.shingle_hashes("A  b\tc d E f").tolist() == shingles.shingle_hashes("a b c d e F").tolist()
    assert shingles.shingle_hashes("É b").tolist() != shingles.shingle_hashes("é b").tolist()


@pytest.mark.parametrize("params", [ngram_join.JoinParams(), ngram_join.JoinParams(cell_shingles=300, hot_sample=30, hot_keys=50)])
def test_near_duplicates_match_brute_force(spark, params):
    texts = noisy_texts(7, 260)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(rows(spark, texts), params).collect()}
    assert [found[i] for i in range(len(texts))] == plain_components(texts)


def test_all_links_match_brute_force(spark):
    texts = noisy_texts(9, 150)
    pairs, members = ngram_join.linked_pairs(rows(spark, texts))
    of = {r.doc_id: r["class"] for r in members.collect()}
    sets = plain_sets(texts)
    want = {(min(of[i], of[j]), max(of[i], of[j])): len(sets[i] & sets[j]) for i in range(150) for j in range(i) if sets[i] and sets[j] and sets[i] != sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert {(r.a, r.b): r.overlap for r in pairs.collect()} == want


def test_near_duplicates_odd_rows(spark):
    assert ngram_join.near_duplicates(rows(spark, [])).count() == 0
    text = " ".join(f"t{i}" for i in range(60))
    found = ngram_join.near_duplicates(rows(spark, [text, text + " more", "else " * 9, text, None], [5, 5, 5, None, 8])).collect()
    assert sorted((r.n_shingles, r.component_id) for r in found) == [(0, 8), (1 + 0, 5), (56, 5), (56, 5), (57, 5)]


def test_words_that_sum_alike_have_other_hashes():
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    assert len(a) == 2048 and shingles.shingle_hashes(a).tolist() != shingles.shingle_hashes(b).tolist()


def test_near_duplicates_of_large_blocks_and_long_texts(spark):
    r = np.random.default_rng(8)
    words = [f"v{i}" for i in range(3000)]
    passage = " ".join(r.choice(words, 40))
    own = lambda n: " ".join(r.choice(words, n))
    shared = [passage + " " + own(30) for _ in range(40)]  # a passage in common, no links
    base = own(80).split()
    near = [" ".join(base[:i] + ["x"] + base[i + 1 :]) for i in range(25)] + [passage + " " + " ".join(base[:60])]
    long = own(20_000)
    texts = [*shared, *near, long, long + " end", *([shared[3]] * 30)]
    found = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.near_duplicates(rows(spark, texts), ngram_join.JoinParams(cell_shingles=400, hot_sample=40, hot_keys=30)).collect()}
    assert [found[i] for i in range(len(texts))] == plain_components(texts)


def test_drop_near_duplicates_of_repeated_and_null_ids(spark):
    text = " ".join(f"t{i}" for i in range(60))
    docs = rows(spark, [text, text, text + " more", "other " * 9, "other " * 9, None, None, ""], [5, 5, 9, None, None, 3, 3, 3])
    kept = ngram_join.drop_near_duplicates(docs).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0, x.text or "") for x in kept) == [(False, 3, ""), (False, 3, ""), (False, 3, ""), (False, 5, text), (True, 0, "other " * 9)]


def test_drop_near_duplicates_keeps_one(spark, tmp_path):
    texts = noisy_texts(3, 120)
    rows(spark, [*texts, texts[20]], [*range(120), 20]).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    kept = [r.doc_id for r in ngram_join.drop_near_duplicates(docs).collect()]
    want = sorted({c for _, c in plain_components(texts)})
    assert sorted(kept) == want and ngram_join.drop_near_duplicates(docs).columns == docs.columns


def test_pipeline_against_its_stages(spark, tmp_path):
    import corpus_pipeline

    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "personal_data", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert not any(pii.find_plain(t) for t in kept.values())
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(kept)
    check_packing(pieces, kept, 2048)
    assert json.dumps(sorted(kept))


# ---- searches on vectors of zeros, copies and uneven lengths


def test_norm_topk_with_queries_of_zeros(spark):
    r = np.random.default_rng(4)
    tables = {
        "one": [[0.0] * 6, *(r.integers(-9, 9, (200, 6)).astype(float).tolist())],
        "every": [[0.0] * 6] * 60,
        "most": [*([[0.0] * 6] * 150), *(r.integers(-1, 2, (50, 6)).astype(float).tolist())],
    }
    for data in tables.values():
        held = spark.createDataFrame(list(enumerate(data)), "vec_id long, v array<double>")
        asked = held.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
        found = {}
        for x in norm_topk.top_k(asked, held, 5, classes=4, block=32, query_block=4).orderBy("query_id", "rank").collect():
            found.setdefault(x.query_id, []).append((x.vec_id, x.score))
        pairs = [(q, i, int(np.dot(data[q], data[i]))) for q in range(0, len(data), 10) for i in range(len(data)) if i != q]
        assert found == brute(pairs, 5)


def test_op8_of_tiny_and_zero_vectors(spark, tmp_path):
    data = [(i, [0.0, 0.0] if i % 50 == 0 else [0.001 * (i % 3), 0.003] if i % 2 else [float(i % 7), -0.5]) for i in range(120)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    whole = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in data}
    found = {}
    for x in queries.op8_norm_topk(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        found.setdefault(x.query_id, []).append((x.vec_id, x.score))
    assert found == brute([(q, i, sum(a * b for a, b in zip(whole[q], whole[i], strict=True))) for q in range(0, 120, 50) for i in range(120) if i != q], 5)


def copied_tables():
    r = np.random.default_rng(8)
    some = lambda n: r.standard_normal((n, 32))
    return {
        "none": some(1500),
        "five of each": np.repeat(some(200), 5, axis=0),
        "thirty of thirty": np.concatenate([some(600), np.repeat(some(30), 30, axis=0)]),
        "two hundred of ten": np.concatenate([some(500), np.repeat(some(10), 200, axis=0)]),
        "all equal": np.repeat(some(1), 300, axis=0),
        "uneven": some(1200) * r.lognormal(0, 1.2, 1200)[:, None],
    }


@pytest.mark.parametrize("name", list(copied_tables()))
def test_vamana_recall_on_copies_and_uneven_lengths(spark, name):
    m = copied_tables()[name]
    m = m[np.random.default_rng(1).permutation(len(m))]
    held = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, v array<double>").cache()
    asked = held.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    found = {}
    for x in vamana.nearest(held, asked, 20, shard_size=1000).orderBy("query_id", "rank").collect():
        found.setdefault(x.query_id, []).append((x.vec_id, x.score))
    met = total = 0
    for q in range(0, len(m), 20):
        scores = m @ m[q]
        scores[q] = -np.inf
        best = np.lexsort((np.arange(len(m)), -np.round(scores, 9)))[:20]
        own = found[q]
        assert len(own) == 20 and len({i for i, _ in own}) == 20 and q not in {i for i, _ in own}
        least = scores[best[-1]] - 1e-9
        met, total = met + sum(s >= least for _, s in own), total + 20
        if name == "all equal":
            assert [i for i, _ in own] == [i for i in range(21) if i != q][:20]
    assert met / total >= 0.95, met / total
