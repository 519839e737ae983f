"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and beginnings of words, chosen by how well they tell the labels of a bounded sample apart; a text that
holds none of them is compared by its other words instead, all that more than one example has but the most common. The
terms' document frequencies are counted over all documents. The sample's documents are the examples: inverted indexes
hold their weights in blocks with each block's maximum, so a search scores only the blocks that can still hold one of
the nearest. Votes weigh by distance and are calibrated on the examples themselves, each left out in turn.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactsheet.llm._common import materialise, parts_of, slices
from contactsheet.llm.labelled import held_out, sample

PER_CLASS = 2_500  #: labelled documents of either label, in expectation, that serve as examples
SURE = 12.0  #: least log-likelihood ratio of a term with the label; whatever reaches it is a term
NEIGHBOURS = 15
DENSITIES = 20
BLOCK = 32  #: examples of a block of the index
FIRST = 12  #: blocks scored before the others are tested by their bounds
PREFIXES = (3, 4, 5, 6, 7)  #: lengths of the beginnings of words that are terms
COMMON = 0.1  #: words that a greater share of the examples' texts hold tell little of what a text is about

_WORD = re.compile(r"[^\W\d_]+")


def term_counts(text: str | None) -> dict[str, int]:
    """How often each word of the whole text, and each beginning of its words (marked by ``^``), occurs."""
    words = Counter(_WORD.findall((text or "").lower()))
    out = dict(words)
    for word, n in words.items():
        for k in PREFIXES:
            if len(word) >= k:
                key = "^" + word[:k]
                out[key] = out.get(key, 0) + n
    return out


class Vocabulary:
    """Terms with their numbers. ``DENSITIES`` more terms, the last, stand for the share of a text's words that hold a
    term, in steps of half an octave: they tell a short text full of a term from a long one that holds it once.

    ``words`` are the terms of texts that hold none of these; their numbers follow."""

    def __init__(self, terms: list[str], words: Iterable[str] = ()):
        self.terms = terms
        self.number = {t: i for i, t in enumerate(terms)}
        self.first_word = len(terms) + DENSITIES
        self.words = {w: self.first_word + i for i, w in enumerate(words)}
        self.size = self.first_word + len(self.words)
        self._openings = {t[1:4] for t in terms if t[0] == "^"} | {t[:3] for t in terms if t[0] != "^"}

    def other(self, text: str | None) -> dict[int, int]:
        """How often each of ``words`` occurs in the text."""
        return self._other(_WORD.findall((text or "").lower()))

    def _other(self, words: list[str]) -> dict[int, int]:
        number = self.words
        return {number[w]: n for w, n in Counter(words).items() if w in number}

    def vector(self, text: str | None) -> dict[int, int]:
        """How often each term occurs in the text, or, if none does, each of ``words``."""
        out: dict[int, int] = {}
        number, openings, hits = self.number, self._openings, 0
        words = _WORD.findall((text or "").lower())
        total = len(words)
        for word, n in Counter(w for w in words if w[:3] in openings).items():  # a term's word begins like the term
            held = [number[t] for t in (word, *("^" + word[:k] for k in PREFIXES if len(word) >= k)) if t in number]
            if held:
                hits += n
                for at in held:
                    out[at] = out.get(at, 0) + n
        if not hits:
            return self._other(words)
        out[len(self.terms) + min(DENSITIES - 1, int(2 * np.log2(total / hits)))] = 1
        return out


class BlockMaxIndex:
    """Inverted lists of examples, cut into blocks of ``BLOCK`` examples, each with the greatest weight in it."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int):
        self.n = len(vectors)
        sizes = np.array([len(t) for t, _ in vectors], np.int64)
        doc = np.repeat(np.arange(self.n), sizes)
        term = np.concatenate([t for t, _ in vectors]) if self.n else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in vectors]) if self.n else np.zeros(0)
        order = np.lexsort((doc, term))
        self.doc, self.weight, term = doc[order], weight[order], term[order]
        self.start = np.searchsorted(term, np.arange(terms + 1))
        key = term * (self.n // BLOCK + 1) + self.doc // BLOCK
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.block_at = np.append(cut, len(key))  # where each block's postings begin
        self.block = self.doc[cut] // BLOCK if len(cut) else cut
        self.block_max = np.maximum.reduceat(self.weight, cut) if len(cut) else np.zeros(0)
        self.block_start = np.searchsorted(cut, self.start)  # a term's first block

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the ``k`` nearest with a term in common, ties to the smaller number; exact.

        A block's bound is the sum of the terms' weights times their maxima in it. The ``FIRST`` blocks of the greatest
        bounds are scored, and then all others whose bound reaches the k-th cosine found; the rest is passed by.
        """
        entry = _ranges(self.block_start[terms], self.block_start[terms + 1])
        if not len(entry):
            return np.zeros(0, np.int64), np.zeros(0)
        factor = np.repeat(weights, self.block_start[terms + 1] - self.block_start[terms])
        block = self.block[entry]
        bound = np.bincount(block, factor * self.block_max[entry])

        def scored(blocks: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
            open_ = np.zeros(len(bound), bool)
            open_[blocks] = True
            here = open_[block]
            lists = entry[here]
            sizes = self.block_at[lists + 1] - self.block_at[lists]
            postings = _ranges(self.block_at[lists], self.block_at[lists + 1])
            total = np.bincount(self.doc[postings], np.repeat(factor[here], sizes) * self.weight[postings])
            if 0 <= without < len(total):
                total[without] = 0.0
            docs = np.flatnonzero(total > least)
            return docs, total[docs]

        def best(docs: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            nearest = np.lexsort((docs, -total))[:k]
            return docs[nearest], total[nearest]

        met = np.flatnonzero(bound)
        first = met[np.argsort(-bound[met], kind="stable")[:FIRST]]
        docs, total = best(*scored(first, 0.0))
        least = total[-1] * (1 - 1e-12) if len(total) == k else 0.0
        bound[first] = -1.0
        rest = np.flatnonzero(bound >= least) if least > 0 else np.flatnonzero(bound > 0)
        if len(rest):
            more, of_more = scored(rest, least * (1 - 1e-12))
            docs, total = best(np.concatenate([docs, more]), np.concatenate([total, of_more]))
        return docs, np.minimum(total, 1.0)


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The whole numbers of all ranges, one after the other."""
    sizes = ends - starts
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, value) knots of the weighted rising step function nearest to (x, y): pool adjacent violators."""
    knots, at = np.unique(x, return_inverse=True)
    total, mass = np.bincount(at, weight * y), np.bincount(at, weight)
    pools: list[list[float]] = []
    for i in range(len(knots)):
        pools.append([total[i], mass[i], 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            t, m, c = pools.pop()
            pools[-1] = [pools[-1][0] + t, pools[-1][1] + m, pools[-1][2] + c]
    return knots, np.repeat([t / m for t, m, _ in pools], [int(c) for _, _, c in pools])


@dataclass
class Model:
    """What scoring needs: vocabulary, inverse document frequencies, the examples' ids, labels, and for texts with a term
    and for others an index and a calibration."""

    vocabulary: Vocabulary
    idf: np.ndarray
    ids: list = field(default_factory=list)
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0))
    index: BlockMaxIndex | None = None
    others: BlockMaxIndex | None = None
    base: float = 0.0
    knots: tuple[np.ndarray, np.ndarray] | None = None
    other_knots: tuple[np.ndarray, np.ndarray] | None = None

    def weights(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weights) of unit length: (1 + log tf) * idf."""
        terms = np.array(sorted(counts), np.int64)
        w = (1 + np.log(np.array([counts[t] for t in terms.tolist()], float))) * self.idf[terms] if len(terms) else np.zeros(0)
        norm = np.sqrt((w * w).sum())
        return (terms, w / norm) if norm > 0 else (terms[:0], w[:0])

    def vote(self, index: BlockMaxIndex | None, terms: np.ndarray, weights: np.ndarray, without: int = -1) -> tuple[float | None, np.ndarray, np.ndarray]:
        """(share of toxic votes, the neighbours, their cosines); votes weigh by the inverse of the distance."""
        docs, cosines = index.nearest(terms, weights, NEIGHBOURS, without) if index else (np.zeros(0, np.int64), np.zeros(0))
        if not len(docs):
            return None, docs, cosines
        say = cosines / (1.05 - cosines)
        return float((say * self.labels[docs]).sum() / say.sum()), docs, cosines

    def score(self, counts: dict[int, int]) -> tuple[float, np.ndarray, np.ndarray]:
        """(calibrated score, neighbours, cosines); a text without any of the words scores as the examples without a term."""
        terms, weights = self.weights(counts)
        other = len(terms) > 0 and terms[0] >= self.vocabulary.first_word
        raw, docs, cosines = self.vote(self.others if other else self.index, terms, weights)
        knots = self.other_knots if other else self.knots
        if raw is None or knots is None:
            return self.base, docs, cosines
        return float(np.clip(np.interp(raw, *knots), 0, 1)), docs, cosines


def choose_words(few: DataFrame, terms: list[str]) -> list[str]:
    """The words of the examples that compare texts without a term: in two texts or more, and not in more than ``COMMON`` of
    them. The sample bounds their number; they are counted in tasks."""
    texts = few.select("text").distinct()
    n = texts.count()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter()
            for text in batch.column(0):
                found.update(set(_WORD.findall((text.as_py() or "").lower())))
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

    words = texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") >= 2) & (F.col("n") <= max(2, COMMON * n)))
    known = set(terms)
    return sorted(w for r in words.select("word").collect() if (w := r["word"]) not in known)


def choose_terms(few: DataFrame) -> list[str]:
    """The terms that toxic examples hold surely more often than others, by the log-likelihood ratio of their presence.

    Terms of clean prose are left out: they would bring a toxic text near to clean ones in proportion to its length.
    The sample bounds their number; no limit is set besides. Documents with the same text count once. Counting is done in tasks and shuffled by term; only the chosen terms
    reach the driver.
    """
    texts = few.groupBy("text").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows at most
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return []

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with_, without = Counter(), Counter()
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                (with_ if label else without).update(term_counts(text.as_py()).keys())
            keys = list(with_ | without)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([with_[t] for t in keys], pa.int64()), pa.array([without[t] for t in keys], pa.int64())], ["term", "n1", "n0"])

    found = texts.select("text", "label").mapInArrow(count, "term string, n1 long, n0 long").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    n, seen = float(n1 + n0), F.col("n1") + F.col("n0")

    def part(count: Column, row: Column, column: float) -> Column:
        return F.when(count > 0, count * F.log(count * n / (row * column))).otherwise(0.0)

    ratio = 2 * (part(F.col("n1"), seen, n1) + part(F.col("n0"), seen, n0) + part(n1 - F.col("n1"), n - seen, n1) + part(n0 - F.col("n0"), n - seen, n0))
    found = found.where((F.col("n1") * float(n0) > F.col("n0") * 2.0 * n1) & (ratio >= SURE))
    return sorted(r["term"] for r in found.select("term").collect())


def _fresh(name: str, taken: Iterable[str]) -> str:
    """A column's name that is not taken, in any case of letters."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name = "_" + name
    return name


def vectors(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", keep: Iterable[str] = ()) -> DataFrame:
    """(id_col, further columns of ``keep``, __terms array<int>, __counts array<int>): the vocabulary's terms in every
    whole text. The last two columns are named with more underscores if columns of ``keep`` are so named."""
    kept = list(dict.fromkeys([id_col, *keep]))
    rows = docs.select(*kept, *([] if text_col in kept else [text_col]))
    at = rows.columns.index(text_col)
    names = [_fresh("__terms", kept), _fresh("__counts", kept)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, at):
            found = [sorted(vocabulary.vector(text.as_py()).items()) for text in batch.column(at)]
            lists = [pa.array([[pair[i] for pair in x] for x in found], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *lists], [*kept, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(kept)])
    return rows.mapInArrow(run, f"{schema}, `{names[0]}` array<int>, `{names[1]}` array<int>")


def learn(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", keep: Iterable[str] = ()) -> tuple[Model, DataFrame]:
    """(model, all documents' vectors, with the columns of ``keep``). The driver receives the chosen terms and words, one
    count of each and the bounded sample's texts' vectors; document frequencies cover all documents. Without both labels
    among the examples, every score is the labels' share (0 without any label). Empty tables give an empty model."""
    few = materialise(sample(docs, labels, label_col, per_class, id_col=id_col, text_col=text_col), "toxicity-examples")
    terms = choose_terms(few)
    vocabulary = Vocabulary(terms, choose_words(few, terms))
    all_vectors = materialise(vectors(docs, vocabulary, id_col, text_col, keep), "toxicity-vectors")
    idf = np.zeros(vocabulary.size)
    n = all_vectors.count()
    for r in all_vectors.select(F.explode(all_vectors.columns[-2]).alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():  # one row a term
        idf[r["term"]] = np.log((1 + n) / (1 + r["df"])) + 1
    model = Model(vocabulary, idf)
    rows = _examples(few, vocabulary).toPandas()
    if not len(rows):
        return model, all_vectors
    rows["at"] = [tuple(x) for x in rows["terms"]]
    rows = rows.sort_values(["at", "label", "doc_id"], ascending=[True, False, True], ignore_index=True)  # like beside like: blocks differ in their maxima
    y, mass = rows["label"].to_numpy(float), rows["weight"].to_numpy(float)
    own = [model.weights(dict(zip(t, c, strict=True))) for t, c in zip(rows["terms"], rows["counts"], strict=True)]
    other = [model.weights(dict(zip(t, c, strict=True))) for t, c in zip(rows["words"], rows["word_counts"], strict=True)]
    has = np.array([len(t) > 0 and t[0] < vocabulary.first_word for t, _ in own])
    none = (np.zeros(0, np.int64), np.zeros(0))
    model.ids, model.labels = rows["doc_id"].tolist(), y
    model.index = BlockMaxIndex([v if h else none for v, h in zip(own, has, strict=True)], vocabulary.size)
    model.others = BlockMaxIndex(other, vocabulary.size)
    left_out = np.array([model.vote(model.index, *own[i], i)[0] if h else model.vote(model.others, *other[i], i)[0] for i, h in enumerate(has)], float)
    share = lambda on: float((mass * y)[on].sum() / mass[on].sum()) if on.any() else float((mass * y).sum() / mass.sum())
    model.base = share(~has)
    met = ~np.isnan(left_out)
    if (has & met).any():
        model.knots = isotonic(left_out[has & met], y[has & met], mass[has & met])
    if (~has & met).any():
        model.other_knots = isotonic(left_out[~has & met], y[~has & met], mass[~has & met])
    return model, all_vectors


def _examples(few: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, label, weight, terms, counts, words, word_counts): the examples, each id once, by terms and by words."""
    lists = ("terms", "counts", "words", "word_counts")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, 1):
            pairs = [sorted(of(text.as_py()).items()) for of in (vocabulary.vector, vocabulary.other) for text in batch.column(1)]
            halves = pairs[: batch.num_rows], pairs[batch.num_rows :]
            columns = [pa.array([[pair[i] for pair in x] for x in half], pa.list_(pa.int32())) for half in halves for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *columns], ["doc_id", "label", "weight", *lists])

    kind = few.schema["doc_id"].dataType.simpleString()
    rows = few.dropDuplicates(["doc_id"]).select("doc_id", "text", "label", "weight")
    return rows.mapInArrow(run, f"doc_id {kind}, label int, weight double, " + ", ".join(f"{c} array<int>" for c in lists))


class _Memo:
    """A model's scores; texts with the same terms, as often, are scored once, as long as no more than ``most`` terms are
    held."""

    def __init__(self, model: Model, most: int = 500_000):
        self.model, self.most, self.held, self.known = model, most, 0, {}

    def __call__(self, terms: list[int], counts: list[int]) -> tuple[float, list[tuple[int, float]]]:
        """(score, the three nearest examples as (number, cosine))."""
        key = (*terms, -1, *counts) if len(terms) > 1 else tuple(terms)  # one term has the length 1 whatever its count
        if key not in self.known:
            if self.held >= self.most:
                self.known.clear()
                self.held = 0
            self.held += len(key) + 10
            value, docs, cosines = self.model.score(dict(zip(terms, counts, strict=True)))
            self.known[key] = value, list(zip(docs[:3].tolist(), cosines[:3].tolist(), strict=True))
        return self.known[key]


def score(model: Model, all_vectors: DataFrame, *, threshold: float = 0.7, id_col: str = "doc_id") -> DataFrame:
    """(id_col, held_out, score, predicted, evidence array of (doc_id, similarity, toxic)): the three nearest examples.

    ``evidence.doc_id`` has the type of ``id_col``. A null or empty text, or one with common words only, has no terms, no
    evidence and the score of examples without terms. A null id stays null and is not held out; repeated rows are scored
    each; texts of any length were read whole by ``vectors``; an empty table gives an empty table.
    """
    terms, counts = all_vectors.columns[-2:]
    id_type = all_vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = _Memo(model)
        for batch in slices(batches):
            found = [scored(t, c) for t, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            scores = [value for value, _ in found]
            predicted = [int(s >= threshold) for s in scores]
            kind = pa.list_(pa.struct([("doc_id", batch.column(0).type), ("similarity", pa.float64()), ("toxic", pa.int32())]))
            evidence = pa.array([[{"doc_id": model.ids[d], "similarity": c, "toxic": int(model.labels[d])} for d, c in near] for _, near in found], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(predicted, pa.int32()), evidence], [id_col, "held_out", "score", "predicted", "evidence"])

    rows = all_vectors.select(id_col, held_out(id_col).alias("held_out"), terms, counts)
    return rows.mapInArrow(run, f"`{id_col}` {id_type}, held_out boolean, score double, predicted int, evidence array<struct<doc_id:{id_type},similarity:double,toxic:int>>")


def clean(model: Model, all_vectors: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """The rows of ``all_vectors`` whose score is below ``threshold``, without their vectors: no join and no shuffle."""
    *keep, at_terms, at_counts = all_vectors.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = _Memo(model)
        for batch in slices(batches):
            terms, counts = (batch.column(c).to_pylist() for c in (at_terms, at_counts))
            stays = pa.array([scored(t, c)[0] < threshold for t, c in zip(terms, counts, strict=True)], pa.bool_())
            yield batch.select(keep).filter(stays)

    return all_vectors.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in all_vectors.schema if f.name in keep))
