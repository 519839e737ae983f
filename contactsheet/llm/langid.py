"""Language identification by rank-order profiles.

A language's profile is the ranking of its most frequent letter n-grams. A document's own ranking is compared to each
profile by the out-of-place distance: how far each n-gram's rank is from its rank in the profile.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contactsheet.llm._common import materialise, parts_of, slices

#: N-grams of a profile, and of a document that are compared to it.
PROFILE = 400

#: Parts of the range of scores that are counted before the scores of one of them are.
SCORE_BINS = 10_000

UNKNOWN = "und"

_SPACE = 32
_TOP = 0x32000  # above are no letters that Python's tables know


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Of each code point, its lower-case letter, or a blank."""
    table = np.full(_TOP + 1, _SPACE, np.int64)
    for code in range(_TOP):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of the whole text's letter n-grams of 1 to 3, with a blank before and after each word.

    A key holds the n-gram's code points, 21 bits each. Without letters, both are empty.
    """
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    chars = np.full(len(codes) + 2, _SPACE, np.int64)
    chars[1:-1] = _letters()[np.minimum(codes, _TOP)]
    blank = chars == _SPACE
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[0] = True
    chars = chars[keep]
    if len(chars) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank = chars == _SPACE
    pairs = (chars[:-1] << 21) | chars[1:]
    triples = (pairs[:-1] << 21) | chars[2:]
    keys = np.sort(np.concatenate([chars[~blank], pairs, triples[~blank[1:-1]]]))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys)))


def ranking(keys: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent keys, in order; equal counts by key."""
    if len(keys) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))[:size]]


class Profiles:
    """Profiles by language, for many comparisons."""

    def __init__(self, ranked: dict[str, list[int]], size: int = PROFILE):
        self.size, self.langs = size, sorted(ranked)
        self._tables = []
        for lang in self.langs:
            keys = np.array(ranked[lang], np.int64)
            order = np.argsort(keys)
            self._tables.append((keys[order], order))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the nearest profile, ties to the first by name; the score is 1 at distance 0, 0 where no
        n-gram is shared. A text without letters is ``und`` at 0, as is every text if no language was learned."""
        own = ranking(*ngram_counts(text), self.size)
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        ranks = np.arange(len(own))
        far = []
        for keys, rank in self._tables:
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            far.append(np.where(keys[at] == own, np.minimum(np.abs(rank[at] - ranks), self.size), self.size).sum())
        best = int(np.argmin(far))
        return self.langs[best], float(1 - far[best] / (self.size * len(own)))


def learn(docs: DataFrame, train: Column, *, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", fit_documents: int | None = None, size: int = PROFILE) -> Profiles:
    """Profiles of the languages of all rows where ``train`` holds and language and text are given.

    Only with ``fit_documents``, of a language with more rows a share chosen by a hash of id and text is used, so that so
    many are expected; of one that this would leave without a row (rows that all repeat each other), those of the least
    hash. N-grams are counted in the tasks; the driver receives ``size`` keys a language, of as many languages as the table has.
    """
    totals = _fit_rows(docs, train, lang_col, id_col, text_col, fit_documents).mapInArrow(_counted, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "key"))
    ranked: dict[str, list[int]] = {}
    for r in totals.withColumn("rank", rank).where(F.col("rank") <= size).orderBy("lang", "rank").collect():
        ranked.setdefault(r["lang"], []).append(r["key"])
    return Profiles(ranked, size)


def _fit_rows(docs: DataFrame, train: Column, lang_col: str, id_col: str, text_col: str, fit_documents: int | None) -> DataFrame:
    """(lang, text) of the rows that ``learn`` uses."""
    chance = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1_000_000)).alias("chance")
    rows = docs.where(F.coalesce(train, F.lit(False)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), chance)
    if fit_documents is None:
        return rows.select("lang", "text")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("chance").alias("least"))
    bound = F.greatest(F.lit(float(fit_documents)) / F.col("n") * 1_000_000, F.col("least") + 1)
    # A row a language, of which the driver and the tasks hold whole profiles besides; texts are not shuffled for it.
    return rows.join(F.broadcast(sizes), "lang").where(F.col("chance") < bound).select("lang", "text")


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts_of(batches, 1):
        parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            parts.setdefault(lang, []).append(ngram_counts(text.as_py()))
        for lang, found in parts.items():
            keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            n = np.bincount(at, np.concatenate([c for _, c in found]), len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], ["lang", "key", "n"])


def low_scores(docs: DataFrame, train: Column, profiles: Profiles, share: float = 0.001, *, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", fit_documents: int | None = None) -> dict[str, float]:
    """By language, the least score that ``share`` of the rows reach at most, of all rows that it was learned from and that
    it is found in; what is far below it is hardly of that language.

    The score is exact: scores are counted by parts of their range, and then those of the part that holds it.
    """
    rows = _fit_rows(docs, train, lang_col, id_col, text_col, fit_documents)
    found = identify(rows, profiles, text_col="text", lang_as="__lang", score_as="score").where(F.col("__lang") == F.col("lang"))
    scores = found.groupBy("lang", "score").agg(F.count("*").alias("n"), F.floor(F.col("score") * SCORE_BINS).alias("bin"))
    scores = materialise(scores, "language-scores")
    upto, all_ = (lambda by: F.sum("n").over(Window.partitionBy("lang").orderBy(by))), F.sum("n").over(Window.partitionBy("lang"))
    bins = scores.groupBy("lang", "bin").agg(F.sum("n").alias("n")).withColumn("upto", upto("bin"))  # SCORE_BINS rows a language
    bins = bins.withColumn("rank", F.greatest(F.ceil(all_ * share), F.lit(1)))
    bins = bins.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
    bins = bins.select("lang", "bin", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))
    low = scores.join(F.broadcast(bins), ["lang", "bin"]).withColumn("upto", upto("score"))  # a row a language
    low = low.where(F.col("upto") >= F.col("rank")).groupBy("lang").agg(F.min("score").alias("low"))
    return {r["lang"]: r["low"] for r in low.collect()}  # a row a language


def identify(docs: DataFrame, profiles: Profiles, *, text_col: str = "text", lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """``docs`` with its columns, then ``lang_as`` string and ``score_as`` double, read from the whole text alone.

    A null text, or one without letters, is ``und`` with score 0. Nulls in other columns stay, repeated rows are
    judged each, and a column of ``docs`` named like one of the two is replaced. Texts of any length are read whole; an
    empty table gives an empty table.
    """
    keep = [c for c in docs.columns if c not in (lang_as, score_as)]
    rows = docs.select(*keep)
    at = keep.index(text_col)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"`{lang_as}` string", f"`{score_as}` double"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [profiles.predict(text.as_py()) for text in batch.column(at)]
            columns = [*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, lang_as, score_as])

    return rows.mapInArrow(run, schema)
