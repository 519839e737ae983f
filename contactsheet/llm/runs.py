"""Periodic runs of words, found by seeds on diagonals.

A run of period q and at least max(6, 4q) words repeats itself q words later over at least max(5, 3q) words. So for the
lags from 2^j to 2^(j+1) - 1 the grams of that guaranteed overlap (5 words for the lag 1, 3 * 2^j else) are indexed, and
two occurrences of a gram in one document, so far apart, are a seed on the diagonal of their lag. As these grams are
longer than the lag, a run's gram recurs first after just its period (two shorter lags would give the run a smaller
period), so only neighbouring occurrences have to be paired and a text costs no more than its length times the number
of octaves. A seed is extended both ways on its diagonal, unless the table of how far each lag is covered has it already.

Grams are named exactly: those of 2^j words by the names of their halves, and only where both halves recur.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactsheet.llm._common import parts_of

LEAST_WORDS = 6  #: of a run
LEAST_PERIODS = 4  #: of a run: its length is this many periods at least

RUNS = "array<struct<start:long,length:long,period:long>>"


def _named(key: np.ndarray) -> np.ndarray:
    """Equal numbers for equal keys that occur more than once; -1 for the rest."""
    _, at, counts = np.unique(key, return_inverse=True, return_counts=True)
    return np.where(counts[at] > 1, at, -1)


def _joined(a: np.ndarray, b: np.ndarray, gap: int) -> np.ndarray:
    """Names of the grams that hold ``a``'s at a place and ``b``'s ``gap`` words later."""
    out = np.full(len(a), -1)
    if gap >= len(a):
        return out
    both = np.flatnonzero((a[:-gap] >= 0) & (b[gap:] >= 0))
    out[both] = _named(a[both] * (len(a) + 1) + b[both + gap])
    return out


def _seeds(names: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag), by lag and place: neighbouring occurrences of a gram with a lag of ``low`` to ``high`` - 1."""
    at = np.flatnonzero(names >= 0)
    at = at[np.argsort(names[at], kind="stable")]
    lag = np.diff(at)
    good = (names[at[1:]] == names[at[:-1]]) & (lag >= low) & (lag < high)
    place, lag = at[:-1][good], lag[good]
    order = np.lexsort((place, lag))
    return place[order], lag[order]


def _matches(words: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words agree from the places i < j on, going forwards (``step`` 1) or back (-1)."""
    done, size = 0, 64
    room = len(words) - j if step > 0 else i + 1
    while done < room:
        n = min(size, room - done)
        if step > 0:
            same = words[i + done : i + done + n] == words[j + done : j + done + n]
        else:
            same = words[i - done - n + 1 : i - done + 1][::-1] == words[j - done - n + 1 : j - done + 1][::-1]
        if not same.all():
            return done + int(same.argmin())
        done, size = done + n, size * 2
    return done


def find_runs(words: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period, in the words' places of all documents together.

    ``words`` numbers the words of several documents one after the other and ``doc`` the document of each; equal numbers
    are equal words. No run reaches over the end of a document.
    """
    n = len(words)
    if n < LEAST_WORDS:
        return []
    longest = int(np.bincount(doc).max())
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    last = np.append(first[1:], n)
    found = []
    names = _named(words * (int(doc.max()) + 1) + doc)  # of grams of 2^j words: in one document only
    half = names
    for j in range(longest.bit_length()):
        low = 1 << j
        if LEAST_PERIODS * low > longest or not (names >= 0).any():
            break
        twice = _joined(names, names, low)
        if j == 0:
            four = _joined(twice, twice, 2)
            grams, k = _joined(four, half, 4), LEAST_WORDS - 1
        else:
            grams, k = _joined(twice, names, 2 * low), (LEAST_PERIODS - 1) * low
        covered: dict[int, int] = {}  # by lag: the place up to which its diagonal is known
        place, lag = _seeds(grams, low, 2 * low)
        fresh = np.ones(len(place), bool)
        fresh[1:] = (lag[1:] != lag[:-1]) | (place[1:] != place[:-1] + 1)  # the next place on a diagonal is covered by the one before
        for i, q in zip(place[fresh].tolist(), lag[fresh].tolist(), strict=True):
            if i < covered.get(q, 0):
                continue
            at = int(np.searchsorted(first, i, side="right")) - 1
            a, b = int(first[at]), int(last[at])
            own = words[a:b]
            right = i + k + _matches(own, i - a + k, i - a + k + q, 1)
            left = i - _matches(own, i - a - 1, i - a - 1 + q, -1) if i > a else i
            covered[q] = right
            length = right - left + q
            if length >= max(LEAST_WORDS, LEAST_PERIODS * q):
                found.append((left, length, q))
        names = twice
    return sorted(found, key=lambda r: (r[0], r[2]))


def split_words(text: bytes | None) -> list[bytes]:
    """The words of a text: what stands between blanks and the control characters 9 to 13."""
    return (text or b"").split()  # bytes split at just these characters


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of most periods, exactly; of several the first, then the one of the smallest period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when every run keeps its first period only."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words, found in one pass over all of them."""
    number: dict[bytes, int] = {}
    sizes = np.array([len(words) for words in texts], np.int64)
    flat = np.fromiter((number.setdefault(w, len(number)) for words in texts for w in words), np.int64, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    filled = np.flatnonzero(sizes)
    for start, length, q in find_runs(flat, np.repeat(np.arange(len(texts)), sizes)):
        at = int(filled[np.searchsorted(starts[filled], start, side="right") - 1])
        out[at].append((start - int(starts[at]), length, q))
    return out


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", reword: Callable[[str | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, runs, strongest, collapsed): every periodic run of the words of each whole text.

    A run is a stretch of words with smallest period q, of at least max(6, 4q) words, that no neighbouring word extends;
    ``runs`` has its (start, length, period) by start and period, ``strongest`` the one of most periods (null without
    any), ``collapsed`` the words that stay, joined by a blank, when each run keeps its first q words. ``reword`` changes
    a text's words first, given the id as text.

    A null text has no words: no runs and an empty ``collapsed``; so has one of blanks. Ids may repeat or be null; each
    row is its own document. Further columns are ignored; an empty table gives an empty table. There is no shuffle. A task
    holds the words of some megabytes of text, or of one longer text.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(id_col).cast("string").alias("__name"))
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts_of(batches, 1):
            texts = [split_words(text) for text in part.column(1).cast(pa.binary()).to_pylist()]
            if reword is not None:
                texts = [reword(name, words) for name, words in zip(part.column(2).to_pylist(), texts, strict=True)]
            all_runs = runs_of(texts)
            collapsed = []
            for words, runs in zip(texts, all_runs, strict=True):
                stays = words if not runs else [w for w, stay in zip(words, kept_words(len(words), runs).tolist(), strict=True) if stay]
                collapsed.append(b" ".join(stays))
            best = [strongest(runs) for runs in all_runs]
            entry = lambda r: {"start": r[0], "length": r[1], "period": r[2]}
            columns = [
                part.column(0),
                pa.array([[entry(r) for r in runs] for runs in all_runs], run_type),
                pa.array([None if b is None else entry(b) for b in best], run_type.value_type),
                pa.array(collapsed, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "runs", "strongest", "collapsed"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, runs {RUNS}, strongest struct<start:long,length:long,period:long>, collapsed string")
