"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage of the whole text is encoded; gated attention, learned from labels of
documents only, weighs the passages' encodings, and the weighted encoding is scored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactsheet.llm._common import parts_of
from contactsheet.llm.labelled import held_out, sample

PASSAGE = 512  #: characters of a passage
FIT_DOCUMENTS = 2_500  #: labelled documents of either label, in expectation, that the model is fitted on
FIT_PASSAGES = 64  #: of a longer document of the sample, neighbouring passages are put together into so many for fitting (scores use each)
SCORED_BYTES = 2 << 20  #: of text that a task encodes at once, or one longer text

# Classes of characters: lower, upper, other letter, digit, blank, line end, full stop, comma, other marks, symbols.
CLASSES = 12
_LOWER, _UPPER, _OTHER, _DIGIT, _BLANK, _LINE, _STOP, _COMMA, _MARK, _SYMBOL, _SHOUT, _BAR = range(CLASSES)
FEATURES = CLASSES * CLASSES + 8


@lru_cache(maxsize=1)
def _class_of() -> np.ndarray:
    table = np.full(0x10000, _OTHER, np.uint8)
    for code in range(0x3000):
        char = chr(code)
        table[code] = _LOWER if char.islower() else _UPPER if char.isupper() else _DIGIT if char.isdigit() else _BLANK if char.isspace() else _OTHER if char.isalnum() else _SYMBOL
    for chars, kind in (("\n\r", _LINE), (".", _STOP), (",", _COMMA), ("'\"-:;()?", _MARK), ("!", _SHOUT), ("|", _BAR)):
        for char in chars:
            table[ord(char)] = kind
    return table


def passages(text: str | None) -> np.ndarray:
    """(passages, FEATURES): rates of character-class pairs, word lengths, and repetition; one row of zeros for no text."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    n = max(1, -(-len(codes) // PASSAGE))
    out = np.zeros((n, FEATURES), np.float32)
    if not len(codes):
        return out
    kind = _class_of()[np.minimum(codes, 0xFFFF)].astype(np.int64)
    at = np.arange(len(kind)) // PASSAGE
    size = np.bincount(at, minlength=n).astype(np.float32)
    pair = kind.copy()
    pair[1:] += CLASSES * kind[:-1]
    pair[0] += CLASSES * _LINE
    out[:, : CLASSES * CLASSES] = np.sqrt(np.bincount(at * CLASSES * CLASSES + pair, minlength=n * CLASSES * CLASSES).reshape(n, -1) / size[:, None])
    space = (kind == _BLANK) | (kind == _LINE)
    begins = ~space & np.concatenate([[True], space[:-1]])
    words = np.bincount(at[begins], minlength=n)
    visible = np.bincount(at[~space], minlength=n)
    length = visible / np.maximum(words, 1)
    # Repetition: how many of a passage's and of the whole text's runs of 8 characters were met before.
    k = 8
    if len(codes) > k:
        low = codes.astype(np.uint64)
        run = np.zeros(len(codes) - k + 1, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                run = run * np.uint64(1_000_003) + low[j : len(low) - k + 1 + j]
        _, first = np.unique(run, return_index=True)
        again = np.ones(len(run), bool)
        again[first] = False
        repeated = np.bincount(at[: len(run)], again, n) / size
    else:
        repeated = np.zeros(n)
    extra = np.stack([np.log1p(length), words / size * 4, np.minimum(length, 20) / 20, repeated, np.log1p(size) / 7, np.full(n, np.log1p(n) / 5), np.full(n, repeated.mean()), np.full(n, 1.0)], axis=1)
    out[:, CLASSES * CLASSES :] = extra
    return out


def pooled(bag: np.ndarray, most: int) -> np.ndarray:
    """The means of ``most`` stretches of neighbouring rows, all of the bag; the bag itself if it has no more rows."""
    if len(bag) <= most:
        return bag
    edges = np.linspace(0, len(bag), most + 1).round().astype(int)
    return np.add.reduceat(bag, edges[:-1], axis=0, dtype=np.float64) / np.diff(edges)[:, None]


class Model:
    """Encoder, gated attention and scorer; ``parts`` are its arrays."""

    HIDDEN, GATE = 32, 16

    def __init__(self, parts: dict[str, np.ndarray]):
        self.parts = parts

    @classmethod
    def start(cls, seed: int) -> Model:
        r = np.random.default_rng(seed)
        h, g = cls.HIDDEN, cls.GATE
        make = lambda a, b: (r.standard_normal((a, b)) * np.sqrt(2 / a)).astype(np.float64)
        return cls({"mean": np.zeros(FEATURES), "scale": np.ones(FEATURES), "we": make(FEATURES, h), "be": np.zeros(h), "v": make(h, g), "u": make(h, g), "wa": make(g, 1)[:, 0], "wo": make(h, 1)[:, 0] * 0.1, "bo": np.zeros(1)})

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """(probabilities by bag, what backward needs); ``starts``: the first passage of each bag, none empty."""
        p = self.parts
        z = (x - p["mean"]) * p["scale"]
        pre = z @ p["we"] + p["be"]
        h = np.maximum(pre, 0)
        tan, gate = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        a = (tan * gate) @ p["wa"]
        bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        a = np.exp(a - np.maximum.reduceat(a, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        doc = np.add.reduceat(a[:, None] * h, starts)
        out = 1 / (1 + np.exp(-np.clip(doc @ p["wo"] + p["bo"], -30, 30)))
        return out, {"z": z, "h": h, "tan": tan, "gate": gate, "a": a, "bag": bag, "doc": doc}

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.parts
        out, k = self.forward(x, starts)
        d = (out - y) * weight / weight.sum()
        h, a, bag, tan, gate = k["h"], k["a"], k["bag"], k["tan"], k["gate"]
        d_doc = (d[:, None] * p["wo"])[bag]
        d_a = a * ((d_doc * h).sum(axis=1) - (d_doc * k["doc"][bag]).sum(axis=1))
        d_tan, d_gate = d_a[:, None] * p["wa"] * gate * (1 - tan**2), d_a[:, None] * p["wa"] * tan * gate * (1 - gate)
        d_h = (a[:, None] * d_doc + d_tan @ p["v"].T + d_gate @ p["u"].T) * (h > 0)
        return {"we": k["z"].T @ d_h, "be": d_h.sum(axis=0), "v": h.T @ d_tan, "u": h.T @ d_gate, "wa": (tan * gate).T @ d_a, "wo": k["doc"].T @ d, "bo": np.array([d.sum()])}


def fit(bags: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, *, epochs: int = 40, batch: int = 64, rate: float = 4e-3, decay: float = 1e-4, seed: int = 5) -> Model:
    """A model fitted by Adam on bags of passages; both labels weigh the same in sum while fitting, the scorer's
    constant is then set back to the labels' real shares. With one label only, its share is the score of all."""
    model = Model.start(seed)
    p = model.parts
    if not len(labels):
        p["wo"][:] = 0
        return model
    real = float(np.clip(np.average(labels, weights=weights), 1e-3, 1 - 1e-3))
    if len(set(labels.tolist())) < 2:
        p["wo"][:], p["bo"][:] = 0, np.log(real / (1 - real))
        return model
    # Bag by bag, so that the sample is never held a second time in double precision.
    count = sum(map(len, bags))
    p["mean"] = sum(b.sum(axis=0, dtype=np.float64) for b in bags) / count
    p["scale"] = 1 / np.maximum(np.sqrt(sum(((b - p["mean"]) ** 2).sum(axis=0) for b in bags) / count), 1e-2)
    share = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum()) * len(labels)
    random = np.random.default_rng(seed)
    m, s = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for epoch in range(epochs):
        order = random.permutation(len(bags))
        now = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for at in range(0, len(order), batch):
            few = order[at : at + batch]
            x = np.concatenate([bags[i] for i in few]).astype(np.float64)
            starts = np.concatenate([[0], np.cumsum([len(bags[i]) for i in few])[:-1]])
            step += 1
            for key, g in model.gradients(x, starts, labels[few], share[few]).items():
                m[key] = 0.9 * m[key] + 0.1 * g
                s[key] = 0.999 * s[key] + 0.001 * g * g
                p[key] -= now * (m[key] / (1 - 0.9**step) / (np.sqrt(s[key] / (1 - 0.999**step)) + 1e-8) + decay * p[key])
    p["bo"] += np.log(real / (1 - real))
    return model


def learn(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", per_class: int = FIT_DOCUMENTS, fit_passages: int = FIT_PASSAGES, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of a bounded sample of labelled, not held-out documents, of any length.

    Every passage of the whole texts is encoded in the tasks; of a document with more than ``fit_passages``, neighbours are
    averaged, so the driver receives 2 * ``per_class`` * ``fit_passages`` * FEATURES half-precision numbers at most (97 MB
    with the given values) and no part of a text is left out. Without labelled documents every score is a half.
    """
    few = sample(docs, labels, label_col, per_class, id_col=id_col, text_col=text_col)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [pooled(passages(text.as_py()), fit_passages).astype(np.float16).tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bags, pa.binary()), batch.column(2), batch.column(3)], ["doc_id", "bag", "label", "weight"])

    id_type = few.schema["doc_id"].dataType.simpleString()
    rows = few.select("doc_id", "text", "label", "weight").mapInArrow(encode, f"doc_id {id_type}, bag binary, label int, weight double").toPandas().sort_values(["doc_id", "bag"])
    bags = [np.frombuffer(x, np.float16).reshape(-1, FEATURES) for x in rows["bag"]]
    return fit(bags, rows["label"].to_numpy(np.float64), rows["weight"].to_numpy(np.float64))


def score(docs: DataFrame, model: Model, *, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted, passages, top_passage, top_weight): every whole text, each passage encoded.

    ``top_passage`` is the number of the passage with the greatest attention. A null or empty text is one empty
    passage; a null id stays null and is not held out; repeated rows are scored each; further columns are ignored; an
    empty table gives an empty table. A text of any length is read whole: a task holds the passages of ``SCORED_BYTES`` of
    text, or of one longer text.
    """
    rows = docs.select(id_col, text_col, held_out(id_col).alias("held_out"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts_of(batches, 1, size=SCORED_BYTES, rows=200):
            bags = [passages(text.as_py()) for text in part.column(1)]
            sizes = np.array([len(x) for x in bags], np.int64)
            starts = np.cumsum(sizes) - sizes
            p, kept = model.forward(np.concatenate(bags).astype(np.float64), starts)
            top = [int(np.argmax(kept["a"][s : s + n])) for s, n in zip(starts, sizes, strict=True)]
            weight = np.maximum.reduceat(kept["a"], starts)
            columns = [part.column(0), part.column(2), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(sizes), pa.array(top, pa.int64()), pa.array(weight)]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "held_out", "score", "predicted", "passages", "top_passage", "top_weight"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, held_out boolean, score double, predicted int, passages long, top_passage long, top_weight double")
