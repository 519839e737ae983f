"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

The rank file and the split pattern are parameters; nothing is downloaded. Long texts are cut at boundaries that no
match of the pattern can cross, so that one call of the library never sees an unbounded text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

#: Fixed value: the pattern that the boundaries below are right for; texts under another pattern are encoded whole.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A blank or line feed after a visible character: every alternative of the pattern ends before it or starts at it.
_BOUNDARY = re.compile(r"(?<=\S)(?=[ \n])")

#: Texts longer than this many characters are split before they are encoded.
SPLIT_CHARS = 20_000

#: White space as the pattern's library has it, in runs too long to be left to its backtracking.
_LONG_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{5000,}")

#: Rows of one Arrow batch that a task hands back.
OUT_ROWS = 1_000


@lru_cache(maxsize=4)
def encoder(rank_path: str, pattern: str) -> tiktoken.Encoding:
    """The library's encoder for a rank file, once per Python worker."""
    with open(rank_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, limit: int = SPLIT_CHARS) -> Iterator[str]:
    """``text`` cut before white space that follows another character, in pieces of about ``limit`` characters.

    A match of the pattern has white space only at its front or consists of it, so none spans such a boundary, and
    the look-ahead of ``\\s+(?!\\S)`` never reaches beyond the end of a piece: the pieces' ids joined are the text's.
    Text without a boundary stays whole, however long.
    """
    start = 0
    while len(text) - start > limit:
        cut = _BOUNDARY.search(text, start + limit)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def _matches_apart(text: str) -> Iterator[tuple[str, bool]]:
    """``text`` in parts, each with whether it is one match of the pattern: a long run of white space.

    Such a run, without its last character where a visible one follows, is one match; its front is a boundary, and what
    is left of it begins the next match. The library's regular expression fails on runs of a million characters.
    """
    start = 0
    for run in _LONG_RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        yield text[start : run.start()], False
        yield text[run.start() : end], True
        start = end
    yield text[start:], False


def encode_text(text: str | None, coder: tiktoken.Encoding) -> np.ndarray:
    """The ids of a whole text as int32; a null text has none."""
    if not text:
        return np.zeros(0, np.int32)
    if len(text) <= SPLIT_CHARS or coder._pat_str != SPLIT_PATTERN:
        return np.array(coder.encode_ordinary(text), np.int32)
    ids = []
    for part, one_match in _matches_apart(text):
        if one_match:
            ids.append(coder._core_bpe.encode_single_piece(part.encode()))
        else:
            ids.extend(map(coder.encode_ordinary, safe_pieces(part)))
    return np.concatenate([np.array(x, np.int32) for x in ids])


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list array, one list per numpy array."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>): the token ids of every whole text, without special tokens.

    A null or empty text has an empty list; a null id stays null; repeated rows are encoded each; further columns of
    ``docs`` are ignored; an empty table gives an empty table.
    """
    rows = docs.select(id_col, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(rank_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(at, OUT_ROWS)
                ids = [encode_text(text.as_py(), coder) for text in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), list_array(ids, pa.int32())], [id_col, "ids"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, ids, decoded binary): the raw bytes of the ids; they need not be valid UTF-8.

    A null list decodes to null, an empty one to no bytes. An id that the rank file lacks raises an error.
    """
    rows = encoded.select(id_col, "ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(rank_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(at, OUT_ROWS)
                decoded = [None if ids is None else coder.decode_bytes(ids) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(decoded, pa.binary())], [id_col, "ids", "decoded"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>, decoded binary): ``decode`` of ``encode`` in one pass through Python."""
    rows = docs.select(id_col, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(rank_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(at, OUT_ROWS)
                ids = [encode_text(text.as_py(), coder) for text in part.column(1)]
                decoded = [coder.decode_bytes(x.tolist()) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), list_array(ids, pa.int32()), pa.array(decoded, pa.binary())], [id_col, "ids", "decoded"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, ids array<int>, decoded binary")
