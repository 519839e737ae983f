"""Word shingles of a text as sorted 64-bit hashes.

A word's hash is XXH3 over its bytes; shingles combine the hashes of their words on whole arrays.
"""

from __future__ import annotations

import hashlib

import numpy as np
from xxhash import xxh3_64_intdigest

WORDS = 5

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash: every bit of the result depends on all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word (a run without blanks and the control characters 9 to 13), with A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()  # bytes split at just these characters
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles of ``words`` words; of a shorter text, one hash of all its words."""
    hashes = word_hashes(text)
    if not len(hashes):
        return hashes
    k = min(words, len(hashes))
    value = np.full(len(hashes) - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            value = value * np.uint64(0xD6E8FEB86659FD93) + hashes[j : len(hashes) - k + 1 + j]
        value = np.sort(_mix(value))
    return value[np.concatenate([[True], value[1:] != value[:-1]])]


def set_key(hashes: np.ndarray) -> bytes:
    """128 bits that name a set of shingles."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
