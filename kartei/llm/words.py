"""Words of texts as flat numpy arrays, batch by batch."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import numpy as np

#: A word is a maximal run of letters and digits; ``[^\W_]`` is exactly ``[\p{L}\p{N}]``.
WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """The words of the lower-cased text; none for null."""
    return WORD.findall(text.lower()) if text else []


_HASHES: dict[str, int] = {}


def hash_word(word: str) -> int:
    """A stable 63-bit hash; remembered for the common words of a worker."""
    h = _HASHES.get(word)
    if h is None:
        h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1
        if len(_HASHES) < 300_000:
            _HASHES[word] = h
    return h


def hashed(lists: Iterable[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Flat hashes of words and the offsets of the lists (one more than lists)."""
    flat: list[int] = []
    ends = [0]
    for words in lists:
        flat += map(hash_word, words)
        ends.append(len(flat))
    return np.array(flat, dtype=np.uint64), np.array(ends, dtype=np.int64)


def scramble(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix), elementwise."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin values modulo 2**64 of all windows of ``length`` ids (across any borders)."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    mixed = scramble(ids.astype(np.uint64) + np.uint64(1))
    h = np.zeros(n, np.uint64)
    for i in range(length):
        h = h * _MIX + mixed[i : i + n]
    return scramble(h)


def window_mask(ends: np.ndarray, length: int) -> np.ndarray:
    """Of all windows over the flat array, those that stay inside one list."""
    total = int(ends[-1])
    n = max(0, total - length + 1)
    mask = np.zeros(n, bool)
    starts = ends[:-1]
    counts = np.diff(ends) - length + 1
    has = counts > 0
    if has.any():
        edge = np.zeros(total + 1, np.int32)
        np.add.at(edge, starts[has], 1)
        np.add.at(edge, starts[has] + counts[has], -1)
        mask = np.cumsum(edge)[:n] > 0
    return mask


def owners(ends: np.ndarray) -> np.ndarray:
    """For each position of the flat array, the number of its list."""
    return np.repeat(np.arange(len(ends) - 1), np.diff(ends))
