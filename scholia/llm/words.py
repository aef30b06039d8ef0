"""Words and rolling hashes of whole texts, vectorised over a batch of documents.

Words are runs of bytes other than space and 0x09 to 0x0D, which is how
``bytes.split`` cuts, so a text is cut by one call. Each distinct word is hashed
once per worker; n-gram hashes are polynomials over word hashes modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash

#: Words a worker remembers, about 50 MB; the memory is emptied when it is full.
REMEMBERED = 250_000
_ODD = 0x9E3779B97F4A7C15
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """64-bit hash of a word, by bytes."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def split(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8, unchanged; none for null."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_split(text: str | None) -> list[bytes]:
    """The words of a text with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


_KEEP = bytes(
    (c + 32 if 65 <= c <= 90 else c) if (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) else 32 for c in range(256)
)


def alphanumeric_words(text: str | None) -> list[bytes]:
    """Words of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split() if text else []


def slices(texts: list[str | None], most: int = 400_000) -> list[tuple[int, int]]:
    """Row ranges of about ``most`` characters, at least one row each, for bounded memory."""
    out, first, size = [], 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > first and size + n > most:
            out.append((first, i))
            first, size = i, 0
        size += n
    return [*out, (first, len(texts))] if len(texts) else []


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def _power(k: int) -> np.uint64:
    return np.uint64(pow(_ODD, k, 2**64))


def ngrams(words: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of ``n`` words, by its first word; empty if there are fewer."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    # Runs of 2, 4, 8, ... words, put together by the bits of n.
    out, have = None, 0
    part, size = words, 1
    while True:
        if n & size:
            out, have = (part, size) if out is None else (part[: len(part) - have] * _power(have) + out[size:], have + size)
        if 2 * size > n:
            break
        part = part[:-size] * _power(size) + part[size:]
        size *= 2
    return mixed(out[:m] + np.uint64(salt * pow(_ODD, n - 1, 2**64) % 2**64))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct ``n``-word shingle hashes, sorted; a shorter text is one shingle, no words none."""
    if not len(words):
        return np.empty(0, dtype=np.uint64)
    return np.unique(ngrams(words, n) if len(words) >= n else ngrams(words, len(words), salt=len(words)))


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned hashes as Spark's signed longs."""
    return values.view(np.int64)


def ranges(lengths: Iterable[int]) -> np.ndarray:
    """0, 1, ... within each of the lengths, one after another."""
    lengths = np.asarray(lengths, dtype=np.int64)
    if not lengths.sum():
        return np.empty(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
