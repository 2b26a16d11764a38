"""Word-shingle sets as sorted 64-bit hashes, and their MinHash signatures."""

from __future__ import annotations

import numpy as np
import xxhash

#: Word hashes kept; beyond it the cache starts anew.
KEPT_WORDS = 400_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def words(text: str) -> list[bytes]:
    """ASCII-lower-cased words between ASCII white space, in UTF-8: bytes of other characters are neither."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def exact_shingles(text: str | None, k: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves."""
    found = words(text or "")
    if not found:
        return set()
    return set(zip(*(found[j:] for j in range(min(k, len(found))))))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the text's k-word shingles; the whole sequence if it has fewer words."""
    found = words(text or "")
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    width = min(k, len(hashes))
    with np.errstate(over="ignore"):
        total = np.full(len(hashes) - width + 1, width, np.uint64)
        for j in range(width):
            total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + len(total)])
    return np.unique(total)


class MinHash:
    """``n`` minima under random affine maps of the hashes' upper halves."""

    def __init__(self, n: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, n, np.uint32)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        upper = (hashes >> np.uint64(32)).astype(np.uint32)
        best = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        with np.errstate(over="ignore"):
            for at in range(0, len(upper), 512):
                part = upper[at : at + 512, None] * self.a
                part += self.b
                np.minimum(best, part.min(axis=0), out=best)
        return best


def odd_sketch(hashes: np.ndarray, n_words: int) -> np.ndarray:
    """Bit b says whether an odd number of hashes fall on it.  The sketches of two sets differ
    in no more bits than the sets differ in elements, since every differing element flips one bit."""
    bits = n_words * 64
    odd = (np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")
