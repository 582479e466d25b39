"""Word shingles as 64-bit hashes, their MinHash bands and odd sketches (numpy, one text at a time)."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

#: Words of a shingle.
WIDTH = 5
#: Bands and hashes of a band: at a similarity of 0.75 two texts share no band with probability 8e-6, at 0.5 they
#: share one with probability 0.6, at 0.3 with 0.04.
BANDS, ROWS = 60, 6
#: Bits of the smallest parity bitmap. Larger sets have 2^level as many, at least a bit a shingle.
BITS = 1024

#: Words whose hashes a worker remembers; a full cache is emptied.
_WORD_CACHE = 100_000
_rng = np.random.default_rng(20240229)
_POSITION = _rng.integers(1, 2**63, WIDTH + 1, dtype=np.uint64) | np.uint64(1)
_SLOPE = _rng.integers(1, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_SHIFT = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_BAND = _rng.integers(1, 2**63, ROWS, dtype=np.uint64) | np.uint64(1)
_BAND_SEED = _rng.integers(1, 2**63, BANDS, dtype=np.uint64)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray, salt: np.uint64 = np.uint64(0)) -> np.ndarray:
    x = (x + salt) * _A
    x ^= x >> np.uint64(30)
    x *= _B
    x ^= x >> np.uint64(27)
    x *= _C
    x ^= x >> np.uint64(31)
    return x


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORD_CACHE:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


_words = _Words()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles of the text, A-Z lower-cased, split at ASCII white space.

    With fewer words the whole sequence is one shingle; without words the set is empty.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(WIDTH, len(words))
    out = np.full(len(words) - width + 1, int(_POSITION[WIDTH]) * width % 2**64, np.uint64)
    for i in range(width):
        out += h[i : len(out) + i] * _POSITION[i]
    return np.unique(mixed(out))


def fingerprint(shingles: np.ndarray) -> bytes:
    """128 bits of BLAKE2b over the sorted set: equal for equal sets only."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def band_hashes(shingles: np.ndarray) -> np.ndarray:
    """One hash per band of the set's MinHash values, as signed 64-bit integers.

    The permutations are of the hashes' upper 32 bits: equal sets have equal values, and numpy runs them eight at a time.
    """
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for i in range(0, len(h), 1024):
        values = np.multiply.outer(h[i : i + 1024], _SLOPE)
        values += _SHIFT
        np.minimum(least, np.minimum.reduce(values, axis=0), out=least)
    return mixed((mixed(least.astype(np.uint64)).reshape(BANDS, ROWS) * _BAND).sum(axis=1, dtype=np.uint64), _BAND_SEED).view(np.int64)


def level_of(n: int) -> int:
    """The least level whose bitmap has a bit a shingle. Sets within a factor of 4/3 are at most one level apart."""
    return max(0, (n - 1) // BITS).bit_length()


def odd_sketch(shingles: np.ndarray, level: int) -> np.ndarray:
    """The parity bitmap of BITS * 2^level bits as signed 64-bit words: each shingle flips one bit.

    The MinHash sample folded into it is the whole set, so the XOR of two bitmaps is the bitmap of the
    sets' symmetric difference, and never has more bits set than that has members.
    """
    bits = BITS << level
    flips = np.bincount((mixed(shingles, _B) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def folded(sketch: np.ndarray) -> np.ndarray:
    """The same set's bitmap of half as many bits."""
    half = len(sketch) // 2
    return sketch[:half] ^ sketch[half:]
