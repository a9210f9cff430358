"""Word shingles as 64-bit hashes, and circulant MinHash signatures of their sets."""

from __future__ import annotations

import functools

import numpy as np
import xxhash

WIDTH = 5
#: Positions that the two permutations of circulant MinHash work on.
POSITIONS = 1 << 20
#: Words whose hashes a Python worker keeps; then it starts anew.
CACHE_WORDS = 200_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHash()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's WIDTH-word shingles: A-Z lower-cased, words parted by ASCII white space
    (bytes.lower and bytes.split do exactly that). Fewer words than WIDTH make one shingle; no words, none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WIDTH:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=WIDTH)], np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(w) - WIDTH + 1
    h = w[:n] * _ODD[0]
    for k in range(1, WIDTH):
        h += w[k : k + n] * _ODD[k]
    return np.unique(mix(h))


@functools.cache
def _windows(k: int) -> np.ndarray:
    """Row p holds the second permutation at p, p + 1, ... p + k - 1, round the circle: its k circular shifts at p."""
    pi = np.random.default_rng(20_240_501).permutation(POSITIONS).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:k]]), k)


def signature(hashes: np.ndarray, k: int) -> np.ndarray:
    """Circulant MinHash: the first permutation scatters the set over the circle, the second one, shifted by 0 to k - 1,
    gives the k coordinates as its minima. Works in pieces, so memory doesn't follow the length of the text."""
    at = (mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - 20)).astype(np.intp)
    shifted, least = _windows(k), np.full(k, POSITIONS, np.int32)
    for i in range(0, len(at), 4096):
        np.minimum(least, shifted[at[i : i + 4096]].min(axis=0), out=least)
    return least


def free() -> None:
    """Lets go of what a worker keeps."""
    _words.clear()
    _windows.cache_clear()


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of the signature."""
    rows = sig.astype(np.uint64).reshape(bands, -1)
    h = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows.shape[1]):
        h = mix(h * _ODD[1] + rows[:, j])
    return h.view(np.int64)
