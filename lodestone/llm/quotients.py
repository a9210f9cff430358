"""Counting quotient filters of 64-bit fingerprints, as numpy arrays.

A fingerprint's upper bits are its quotient, the others its remainder. For each quotient one bit says whether it occurs, for
each slot one bit whether its run ends there; slots hold remainders in order, and a counter only where it is above one. So
nothing of a fingerprint is lost, and filters of any sizes merge by their sorted remainders into the filter of all.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QBBB")


def encode(fingerprints: np.ndarray, counts: np.ndarray, lead: int = 0) -> bytes:
    """The filter of distinct, ascending fingerprints (uint64), which share their upper lead bits."""
    n, bits = len(fingerprints), 64 - lead
    q = min(bits, max(1, int(n - 1).bit_length())) if n else 1  # about one slot a quotient
    r = bits - q
    low = fingerprints & np.uint64((1 << bits) - 1)
    quotient, remainder = low >> np.uint64(r), low & np.uint64((1 << r) - 1)
    occupied = np.zeros(1 << q, bool)
    occupied[quotient.astype(np.int64)] = True
    last = np.append(quotient[1:] != quotient[:-1], True)[:n]
    width = (r + 7) // 8
    several = counts > 1
    head = _HEAD.pack(int(fingerprints[0] >> np.uint64(bits)) if n and lead else 0, lead, q, width)
    slots = np.ascontiguousarray(remainder.astype("<u8")).view(np.uint8).reshape(n, 8)[:, :width].tobytes()
    return b"".join([head, struct.pack("<Q", n), np.packbits(occupied).tobytes(), np.packbits(last).tobytes(), np.packbits(several).tobytes(), slots, counts[several].astype("<u8").tobytes()])


def decode(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints in order and their counts."""
    top, lead, q, width = _HEAD.unpack_from(blob)
    (n,) = struct.unpack_from("<Q", blob, _HEAD.size)
    at, r = _HEAD.size + 8, 64 - lead - q

    def take(size: int) -> np.ndarray:
        nonlocal at
        at += size
        return np.frombuffer(blob, np.uint8, size, at - size)

    flags = lambda m: np.unpackbits(take((m + 7) // 8), count=m).astype(bool)
    occupied, last, several = flags(1 << q), flags(n), flags(n)
    slots = np.zeros((n, 8), np.uint8)
    slots[:, :width] = take(n * width).reshape(n, width)
    run = np.cumsum(last) - last  # the run that each slot belongs to
    quotient = np.flatnonzero(occupied).astype(np.uint64)[run]
    low = (quotient << np.uint64(r)) | slots.view("<u8").ravel()
    counts = np.ones(n, np.int64)
    counts[several] = take(8 * int(several.sum())).view("<u8")
    return low | (np.uint64(top) << np.uint64(64 - lead) if lead else np.uint64(0)), counts


def merged(fingerprints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints in order with their counts added up; the sort is stable, so it runs along ordered stretches."""
    order = np.argsort(fingerprints, kind="stable")
    fingerprints, counts = fingerprints[order], counts[order]
    first = np.flatnonzero(np.append(True, fingerprints[1:] != fingerprints[:-1])[: len(fingerprints)])
    return fingerprints[first], np.add.reduceat(counts, first) if len(first) else counts


def merge(blobs: list[bytes], lead: int = 0) -> bytes:
    """The filter of all that the filters hold."""
    both = [decode(b) for b in blobs]
    return encode(*merged(np.concatenate([f for f, _ in both]), np.concatenate([c for _, c in both])), lead)
