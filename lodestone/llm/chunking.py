"""Content-defined chunking by a gear rolling hash, over whole blocks of documents at once."""

from __future__ import annotations

import hashlib

import numpy as np

#: Bytes that the rolling hash covers.
WINDOW = 32


def byte_table(salt: str, width: int) -> np.ndarray:
    """A pseudo-random number of ``width`` bytes for every byte value."""
    rows = [hashlib.blake2b(bytes([b]), digest_size=width, key=salt.encode()).digest() for b in range(256)]
    return np.frombuffer(b"".join(rows), f"<u{width}")


GEAR = byte_table("gear", 4)


def gear(data: np.ndarray) -> np.ndarray:
    """At every byte the hash of it and the 31 before: sum of GEAR[b[i - j]] << j."""
    out = GEAR[data]
    step = 1
    while step < WINDOW:
        shifted = out[:-step] << np.uint32(step)
        out = out.copy()
        out[step:] += shifted
        step *= 2
    return out


def _inside(data: np.ndarray, bounds: np.ndarray, ends: np.ndarray, before: int, after: int) -> np.ndarray:
    """Those ends that have so many bytes of their own document before and after."""
    document = np.searchsorted(bounds, ends, side="left") - 1
    return ends[(ends - bounds[document] >= before) & (bounds[document + 1] - ends >= after)]


def masked_ends(data: np.ndarray, bounds: np.ndarray, bits: int, longest: int) -> np.ndarray:
    """Where chunks end: the top ``bits`` of the hash are zero, at most ``longest`` bytes on, or a document ends.

    A document's chunks depend on its own bytes only, whatever stands beside it.
    """
    ends = np.flatnonzero(gear(data) >> np.uint32(32 - bits) == 0) + 1
    ends = _inside(data, bounds, ends, WINDOW, 0)
    ends = np.unique(np.concatenate([ends, bounds[1:]]))
    ends = ends[ends > 0]
    sizes = np.diff(ends, prepend=0)
    extra = (sizes - 1) // longest
    if extra.any():
        index = np.arange(int(extra.sum())) - np.repeat(np.cumsum(extra) - extra, extra)
        forced = np.repeat(ends - sizes, extra) + (index + 1) * longest
        ends = np.sort(np.concatenate([ends, forced]))
    return ends


def word_gear(words: np.ndarray) -> np.ndarray:
    """At every word a hash of it and the word before, made from 64-bit digests as ``gear`` is from bytes."""
    out = (words.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    out[1:] += out[:-1].copy() << np.uint32(1)
    return out


def peak_ends(hashed: np.ndarray, bounds: np.ndarray, before: int, reach: int) -> np.ndarray:
    """Where chunks end: the hash is the largest within ``reach`` places on either side, or a document ends.

    ``hashed`` has a number per place, made of ``before`` places that end there.
    Peaks are more than ``reach`` places apart and seldom much farther than twice
    that, so a short passage holds whole chunks wherever it stands. Equal hashes
    are peaks each: a text that repeats one word is cut at every repetition.
    """
    size = len(hashed)
    ends = np.zeros(0, np.int64)
    if size > 2 * reach:
        top, width = hashed, 1
        while width * 2 <= reach:
            top = np.maximum(top[:-width], top[width:])
            width *= 2
        if width < reach:
            rest = reach - width
            top = np.maximum(top[: len(top) - rest], top[rest:])
        # top[i] is the largest of hashed[i : i + reach]
        middle = hashed[reach : size - reach]
        peaks = (middle >= top[: len(middle)]) & (middle >= top[reach + 1 : reach + 1 + len(middle)])
        ends = np.flatnonzero(peaks) + reach + 1
        ends = _inside(hashed, bounds, ends, before + reach, reach)
    ends = np.unique(np.concatenate([ends, bounds[1:]]))
    return ends[ends > 0]


def starts_of(ends: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], ends[:-1]]).astype(np.int64)


MIX = byte_table("digest", 8)
BASE = np.uint64(0x9E3779B97F4A7C15)


def chunk_digests(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit digest of every chunk of bytes, as signed numbers."""
    return _digests(MIX[data], ends)


def word_chunk_digests(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit digest of every chunk of words, which are given by their own digests."""
    return _digests(words.view(np.uint64), ends)


def _digests(numbers: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(ends):
        return np.zeros(0, np.int64)
    starts = starts_of(ends)
    sizes = ends - starts
    powers = np.multiply.accumulate(np.full(int(sizes.max()), BASE, np.uint64))
    terms = numbers * powers[np.arange(len(numbers)) - np.repeat(starts, sizes)]
    out = np.add.reduceat(terms, starts) + sizes.astype(np.uint64)
    for shift in (29, 32):
        out ^= out >> np.uint64(shift)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return (out ^ (out >> np.uint64(31))).view(np.int64)
