"""Words, shingles and hashes of many texts at once, over the bytes of an Arrow batch."""

from __future__ import annotations

import numpy as np

from ._arrays import by_part

_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value for each byte, and the odd base of polynomial hashes modulo 2**64.
BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, and grown when a longer text comes."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[i] = sum of BYTE[data[j]] * BASE**j over j < i."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of data[start:end], equal for equal bytes wherever they stand."""
    return (prefix[end] - prefix[start]) * powers(BASE_INVERSE, len(prefix))[start]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all 64 (xor, shift and multiply)."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts that stand one after another, A-Z lower-cased.

    Returns the lower-cased bytes, the start and end of each word, and the first word of each text
    with the number of words at the end.
    """
    low = LOWER[data]
    solid = np.empty(len(low) + 2, bool)
    solid[0] = solid[-1] = False
    np.logical_not(SPACE[low], out=solid[1:-1])
    begin = solid[1:] & ~solid[:-1]
    stop = solid[:-1] & ~solid[1:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(low))]
    touching = inner[solid[inner] & solid[inner + 1]]  # a word ends where a text ends
    begin[touching] = True
    stop[touching] = True
    start, end = np.flatnonzero(begin), np.flatnonzero(stop)
    return low, start, end, np.searchsorted(start, bounds)


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and the first word of each text with the number of words at the end."""
    low, start, end, first = words(data, bounds)
    h = span_hash(prefix_hash(low), start, end) if len(start) else np.zeros(0, np.uint64)
    return mix(h + (end - start).astype(np.uint64)), first


_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct ``n``-word shingles of each text, sorted within it, and where each text's begin.

    A text of fewer words has its whole sequence as its one shingle; one without words has none.
    """
    count = np.diff(first)
    made = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    starts = np.concatenate([[0], np.cumsum(made)])
    owner = np.repeat(np.arange(len(count)), made)
    at = np.arange(starts[-1]) - np.repeat(starts[:-1] - first[:-1], made)
    left = first[owner + 1] - at
    out = np.minimum(left, n).astype(np.uint64)
    for k in range(n):
        inside = left > k
        if inside.all():
            out += h[at + k] * _PLACE[k]
        else:
            out[inside] += h[at[inside] + k] * _PLACE[k]
    out = mix(out)
    order = np.argsort(out)
    order = order[by_part(owner[order])]
    out, owner = out[order], owner[order]
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    out, owner = out[fresh], owner[fresh]
    return out, np.searchsorted(owner, np.arange(len(count) + 1))
