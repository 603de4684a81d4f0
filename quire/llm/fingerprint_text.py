"""SimHash of one text: the pure part of the near-duplicate operator.

Words are runs of bytes other than ASCII white space, A-Z lower-cased; every
4-word shingle (repeats included) votes with the bits of its XXH64 (seed 42).
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import xxhash

SHINGLE = 4
SEED = 42
_CHUNK = 1 << 15


def shingle_hashes(data: bytes) -> np.ndarray:
    """XXH64 of every shingle, in text order; a shorter text is one shingle, a text without words none."""
    words = data.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return np.array([digest(joined, SEED)], np.uint64)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    ends = [e - 1 for e in starts[SHINGLE:]]
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(ends))


def simhash(data: bytes | None) -> int:
    """The 64-bit fingerprint as an unsigned integer; zero for a text without words."""
    hashes = shingle_hashes(data or b"")
    if not len(hashes):
        return 0
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        block = np.ascontiguousarray(hashes[at : at + _CHUNK]).view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * votes > len(hashes)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
