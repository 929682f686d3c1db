"""Word shingles of whole texts, as hashes."""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42
#: Hashes whose bits are added up together.
_AT_ONCE = 1 << 16


def shingle_hashes(text: str | None, shingle_words: int) -> np.ndarray:
    """XXH64 of each shingle of a text with A-Z in lower case, repeats included, as unsigned numbers.

    Words are runs of characters other than space and \\x09-\\x0D. A text of fewer words is one shingle, one without
    words none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    k = min(shingle_words, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = len(words) - k + 1
    del words
    out = np.empty(n, dtype=np.uint64)
    for at in range(0, n, _AT_ONCE):
        to = min(n, at + _AT_ONCE)
        places = zip(starts[at:to].tolist(), ends[at + k - 1 : to + k - 1].tolist(), strict=True)
        out[at:to] = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in places]
    return out


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash: a bit is 1 if it is set in over half the hashes; no hashes: 0."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, hashes.size, _AT_ONCE):
        part = hashes[at : at + _AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > hashes.size, bitorder="little").tobytes(), "little")


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """The sorted distinct hashes, as signed numbers."""
    return np.unique(hashes.view(np.int64))
