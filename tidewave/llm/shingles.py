"""Word shingles and their hashes, and the fingerprint that they vote for."""

from __future__ import annotations

import numpy as np
import xxhash

BITS = 64
SHINGLE = 3
SEED = 42
VOTES = 65_536


def votes(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), VOTES):  # a long text's bits need not lie in memory together
        part = hashes[at : at + VOTES].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def shingle_hashes(tokens: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of `shingle` words, joined by single spaces; of all words where there are fewer."""
    if not tokens:
        return np.zeros(0, np.uint64)
    text = memoryview(b" ".join(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    last = ends[min(shingle, len(tokens)) - 1 :]
    first = np.concatenate(([0], ends[: len(last) - 1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(text[a:b], SEED) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(last)
    )


def fingerprint_of(tokens: list[bytes], shingle: int = SHINGLE) -> int:
    """Of the lower-cased words of a text; no words give zero."""
    return votes(shingle_hashes(tokens, shingle)) if tokens else 0
