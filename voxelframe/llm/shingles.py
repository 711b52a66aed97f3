"""Five-word shingle sets as 64-bit hashes, and MinHash signatures over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import BLANK_SPLIT, U64, mix, slices, text_buffer, word_hashes

WORDS = 5
#: Signature: SYMBOLS minima, BITS bits of each.
SYMBOLS, BITS = 64, 16
_MULTIPLIERS = mix(np.arange(1, SYMBOLS + 1, dtype=U64) * U64(0xA0761D6478BD642F)) | U64(1)
_WEIGHTS = mix(np.arange(101, 101 + WORDS, dtype=U64)) | U64(1)


def shingle_sets(column: pa.Array):
    """Yield each text's sorted distinct shingle hashes.

    A text of one to four words has its whole sequence as the one shingle; a
    text without words, an empty and a null one have none.
    """
    raw, offsets = text_buffer(column)
    for i, j in slices(offsets):
        h, first, _, _ = word_hashes(raw, offsets[i : j + 1], BLANK_SPLIT)
        if len(h) >= WORDS:
            n = len(h) - WORDS + 1
            s = h[:n] * _WEIGHTS[0]
            for k in range(1, WORDS):
                s = s + h[k : k + n] * _WEIGHTS[k]
            s = mix(s)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= WORDS:
                yield np.unique(s[a : b - WORDS + 1])
            elif b > a:
                yield mix(np.array([(h[a:b] * _WEIGHTS[: b - a]).sum() + U64(b - a)], U64))
            else:
                yield h[:0]


def signature(shingles: np.ndarray) -> bytes:
    """SYMBOLS symbols of BITS bits, as little-endian bytes."""
    least = np.full(SYMBOLS, ~U64(0))
    for k in range(0, len(shingles), 2048):
        np.minimum(least, (_MULTIPLIERS[:, None] * shingles[None, k : k + 2048]).min(axis=1), out=least)
    return (least >> U64(8)).astype(np.uint16).tobytes()


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    a, b = mix(shingles + U64(0x51ED270B)), mix(shingles ^ U64(0xB492B66FBE98F273))
    return int(a.sum().astype(np.int64)), int(b.sum().astype(np.int64))
