"""The position-keyed byte coding of the binary files; encoding and decoding are the same."""

from __future__ import annotations

import numpy as np

_KEYS = np.array([7 ^ k for k in range(101)], dtype=np.uint8)


def coded(data: bytes, position: int = 0) -> bytes:
    """Every byte combined with 7 and (its absolute position + 4) mod 101."""
    n = len(data)
    keys = np.resize(np.roll(_KEYS, -((position + 4) % 101)), n)
    return (np.frombuffer(data, dtype=np.uint8) ^ keys).tobytes()


def phases(data: bytes) -> list[bytes]:
    """The data decoded at each of the 101 places in the key sequence."""
    return [coded(data, p) for p in range(101)]


def score(text: bytes) -> int:
    """How much a decoded slice looks like records: printable bytes and tags for it, other bytes against it."""
    codes = np.frombuffer(text, dtype=np.uint8)
    good = ((codes >= 32) & (codes < 127)).sum() + 4 * ((codes >= 0xB5) & (codes <= 0xDF)).sum()
    return int(good - 2 * ((codes < 32) | (codes == 127)).sum())


def candidates(data: bytes) -> list[tuple[int, int]]:
    """(phase, score) by falling score, then phase: a diagnosis, not how records are found."""
    return sorted(((p, score(t)) for p, t in enumerate(phases(data))), key=lambda x: (-x[1], x[0]))
