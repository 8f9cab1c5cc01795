"""Sequences in two bits a base, with a mask of special bases where there are any."""

from __future__ import annotations

import numpy as np

_CODE = np.full(256, 4, np.uint8)
_CODE[list(b"ACGT")] = range(4)
#: The four bases of a byte, the first in its lowest bits.
_FOUR = np.array([[byte >> shift & 3 for shift in (0, 2, 4, 6)] for byte in range(256)], np.uint8)


def codes(seq: str) -> np.ndarray:
    """0 .. 3 for A, C, G, T, 4 for any other letter."""
    return _CODE[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]


def pack(code: np.ndarray) -> bytes:
    """How many bases (4 bytes), whether some are special (1), two bits each, and then a bit each if so."""
    n = len(code)
    four = np.zeros((-(-n // 4), 4), np.uint8)
    four.reshape(-1)[:n] = code & 3
    bits = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    special = code == 4
    some = bool(special.any())
    return n.to_bytes(4, "little") + bytes([some]) + bits.tobytes() + (np.packbits(special).tobytes() if some else b"")


def size(packed: bytes) -> int:
    return int.from_bytes(packed[:4], "little")


def unpack(packed: bytes) -> np.ndarray:
    n = size(packed)
    bits = np.frombuffer(packed, np.uint8, -(-n // 4), 5)
    code = _FOUR[bits].reshape(-1)[:n]
    if packed[4]:
        code[np.unpackbits(np.frombuffer(packed, np.uint8, offset=5 + len(bits)), count=n).astype(bool)] = 4
    return code
