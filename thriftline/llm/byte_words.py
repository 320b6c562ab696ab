"""Words of many texts at once: stretches of UTF-8 bytes of some classes, found by array operations."""
from __future__ import annotations

import numpy as np
import pyarrow as pa

#: A-Z as a-z.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def array_of(starts: np.ndarray, inside: np.ndarray, data: np.ndarray) -> pa.Array:
    """The stretches of ``data`` that begin at ``starts`` and are ``inside``, as binaries (64-bit offsets)."""
    letters = data[inside]
    before = np.concatenate([[0], np.cumsum(inside)])  # bytes inside before each byte
    ends = np.concatenate([before[starts], [len(letters)]])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(letters)])
