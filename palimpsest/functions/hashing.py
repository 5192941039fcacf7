"""The exact slice hash: 32-bit Murmur3, seed 0, of (table id, key length, key).

Spark's own ``hash`` is another variant, so this one is a vectorised function over Arrow batches. The
table id counts as eight bytes and the length as four, little-endian.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

_MASK = np.uint64(0xFFFFFFFF)
#: Fixed values of Murmur3's 32-bit variant.
_C1, _C2 = np.uint64(0xCC9E2D51), np.uint64(0x1B873593)


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return ((x << np.uint64(by)) | (x >> np.uint64(32 - by))) & _MASK


def murmur32(rows: list[bytes]) -> np.ndarray:
    """Unsigned hashes of byte strings, computed column by column for all rows of a length."""
    out = np.zeros(len(rows), np.uint64)
    lengths = np.array([len(r) for r in rows], np.int64)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        whole = np.zeros((len(at), -(-int(n) // 4) * 4), np.uint8)
        whole[:, : int(n)] = np.frombuffer(b"".join(rows[i] for i in at), np.uint8).reshape(len(at), int(n))
        blocks = whole.reshape(len(at), -1, 4).astype(np.uint64) @ (np.uint64(1) << np.arange(0, 32, 8, dtype=np.uint64)) if n else np.zeros((len(at), 0), np.uint64)
        h = np.zeros(len(at), np.uint64)
        for i in range(blocks.shape[1]):
            k = _rotate(blocks[:, i] * _C1 & _MASK, 15) * _C2 & _MASK
            h ^= k
            if 4 * i + 4 <= n:
                h = (_rotate(h, 13) * np.uint64(5) + np.uint64(0xE6546B64)) & _MASK
        h ^= np.uint64(n)
        h = (h ^ (h >> np.uint64(16))) * np.uint64(0x85EBCA6B) & _MASK
        h = (h ^ (h >> np.uint64(13))) * np.uint64(0xC2B2AE35) & _MASK
        out[at] = h ^ (h >> np.uint64(16))
    return out


def coordinate(table_id: int, key: bytes) -> bytes:
    return table_id.to_bytes(8, "little") + len(key).to_bytes(4, "little") + key


@F.pandas_udf(LongType())
def _slice_hash(table_id: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(murmur32([coordinate(int(t), bytes(k or b"")) for t, k in zip(table_id, key, strict=True)]).astype(np.int64))


def slice_hash(table_id: Column, key: Column) -> Column:
    """The hash that exact slices and placement use, as a long of 32 bits; keep it as a column where it filters often."""
    return _slice_hash(table_id, key)
