"""Words, word hashes and Arrow helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Multiplier of the rolling polynomial over word hashes (odd, so invertible).
STEP = np.uint64(0x9E3779B97F4A7C15)


def utf8_rows(column: pa.Array) -> Iterator[bytes | None]:
    """UTF-8 bytes of each row of a string column, None for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    view = memoryview(data) if data is not None else memoryview(b"")
    valid = column.is_valid().to_pylist() if column.null_count else None
    for i in range(len(column)):
        yield None if valid is not None and not valid[i] else bytes(view[ends[i] : ends[i + 1]])


def spaced(text: bytes | None) -> list[bytes]:
    """Words as maximal runs without space or U+0009-U+000D; null has none."""
    return text.split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit hash for each run of ``size`` words; empty when there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        for k in range(1, size):
            out = out * STEP + hashes[k : k + n]
    return mix(out)


def list_of(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """List column from one numpy array per row."""
    lengths = np.fromiter(map(len, values), np.int64, len(values))
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    flat = np.concatenate(values) if len(values) else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))
