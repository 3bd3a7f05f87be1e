"""Vectorised work on the UTF-8 bytes of Arrow string columns.

All functions take whole buffers, so a batch of documents costs a fixed number of
numpy calls.  Hashes are 64-bit polynomials over per-byte random values, finished
with a splitmix round; an odd base has an inverse modulo 2**64, so the hash of any
slice comes from two prefix sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd bases of the polynomials and their inverses; the second serves where 64 bits do not suffice.
_BASES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
_INVERSES = [pow(b, -1, 1 << 64) for b in _BASES]
_BYTE_VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_tables: dict[int, np.ndarray] = {}

#: The separators of the word pattern [^\x20\x09-\x0D]+, as a table over bytes.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64's finisher: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _tables.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        _tables[base] = have
    return have[:n]


def prefix_hashes(values: np.ndarray, which: int = 0) -> np.ndarray:
    """P with P[i] = sum of values[j] * base**j for j < i; which: the base."""
    out = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values * powers(_BASES[which], len(values)), out=out[1:])
    return out


def slice_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of values[start:end] for each pair, independent of where it stands."""
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * powers(_INVERSES[which], len(prefix))[start] + (end - start).astype(np.uint64))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES[data]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int = 1 << 20):
    """(first, last) ranges of documents whose bytes together stay under most; a longer document stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every word [^\\x20\\x09-\\x0D]+ ; words never cross documents."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~IS_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def whole_keys(batches, key: int):
    """Batches recut so that rows of one key, which follow each other, are never parted."""
    held: list[pa.Table] = []
    for batch in batches:
        keys = batch.column(key).to_numpy()
        if not len(keys):
            continue
        part = pa.Table.from_batches([batch])
        other = np.flatnonzero(keys != keys[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield pa.concat_tables([*held, part.slice(0, cut)])
            held = []
        elif held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.concat_tables(held)
            held = []
        held.append(part.slice(cut))
    if held:
        yield pa.concat_tables(held)
