"""Words and hashes of whole Arrow text columns with numpy, for use inside Spark tasks.

A text column arrives as one buffer of UTF-8 bytes and an array of offsets.  Words, word hashes
and windows are then a few vector operations for a whole batch, with no loop over words.
Every hash is 64 bits wide and the same in all processes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text that are handled at once; a single longer text is taken whole.
SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64))


def byte_class(pattern: bytes) -> np.ndarray:
    """A table of 256 flags, set for the bytes listed."""
    table = np.zeros(256, bool)
    table[np.frombuffer(pattern, np.uint8)] = True
    return table


# Words are runs of anything but space, tab, line feed, vertical tab, form feed, carriage return.
NOT_SPACE = ~byte_class(b" \t\n\x0b\x0c\r")
# Words are runs of ASCII letters and digits and of all bytes outside ASCII.
WORD_BYTES = byte_class(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
# Lower case for A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows with at most ``limit`` bytes of text each."""
    for batch in batches:
        _, at = text_buffer(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(at, at[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def spans(raw: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of ``inside`` bytes; runs end with their row."""
    flags = np.zeros(len(raw) + 1, bool)
    flags[:-1] = inside[raw]
    first = flags.copy()
    first[1:] &= ~flags[:-1]
    cuts = at[1:-1]
    first[cuts] |= flags[cuts]
    first[-1] = False
    starts = np.flatnonzero(first)
    last = flags[:-1] & ~flags[1:]
    cuts = cuts[(cuts > 0) & (cuts <= len(raw))] - 1
    last[cuts] |= flags[cuts]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(at, starts, side="right") - 1


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span; spans are in order and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, low + SLICE_BYTES, side="right")))
        piece = raw[low : int(ends[j - 1])]
        power = np.full(len(piece) + 1, _BASE, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTE_CODE[piece] * power[:-1], out=sums[1:])
        power[1:] = _BASE_INVERSE
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[b] - sums[a]) * power[a] + (b - a).astype(np.uint64))
        i = j
    return out


def rolling(raw: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of ``size`` bytes."""
    power = np.full(len(raw) + 1, _BASE, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[raw] * power[:-1], out=sums[1:])
    power[1:] = _BASE_INVERSE
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    return mix((sums[size:] - sums[:-size]) * power[: len(raw) - size + 1])


def windows(hashes: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` consecutive words of one row, and the index of their first words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = mix(out + hashes[i : i + n])
    same = np.flatnonzero(row[:n] == row[size - 1 :])
    return out[same], same


def window_minima(values: np.ndarray, row: np.ndarray, size: int) -> np.ndarray:
    """Positions of the least value of any ``size`` neighbours in one row, all of them if some are equal.

    A row of fewer than ``size`` values is one window.
    """
    n = len(values)
    if not n or size == 1:
        return np.arange(n)
    bounds = np.flatnonzero(np.r_[True, row[1:] != row[:-1], True])
    chosen = np.zeros(n, bool)
    if n >= size:
        least = values.copy()
        width = 1
        while width < size:  # least[i] of values[i : i + width]
            step = min(width, size - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        least[row[: n - size + 1] != row[size - 1 :]] = 0
        # A value is chosen if it is the least of a window that holds it: the greatest of those least values.
        top = np.zeros(n + size - 1, values.dtype)
        top[size - 1 : n] = least
        width = 1
        while width < size:
            step = min(width, size - width)
            top = np.maximum(top[:-step], top[step:])
            width += step
        chosen = top == values
    lengths = np.diff(bounds)
    short = lengths < size
    if short.any():
        whole = np.repeat(np.minimum.reduceat(values, bounds[:-1]), lengths)
        chosen |= np.repeat(short, lengths) & (values == whole)
    return np.flatnonzero(chosen)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending whole numbers below 2**56 as bytes: of each step some low bits, as its size asks for, and then the rest
    as a byte, with 255 where 255 are added and more follows."""
    steps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    bits = 0
    while len(values) and int(values[-1]) >> bits >= 64 * len(values):
        bits += 1
    low = [(steps >> np.uint64(i)).astype(np.uint8) for i in range(0, bits, 8)]
    if bits % 8:
        low[-1] = np.packbits(np.unpackbits(low[-1][:, None], axis=1, count=bits % 8, bitorder="little"))
    more, rest = np.divmod(steps >> np.uint64(bits), np.uint64(255))
    place = np.cumsum(more.astype(np.int64) + 1)
    high = np.full(int(place[-1]) if len(place) else 0, 255, np.uint8)
    high[place - 1] = rest
    return bytes([bits]) + b"".join(part.tobytes() for part in [*low, high])


def unpack_sorted(data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers that `pack_sorted` was given."""
    raw = np.frombuffer(data, np.uint8)
    bits, raw = int(raw[0]), raw[1:]
    low = []
    for i in range(0, bits, 8):
        wide = min(8, bits - i)
        part, raw = raw[: (n * wide + 7) // 8], raw[(n * wide + 7) // 8 :]
        if wide < 8:
            part = np.packbits(np.unpackbits(part, count=n * wide).reshape(n, wide), axis=1, bitorder="little")[:, 0]
        low.append(np.cumsum(part, dtype=np.uint64) << np.uint64(i))
    return sum(low, np.cumsum(raw, dtype=np.uint64)[raw < 255] << np.uint64(bits))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
