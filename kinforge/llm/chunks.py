"""Columns of texts as ids, by way of their distinct chunks.

A column's UTF-8 bytes are cut where the runs of the tokenizers always end: before a space that something
else than white space follows, on both sides of a line end between other characters, and between a letter
and a mark of ``.,;:!?``. What stands left of a cut never changes the ids right of it. The chunks of a
slice are reduced to distinct ones by Arrow's dictionary encoding, only those are looked up or encoded,
and the ids of all texts are gathered from them by numpy. Ids are little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def _flags(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for first, last in ranges:
        out[first : last + 1] = True
    return out


#: First bytes of characters that surely are no white space. Beyond ASCII that depends on more bytes after C2, E1, E2, E3.
_SOLID = _flags((0x21, 0x7E), (0xC3, 0xE0), (0xE4, 0xF4))
_LETTER = _flags((0x41, 0x5A), (0x61, 0x7A))
_MARK = np.isin(np.arange(256), list(b".,;:!?"))


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in slices of about SLICE_BYTES of text."""
    sizes = np.frombuffer(batch.column(column).buffers()[1], "<i4")[batch.column(column).offset :][: batch.num_rows + 1].astype(np.int64) if batch.num_rows else np.zeros(1)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, borders) of a string or binary column without nulls; text i is bytes[borders[i]:borders[i + 1]]."""
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    borders = np.frombuffer(column.buffers()[1], "<i4")[column.offset :][: len(column) + 1].astype(np.int64)
    data = np.empty(0, np.uint8) if column.buffers()[2] is None else np.frombuffer(column.buffers()[2], np.uint8)[borders[0] : borders[-1]]
    return data, borders - borders[0]


def cuts(data: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Ascending places at which ``data`` may be cut, its borders and both ends among them."""
    n = len(data)
    if not n:
        return np.zeros(1, np.int64)
    at = np.zeros(n + 1, bool)
    first = borders[borders < n]
    begins = _SOLID[data]
    begins[first] = False  # what stands before a border is not what comes before the text after it
    at[: n - 1] = (data[:-1] == 0x20) & begins[1:]
    two = np.zeros(n, bool)  # the last byte of a character of two bytes, none of which is white space from C3 on
    two[1:] = (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
    ends = ((data > 0x20) & (data < 0x7F)) | two
    line = np.zeros(n, bool)
    line[1:-1] = (data[1:-1] == 0x0A) & ends[:-2] & begins[2:]
    line[first] = False
    at[:n] |= line
    at[1:] |= line
    latin = np.zeros(n, bool)  # U+00C0 to U+00FF but for the two signs among them
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    at[1:n] |= (_LETTER[data] | latin)[:-1] & _MARK[data[1:]]
    at[borders] = True
    at[[0, n]] = True
    return np.flatnonzero(at)


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the runs ``values[starts[w] : starts[w] + sizes[w]]`` for each of ``which`` in a row, where each of them ends)."""
    long = sizes[which]
    ends = np.cumsum(long, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    at = np.repeat((starts[which] - (ends - long)).astype(kind), long)
    at += np.arange(total, dtype=kind)
    return values[at], ends


def encoded(data: np.ndarray, borders: np.ndarray, ids_of: Mapping[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, ``len(borders)`` bounds of each text's ids); ``ids_of`` has the ids of a chunk as bytes."""
    at = cuts(data, borders)
    if len(at) < 2:
        return np.empty(0, "<u4"), np.zeros(len(borders), np.int64)
    chunks = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype("<i4")), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    parts = list(map(ids_of.__getitem__, chunks.dictionary.to_pylist()))
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    ids, ends = gathered(np.frombuffer(b"".join(parts), "<u4"), np.cumsum(sizes) - sizes, sizes, chunks.indices.to_numpy())
    return ids, np.r_[0, ends][np.searchsorted(at, borders)]


def closed(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end`` after each text."""
    return np.insert(ids, bounds[1:], end).astype("<u4"), bounds + np.arange(len(bounds))


def binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Runs of a flat array as a binary column."""
    width = values.dtype.itemsize
    if len(values) * width < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype("<i4")), pa.py_buffer(np.ascontiguousarray(values))])
    raw = values.tobytes()
    return pa.array([raw[a:b] for a, b in zip((bounds[:-1] * width).tolist(), (bounds[1:] * width).tolist(), strict=True)], pa.binary())
