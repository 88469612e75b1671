"""Arrow text <-> numpy code points, without a string call per row.

A text column is one flat ``uint32`` array of code points and an ``int64``
array of n + 1 row offsets.  Nulls are empty rows; the caller keeps the mask.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1_000_000  # bytes of text of which arrays are made at a time


def from_arrow(col) -> tuple[np.ndarray, np.ndarray]:
    """Code points and row offsets of an Arrow string array."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks != 1 else col.chunk(0)
    col = col.cast(pa.large_string())
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64, n + 1, col.offset * 8)
    lo, hi = int(off[0]), int(off[-1])
    raw = bytes(memoryview(data)[lo:hi]) if data is not None else b""
    cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(cp) == len(raw):
        return cp, off - lo
    starts = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    count = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(starts, out=count[1:])
    return cp, count[off - lo]


def from_list(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) if t else 0 for t in texts], out=off[1:])
    return np.frombuffer("".join(t for t in texts if t).encode("utf-32-le", "surrogatepass"), np.uint32), off


def to_arrow(cp: np.ndarray, off: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """The reverse of from_arrow."""
    raw = np.ascontiguousarray(cp, dtype="<u4").tobytes().decode("utf-32-le").encode("utf-8")
    size = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    at = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    valid = None
    if null is not None and null.any():
        valid = pa.array(~null).buffers()[1]
    return pa.Array.from_buffers(
        pa.large_string(), len(off) - 1, [valid, pa.py_buffer(at[off].astype(np.int64).tobytes()), pa.py_buffer(raw)]
    ).cast(pa.string())


def rows_of(off: np.ndarray) -> np.ndarray:
    """The row number of every code point."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def table(fn, dtype=np.uint8, size: int = 0x110000) -> np.ndarray:
    """A lookup table over all code points; fn gets one character."""
    out = np.zeros(size, dtype)
    for c in range(size):
        if not 0xD800 <= c <= 0xDFFF:
            v = fn(chr(c))
            if v:
                out[c] = v
    return out


def pieces(batch: pa.RecordBatch, *columns: str):
    """Cuts a batch at row borders so that a piece has about PIECE bytes of text in its text columns, or one row."""
    size = np.zeros(batch.num_rows, np.int64)
    for c in columns:
        size += pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(size)])
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PIECE, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def frames(pdf, column: str):
    """The same for a pandas frame, by characters."""
    upto = np.cumsum([0, *(len(x) if isinstance(x, str) else 0 for x in pdf[column])])
    lo = 0
    while lo < len(pdf):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PIECE // 4, "right")) - 1)
        yield pdf.iloc[lo:hi]
        lo = hi
