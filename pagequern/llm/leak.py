"""Problem 8: passages of held-out texts inside a corpus, by Wu-Manber search.

Every run of ``span`` consecutive words of an item is a pattern.  The search
works on words: blocks of two words index a shift table; where the shift of the
block at the end of the window is positive, the window moves by it unseen; where
it is 0, the hash of the window's last words selects the patterns of a bucket and
all words of window and pattern are compared.  Many windows (one a lane) move at
a time, a lane being a stretch of one cell, so no window crosses a cell.

Words are compared by their 64-bit hashes.  The shift table has SPARSE entries for
every word of the patterns, so its windows move as fast for many items as for few.
Items are searched in blocks of a bounded number, so what a task holds does not
grow with the number of items; each block is one more pass over the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import codepoints as C
from . import words as W

SPAN = 15
BLOCK = 2
LEAST_BITS, MOST_BITS = 16, 26  # of the shift table
SPARSE = 8  # entries of the shift table for every word of the patterns
LANE = 512
ITEMS_PER_PASS = 20_000


class Patterns:
    """Shift table, suffix buckets and pattern words for a block of items."""

    def __init__(self, ids: list[int], texts: list[str], span: int = SPAN):
        self.span = span
        cp, off = C.from_list(texts)
        first, _, h = W.find(cp, off)
        item = np.searchsorted(off, first, "right") - 1
        start = np.arange(max(len(h) - span + 1, 0))
        start = start[item[start] == item[start + span - 1]] if len(start) else start
        self.words = h
        self.first = start
        self.item = np.array(ids, np.int64)[item[start]] if len(start) else np.zeros(0, np.int64)
        # so large that most blocks of a text are in no pattern and shift the window by its whole length
        self.bits = int(np.clip(np.ceil(np.log2(max(1, SPARSE * len(h)))), LEAST_BITS, MOST_BITS))
        self.shift = np.full(1 << self.bits, span - BLOCK + 1, np.uint8)
        for j in range(BLOCK, span + 1):  # block ends after j words of the pattern
            code = self.code(h, start + j - 1)
            np.minimum.at(self.shift, code, np.uint8(span - j))
        suffix = self.suffix(h, start + span - 1)
        order = np.argsort(suffix, kind="stable")
        self.first, self.item, self.bucket = start[order], self.item[order], suffix[order]

    def code(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((h[at] + (h[at - 1] << np.uint64(1))) >> np.uint64(64 - self.bits)).astype(np.int64)

    @staticmethod
    def suffix(h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hash of the last two blocks of a window."""
        return W.mix(h[at] + (h[at - 1] << np.uint64(1)) + h[at - 2] * W.MULT + (h[at - 3] << np.uint64(3)))


def scan(p: Patterns, h: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word position of a window's end, item) of all occurrences in word hashes h."""
    span, n = p.span, len(h)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n < span or not len(p.first):
        return none
    edge = np.flatnonzero(np.diff(seg)) + 1
    lo = np.concatenate([[0], edge])
    hi = np.concatenate([edge, [n]])
    long = hi - lo >= span
    lo, hi = lo[long], hi[long]
    pieces = (hi - lo - span) // LANE + 1
    lane_lo = np.repeat(lo, pieces) + LANE * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    stop = np.minimum(lane_lo + LANE + span - 1, np.repeat(hi, pieces))  # windows end before stop
    at = lane_lo + span - 1
    found_at, found_item = [], []
    while len(at):
        s = p.shift[p.code(h, at)].astype(np.int64)
        zero = s == 0
        if zero.any():
            end = at[zero]
            key = p.suffix(h, end)
            a = np.searchsorted(p.bucket, key, "left")
            b = np.searchsorted(p.bucket, key, "right")
            m = b > a
            end, a, b = end[m], a[m], b[m]
            if len(end):
                k = b - a
                cand = np.repeat(a, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                end = np.repeat(end, k)
                back = np.arange(span)
                same = (h[end[:, None] - back] == p.words[(p.first[cand] + span - 1)[:, None] - back]).all(1)
                found_at.append(end[same])
                found_item.append(p.item[cand[same]])
        at = at + np.maximum(s, 1)
        live = at < stop
        at, stop = at[live], stop[live]
    if not found_at:
        return none
    return np.concatenate(found_at), np.concatenate(found_item)


def _cells(batch: pa.RecordBatch, off: np.ndarray) -> np.ndarray:
    """Positions at which a cell begins or ends, and all row offsets, sorted."""
    parts = [off]
    start, length = batch.column("cell_start"), batch.column("cell_len")
    rows = np.repeat(np.arange(len(start)), np.nan_to_num(start.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
    s = start.flatten().to_numpy(zero_copy_only=False).astype(float)
    e = s + length.flatten().to_numpy(zero_copy_only=False).astype(float)
    for x in (s, e):
        ok = ~np.isnan(x)
        pos = off[rows[ok]] + x[ok].astype(np.int64)
        parts.append(np.clip(pos, off[rows[ok]], off[rows[ok] + 1]))
    return np.unique(np.concatenate(parts))


def _search(batches, patterns: Patterns):
    for whole in batches:
        for b in C.pieces(whole, "text"):
            cp, off = C.from_arrow(b.column("text"))
            breaks = _cells(b, off)
            first, _, h = W.find(cp, breaks)
            seg = np.searchsorted(breaks, first, "right")
            at, item = scan(patterns, h, seg)
            if len(at):
                row = np.searchsorted(off, first[at], "right") - 1
                pair = np.unique(np.stack([row, item]), axis=1)
                ids = b.column("doc_id").take(pa.array(pair[0]))
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(pair[1])], names=["doc_id", "item_id"])


def leaked_items(documents, items, span: int = SPAN):
    """(doc_id, item_id) of every item with ``span`` consecutive words in one cell of a document.

    documents: doc_id, text, cells (array of structs with start_pos, len_chars);
    items: item_id, text; further columns are ignored.  Null or empty texts and
    items shorter than span words give nothing; null cells make the text one cell;
    text outside the cells is searched by itself; rows are distinct.
    """
    from pyspark.sql import functions as F

    items = items.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    docs = documents.where("text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.coalesce(F.col("cells.start_pos"), F.array().cast("array<int>")).alias("cell_start"),
        F.coalesce(F.col("cells.len_chars"), F.array().cast("array<int>")).alias("cell_len"),
    )
    passes = max(1, -(-items.count() // ITEMS_PER_PASS))
    out = None
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k) if passes > 1 else items
        rows = part.collect()  # at most about ITEMS_PER_PASS items
        patterns = Patterns([r.item_id for r in rows], [r.text for r in rows], span)
        found = docs.mapInArrow(lambda b, p=patterns: _search(b, p), "doc_id long, item_id long")
        out = found if out is None else out.unionByName(found)
    return out.distinct()
