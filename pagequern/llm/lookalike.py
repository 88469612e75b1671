"""Problem 3: one form for texts that look the same.

Every step is a gather over a flat code-point array of a whole Arrow batch:

1. width, font and ligature variants, decomposable letters, every kind of space
   and invisible characters are looked up; characters with an expansion of
   several code points (or none) are written through prefix-summed offsets;
2. marks are put into canonical order and composed with their starter, the k-th
   mark of all clusters at a time;
3. letters of another script inside a word take the look-alike of the script
   that most letters of the word can only belong to.

``form`` is the readable result of the three steps.  ``key`` goes on to fold all
look-alike letters to one prototype, so it is equal exactly for texts that look
the same.  Letter case, accents, punctuation, digits and super- or subscripts
are kept.  Null gives null; empty or blank text gives an empty form.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa

from ..plans.lineage import cut
from . import codepoints as C

# Letters that look like a Latin letter, by script.
CYRILLIC = "АВЕЅІЈКМНОРСТУХҮԚԜавеѕіјкмнорстухһԁԛԝѵү"
CYRILLIC_AS = "ABESIJKMHOPCTYXYQWaBesijkMHopcTyxhdqwvy"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοννικαρυγ"
GREEK_AS = "ABEZHIKMNOPTYXovvikapuy"
# Lower-case Cyrillic letters whose look is only that of a small capital are left alone.
SMALL_CAPITAL = "вкмнт"
FOLDED = {"<wide>", "<narrow>", "<font>", "<compat>"}
SPACE, GONE = 1, 2


@functools.lru_cache(1)
def tables():
    """(expansion offsets, expansion code points, class, combining class, pair keys, pair values, latin, cyrillic, script)."""
    first: dict[int, str] = {}
    kind = np.zeros(0x110000, np.uint8)
    ccc = np.zeros(0x110000, np.uint8)
    pairs: dict[int, int] = {}
    for c in range(0x110000):
        if 0xD800 <= c <= 0xDFFF:
            continue
        ch = chr(c)
        cat = unicodedata.category(ch)
        if cat == "Cn":
            continue
        ccc[c] = unicodedata.combining(ch)
        if cat in ("Zs", "Zl", "Zp") or ch in "\t\n\r\v\f":
            kind[c] = SPACE
            if c != 0x20:
                first[c] = " "
            continue
        if cat == "Cf" or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF or c in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0):
            kind[c] = GONE
            first[c] = ""
            continue
        if c in (0x2010, 0x2011):  # hyphens that differ only in line breaking
            first[c] = "-"
            continue
        d = unicodedata.decomposition(ch)
        if not d:
            continue
        parts = d.split()
        if parts[0].startswith("<"):
            letter = cat[0] in "LMNP" or cat == "So"
            if parts[0] in FOLDED and letter and c not in (0x2026, 0x2025) and (cat[0] != "N" or parts[0] != "<compat>"):
                first[c] = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", ch))
        else:
            first[c] = unicodedata.normalize("NFD", ch)
            if len(parts) == 2 and unicodedata.normalize("NFC", ch) == ch:
                pairs[(int(parts[0], 16) << 21) | int(parts[1], 16)] = c
    length = np.ones(0x110000, np.int32)
    for c, s in first.items():
        length[c] = len(s)
    begin = np.zeros(0x110000 + 1, np.int64)
    many = {c: s for c, s in first.items() if len(s) > 1}
    pool: list[int] = []
    for c, s in many.items():
        begin[c] = len(pool)
        pool += map(ord, s)
    single = np.arange(0x110000, dtype=np.uint32)
    for c, s in first.items():
        if len(s) == 1:
            single[c] = ord(s)
    keys = np.array(sorted(pairs), np.int64)
    values = np.array([pairs[k] for k in keys.tolist()], np.uint32)
    latin = np.arange(0x110000, dtype=np.uint32)
    cyrillic = np.arange(0x110000, dtype=np.uint32)
    # script: 1 Latin, 2 Cyrillic, 3 Greek; +4 where another script has the same look
    script = np.zeros(0x250, np.uint8)
    script = np.concatenate([script, np.zeros(0x110000 - 0x250, np.uint8)])
    for c in range(0x41, 0x250):
        if chr(c).isalpha():
            script[c] = 1
    script[0x400:0x530] = 2
    script[0x370:0x400] = 3
    for src, dst in ((GREEK, GREEK_AS), (CYRILLIC, CYRILLIC_AS)):
        for a, b in zip(src, dst):
            if a in SMALL_CAPITAL:
                continue
            latin[ord(a)] = ord(b)
            script[ord(a)] |= 4
            script[ord(b)] |= 4
            if src is CYRILLIC:
                cyrillic[ord(b)] = ord(a)
    return length, begin, np.array(pool, np.uint32), single, kind, ccc, keys, values, latin, cyrillic, script


@functools.lru_cache(1)
def _seconds() -> np.ndarray:
    """True for code points that are the second of a composable pair."""
    out = np.zeros(0x110000, bool)
    out[tables()[6] & 0x1FFFFF] = True
    return out


def _compose(cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order, then composition of marks with their starters."""
    _, _, _, _, _, ccc_of, keys, values, _, _, _ = tables()
    ccc = ccc_of[cp]
    mark = ccc > 0
    # vowel signs and the like may compose although their class is 0: only pairs known to compose matter
    if not (mark.any() or _seconds()[cp].any()):
        return cp, row
    new_row = np.ones(len(cp), bool)
    new_row[1:] = row[1:] != row[:-1]
    starter = ~mark | new_row
    cluster = np.cumsum(starter) - 1
    wrong = np.flatnonzero(mark[1:] & mark[:-1] & ~new_row[1:] & (ccc[1:] < ccc[:-1])) + 1
    if len(wrong):
        at = np.flatnonzero(np.isin(cluster, cluster[wrong]))
        order = at[np.lexsort((ccc[at], cluster[at]))]
        cp, ccc = cp.copy(), ccc.copy()
        cp[at], ccc[at] = cp[order], ccc[order]
    head = np.flatnonzero(np.diff(cluster, prepend=-1))
    nth = np.arange(len(cp)) - head[cluster]
    marks = np.flatnonzero(nth)
    base = cp[head].copy()
    last = np.zeros(len(head), np.int64)
    keep = np.ones(len(cp), bool)
    deepest = int(nth.max(initial=0))
    for k in range(1, deepest + 1):
        at = marks[nth[marks] == k]
        cl = cluster[at]
        free = (last[cl] == 0) | (last[cl] < ccc[at])
        key = (base[cl].astype(np.int64) << 21) | cp[at]
        pos = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = free & (keys[pos] == key)
        base[cl[hit]] = values[pos[hit]]
        keep[at[hit]] = False
        last[cl[~hit]] = ccc[at[~hit]]
    cp = cp.copy()
    cp[head] = base
    cp, row = cp[keep], row[keep]
    # starters that compose with a following starter (class 0 vowel signs)
    for _ in range(2):
        if len(cp) < 2:
            break
        key = (cp[:-1].astype(np.int64) << 21) | cp[1:]
        pos = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = np.flatnonzero((keys[pos] == key) & (row[:-1] == row[1:]))
        if not len(hit):
            break
        hit = hit[np.diff(hit, prepend=-2) > 1]
        cp[hit] = values[pos[hit]]
        cp, row = np.delete(cp, hit + 1), np.delete(row, hit + 1)
    return cp, row


def _one_script(cp: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Gives look-alikes of another script the script of their word."""
    _, _, _, _, _, ccc, _, _, latin, cyrillic, script_of = tables()
    s = script_of[cp]
    letter = (s > 0) | (ccc[cp] > 0)
    if not ((s & 3) > 1).any():
        return cp
    start = letter.copy()
    start[1:] &= ~(letter[:-1] & (row[1:] == row[:-1]))
    word = np.cumsum(start) - 1
    word[~letter] = -1
    n = int(start.sum())
    kind = s & 3
    count = [np.bincount(word[letter & (kind == k)], minlength=n) for k in (1, 2, 3)]
    sure = [np.bincount(word[letter & (kind == k) & (s < 4)], minlength=n) for k in (1, 2, 3)]
    to_latin = (count[0] > 0) & (count[1] + count[2] > 0) & ((sure[0] > sure[1]) | ((sure[0] == sure[1]) & (count[0] >= count[1])))
    to_latin |= (count[0] > 0) & (count[2] > 0) & (count[1] == 0)
    to_cyrillic = (count[1] > 0) & (count[0] > 0) & ~to_latin
    out = cp.copy()
    w = np.maximum(word, 0)
    if n:
        m = letter & to_latin[w]
        out[m] = latin[cp[m]]
        m = letter & to_cyrillic[w]
        out[m] = cyrillic[cp[m]]
    return out


def normalise(cp: np.ndarray, off: np.ndarray):
    """(form code points, form offsets, key code points, key offsets)."""
    length, begin, pool, single, kind, _, _, _, latin, _, _ = tables()
    n = len(off) - 1
    row = C.rows_of(off)
    size = length[cp]
    if (size == 1).all():
        out = single[cp]
    else:
        row = np.repeat(row, size)
        src = np.repeat(cp, size)
        at = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        within = np.arange(at[-1]) - np.repeat(at[:-1], size)
        out = np.where(np.repeat(size, size) > 1, pool[np.minimum(begin[src] + within, max(len(pool) - 1, 0))], single[src])
    form, form_off = _outer(*_compose(_one_script(out, row), row), n)
    key, key_off = _outer(*_compose(latin[out], row), n)
    return form, form_off, key, key_off


def _outer(out: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Drops outer spaces, which cannot be seen; returns code points and offsets."""
    space = out == 0x20
    if space.any():
        # a space goes if no solid character precedes or follows it in its row
        solid = np.flatnonzero(~space)
        lo = np.full(n, len(out) + 1)
        hi = np.full(n, -1)
        r = row[solid]
        edge = np.ones(len(r), bool)
        edge[1:] = r[1:] != r[:-1]
        lo[r[edge]] = solid[edge]
        edge = np.ones(len(r), bool)
        edge[:-1] = r[1:] != r[:-1]
        hi[r[edge]] = solid[edge]
        i = np.arange(len(out))
        keep = (i >= lo[row]) & (i <= hi[row])
        out, row = out[keep], row[keep]
    off = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(row, minlength=n), out=off[1:])
    return out, off


def normalise_batch(col: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(form, key) of an Arrow string column."""
    null = np.asarray(col.is_null())
    cp, off = C.from_arrow(col)
    form, form_off, key, key_off = normalise(cp, off)
    return C.to_arrow(form, form_off, null), C.to_arrow(key, key_off, null)


def normalise_columns(df, columns: list[str]):
    """Adds ``<column>_form`` and ``<column>_key`` for each text column.

    All other columns pass through; a clash with an existing name is an error.
    """
    from pyspark.sql import types as T

    new = [f"{c}_{k}" for c in columns for k in ("form", "key")]
    clash = set(new) & set(df.columns)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    schema = T.StructType(df.schema.fields + [T.StructField(c, T.StringType()) for c in new])

    def run(batches):
        for b in (piece for whole in batches for piece in C.pieces(whole, *columns)):
            arrays, names = list(b.columns), list(b.schema.names)
            for c in columns:
                arrays += normalise_batch(b.column(names.index(c)))
            yield pa.RecordBatch.from_arrays(arrays, names=names + new)

    return df.mapInArrow(run, schema)


BLOCK = 2_000  # rows of a class that one task pairs at a time


class SameLook:
    """Rows of df (an id and text columns) by the look of their values, field by field.

    Nulls, blanks and repeated rows give nothing.  Values are normalised once; only
    hashes are exchanged.  A class is what looks the same; only those with more than
    one variant are kept, so a value shared by a third of all rows meets nothing
    unless it has a look-alike.
    """

    def __init__(self, df, id_col: str, fields: list[str]):
        from pyspark.sql import functions as F

        long = df.select(
            F.col(id_col).cast("long").alias("id"),
            F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])).alias("x"),
        ).select("id", "x.field_name", "x.value")
        keyed = normalise_columns(long.where(F.col("value").isNotNull()), ["value"]).where(F.length("value_key") > 0)
        keyed = cut(keyed.select("id", "field_name", F.md5("value_key").alias("key"), F.md5("value").alias("raw")).distinct())
        variants = keyed.groupBy("field_name", "key", "raw").agg(F.count("*").alias("n"))
        several = variants.groupBy("field_name", "key").agg(F.sum("n").alias("rows"), F.count("*").alias("variants")).where("variants > 1")
        self.members = cut(keyed.join(several, ["field_name", "key"]))
        self.variants = variants.join(several.select("field_name", "key", "rows"), ["field_name", "key"])

    def classes(self):
        """(field_name, key, raw, members, links): variants, by hash, with their rows and how many rows of the class differ from each."""
        from pyspark.sql import functions as F

        return self.variants.select("field_name", "key", "raw", F.col("n").alias("members"), (F.col("rows") - F.col("n")).alias("links"))

    def membership(self):
        """(field_name, id, key, raw)."""
        return self.members.select("field_name", "id", "key", "raw")

    def pairs(self):
        """(field_name, page_id_1, page_id_2) of rows that look the same but differ; large classes are paired block by block."""
        from pyspark.sql import functions as F

        m = self.members.withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int"))
        left = m.select("field_name", "key", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.col("raw").alias("raw_1"), F.col("id").alias("page_id_1"))
        right = m.select("field_name", "key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("raw").alias("raw_2"), F.col("id").alias("page_id_2"))
        both = left.join(right, ["field_name", "key", "block"]).where("raw_1 <> raw_2 AND page_id_1 < page_id_2")
        # a page delivered with several values of a field can meet another page more than once
        return both.select("field_name", "page_id_1", "page_id_2").distinct()


def same_look_pairs(df, id_col: str, fields: list[str]):
    """Pairs of rows whose values of a field look the same but differ."""
    return SameLook(df, id_col, fields).pairs()
