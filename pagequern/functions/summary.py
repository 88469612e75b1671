"""Sentences, words and sentence ranks of plain text.

A sentence ends after stop signs and closing marks before white space and a
capital, digit or opening mark, or at a newline; titles and like abbreviations
are guarded.  All but the stemmer and the full ranking are column expressions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import voting
from .stemming import stem
from .text import WS, let, strip

GUARD = r"(^|[^\p{L}])(Dr|Mr|Mrs|Ms|Prof|St|Sr|Sra|Jr|No|Nr|Fig|vs|etc|ca|approx|e\.g|i\.e|[A-Z])\."
DAMPING = 0.85


def sentences(c: Column) -> Column:
    """The sentences of a text in order."""
    c = F.regexp_replace(c, f"{GUARD}{WS}+", "$1$2.\u0001")
    c = F.regexp_replace(c, rf"([.!?…][”\"»’)]*){WS}+([\p{{Lu}}“\"„«(¿¡0-9])", "$1\u0002$2")
    parts = F.split(F.replace(F.replace(c, F.lit("\n"), F.lit("\u0002")), F.lit("\u0001"), F.lit(" ")), "\u0002")
    return F.filter(F.transform(parts, strip), lambda s: F.length(s) > 0)


def complete(s: Column) -> Column:
    """Ends in a stop sign, is no bare number and no line of dialogue."""
    bare = F.regexp_replace(s, r"^[ .!?…]+|[ .!?…]+$", "")
    return s.rlike(r"[.!?…]$") & ~bare.rlike(r"^\p{Nd}+$") & ~s.rlike(f"^{WS}*[-—]")


def words(s: Column) -> Column:
    """Distinct lower-case alphabetic words in order of first use."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.replace(s, F.lit("İ"), F.lit("i"))), F.lit(r"\p{L}+"), F.lit(0)))


def overlap(a: Column, b: Column) -> Column:
    """Shared words over the sum of both sizes; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def ranks(sets: Column, iterations: int) -> Column:
    """PageRank of sentences given as word sets, after fixed iterations, inside Catalyst (G1).

    Sentences without an edge get null.  The work is quadratic in the number of
    sentences, so this form suits summaries and descriptions; ranked_order is
    the one for long texts.
    """
    def matrix(sets_: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(sets_) - 1)
        return F.transform(at, lambda i: F.transform(at, lambda j: F.when(i == j, F.lit(0.0)).otherwise(overlap(F.get(sets_, i), F.get(sets_, j)))))

    def of(m: Column) -> Column:
        sums = F.transform(m, lambda r: F.aggregate(r, F.lit(0.0), lambda x, y: x + y))
        return let(F.struct(m.alias("m"), sums.alias("sums"), F.nullif(F.size(F.filter(sums, lambda s: s > 0)), F.lit(0)).alias("n")), stable)

    def stable(z: Column) -> Column:
        p = F.transform(z["m"], lambda r: F.zip_with(r, z["sums"], lambda x, s: F.when(s > 0, x / s).otherwise(0.0)))
        return let(p, lambda q: walk(z, q))

    def walk(z: Column, p: Column) -> Column:
        def step(v: Column, _k: Column) -> Column:
            return F.transform(p, lambda r: F.lit(1 - DAMPING) / z["n"] + DAMPING * F.aggregate(F.zip_with(r, v, lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y))

        start = F.transform(z["sums"], lambda s: F.when(s > 0, F.lit(1.0) / z["n"]).otherwise(0.0))
        end = F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, step)
        return F.zip_with(end, z["sums"], lambda v, s: F.when(s > 0, v))

    return F.when(F.size(sets) == 0, F.array().cast("array<double>")).otherwise(let(let(sets, matrix), of))


DENSE = 400  # sentences up to which one matrix holds all similarities
WIDE = 2_000_000  # numbers of a sparse product that are held at a time


def _products(sets: list[set[str]]):
    """x -> x W for the similarities W of sentences (C21) without their diagonal; the matrix is made for short texts only.

    |A & B| / (|A| + |B|) depends on sizes besides shared words, and few sizes occur:
    the vector is summed by word and size, then gathered by sentence, so memory grows
    with the words of the text and never with pairs of sentences.
    """
    n = len(sets)
    vocab = {w: k for k, w in enumerate(sorted(set().union(*sets)))}
    size = np.array([len(s) for s in sets])
    word = np.array([vocab[w] for s in sets for w in sorted(s)], np.int64)
    row = np.repeat(np.arange(n), size)
    if n <= DENSE:
        m = np.zeros((n, len(vocab)), np.float32)
        m[row, word] = 1
        total = size[:, None] + size[None, :]
        w = np.divide((m @ m.T).astype(float), total, out=np.zeros((n, n)), where=total > 0)
        np.fill_diagonal(w, 0)
        return lambda x: x @ w
    sizes, at = np.unique(size[size > 0], return_inverse=True)
    kind = np.zeros(n, np.int64)
    kind[size > 0] = at
    begin = np.concatenate([[0], np.cumsum(size)])
    step = max(1, WIDE // len(sizes))
    borders = [0]
    while borders[-1] < n:
        borders.append(max(borders[-1] + 1, int(np.searchsorted(begin, begin[borders[-1]] + step, "right")) - 1))

    def product(x: np.ndarray) -> np.ndarray:
        by = np.zeros((len(vocab), len(sizes)))
        np.add.at(by, (word, kind[row]), x[row])
        out = np.zeros(n)
        for lo, hi in zip(borders, borders[1:]):
            a, b = begin[lo], begin[hi]
            if a == b:
                continue
            some = np.flatnonzero(size[lo:hi]) + lo
            shared = np.add.reduceat(by[word[a:b]], begin[some] - a, axis=0)
            out[some] = (shared / (sizes[None, :] + size[some, None])).sum(1)
        return out - np.where(size > 0, x / 2, 0.0)

    return product


def ranked_order(sets: list[set[str]], damping: float = DAMPING, tolerance: float = 1e-6, most: int = 100) -> list[tuple[int, float]]:
    """(sentence, rank) by rank descending, ties by position; sentences without an edge are left out (G1, K4)."""
    n = len(sets)
    if not n or not any(sets):
        return []
    product = _products(sets)
    total = product(np.ones(n))
    keep = total > 1e-12
    k = int(keep.sum())
    if not k:
        return []
    share = np.divide(1.0, total, out=np.zeros(n), where=keep)
    v = keep / k
    for _ in range(most):
        new = np.where(keep, (1 - damping) / k + damping * product(v * share), 0.0)
        done = np.abs(new - v).sum() < k * tolerance
        v = new
        if done:
            break
    order = sorted(np.flatnonzero(keep).tolist(), key=lambda i: (-round(v[i], 12), i))
    return [(i, float(v[i])) for i in order]


def summarise(sents: list[str], language: str, n: int) -> str:
    """The n best sentences in text order."""
    import re

    sets = [{stem(x, language) for x in re.findall(r"[^\W\d_]+", s.lower())} for s in sents]
    top = sorted(i for i, _ in ranked_order(sets)[:n])
    return " ".join(sents[i] for i in top)


def _summaries(sents: pd.Series, language: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([summarise(list(s), lang or "en", int(k)) if s is not None else None for s, lang, k in zip(sents, language, n)])


def summary_column(sents: Column, language: Column, n: int) -> Column:
    """The summary of each row's sentences, by an Arrow UDF."""
    return F.pandas_udf(_summaries, "string")(sents, language, F.lit(n))


def _told(header: pd.Series, sents: pd.Series, n: pd.Series) -> pd.DataFrame:
    out = []
    for h, s, k in zip(header, sents, n):
        lang = voting.vote(" ".join([h or "", *s])) if s is not None and len(s) else None
        out.append((lang, summarise(list(s), lang or "en", int(k)) if s is not None else None))
    return pd.DataFrame(out, columns=["language", "summary"])


def told_column(header: Column, sents: Column, n: int) -> Column:
    """Struct of the language (of title and sentences) and the summary of each row's sentences, by one Arrow UDF."""
    return F.pandas_udf(_told, "struct<language:string,summary:string>")(header, sents, F.lit(n))


def _stems(words: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([[stem(w, lang or "en") for w in ws] if ws is not None else None for ws, lang in zip(words, language)])


def stems_column(words_: Column, language: Column) -> Column:
    """Stems of each row's words."""
    return F.pandas_udf(_stems, "array<string>")(words_, language)
