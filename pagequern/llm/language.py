"""Problem 5: languages of texts and of their sentences by rank-order profiles.

A profile is the list of a language's most frequent character n-grams (1 to 4,
words padded with blanks) in rank order.  A sentence's n-grams are ranked the
same way; its distance to a language is the sum over its n-grams of how far each
is out of place there, a missing one counting as far as can be.  N-grams in no
profile are equally missing everywhere and left out.

A text's own language is the one with the least summed distance.  A sentence is
in another language only if that is nearer by MARGIN; so names and single words
do not make a language.  Confidence is the relative distance to the runner-up.
Texts are brought to one form first (see lookalike).
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
import pyarrow as pa

from . import codepoints as C
from . import lookalike, sentences
from . import words as W

PROFILE = 1000
LONGEST = 4
MARGIN = 0.12
ADDRESS = re.compile(r"[\w.@-]*[\w]\.[a-z]{3,}(?![\w])|\S*@\S+", re.ASCII)

# Names of the languages in English and their three-letter codes.
NAMES = {
    "de": "german deu ger deutsch", "en": "english eng", "es": "spanish spa castilian español", "fr": "french fra fre français", "hi": "hindi hin",
    "it": "italian ita italiano", "ja": "japanese jpn jp", "nl": "dutch nld dut nederlands flemish", "pt": "portuguese por português", "ru": "russian rus русский",
    "sv": "swedish swe svenska", "th": "thai tha", "tr": "turkish tur türkçe", "zh": "chinese zho chi cmn cn mandarin 中文",
}


@functools.lru_cache(1)
def _names() -> dict[str, str]:
    return {n: code for code, names in NAMES.items() for n in [code, *names.split()]}


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    """Letters and marks in lower case; everything else is a blank."""
    import unicodedata

    t = np.full(0x110000, 32, np.uint32)
    lower = W.tables()[1]
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] in "LM":
            t[c] = lower[c]
    return t


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, n-gram hash) of all n-grams, repeated as they occur."""
    cp, off = C.from_list(texts)
    n = len(off) - 1
    row = C.rows_of(off)
    full = np.full(len(cp) + 2 * n, 32, np.uint32)
    at = np.arange(len(cp)) + 2 * row + 1
    full[at] = _letters()[cp]
    frow = np.repeat(np.arange(n), np.diff(off) + 2)
    keep = np.ones(len(full), bool)
    keep[1:] = (full[1:] != 32) | (full[:-1] != 32)
    full, frow = full[keep], frow[keep]
    who, what = [], []
    for k in range(1, LONGEST + 1):
        m = len(full) - k + 1
        if m <= 0:
            break
        ok = frow[:m] == frow[k - 1 : k - 1 + m] if k > 1 else np.ones(m, bool)
        h = np.full(m, k, np.uint64)
        for j in range(k):
            ch = full[j : j + m]
            if 0 < j < k - 1:
                ok &= ch != 32
            h = h * np.uint64(0x100000001B3) + ch
        if k == 1:
            ok &= full[:m] != 32
        elif k == 2:
            ok &= (full[:m] != 32) | (full[1 : m + 1] != 32)
        who.append(frow[:m][ok])
        what.append(W.mix(h[ok]))
    return np.concatenate(who) if who else np.zeros(0, np.int64), np.concatenate(what) if what else np.zeros(0, np.uint64)


class Profiles:
    """Ranks of the profile n-grams by language, for the classifier."""

    def __init__(self, langs: list[str], ranked: dict[str, list[int]]):
        self.langs = langs
        self.known = np.unique(np.array([g for r in ranked.values() for g in r], np.int64).view(np.uint64))
        self.far = PROFILE
        self.rank = np.full((len(self.known), len(langs)), -1, np.int32)
        for j, lang in enumerate(langs):
            g = np.array(ranked.get(lang, []), np.int64).view(np.uint64)
            self.rank[np.searchsorted(self.known, g), j] = np.arange(len(g))

    def distance(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(distance by text and language, number of n-grams that count)."""
        n, k = len(texts), len(self.langs)
        total, weight = np.zeros((n, k)), np.zeros(n)
        if not n or not len(self.known):
            return total, weight
        who, g = grams(texts)
        at = np.minimum(np.searchsorted(self.known, g), len(self.known) - 1)
        hit = self.known[at] == g
        key, count = np.unique(who[hit] * len(self.known) + at[hit], return_counts=True)
        who, g = key // len(self.known), key % len(self.known)
        order = np.lexsort((g, -count, who))
        who, g = who[order], g[order]
        begin = np.searchsorted(who, np.arange(n))
        mine = np.arange(len(who)) - begin[who]
        for j in range(k):
            r = self.rank[g, j]
            d = np.where(r < 0, self.far, np.minimum(np.abs(mine - r), self.far))
            total[:, j] = np.bincount(who, d, n)
        return total, np.bincount(who, minlength=n).astype(float)


def fit(samples, size: int = PROFILE) -> Profiles:
    """Profiles of a table lang, text; n-grams are counted over all rows, the top ``size`` a language kept."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    def count(pdfs):
        for pdf in pdfs:
            who, g = grams(pdf["text"].tolist())
            if not len(who):
                continue
            out = pd.DataFrame({"lang": pdf["lang"].to_numpy()[who], "g": g.view(np.int64)})
            yield out.groupby(["lang", "g"]).size().rename("n").reset_index()

    s = samples.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    counts = s.mapInPandas(count, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "g"))).where(F.col("r") <= size)
    ranked: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "r").collect():  # languages * size rows
        ranked.setdefault(r.lang, []).append(r.g)
    return Profiles(sorted(ranked), ranked)


def segments(profiles: Profiles, texts: list[str | None]) -> list[tuple[int, str, str, float, str, float]]:
    """(text number, sentence, language, confidence, text's language, its confidence) of every sentence."""
    form = lookalike.normalise_batch(pa.array([t or "" for t in texts], pa.string()))[0].to_pylist()
    units = sentences.split_list(form)
    owner = np.repeat(np.arange(len(units)), [len(u) for u in units])
    flat = [u for us in units for u in us]
    d, n = profiles.distance([ADDRESS.sub(" ", u) if "www" in u or "@" in u else u for u in flat])
    usable = n > 0
    whole = np.zeros((len(texts), len(profiles.langs)))
    np.add.at(whole, owner[usable], d[usable])
    langs = profiles.langs
    if not langs:
        return []
    main = whole.argmin(1)
    two = np.partition(whole, 1, axis=1)[:, :2] if len(langs) > 1 else np.hstack([whole, whole])
    main_conf = 1 - two[:, 0] / np.maximum(two[:, 1], 1e-9)
    best = d.argmin(1)
    own = d[np.arange(len(flat)), main[owner]]
    low = d[np.arange(len(flat)), best]
    pick = np.where(low < own * (1 - MARGIN), best, main[owner])
    got = d[np.arange(len(flat)), pick]
    if len(flat):
        others = d.copy()
        others[np.arange(len(flat)), pick] = np.inf
        conf = np.clip(1 - got / np.maximum(others.min(1), 1e-9), 0, 1) if len(langs) > 1 else np.ones(len(flat))
    out = []
    for i, o in enumerate(owner.tolist()):
        if usable[i]:
            out.append((o, flat[i], langs[pick[i]], round(float(conf[i]), 4), langs[main[o]], round(float(main_conf[o]), 4)))
    return out


def language_segments(articles, samples):
    """page_id, label, segment_no, segment, lang, confidence, main_lang, main_confidence of every description sentence.

    Null, blank and letterless descriptions give no rows; repeated rows give theirs once.
    """
    from pyspark.sql import functions as F

    profiles = fit(samples)
    a = articles.select(F.col("page_id").cast("long"), F.col("language").alias("label"), "description").where("description IS NOT NULL")

    def run(pdfs):
        for pdf in (piece for whole in pdfs for piece in C.frames(whole, "description")):
            got = segments(profiles, pdf["description"].tolist())
            if not got:
                continue
            out = pd.DataFrame(got, columns=["row", "segment", "lang", "confidence", "main_lang", "main_confidence"])
            out["segment_no"] = out.groupby("row").cumcount().astype("int32")
            out["page_id"] = pdf["page_id"].to_numpy()[out["row"]]
            out["label"] = pdf["label"].to_numpy()[out["row"]]
            yield out[["page_id", "label", "segment_no", "segment", "lang", "confidence", "main_lang", "main_confidence"]]

    return a.mapInPandas(run, "page_id long, label string, segment_no int, segment string, lang string, confidence double, main_lang string, main_confidence double").distinct()


def wrong_or_mixed(segs):
    """(page_id, lang) of articles whose label is missing or wrong, or that hold several languages."""
    from pyspark.sql import functions as F

    norm = F.regexp_replace(F.lower(F.trim(F.col("label"))), "_", "-")
    mapping = F.create_map(*[F.lit(x) for kv in _names().items() for x in kv])
    named = F.coalesce(F.try_element_at(mapping, norm), F.try_element_at(mapping, F.regexp_extract(norm, r"^[^- (]*", 0)))
    long = segs.select("page_id", named.alias("named"), "main_lang", "lang", F.length("segment").alias("n"))
    by = long.groupBy("page_id", "named", "lang").agg(F.sum("n").alias("n"))
    page = by.groupBy("page_id").agg(F.max(F.struct("n", "lang")).alias("top"), F.count("*").alias("langs"), F.max("named").alias("named"), F.collect_set("lang").alias("all"))
    bad = page.where((F.col("langs") > 1) | F.col("named").isNull() | (F.col("named") != F.col("top.lang")))
    return bad.select("page_id", F.explode("all").alias("lang"))
