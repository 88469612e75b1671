"""Language of a text by a vote of its function words, or by its script."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Frequent function words by language.
FUNCTION_WORDS = {
    "de": "der die das und ist nicht ein eine mit den im dem für auf zum am des", "en": "the and of to in is that for with on was at by an this from", "es": "el la los las de que y en un una con por para del su", "fr": "le la les des et est un une dans pour que avec sur du à",
    "it": "il lo gli di che è un una per con del della ha e i", "nl": "de het een en van in is dat op te met voor zijn bij na", "pt": "o a os as de que e em um uma com para do da no", "sv": "och att det som en på är av för med den till efter om ett", "tr": "ve bir bu için ile da de çok daha gibi ama sonra",
    "da": "og er til af ikke der jeg har blev også hvor være eller skal fra deres efter", "no": "og er til av ikke som jeg har ble også hvor være eller skal fra etter", "fi": "ja on ei se että oli kun mutta niin hän joka ovat kuin myös sitä vain jo", "hu": "a az és hogy nem is egy ez van volt de meg már csak mint vagy azt",
}
SCRIPTS = {"ru": r"[\x{400}-\x{4FF}]", "ja": r"[\x{3040}-\x{30FF}]", "zh": r"[\x{4E00}-\x{9FFF}]", "hi": r"[\x{900}-\x{97F}]", "th": r"[\x{E00}-\x{E7F}]"}
SCRIPT_SHARE = 0.2


def language(c: Column) -> Column:
    """The language with most votes (ties: first by code); null for a text without letters or votes."""
    def of(t: Column) -> Column:
        tokens = F.regexp_extract_all(F.lower(t), F.lit(r"\p{L}+"), F.lit(0))
        return T.let(tokens, lambda ts: pick(t, ts))

    def pick(t: Column, tokens: Column) -> Column:
        def count(ws: list[str]) -> Column:
            return F.size(F.filter(tokens, lambda x: x.isin(ws)))

        votes = [F.struct(count(ws.split()).alias("n"), F.lit(-i).alias("o"), F.lit(code).alias("code")) for i, (code, ws) in enumerate(sorted(FUNCTION_WORDS.items()))]
        out = T.let(F.array_max(F.array(*votes)), lambda b: F.when(b["n"] > 0, b["code"]))
        letters = F.regexp_replace(t, r"[^\p{L}]", "")
        for code in reversed(list(SCRIPTS)):
            share = (F.length(letters) - F.length(F.regexp_replace(letters, SCRIPTS[code], ""))) / F.nullif(F.length(letters), F.lit(0))
            out = F.when(share >= SCRIPT_SHARE, F.lit(code)).otherwise(out)
        return F.when(F.length(letters) > 0, out)

    return T.let(c, of)


WORD = re.compile(r"[^\W\d_]+")
_OF_WORD: dict[str, list[str]] = {}
for _code, _words in FUNCTION_WORDS.items():
    for _w in set(_words.split()):
        _OF_WORD.setdefault(_w, []).append(_code)
_SCRIPT = {code: re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), rx)) for code, rx in SCRIPTS.items()}


def vote(text: str | None) -> str | None:
    """The same for a plain string."""
    if not text:
        return None
    letters = sum(map(str.isalpha, text))
    if not letters:
        return None
    if not text.isascii():
        for code, rx in _SCRIPT.items():
            if sum(c.isalpha() for c in rx.findall(text)) >= SCRIPT_SHARE * letters:
                return code
    votes: dict[str, int] = {}
    for w in WORD.findall(text.lower()):
        for code in _OF_WORD.get(w, ()):
            votes[code] = votes.get(code, 0) + 1
    return min(votes, key=lambda c: (-votes[c], c)) if votes else None
