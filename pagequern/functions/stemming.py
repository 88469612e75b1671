"""Stems of words.

English, German, Swedish, Danish and Norwegian follow the published Snowball
algorithms: endings are removed only inside regions of a word, R1 (after the first
consonant that follows a vowel) and R2 (the same again within R1).  The other
languages lose the longest ending of a list.  Unknown languages are treated as English.
"""

from __future__ import annotations

import functools
import re

# Inflectional endings by language; a stem keeps at least three letters.
ENDINGS = {
    "fr": "issements issement ations ation ements ement euses euse eurs eur ives ive ées és ée er ez es é e s",
    "es": "amientos amiento aciones ación mente adas ados idas idos ando iendo ada ado ida ido es as os ar er ir a e o s",
    "it": "azioni azione mente ando endo ate ati ato ata are ere ire i e a o", "pt": "amentos amento ações ação mente adas ados ando endo ada ado es as os ar er ir a e o s",
    "nl": "heden ingen heid ing en er e s",
    "ru": "иями ями ами ость ого ему ыми ими ией ию ая ое ые ий ый ой ам ах ов ев ть ла ло ли а е и о у ы ь я ю", "tr": "larının lerinin larda lerde lardan lerden ların lerin lar ler dan den da de ın in un ün ı i u ü",
    "fi": "issa issä ista istä ille ilta iden jen ssa ssä sta stä lle lta na nä en n a ä t", "hu": "okat eket ökat oknak eknek ban ben nak nek ból ből ok ek ök t k",
}
LISTS = {k: sorted(v.split(), key=len, reverse=True) for k, v in ENDINGS.items()}


def region(word: str, vowels: str, start: int = 0) -> int:
    """Place after the first consonant that follows a vowel, from start on."""
    for i in range(start + 1, len(word)):
        if word[i] not in vowels and word[i - 1] in vowels:
            return i + 1
    return len(word)


def ending(word: str, endings: str, r: int) -> str | None:
    """The longest of the endings that the word has inside a region."""
    return max((e for e in endings.split() if word.endswith(e) and len(word) - len(e) >= r), key=len, default=None)


# ------------------------------------------------------------ English
V = "aeiouy"
# Fixed values of the English algorithm.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
KEPT = frozenset("sky news howe atlas cosmos bias andes".split())
KEPT_LATER = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize"
SHORT = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def english(w: str) -> str:
    if len(w) <= 2:
        return w
    if w in IRREGULAR:
        return IRREGULAR[w]
    if w in KEPT:
        return w
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", w.removeprefix("'"))
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or region(w, V)
    r2 = region(w, V, r1)
    w = re.sub(r"(?:'s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in V for c in w[:-2]):
        w = w[:-1]
    if w in KEPT_LATER:
        return w
    m = re.search(r"(eedly|ingly|edly|eed|ing|ed)$", w)
    if m and m[1] in ("eed", "eedly"):
        w = w[: m.start()] + "ee" if m.start() >= r1 else w
    elif m and any(c in V for c in w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            w = w[:-1]
        elif r1 >= len(w) and SHORT.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in V:
        w = w[:-1] + "i"
    e = max((x for x in [*STEP2, "ogi", "li"] if w.endswith(x)), key=len, default=None)
    if e and len(w) - len(e) >= r1:
        if e in STEP2:
            w = w[: -len(e)] + STEP2[e]
        elif e == "ogi":
            w = w[:-1] if w[-4:-3] == "l" else w
        elif w[-3:-2] in "cdeghkmnrt":
            w = w[:-2]
    e = max((x for x in [*STEP3, "ative"] if w.endswith(x)), key=len, default=None)
    if e and len(w) - len(e) >= r1:
        if e in STEP3:
            w = w[: -len(e)] + STEP3[e]
        elif len(w) - 5 >= r2:
            w = w[:-5]
    e = max((x for x in [*STEP4.split(), "ion"] if w.endswith(x)), key=len, default=None)
    if e and len(w) - len(e) >= r2 and (e != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(e)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not SHORT.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


# ------------------------------------------------------------ Germanic languages
def german(w: str) -> str:
    v = "aeiouyäöü"
    w = re.sub(f"(?<=[{v}])([uy])(?=[{v}])", lambda m: m[1].upper(), w.replace("ß", "ss"))
    first = region(w, v)
    r1, r2 = max(3, first), region(w, v, first)
    e = ending(w, "em ern er e en es", 0)
    if e:
        if len(w) - len(e) >= r1:
            w = w[: -len(e)]
            w = w[:-1] if e in ("e", "en", "es") and w.endswith("niss") else w
    elif w.endswith("s") and len(w) - 1 >= r1 and w[-2:-1] in tuple("bdfghklmnrt"):
        w = w[:-1]
    e = ending(w, "en er est", 0)
    if e:
        w = w[: -len(e)] if len(w) - len(e) >= r1 else w
    elif w.endswith("st") and len(w) - 2 >= r1 and len(w) > 5 and w[-3] in "bdfghklmnt":
        w = w[:-2]
    e = ending(w, "end ung ig ik isch lich heit keit", 0)
    if e and len(w) - len(e) >= r2:
        stem_ = w[: -len(e)]
        if e in ("end", "ung"):
            w = stem_
            if w.endswith("ig") and len(w) - 2 >= r2 and not w.endswith("eig"):
                w = w[:-2]
        elif e in ("ig", "ik", "isch"):
            w = w if stem_.endswith("e") else stem_
        elif e in ("lich", "heit"):
            w = stem_
            if w.endswith(("er", "en")) and len(w) - 2 >= r1:
                w = w[:-2]
        else:
            w = stem_
            x = ending(w, "lich ig", r2)
            w = w[: -len(x)] if x else w
    return w.translate(str.maketrans("UYäöü", "uyaou"))


def swedish(w: str) -> str:
    v = "aeiouyäåö"
    r1 = max(3, region(w, v))
    e = ending(w, "a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast", r1)
    if e:
        w = w[: -len(e)]
    elif w.endswith("s") and len(w) - 1 >= r1 and w[-2] in "bcdfghjklmnoprtvy":
        w = w[:-1]
    if ending(w, "dd gd nn dt gt kt tt", r1):
        w = w[:-1]
    e = ending(w, "lig ig els löst fullt", r1)
    return w if not e else w[:-1] if e in ("löst", "fullt") else w[: -len(e)]


def danish(w: str) -> str:
    v = "aeiouyæåø"
    r1 = max(3, region(w, v))
    e = ending(w, "hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret", r1)
    if e:
        w = w[: -len(e)]
    elif w.endswith("s") and len(w) - 1 >= r1 and w[-2] in "abcdfghjklmnoprtvyzå":
        w = w[:-1]
    if ending(w, "gd dt gt kt", r1):
        w = w[:-1]
    if w.endswith("igst"):
        w = w[:-2]
    e = ending(w, "ig lig elig els løst", r1)
    if e == "løst":
        w = w[:-1]
    elif e:
        w = w[: -len(e)]
        if ending(w, "gd dt gt kt", r1):
            w = w[:-1]
    if len(w) - 1 >= r1 and len(w) > 1 and w[-1] == w[-2] and w[-1] not in v:
        w = w[:-1]
    return w


def norwegian(w: str) -> str:
    v = "aeiouyæåø"
    r1 = max(3, region(w, v))
    e = ending(w, "a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast erte ert", r1)
    if e:
        w = w[: -len(e)] + ("er" if e in ("erte", "ert") else "")
    elif w.endswith("s") and len(w) - 1 >= r1 and (w[-2] in "bcdfghjlmnoprtvyz" or (w[-2] == "k" and w[-3:-2] not in tuple(v))):
        w = w[:-1]
    if ending(w, "dt vt", r1):
        w = w[:-1]
    e = ending(w, "leg eleg ig eig lig elig els lov elov slov hetslov", r1)
    return w[: -len(e)] if e else w


RULES = {"en": english, "de": german, "sv": swedish, "da": danish, "no": norwegian}


@functools.lru_cache(1 << 17)
def stem(word: str, language: str) -> str:
    """The stem of a lower-case word."""
    for e in LISTS.get(language, ()):
        if word.endswith(e) and len(word) - len(e) >= 3:
            return word[: -len(e)]
    return word if language in LISTS else RULES.get(language, english)(word)
