"""The Porter2 (Snowball English) stemmer, from its published description."""

from __future__ import annotations

import re
from functools import lru_cache

#: Fixed values of the algorithm: words with stems of their own, and words left alone after step 1a.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
STOP_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less", "ogi": "og", "ogist": "og", "li": ""}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
STEP1B = ("eed", "eedly", "ed", "edly", "ing", "ingly")
#: The suffixes of a step, longest first.
_ENDS_1B, _ENDS_2, _ENDS_3, _ENDS_4 = (tuple(sorted(names, key=len, reverse=True)) for names in (STEP1B, STEP2, STEP3, STEP4))
_PREFIXES = ("gener", "commun", "arsen")
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_V, _NV = "[aeiouy]", "[^aeiouy]"
_VOWEL, _REGION, _Y = re.compile(_V), re.compile(f"{_V}{_NV}"), re.compile(r"^y|(?<=[aeiouy])y")
_SHORT, _QUOTED = re.compile(rf"(?:{_NV}{_V}[^aeiouywxY]|^{_V}{_NV}|^past)$"), re.compile(r"('s'|'s|')$")


def _region(word: str, start: int = 0) -> int:
    m = _REGION.search(word, start)
    return m.end() if m else len(word)


def _short_end(w: str) -> bool:
    return bool(_SHORT.search(w))


def _longest(w: str, suffixes: tuple[str, ...]) -> str:
    """The longest of *suffixes*, which come longest first, that ends *w*; most words have none."""
    return next(s for s in suffixes if w.endswith(s)) if w.endswith(suffixes) else ""


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = word.lstrip("'") if word.startswith("'") else word
    if "y" in w:
        w = _Y.sub("Y", w)
    prefix = next(len(p) for p in _PREFIXES if w.startswith(p)) if w.startswith(_PREFIXES) else 0
    r1 = prefix or _region(w)
    r2 = _region(w, r1) if r1 < len(w) else len(w)
    if "'" in w:
        w = _QUOTED.sub("", w)
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w, 0, len(w) - 2):
        w = w[:-1]
    if w in STOP_AFTER_1A:
        return w
    # 1b
    s = _longest(w, _ENDS_1B)
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and _VOWEL.search(w, 0, len(w) - len(s)):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLES):
            w = w if len(w) == 3 and w[0] in "aeo" else w[:-1]
        elif _short_end(w) and r1 >= len(w):
            w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # 2
    s = _longest(w, _ENDS_2)
    if s and len(w) - len(s) >= r1:
        head = w[: -len(s)]
        if not (s == "ogi" and not head.endswith("l")) and not (s == "li" and head[-1:] not in tuple("cdeghkmnrt")):
            w = head + STEP2[s]
    # 3
    s = _longest(w, _ENDS_3)
    if s and len(w) - len(s) >= r1 and not (s == "ative" and len(w) - len(s) < r2):
        w = w[: -len(s)] + STEP3[s]
    # 4
    s = _longest(w, _ENDS_4)
    if s and len(w) - len(s) >= r2 and not (s == "ion" and w[-4:-3] not in ("s", "t")):
        w = w[: -len(s)]
    # 5
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
