"""Text analysis: one implementation for index, query and trace."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

import numpy as np

from .porter2 import stem

#: The English stop words, and letters that decomposition doesn't bring to ASCII.
STOP_WORDS = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
FOLDS = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "ħ": "h", "ŋ": "n", "ŧ": "t", "ĸ": "k"}
#: A token takes at most so many characters of its run, and goes if it has so many bytes after folding.
TOKEN_CHARS, TOKEN_BYTES = 40, 40
_QUOTES = "'’＇"


class Token(NamedTuple):
    term: str
    position: int
    start: int  # code points of the source, end exclusive
    end: int


@lru_cache(maxsize=1 << 16)
def fold(word: str) -> str:
    word = word.lower()
    if word.isascii():
        return word
    plain = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c) or ord(c) > 0x36F)
    return unicodedata.normalize("NFC", "".join(FOLDS.get(c, c) for c in plain))


def _clusters(text: str):
    """(normal form, start, end) of each starter with its marks, so that spans follow NFKC."""
    i, n = 0, len(text)
    while i < n:
        j = i + 1
        while j < n and unicodedata.combining(text[j]):
            j += 1
        yield unicodedata.normalize("NFKC", text[i:j]), i, j
        i = j


_WORD = re.compile(r"[^\W_]+")


def _runs(text: str):
    """(word, start, end, possessive) of each run of letters and digits of the NFKC form."""
    if unicodedata.is_normalized("NFKC", text):
        # Parts of a normal text are normal, and for re a word character but the underscore is one that is alphanumeric.
        for m in _WORD.finditer(text):
            word, start = m.group(), m.start()
            single = word in ("s", "S") and start >= 2 and text[start - 1] in _QUOTES and text[start - 2].isalnum()
            yield word[:TOKEN_CHARS], start, m.end(), single
        return
    chars = [(c, s, e) for norm, s, e in _clusters(text) for c in norm]
    word: list[str] = []
    start = end = 0
    for c, s, e in [*chars, (" ", len(text), len(text))]:
        if c.isalnum():
            if not word:
                start = s
            word.append(c)
            end = e
        elif word:
            single = len(word) == 1 and word[0] in "sS" and start >= 2 and text[start - 1] in _QUOTES and text[start - 2].isalnum()
            yield "".join(word[:TOKEN_CHARS]), start, end, single
            word = []


def surface(text: str, long: bool = False) -> list[Token]:
    """Folded words with positions; a possessive s goes without leaving a gap. long: keep overlong ones."""
    out, at = [], 0
    for word, s, e, possessive in _runs(text):
        if possessive:
            continue
        term = fold(word)
        if long or not _long(term):
            out.append(Token(term, at, s, e))
        at += 1
    return out


def _long(term: str) -> bool:
    return len(term) >= TOKEN_BYTES or not term.isascii() and len(term.encode()) >= TOKEN_BYTES


def both(text: str, stop_words: bool = True, synonyms: dict[str, tuple[str, ...]] | None = None) -> tuple[list[Token], list[Token], int]:
    """(folded words, stems, last position or -1) in one reading.

    Stop words leave gaps among the stems; synonyms (index time) stand at their source's place.
    """
    every = surface(text, True)
    shown = [t for t in every if not _long(t.term)]
    out = []
    for t in shown:
        if stop_words and t.term in STOP_WORDS:
            continue
        term = stem(t.term)
        out.append(Token(term, t.position, t.start, t.end))
        if synonyms and term in synonyms:
            out += [Token(x, t.position, t.start, t.end) for x in synonyms[term]]
    return shown, out, every[-1].position if every else -1


#: A possessive s: what it follows is a letter or digit and a quote, and it is a run by itself.
_POSSESSIVE = re.compile(rf"(?<=[^\W_][{_QUOTES}])[sS](?![^\W_])")
_KEPT = re.compile(rf"(?!{_POSSESSIVE.pattern})[^\W_]+")


def words_at(text: str) -> tuple[list[str], np.ndarray, int]:
    """The runs of a text as terms() takes them, their positions, and the last position or -1: those of both(), without spans or an object for each token."""
    if unicodedata.is_normalized("NFKC", text):
        words = (_KEPT if any(q in text for q in _QUOTES) and _POSSESSIVE.search(text) else _WORD).findall(text)
        return words, np.arange(len(words)), len(words) - 1
    every = surface(text, True)
    # These are folded already, which the sign before them says.
    return [f"\0{t.term}" for t in every], np.array([t.position for t in every], np.int64), every[-1].position if every else -1


@lru_cache(maxsize=1 << 17)
def terms(word: str, stop_words: bool) -> tuple[str | None, str | None]:
    """(folded word, stem) of a run: neither if it is too long, no stem of a stop word."""
    term = word[1:] if word.startswith("\0") else fold(word[:TOKEN_CHARS])
    if _long(term):
        return None, None
    return term, None if stop_words and term in STOP_WORDS else stem(term)


def gather(text: str, stop_words: bool, synonyms: dict[str, tuple[str, ...]], base: int, stems: dict[str, list[int]], shown: dict[str, list[int]]) -> tuple[int, int, int]:
    """Put the positions of both() from *base* on under their terms; how many stems and folded words there are, and the last position or -1."""
    words, places, last = words_at(text)
    n_stems, n_shown = 0, 0
    for word, at in zip(words, (places + base).tolist(), strict=True):
        term, root = terms(word, stop_words)
        if term is not None:
            shown.setdefault(term, []).append(at)
            n_shown += 1
            for x in (root, *synonyms.get(root, ())) if root is not None else ():
                stems.setdefault(x, []).append(at)
                n_stems += 1
    return n_stems, n_shown, last


def analyze(text: str, stop_words: bool = True, synonyms: dict[str, tuple[str, ...]] | None = None) -> list[Token]:
    """Stems with positions."""
    return both(text, stop_words, synonyms)[1]


def query_terms(text: str, stop_words: bool = True) -> list[str]:
    return list(dict.fromkeys(t.term for t in analyze(text, stop_words)))


def fuzzy_eligible(term: str) -> bool:
    return len(term) >= 4 and any(c.isalpha() for c in term) and not any(c.isnumeric() or c in "-_/" for c in term)


def edits(a: str, b: str, transpositions: bool = True, prefix: bool = False) -> int:
    """Edit distance of *a* to *b*, or with prefix to the nearest prefix of *b*; a swap of neighbours is one edit if asked."""
    back, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if transpositions and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, back[j - 2] + 1)
            new.append(d)
        back, row = row, new
    return min(row) if prefix else row[-1]
