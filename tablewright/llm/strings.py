"""Comparing single words: folding, phonetic codes, Jaro-Winkler similarity and slips of the keyboard."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

_UNMARKED = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe"})
_SOUNDS = str.maketrans({**dict.fromkeys("bfpv", "1"), **dict.fromkeys("cgjkqsxz", "2"), **dict.fromkeys("dt", "3"), "l": "4", **dict.fromkeys("mn", "5"), "r": "6", **dict.fromkeys("aeiouyhw", "")})


def fold(text: str) -> str:
    """Lower case, without marks, single blanks."""
    text = unicodedata.normalize("NFKD", text).casefold().translate(_UNMARKED)
    return re.sub(r"\s+", " ", "".join(c for c in text if not unicodedata.combining(c))).strip()


@lru_cache(maxsize=200_000)
def phonetic(word: str) -> str:
    """The first letter and the consonants by sound, without repeats."""
    return word[:1] + re.sub(r"(.)\1+", r"\1", word[1:].translate(_SOUNDS))


@lru_cache(maxsize=200_000)
def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used, left = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                left.append(x)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [y for y, u in zip(b, used) if u]
    half = sum(x != y for x, y in zip(left, right)) / 2
    jaro = (m / len(a) + m / len(b) + (m - half) / m) / 3
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


@lru_cache(maxsize=200_000)
def slips(a: str, b: str) -> int:
    """Insertions, deletions, exchanges and swaps of neighbours between two words."""
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        before, last = last, row
    return last[-1]


def lessened(word: str) -> list[str]:
    """The word and the word with one letter left out at each place: two words one slip apart share one of these."""
    return [word, *dict.fromkeys(word[:i] + word[i + 1 :] for i in range(len(word)))]


def in_order(short: str, long: str) -> bool:
    """Whether the letters of one word stand in this order in the other, beginning with its first letter."""
    if not short or not long or short[0] != long[0]:
        return False
    rest = iter(long)
    return all(c in rest for c in short)
