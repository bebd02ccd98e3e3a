"""Hangul words as plain strings, for folds that look at one row after another."""

from __future__ import annotations

import re

from strandloom.functions.text import LEADS, PARTICLES, TAILS, VOWELS


def compact(text: str) -> str:
    return re.sub(r"[\s._/-]+", "", text).casefold()


def letters(text: str) -> str:
    out = []
    for c in compact(text):
        n = ord(c) - 0xAC00
        out += [LEADS[n // 588], VOWELS[n % 588 // 28], TAILS[n % 28]] if 0 <= n < 11172 else [c]
    return "".join(out)


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def phonetic_ratio(a: str, b: str) -> float:
    x, y = letters(a), letters(b)
    return edits(x, y) / max(len(x), len(y), 1)


def without_particle(word: str) -> str:
    bare = compact(word)
    ending = next((p for p in PARTICLES if bare.endswith(p) and len(bare) - len(p) >= 2), "")
    return bare[: len(bare) - len(ending)]


def contains(text: str, phrase: str) -> bool:
    """Korean phrases ignore spaces; Latin ones stand between other characters than letters and digits, in any case."""
    if re.search("[가-힣]", phrase):
        return compact(phrase) in compact(text)
    return bool(phrase) and re.search(rf"(?<![A-Za-z0-9]){re.escape(phrase)}(?![A-Za-z0-9])", text, re.IGNORECASE) is not None
