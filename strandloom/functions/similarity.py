"""Sequence similarity by matching blocks, for which Spark has no function: small Arrow UDFs around the standard library."""

from __future__ import annotations

import difflib
import json
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"[가-힣A-Za-z0-9À-ÿ]+")


LONG = 1 << 14  # characters from which on slices of all places would take too much memory
SHORT = 20_000  # pairs of places up to which the standard library is quicker


def _common(a: str, b: str) -> int:
    """Of some run that both hold, how long it is: the longest at one of the nearest shifts."""
    if len(a) > len(b):
        a, b = b, a
    x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (a, b))
    n, most = len(x), 0
    for shift in {*range(min(len(y) - n, 8) + 1), len(y) - n}:
        apart = np.flatnonzero(x != y[shift : shift + n])
        most = max(most, int(np.diff(apart, prepend=-1, append=n).max()) - 1)
    return most


def longest_run(a: str, b: str) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the longest run of characters that both hold; of equally long ones the first in a, then in b."""
    runs = lambda s, k: [s[i : i + k] for i in range(len(s) - k + 1)]
    holds = lambda k: k <= min(len(a), len(b)) and not set(runs(b, k)).isdisjoint(runs(a, k))
    low = _common(a, b)
    if holds(low + 1):
        low, step = low + 1, 1
        while holds(low + step):
            low, step = low + step, 2 * step
        high = low + step  # too long
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if holds(middle) else (low, middle)
    if not low:
        return 0, 0, 0
    there = set(runs(b, low))
    i = next(i for i in range(len(a)) if a[i : i + low] in there)
    return i, b.find(a[i : i + low]), low


def matched(a: str, b: str) -> int:
    """Characters in matching blocks: those of the longest run that both hold, and of what lies before it and behind it in both.

    A run's length is found by bisection over hashed slices, so the work isn't quadratic in the texts' length, as the standard library's is.
    """
    total, left = 0, [(a, b)]
    while left:
        x, y = left.pop()
        if x == y:
            total += len(x)
        elif len(x) * len(y) <= SHORT or max(len(x), len(y)) > LONG:
            total += sum(block.size for block in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
        else:
            i, j, k = longest_run(x, y)
            if k:
                total += k
                left += [(x[:i], y[:j]), (x[i + k :], y[j + k :])]
    return total


def ratio(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    return 1.0 if a == b else 2.0 * matched(a, b) / (len(a) + len(b))


def ratio_bounds(left: list[str], right: list[str]) -> np.ndarray:
    """For each pair of texts a number that its ratio doesn't exceed: the characters that both have, wherever they are."""
    kinds = {c: k for k, c in enumerate(sorted(set().union(*left, *right)))}
    counts = []
    for texts in (left, right):
        of = np.zeros((len(kinds), len(texts)), np.int32)
        for i, t in enumerate(texts):
            for c, n in Counter(t).items():
                of[kinds[c], i] = n
        counts.append(of)
    both = np.zeros((len(left), len(right)), np.int32)
    for x, y in zip(*counts):
        i, j = np.flatnonzero(x), np.flatnonzero(y)
        both[np.ix_(i, j)] += np.minimum.outer(x[i], y[j])
    size = np.add.outer([len(t) for t in left], [len(t) for t in right])
    return np.where(size > 0, 2.0 * both / np.maximum(size, 1), 1.0)


@F.pandas_udf(T.DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * matched / total characters; the order of the arguments matters."""
    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.StringType())
def nfkc_udf(a: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else unicodedata.normalize("NFKC", x).casefold() for x in a], dtype="object")


OPERATIONS = T.ArrayType(T.StructType([T.StructField("operation", T.StringType()), T.StructField("before_text", T.StringType()), T.StructField("after_text", T.StringType())]))


@F.pandas_udf(OPERATIONS)
def word_edits_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """The word-level operations that turn a into b, equal stretches left out."""
    out = []
    for x, y in zip(a, b):
        p, q = (x or "").split(), (y or "").split()
        steps = difflib.SequenceMatcher(None, p, q, autojunk=False).get_opcodes()
        out.append([{"operation": op, "before_text": " ".join(p[i:j]), "after_text": " ".join(q[k:m])} for op, i, j, k, m in steps if op != "equal"])
    return pd.Series(out)


def edit_class(before: str, after: str, fillers: frozenset[str] = frozenset({"어", "음", "그", "uh", "um"})) -> str:
    """none, punctuation, filler, or by similarity minor (0.88), moderate (0.65) or substantive."""
    if before == after:
        return "none"
    words = lambda s: [w.lower() for w in _TOKEN.findall(s)]
    x, y = words(before), words(after)
    if "".join(x) == "".join(y):
        return "punctuation"
    if [w for w in x if w not in fillers] == [w for w in y if w not in fillers]:
        return "filler"
    r = ratio(" ".join(x), " ".join(y))
    return "minor" if r >= 0.88 else "moderate" if r >= 0.65 else "substantive"


@F.pandas_udf(T.StringType())
def edit_class_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edit_class(x or "", y or "") for x, y in zip(a, b)])


def similar_names(a: str, b: str) -> bool:
    """Spelling variants, but no extensions of each other by three characters or more.

    Names of as many words, two or more: each word alike (0.62) and all on average (0.8). Else by their letters and digits: with one
    initial, 0.72 from seven characters on (four more or less at most) or 0.76 from five (two at most); single words with one initial
    0.68 from seven characters and 0.7 from five, others 0.84, four more or less at most.
    """
    x, y = a.lower().split(), b.lower().split()
    one, two = (re.sub("[^a-z0-9]+", "", s.lower()) for s in (a, b))
    if x == y or not one or not two:
        return False
    more, longest, initial = abs(len(one) - len(two)), max(len(one), len(two)), one[0] == two[0]
    if (one.startswith(two) or two.startswith(one)) and more >= 3:
        return False
    if len(x) == len(y) > 1:
        each = [ratio(p, q) for p, q in zip(x, y)]
        return min(each) >= 0.62 and sum(each) / len(each) >= 0.80
    r = ratio(one, two)
    if initial and (longest >= 7 and more <= 4 and r >= 0.72 or longest >= 5 and more <= 2 and r >= 0.76):
        return True
    if len(x) == len(y) == 1:
        return more <= 4 and r >= (0.68 if initial and longest >= 7 else 0.70 if initial and longest >= 5 else 0.84)
    return False


@F.pandas_udf(T.BooleanType())
def similar_names_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([bool(x and y and similar_names(x, y)) for x, y in zip(a, b)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def recovered_objects_udf(texts: pd.Series) -> pd.Series:
    """The complete JSON objects of a list that may have been cut off."""
    read = json.JSONDecoder()

    def recover(text: str | None) -> list[str]:
        out, at = [], (text or "").find("[") + 1
        while at and (start := text.find("{", at)) >= 0:
            try:
                value, at = read.raw_decode(text, start)
            except ValueError:
                break
            out.append(json.dumps(value, ensure_ascii=False, sort_keys=True))
        return out

    return pd.Series([recover(t) for t in texts])


_SHIELDED = re.compile(r"https?://\S+|\b[\w-]+\.(?:com|org|net|io|ai|kr)\b(?:/\S*)?|(?<!\w)/[a-z][\w-]*|(?:\./|~/)\S+")


def replace_shielded(text: str | None, variants: dict[str, str]) -> str | None:
    """Variants replaced by their canonical forms, the longest first and as whole words, but not inside URLs, domains, paths and commands."""
    if text is None or not variants:
        return text
    forms = sorted(variants, key=len, reverse=True)
    find = re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(r"\s*".join(map(re.escape, v.split())) for v in forms) + r")(?![A-Za-z0-9])", re.IGNORECASE)
    known = {"".join(v.lower().split()): c for v, c in variants.items()}
    out, at = [], 0
    for m in [*_SHIELDED.finditer(text), None]:
        end = m.start() if m else len(text)
        out.append(find.sub(lambda x: known["".join(x[0].lower().split())], text[at:end]))
        if m:
            out.append(m[0])
            at = m.end()
    return "".join(out)


def replace_shielded_udf(variants: dict[str, str]):
    """A UDF of replace_shielded for a small table of variants."""

    @F.pandas_udf(T.StringType())
    def replaced(texts: pd.Series) -> pd.Series:
        return pd.Series([replace_shielded(t, variants) for t in texts], dtype="object")

    return replaced


GUARD = T.StructType([T.StructField("passed", T.BooleanType()), T.StructField("reason", T.StringType())])


def fidelity(before: str, after: str, protected: tuple[str, ...] = ()) -> tuple[bool, str]:
    """Whether a rewrite keeps what it must, and the first reason why not."""
    if not after.strip():
        return False, "empty"
    if not 0.65 <= len(after) / max(1, len(before)) <= 1.35:
        return False, "length"
    if sorted(re.findall(r"\d+(?:\.\d+)?", before)) != sorted(re.findall(r"\d+(?:\.\d+)?", after)):
        return False, "numbers"
    latin = lambda s: {w.lower() for w in re.findall(r"[A-Za-z][A-Za-z0-9]+", s)}
    if re.search("[가-힣]", before) and not latin(before) <= latin(after):
        return False, "latin_names"
    if any(p in before and p not in after for p in protected):
        return False, "protected_term"
    changed = [o for o in difflib.SequenceMatcher(None, before.split(), after.split(), autojunk=False).get_opcodes() if o[0] != "equal"]
    return (False, "too_many_changes") if len(changed) > 4 else (True, "")


@F.pandas_udf(GUARD)
def fidelity_udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([fidelity(x or "", y or "") for x, y in zip(a, b)], columns=["passed", "reason"])


PATCH = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_spans", T.IntegerType()), T.StructField("n_rejected", T.IntegerType())])


def patched(before: str, candidate: str, anchor: int = 2, longest: int = 3) -> tuple[str, int, int]:
    """before with those word differences to the candidate that are short and stand between `anchor` equal words (or an end), and how many were taken and left."""
    x, y = before.split(), candidate.split()
    steps = difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes()
    out, taken, left = [], 0, 0
    for n, (op, i, j, k, m) in enumerate(steps):
        if op == "equal":
            out += x[i:j]
            continue
        fits = max(j - i, m - k) <= longest
        held = all(not 0 <= p < len(steps) or steps[p][2] - steps[p][1] >= anchor for p in (n - 1, n + 1))
        numbers = re.findall(r"\d+", " ".join(x[i:j])) == re.findall(r"\d+", " ".join(y[k:m]))
        if fits and held and numbers:
            out += y[k:m]
            taken += 1
        else:
            out += x[i:j]
            left += 1
    return " ".join(out), taken, left


@F.pandas_udf(PATCH)
def patched_udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([patched(x or "", y or "") for x, y in zip(a, b)], columns=["text", "n_spans", "n_rejected"])
