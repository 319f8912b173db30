"""String similarity as Arrow UDFs.

Each UDF sees a batch of rows, works out every distinct input once and keeps a bounded
memo per Python worker.  Exact hits are answered by built-in expressions around the UDF,
which then gets NULLs for those rows.
"""

from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanweave import constants as K
from scanweave.functions.text import tokens

MEMO = 1 << 16
WINDOW_BATCH = 1 << 17
#: from this length on, the library passes over frequent symbols
FREQUENT_FROM = 200


# --- gestalt ratio -----------------------------------------------------------------
def _shared(a: str, b: str) -> int:
    """Symbols in matching blocks: the longest common piece, of equals the first in a, then in b,
    and what is shared left and right of it."""
    n, m = len(a), len(b)
    i = most = at = there = 0
    while i + most < n:
        k = most + 1
        j = b.find(a[i:i + k])
        while j >= 0:  # a longer piece from here on: goes on at this place, else at a later one
            while i + k < n and j + k < m and a[i + k] == b[j + k]:
                k += 1
            most, at, there = k, i, j
            j = b.find(a[i:i + k + 1], j + 1) if i + k < n else -1
        i += 1
    if not most:
        return 0
    left = _shared(a[:at], b[:there]) if at and there else 0
    at, there = at + most, there + most
    return left + most + (_shared(a[at:], b[there:]) if at < n and there < m else 0)


@lru_cache(maxsize=MEMO)
def gestalt_ratio(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if len(b) >= FREQUENT_FROM:
        return SequenceMatcher(None, a, b).ratio()
    return 2.0 * _shared(a, b) / (len(a) + len(b))


def reaches(a: str, b: str, floor: float) -> bool:
    """ratio(a, b) >= floor.  Matching symbols are at most those of the shorter text and at
    most those of either that the other has at all; both bounds come first."""
    need = floor * (len(a) + len(b)) / 2.0
    if min(len(a), len(b)) < need or sum(map(a.__contains__, b)) < need or sum(map(b.__contains__, a)) < need:
        return False
    return gestalt_ratio(a, b) >= floor


def per_distinct(fn, *columns):
    """fn over the distinct argument tuples of a batch, NULL where an argument is NULL."""
    known = {}
    out = []
    for row in zip(*(c.tolist() for c in columns)):
        if row not in known:
            known[row] = None if None in row else fn(*row)
        out.append(known[row])
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return per_distinct(gestalt_ratio, a, b).astype("float64")


def seq_ratio(a: Column, b: Column) -> Column:
    """Similarity 0..1 by longest matching blocks.  The order of the arguments matters."""
    return F.when(a == b, F.lit(1.0)).otherwise(
        _ratio(F.when(a != b, a), F.when(a != b, b))
    )


# --- nearest of a fixed list --------------------------------------------------------
def _nearest_choice(choices, min_ratio):
    keyed = [(c, c.replace(" ", "").replace("-", "")) for c in choices]

    def nearest(text):
        compact = text.replace(" ", "").replace("-", "")
        best, best_ratio = text, 0.0
        for choice, key in keyed:
            # Only a ratio above both the floor and the best so far can change the answer.
            goal = max(best_ratio, min_ratio)
            total = len(compact) + len(key)
            if 2.0 * min(len(compact), len(key)) / max(1, total) < goal:
                continue
            matcher = SequenceMatcher(None, compact, key)
            if matcher.quick_ratio() < goal:
                continue
            ratio = matcher.ratio()
            if ratio >= min_ratio and ratio > best_ratio:
                best, best_ratio = choice, ratio
        return best

    return lru_cache(maxsize=MEMO)(nearest)


def fuzzy_choice(text: Column, choices=tuple(K.STATES), min_ratio=K.STATE_MIN_RATIO) -> Column:
    """The most similar choice, or the text itself below ``min_ratio``.  The list is fixed
    and small, so it travels with the expression and no join is needed."""
    memo = {}

    @F.pandas_udf(T.StringType())
    def nearest(texts: pd.Series) -> pd.Series:
        if "fn" not in memo:
            memo["fn"] = _nearest_choice(choices, min_ratio)
        return per_distinct(memo["fn"], texts)

    known = text.isin(list(choices))
    return F.when(known, text).otherwise(nearest(F.when(~known, text)))


# --- label words inside a text -------------------------------------------------------
@lru_cache(maxsize=MEMO)
def labels_like(field: str, word: str) -> frozenset:
    """The label words of a field that a word nearly is."""
    return frozenset(
        label for label in K.FIELD_LABELS[field]
        if word == label or reaches(label, word, K.LEAKAGE_TOKEN_RATIO)
    )


@F.pandas_udf(T.DoubleType())
def _leakage(field: pd.Series, words: pd.Series) -> pd.Series:
    def share(f, text):
        found = frozenset().union(*(labels_like(f, w) for w in text.split()))
        return len(found) / len(K.FIELD_LABELS[f])

    return per_distinct(share, field, words).astype("float64")


def label_leakage(field: Column, normalized: Column) -> Column:
    """Share of the field's label words found, nearly, in the text; 0 for other fields."""
    applies = field.isin(list(K.FIELD_LABELS)) & (normalized != "")
    return F.coalesce(
        _leakage(F.when(applies, field), F.when(applies, normalized)), F.lit(0.0)
    )


# --- label phrase in a layout row ------------------------------------------------------
def letter_set(text: str) -> Column:
    """The letters of a fixed text and its length."""
    return F.struct(F.lit("".join(dict.fromkeys(text))).alias("letters"), F.lit(len(text)).alias("n"))


def ratio_bound(text: Column, wanted: Column) -> Column:
    """No piece of the text has a higher ratio with the wanted one (as ``letter_set``): symbols in
    common are symbols of both, and m of them need a piece of m symbols at least.  0 for no text."""
    m = F.least(wanted["n"], F.length(text) - F.length(F.call_function("translate", text, wanted["letters"], F.lit(""))))
    n = F.greatest(wanted["n"], F.lit(1))
    return 2.0 - 2.0 * n / (m + n)  # 2m / (m + n), with the counted letters in one place only


def _less_surplus(score: Column, surplus: Column) -> Column:
    """Every word more than the phrase has costs, down to a floor."""
    kept = 1.0 - F.greatest(F.lit(0), surplus) * K.PHRASE_SURPLUS_COST
    return score * F.greatest(F.lit(K.PHRASE_SURPLUS_FLOOR), kept)


def phrase_sets(phrase: str, most_words: int) -> list[Column]:
    """The letter sets of a fixed phrase (``whole``) and of its words (``w0``, ``w1``, ...), as
    fields of a struct of equal shape for all phrases."""
    words = phrase.split()
    words += [""] * (most_words - len(words))
    return [letter_set(phrase).alias("whole"), *[letter_set(w).alias(f"w{i}") for i, w in enumerate(words)], F.lit(len(phrase.split())).alias("n_words")]


def phrase_bound(text: Column, token_count: Column, sets: Column, most_words: int) -> Column:
    """At least the phrase score of a normalized row, from its letters alone.  A filter on it
    has no common parts to share, so every part is in it once: a word that counts as close is
    stood for by its ratio over the least close one."""
    weight = K.PHRASE_RATIO_WEIGHT + K.PHRASE_CLOSE_WEIGHT / K.PHRASE_CLOSE_RATIO
    by_words = sum((ratio_bound(text, sets[f"w{i}"]) for i in range(most_words)), F.lit(0.0)) * weight / sets["n_words"]
    return _less_surplus(F.least(F.lit(1.0), F.greatest(by_words, ratio_bound(text, sets["whole"]))), token_count - sets["n_words"])


def _nearest(wanted: str, given: list[str]) -> float:
    return max(gestalt_ratio(wanted, g) for g in given)


@F.pandas_udf(T.DoubleType())
def _by_words(phrase: pd.Series, row: pd.Series) -> pd.Series:
    """The weighed ratios of the nearest word of a row for each word of a phrase."""

    def score(wanted, given):
        near = np.array([_nearest(w, given.split()) for w in wanted.split()])
        return float(K.PHRASE_RATIO_WEIGHT * near.mean() + K.PHRASE_CLOSE_WEIGHT * (near >= K.PHRASE_CLOSE_RATIO).mean())

    return per_distinct(score, phrase, row).astype("float64")


@F.pandas_udf(T.DoubleType())
def _by_run(phrase: pd.Series, runs: pd.Series) -> pd.Series:
    """The ratio of the nearest of several runs of words, one a line."""
    return per_distinct(lambda wanted, given: _nearest(wanted, given.split("\n")), phrase, runs).astype("float64")


def phrase_score(text: Column, token_count: Column, phrase: Column, phrase_words: Column) -> Column:
    """How well a normalized row shows a label phrase, 0..1: by the nearest word of the row for
    each word of the phrase, or by the nearest run of as many words; surplus words cost.  NULL
    for no text."""
    n = F.least(token_count, phrase_words)
    runs = F.transform(F.sequence(F.lit(1), token_count - n + 1), lambda i: F.array_join(F.slice(tokens(text), i, n), " "))
    nearest = F.greatest(_by_words(phrase, text), _by_run(phrase, F.when(text.isNotNull(), F.array_join(runs, "\n"))))
    return _less_surplus(nearest, token_count - phrase_words)


# --- best alignment of the shorter text within the longer ----------------------------------
def _window_score(pattern: str, text: str) -> float:
    """Best score of the pattern (1..64 symbols) over all windows of the text that are no
    longer than the pattern and, if shorter, lie at an end of the text.  All windows are
    worked through side by side with the bit-parallel LCS recurrence."""
    m, n = len(pattern), len(text)
    masks = {}
    for i, symbol in enumerate(pattern):
        masks[symbol] = masks.get(symbol, 0) | (1 << i)
    # m - 1 blanks on both sides turn the short end windows into windows of full length.
    bits = np.zeros(n + 2 * (m - 1), dtype=np.uint64)
    bits[m - 1:m - 1 + n] = [masks.get(symbol, 0) for symbol in text]
    windows = np.lib.stride_tricks.sliding_window_view(bits, m)
    starts = np.arange(len(windows))
    lengths = np.minimum(np.minimum(starts + 1, m), n + m - 1 - starts)
    best = 0.0
    for at in range(0, len(windows), WINDOW_BATCH):
        part = windows[at:at + WINDOW_BATCH]
        state = np.full(len(part), ~np.uint64(0))
        for j in range(m):
            hit = state & part[:, j]
            state = (state + hit) | (state - hit)
        lcs = np.bitwise_count(~state)
        best = max(best, float((200.0 * lcs / (m + lengths[at:at + WINDOW_BATCH])).max()))
    return best


def _long_window_score(pattern: str, text: str) -> float:
    """The same for patterns over 64 symbols, on Python's unbounded integers."""
    m, n = len(pattern), len(text)
    masks = {}
    for i, s in enumerate(pattern):
        masks[s] = masks.get(s, 0) | (1 << i)
    full = (1 << m) - 1
    best = 0.0
    for start in range(1 - m, n):
        window = text[max(0, start):start + m]
        state = full
        for s in window:
            hit = state & masks.get(s, 0)
            state = ((state + hit) | (state - hit)) & full
        best = max(best, 200.0 * (m - state.bit_count()) / (m + len(window)))
    return best


@lru_cache(maxsize=MEMO)
def partial_score(a: str, b: str) -> float:
    if not a or not b:
        return 100.0 if not a and not b else 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if short in long:
        return 100.0
    score = _window_score if len(short) <= 64 else _long_window_score
    best = score(short, long)
    return max(best, score(long, short)) if len(a) == len(b) else best


@F.pandas_udf(T.DoubleType())
def _partial(a: pd.Series, b: pd.Series) -> pd.Series:
    return per_distinct(partial_score, a, b).astype("float64")


def partial_ratio(a: Column, b: Column) -> Column:
    """0..100: best indel similarity of the shorter text to a window of the longer."""
    inside = F.contains(b, a) & (F.length(a) > 0)
    return F.when(inside, F.lit(100.0)).otherwise(
        _partial(F.when(~inside, a), F.when(~inside, b))
    )
