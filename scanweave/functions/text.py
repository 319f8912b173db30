"""Cleaning of recognised text: Column in, Column out, no Python in the row path.

Text is folded to ASCII first, so that one set of plain regular expressions is right
for every language: non-ASCII letters and digits become the stand-in ``q`` (still a
word character, never an upper-case letter), other non-ASCII symbols become ``-`` and
every kind of blank becomes one space.  The cleaning steps blank all of them anyway.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanweave import constants as K

NON_ASCII_WORD = r"[^\x00-\x7F\p{M}\p{P}\p{S}\p{Z}\p{C}]"
#: letter by letter, since Java's expressions test such a class many times faster than ranges
UPPER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ANY_BLANK = r"[\x09-\x0D\x1C-\x1F\x85\xA0\p{Z}]"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.transform(F.array(value), body).getItem(0)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, " {2,}", " "))  # single blanks are no match


def fold_ascii(c: Column) -> Column:
    folded = F.regexp_replace(c, ANY_BLANK, " ")
    folded = F.regexp_replace(folded, NON_ASCII_WORD, "q")
    folded = F.regexp_replace(folded, r"[^\x00-\x7F]", "-")
    return F.when(c.rlike(r"[^\x20-\x7E]"), folded).otherwise(c)


def tokens(c: Column) -> Column:
    """Words of a text whose blanks are plain spaces; no words for a blank text."""
    # one blank is split at without an expression; " +" would be compiled for every text
    return F.filter(F.split(c, " "), lambda w: w != "")


def merge_spaced_letters(c: Column) -> Column:
    # One pass already is the fixpoint: a merged pair has no inner boundary left.
    return F.regexp_replace(c, r"\b([A-Z0-9])\s+([A-Z0-9])\b", "$1$2")


def drop_printed_labels(c: Column) -> Column:
    return F.regexp_replace(c, r"\b(" + "|".join(K.PRINTED_LABEL_WORDS) + r")\b", "")


def base_clean(c: Column) -> Column:
    upper = fold_ascii(F.upper(F.coalesce(c, F.lit(""))))
    return F.regexp_replace(
        merge_spaced_letters(drop_printed_labels(upper)), f"[^{UPPER}{DIGITS} /]", " "
    )


def digits_to_letters(c: Column) -> Column:
    return F.translate(c, *K.DIGIT_TO_LETTER)


def letters_to_digits(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.upper(c), *K.LETTER_TO_DIGIT), f"[^{DIGITS}]", "")


def clean_generic(c: Column) -> Column:
    return squeeze(base_clean(c))


def _long_words(c: Column) -> Column:
    letters = F.regexp_replace(digits_to_letters(c), f"[^{UPPER} ]+", "")
    return squeeze(F.regexp_replace(letters, r"\b[A-Z]{1,2}\b", ""))


def clean_name(c: Column) -> Column:
    return _long_words(base_clean(c))


def clean_state_text(c: Column) -> Column:
    """State text before the fuzzy choice; hyphens are blanked by the base step."""
    return _long_words(base_clean(c))


def address_line(c: Column) -> Column:
    """One address line: trailing stray letter dropped, relation prefix repaired,
    scattered letters joined."""

    def short(ws):
        return F.size(F.filter(ws, lambda w: F.length(w) <= 1))

    def without_stray_tail(ws):
        n = F.size(ws)
        head = F.slice(ws, 1, F.greatest(n - 1, F.lit(0)))
        stray = (
            (n > 1)
            & (F.length(F.try_element_at(ws, F.lit(-1))) == 1)
            & (F.length(F.array_join(head, "")) >= 4)
        )
        return F.when(stray, head).otherwise(ws)

    def with_relation(ws):
        first = F.replace(F.get(ws, F.lit(0)), F.lit("/"), F.lit(""))
        fixed = F.transform(
            ws,
            lambda w, i: F.when(i == 0, F.concat(F.left(first, F.lit(1)), F.lit("/O"))).otherwise(w),
        )
        return F.when(first.isin(K.RELATION_TOKENS), fixed).otherwise(ws)

    def joined(ws):
        n = F.size(ws)
        split_word = (
            (n == 2)
            & (F.length(F.get(ws, F.lit(0))) == 1)
            & (F.length(F.get(ws, F.lit(1))) >= 4)
        )
        scattered = (n >= 3) & (short(ws) >= F.greatest(F.lit(2), F.floor(n / 2)))
        return F.when(split_word | scattered, F.array_join(ws, "")).otherwise(F.array_join(ws, " "))

    return let(
        tokens(clean_generic(c)),
        lambda ws: let(without_stray_tail(ws), lambda v: let(with_relation(v), joined)),
    )


def anchor_text(c: Column) -> Column:
    upper = F.translate(F.upper(c), *K.ANCHOR_LETTERS)
    return squeeze(F.regexp_replace(upper, r"[^\p{L}\p{N}]+", " "))


def plain_text(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.upper(c), r"[^\p{L}\p{N}]+", " "))


def alnum_only(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), r"[^\p{L}\p{N}]", "")


def round4(c: Column) -> Column:
    """Half-even, like the confidences it has to agree with."""
    return F.bround(c, 4)


def vote_sum(c: Column) -> Column:
    """Sum for an argmax: rounded, since the order of a distributed sum is not fixed."""
    return F.round(F.sum(c), 9)


def review_flags(confidence: Column) -> Column:
    c = confidence.cast("double")
    return F.struct(
        F.bround(c * 100, 2).alias("score_percentage"),
        (c < K.REVIEW_CONFIDENCE).alias("needs_review"),
    )


def holder_name(c: Column) -> Column:
    """First two words of an identity card text that are not printed noise."""
    blank_folded = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), ANY_BLANK, " ")
    words = F.filter(
        F.split(F.regexp_replace(blank_folded, f"[^{UPPER} ]", ""), " +"),
        lambda w: (F.length(w) > 2) & ~w.isin(K.HOLDER_NOISE_WORDS),
    )
    return F.array_join(F.slice(words, 1, 2), " ")


def account_number(c: Column) -> Column:
    """Longest run of 9 to 18 digits, the first of equals; empty if there is none."""
    runs = F.regexp_extract_all(fold_ascii(F.coalesce(c, F.lit(""))), F.lit(r"\b[0-9]{9,18}\b"), F.lit(0))
    ranked = F.transform(runs, lambda r, i: F.struct(F.length(r).alias("n"), (-i).alias("o"), r.alias("r")))
    return F.coalesce(F.array_max(ranked)["r"], F.lit(""))
