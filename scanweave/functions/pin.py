"""Postal code digits out of noisy text."""

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanweave import constants as K
from scanweave.functions.text import base_clean, let


def token_digits(token: Column, weak: bool = False) -> Column:
    """Digits of a token ``[A-Z0-9|!]*``; look-alike letters count, with ``weak`` also the thin ones."""
    alike, digits = K.PIN_WEAK if weak else K.PIN_STRONG
    others = "".join(c for c in string.ascii_uppercase + "|!" if c not in alike)
    return F.translate(token, alike + others, digits)  # what has no counterpart is dropped


def _lane_digits(separator_lane: Column, digit_lane: Column) -> Column:
    """Digits of one lane when the other lane is mostly box separators, else NULL."""
    n = F.length(separator_lane)
    separators = n - F.length(F.translate(separator_lane, K.PIN_SEPARATORS, ""))
    digits = token_digits(digit_lane, weak=True)
    usable = (separators * 5 >= n * 3) & (F.length(digit_lane) >= 6) & (F.length(digits) >= 6)
    return F.when(usable, F.left(digits, F.lit(6)))


def _from_lanes(upper: Column) -> Column:
    def lanes(compact):
        both = F.struct(
            F.regexp_replace(compact, "(.).?", "$1").alias("even"),
            F.regexp_replace(compact, ".(.?)", "$1").alias("odd"),
        )
        # Mostly separators in one lane are a good part of both; few texts have them.
        n = F.length(compact)
        separators = n - F.length(F.translate(compact, K.PIN_SEPARATORS, ""))
        possible = (n >= 10) & (separators * 5 >= F.floor(n / 2) * 3)
        return F.when(possible, let(both, lambda b: F.coalesce(
            _lane_digits(b["even"], b["odd"]), _lane_digits(b["odd"], b["even"]))))

    return let(F.regexp_replace(upper, "[^A-Z0-9|!]+", ""), lanes)


def _from_tokens(upper: Column) -> Column:
    def per_token(t):
        def choose(d):
            return (
                F.when(F.length(d["strong"]) == 6, d["strong"])
                .when((F.length(d["strong"]) > 6) & t.rlike("^[0-9]+$"), F.left(d["strong"], F.lit(6)))
                .when(F.length(d["weak"]) == 6, d["weak"])
            )

        return let(F.struct(token_digits(t).alias("strong"), token_digits(t, weak=True).alias("weak")), choose)

    # A token never has more digits than characters, so only runs of six and more count.
    found = F.transform(F.regexp_extract_all(upper, F.lit("[A-Z0-9|!]{6,}"), F.lit(0)), per_token)
    return F.get(F.filter(found, lambda d: d.isNotNull()), F.lit(0))


def pin_digits(c: Column) -> Column:
    def read(upper):
        joined = let(F.regexp_replace(upper, "[^0-9]+", ""),
                     lambda j: F.when(F.length(j) >= 6, F.left(j, F.lit(6))))
        return F.coalesce(_from_lanes(upper), _from_tokens(upper), joined, F.lit(""))

    return let(F.upper(F.coalesce(c, F.lit(""))), read)


def clean_pin(c: Column) -> Column:
    return let(base_clean(c), pin_digits)
