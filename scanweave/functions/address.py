"""Address lines to named parts, by line position."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanweave import constants as K
from scanweave.functions.text import address_line, clean_generic, let, squeeze, tokens

PARTS = (
    "area", "district", "city", "town_or_city", "address_line_1", "village",
    "street_or_post_office", "area_or_locality", "state",
)


def _at(items: Column, position: int) -> Column:
    """Element at a 1-based or negative position, empty when there is none."""
    return F.coalesce(F.try_element_at(items, F.lit(position)), F.lit(""))


def _by_line(lines: Column, state: Column) -> dict:
    n = F.size(lines)
    last, five = _at(lines, -1), n >= 5
    return {
        "address_line_1": _at(lines, 1),
        "village": _at(lines, 2),
        "street_or_post_office": _at(lines, 3),
        "area_or_locality": _at(lines, 4),
        "town_or_city": F.when(five, _at(lines, 5)).otherwise(last),
        "district": F.when(five, _at(lines, 5)).otherwise(last),
        "city": F.when(five, _at(lines, 5)).when(n >= 2, _at(lines, -2)).otherwise(last),
        "area": F.when(five, _at(lines, 4)).when(n >= 3, _at(lines, -3))
        .when(n == 2, _at(lines, -2)).otherwise(last),
        "state": state,
    }


def _by_word(words: Column, state: Column) -> dict:
    empty = F.lit("")
    return {
        **{p: empty for p in PARTS},
        "state": F.when(F.size(words) >= 1, _at(words, -1)).otherwise(state),
        "district": _at(words, -1),
        "city": _at(words, -2),
        "area": _at(words, -3),
    }


def parse_address(raw: Column, pin: Column, state: Column, lines: Column) -> Column:
    """Struct of address parts from the recognised lines, or from the raw text if there
    is no usable line.  ``lines`` is an array of strings and may be NULL."""
    pin, state = F.coalesce(pin, F.lit("")), F.coalesce(state, F.lit(""))
    kept = F.filter(
        F.transform(F.coalesce(lines, F.array().cast("array<string>")), address_line),
        lambda x: x != "",
    )
    noise = r"\b(" + "|".join(K.ADDRESS_NOISE_WORDS) + r")\b"

    def with_text(ls):
        text = F.when(F.size(ls) > 0, F.array_join(ls, " ")).otherwise(clean_generic(raw))
        return let(squeeze(F.regexp_replace(F.translate(text, "650", "GSO"), noise, "")),
                   lambda full: with_pin(ls, full))

    # What several parts use is bound once: inside a lambda no engine shares common expressions.
    def with_pin(ls, full):
        probe = F.regexp_extract(
            F.translate(full, "GOS", "005"), r"\b[0-9]{6}\b|\b[0-9]{5}[L|I][0-9]\b", 0
        )
        own = F.filter(ls, lambda x: (x != state) & (x != "INDIA"))
        return let(F.struct(probe.alias("probe"), own.alias("own")), lambda b: with_words(ls, full, b["probe"], b["own"]))

    def with_words(ls, full, probe, own):
        # With a hit the first six-character word is taken out, whatever it is.
        rest = F.when(
            probe != "", F.trim(F.regexp_replace(full, r"^(.*?)\b.{6}\b(.*)$", "$1$2"))
        ).otherwise(full)
        words = F.when(F.size(own) == 0, F.filter(tokens(rest), lambda w: F.length(w) > 2))
        return let(words, lambda ws: parts(ls, full, probe, own, ws))

    def parts(ls, full, probe, own, words):
        code = F.when(probe != "", F.translate(probe, "L|I", "111")).otherwise(pin)
        by_line, by_word = _by_line(own, state), _by_word(words, state)
        has_lines = F.size(own) > 0
        return F.struct(
            full.alias("full_address"),
            *[F.when(has_lines, by_line[p]).otherwise(by_word[p]).alias(p) for p in PARTS],
            ls.alias("line_items"),
            code.alias("pin_code"),
            F.lit("INDIA").alias("country"),
        )

    return let(kept, with_text)
