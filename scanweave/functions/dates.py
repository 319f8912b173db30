"""Birth dates: digit repair, century pivot, calendar check.

``current_year`` is always a parameter: results must not change with the day of the run.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanweave.functions.text import base_clean, let, letters_to_digits

DEFAULT_CURRENT_YEAR = 2026


def year_digits(digits: Column, current_year: int = DEFAULT_CURRENT_YEAR) -> Column:
    """Four-digit year of a digit string of 2, 3 or 4 and more digits, else empty."""
    n = F.length(digits)
    head = F.left(digits, F.lit(4))
    suffix = F.when(n >= 4, F.substring(digits, 3, 2)).otherwise(F.right(digits, F.lit(2)))
    value = suffix.try_cast("int")
    pivot = F.when(value <= current_year % 100, 2000 + value).otherwise(1900 + value).cast("string")
    starts = F.left(digits, F.lit(1)).isin("1", "2")
    return (
        F.when((n >= 4) & head.try_cast("int").between(1900, current_year), head)
        .when(((n >= 4) | (n == 3)) & starts, pivot)
        .when(n == 2, pivot)
        .otherwise(F.lit(""))
    )


def dob_from_digits(day: Column, month: Column, year: Column,
                    current_year: int = DEFAULT_CURRENT_YEAR) -> Column:
    def dated(p):
        d, m, y = p["d"], p["m"], p["y"]
        whole = (F.length(d) == 2) & (F.length(m) == 2) & (F.length(y) == 4)
        return let(F.when(whole, F.concat_ws("/", d, m, y)), lambda text: F.when(
            F.try_to_date(text, "dd/MM/yyyy").isNotNull(), text).otherwise(F.lit("")))

    parts = F.struct(
        F.left(day, F.lit(2)).alias("d"), F.left(month, F.lit(2)).alias("m"),
        let(year, lambda y: year_digits(y, current_year)).alias("y"))
    return let(parts, dated)


def dob_from_parts(day: Column, month: Column, year: Column,
                   current_year: int = DEFAULT_CURRENT_YEAR) -> Column:
    return dob_from_digits(
        letters_to_digits(day), letters_to_digits(month), letters_to_digits(year), current_year
    )


def clean_dob(c: Column, current_year: int = DEFAULT_CURRENT_YEAR,
              slash_is_separator: bool = False) -> Column:
    """Date in free text: around the first 19xx/20xx year, else read left to right.

    A slash counts as a misread 7 unless ``slash_is_separator`` is set.
    """
    text = base_clean(c)
    if slash_is_separator:
        text = F.translate(text, "/", " ")

    def parts(x, at, year):
        return dob_from_digits(x.substr(at, F.lit(2)), x.substr(at + 2, F.lit(2)), year, current_year)

    def read(x):
        around = let(F.regexp_instr(x, F.lit("19[0-9][0-9]|20[0-9][0-9]")), lambda at: F.when(
            at >= 5, parts(x, at - 4, x.substr(at, F.lit(4)))))
        straight = F.when(F.length(x) >= 7, parts(x, F.lit(1), x.substr(F.lit(5), F.length(x))))
        return F.coalesce(let(around, lambda a: F.when(a != "", a)), straight, F.lit(""))

    return let(letters_to_digits(text), read)


def repair_year_tail(dob: Column, raw: Column, hint_digit: Column, hint_letter: Column,
                     misread: str = "4", intended: str = "7", year: str = "1954") -> Column:
    """A year ending in a Y or V look-alike was read as 1954; write 1957 again."""
    wrong = (hint_digit == intended) & dob.endswith("/" + year)
    fixed = F.concat(dob.substr(F.lit(1), F.length(dob) - 1), F.lit(intended))
    tail = F.coalesce(F.nullif(hint_letter, F.lit("")), F.lit("Y"))
    fixed_raw = F.when(
        raw.endswith(misread), F.concat(raw.substr(F.lit(1), F.length(raw) - 1), tail)
    ).otherwise(raw)
    return F.struct(
        F.when(wrong, fixed_raw).otherwise(raw).alias("raw_text"),
        F.when(wrong, fixed).otherwise(dob).alias("clean_text"),
    )
