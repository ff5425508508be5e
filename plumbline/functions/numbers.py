"""Column functions on numbers and on the text they were written in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A signed decimal, with or without a leading zero, optionally in scientific form.
NUMBER = r"[-+]?(?:\d+\.\d+|\d+|\.\d+)(?:[eE][-+]?\d+)?"


def to_double(c: Column) -> Column:
    """Text or number to double; anything unreadable becomes null."""
    return c.try_cast("double")


def clean_nan(c: Column) -> Column:
    """NaN to null, so that missing values look the same everywhere."""
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def decimals_of(raw: Column) -> Column:
    """Number of digits written after the point."""
    return F.length(F.regexp_extract(raw, r"\.(\d+)", 1))


def parse_number(raw: Column) -> Column:
    """First number in a cell such as ``12.5%`` or ``1,234`` or ``.05*``."""
    text = F.regexp_replace(raw, r"(?<=\d)[,，](?=\d{3}(?:\D|$))", "")
    text = F.translate(text, "−－–", "---")
    return F.regexp_extract(text, NUMBER, 0).try_cast("double")


def parse_p(raw: Column) -> Column:
    """p-value text to double: ``.05``, ``1e-5``, ``1.2×10^-3``."""
    text = F.translate(raw, "−－–", "---")
    power = F.regexp_extract(text, r"[×x*]\s*10\s*\^?\s*\(?(-?\d+)\)?", 1).try_cast("int")
    base = F.regexp_extract(text, NUMBER, 0).try_cast("double")
    return F.when(power.isNotNull(), base * F.pow(F.lit(10.0), power)).otherwise(base)


def half_unit(raw: Column) -> Column:
    """Half a unit of the last digit written: the rounding width of a reported number."""
    power = F.coalesce(
        F.regexp_extract(raw, r"[×x*]\s*10\s*\^?\s*\(?(-?\d+)\)?", 1).try_cast("int"),
        F.regexp_extract(raw, r"[eE]([-+]?\d+)", 1).try_cast("int"),
        F.lit(0),
    )
    return F.lit(0.5) * F.pow(F.lit(10.0), power - decimals_of(raw))


def plain_text(value: Column) -> Column:
    """Decimal text without trailing zeros; null below 1e-4 and from 1e16 on, where a value is only ever
    written in scientific form."""
    text = value.cast("string")
    size = F.abs(value)
    text = F.when(~text.contains("E"), text).when(
        (size >= 1e-4) & (size < 1e16), value.try_cast("decimal(38,20)").cast("string"))
    text = F.when(text.contains("."), F.regexp_replace(text, r"\.?0*$", "")).otherwise(text)
    return F.regexp_replace(text, "^-", "")


def first_digit(value: Column) -> Column:
    """Leading non-zero digit, read from the decimal text and not from a logarithm."""
    digit = F.regexp_extract(value.cast("string"), r"^-?[0.]*([1-9])", 1)
    return digit.try_cast("int")


def terminal_digit(value: Column, scale: int | None = None) -> Column:
    """Last digit as read: ``120.0`` -> 0, ``12.50`` -> 5.

    With ``scale`` the value is first written with that many decimals (a price in cents), which
    keeps trailing zeros and needs no text.
    """
    if scale is not None:
        return F.pmod(F.round(F.abs(value) * (10 ** scale)).cast("long"), F.lit(10)).cast("int")
    return F.regexp_extract(plain_text(value), r"(\d)$", 1).try_cast("int")


def two_digit_tail(raw: Column) -> Column:
    """Last two decimals of a number written with at least two of them."""
    return F.nullif(F.regexp_extract(raw, r"\.\d*(\d\d)$", 1), F.lit(""))


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation as an aggregate; null without variance.

    The built-in one fails under ANSI division when a side is constant.
    """
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(r > 1, 1.0).when(r < -1, -1.0).otherwise(r)


CHINESE_DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5,
                  "六": 6, "七": 7, "八": 8, "九": 9}


def chinese_numeral(raw: Column) -> Column:
    """Arabic digits or Chinese numerals up to 99, as an integer."""
    table = F.create_map(*[F.lit(v) for kv in CHINESE_DIGITS.items() for v in kv])
    arabic = raw.try_cast("int")
    head = F.regexp_extract(raw, r"^(.)?十(.)?$", 1)
    tail = F.regexp_extract(raw, r"^(.)?十(.)?$", 2)
    tens = F.coalesce(table[head], F.lit(1)) * 10 + F.coalesce(table[tail], F.lit(0))
    return F.coalesce(arabic, F.when(raw.contains("十"), tens).otherwise(table[raw]))
