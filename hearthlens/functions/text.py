"""Text to numbers, flags and labels, and numbers back to text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_money(text: Column) -> Column:
    """``'$1,234.00'`` to 1234.0: the whole text but for one leading currency sign and the commas.

    Empty text is 0, NULL and text that is no finite number are NULL.
    """
    signed = F.substring(text, 1, 1).isin("$", "€", "£", "¥")
    digits = F.replace(F.when(signed, F.substr(text, F.lit(2))).otherwise(text), F.lit(","), F.lit(""))
    # Unlike a double, a decimal takes no "NaN", "Infinity" or "12d".
    number = digits.try_cast("decimal(38,9)").cast("double")
    return F.coalesce(number, F.when(F.trim(digits) == "", F.lit(0.0)))


def parse_bathrooms(text: Column) -> Column:
    """``'1.5 shared baths'`` to 1.5: whatever stands before the first letter, 0 when nothing does."""
    before_letters = F.trim(F.regexp_extract(text, "^([^A-Za-z]*)", 1))
    return F.coalesce(before_letters.try_cast("double"), F.lit(0.0))


def flag(text: Column) -> Column:
    """0 for ``'f'`` and 1 for anything else, NULL included."""
    return F.when(text == "f", 0).otherwise(1)


def superhost_label(text: Column) -> Column:
    """``'t'``/``'f'`` as words; NULL stays NULL, unlike in :func:`flag`."""
    return F.when(text == "t", "Superhost").when(text == "f", "Not Superhost")


def fold(text: Column) -> Column:
    """Key under which text compares without case and trailing blanks."""
    return F.lower(F.rtrim(text))


def number_text(number: Column) -> Column:
    """A float as text with six significant digits: ``10``, ``163.49``, ``104998``, ``1.5e+006``.

    Halves go away from zero. NULL gives empty text, as text concatenation treats it.
    """
    shown = F.format_string("%.6g", number.cast("double"))
    shown = F.regexp_replace(shown, r"(\.\d*?)0+(?=e|$)", "$1")
    shown = F.regexp_replace(shown, r"\.(?=e|$)", "")
    shown = F.regexp_replace(shown, r"(e[+-])(\d\d)$", "$10$2")
    return F.when(number.isNull(), "").otherwise(shown)


def money_text(number: Column) -> Column:
    return F.concat(F.lit("$"), number_text(number))


def range_text(low: Column, high: Column) -> Column:
    return F.concat(number_text(low), F.lit(" - "), number_text(high))


def percent_text(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` as ``'31.06%'``, always two decimals."""
    share = F.try_divide(part.cast("double") * 100, whole.cast("double"))
    return F.concat(share.cast("decimal(10,2)").cast("string"), F.lit("%"))
