"""Scalar functions on names, tokens and type strings, all as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def capitalize(c: Column) -> Column:
    """First sign upper-cased, the rest as it is."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2**31 - 1))


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def strip_extension(path: Column) -> Column:
    """Without the last extension; dots of directories stay."""
    return F.regexp_replace(path, r"\.[^./]*$", "")


def main_type(c: Column) -> Column:
    """``TYPE:Subtype`` -> TYPE."""
    return F.when(F.instr(c, ":") > 1, F.substring_index(c, ":", 1)).otherwise(c)


def sub_type(c: Column) -> Column:
    return F.when(F.instr(c, ":") > 1, F.regexp_extract(c, r"^[^:]+:(.*)$", 1)).otherwise(F.lit(""))


def word_shape(token: Column) -> Column:
    """FEA10: first of all-digit forms, allCaps, initCap, lowerCase, hyphenated, other (ASCII letters and digits)."""
    return (
        F.when(token.rlike(r"^[0-9]{2}$"), "twoDigitNum").when(token.rlike(r"^[0-9]{4}$"), "fourDigitNum").when(token.rlike(r"^[0-9]+$"), "otherNum")
        .when(token.rlike(r"^[A-Z]+$"), "allCaps").when(token.rlike(r"^[A-Z][a-z]+$"), "initCap").when(token.rlike(r"^[a-z]+$"), "lowerCase")
        .when(token.rlike(r"^[A-Za-z0-9]+(-[A-Za-z0-9]+)+$"), "hyphenated").otherwise("other")
    )


def shape(token: Column) -> Column:
    """FEA5: every sign as A, a, 0 or itself."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[0-9]", "0"), "[A-Z]", "A"), "[a-z]", "a")


def short_shape(token: Column) -> Column:
    """FEA5: the shape with runs of one sign collapsed."""
    return F.regexp_replace(shape(token), r"(.)\1+", "$1")


def letters(token: Column) -> Column:
    """FEA4: ASCII letters only."""
    return F.regexp_replace(token, "[^A-Za-z]", "")


def non_letters(token: Column) -> Column:
    """FEA4: everything but ASCII letters."""
    return F.regexp_replace(token, "[A-Za-z]", "")


#: FEA1: whole-token flags
FLAGS = {
    "INITCAP": "[A-Z].*", "CAPITALIZED": "[A-Z][a-z]+", "ALLCAPS": "[A-Z]+", "ALLDIGITS": "[0-9]+", "TWODIGITS": "[0-9]{2}", "FOURDIGITS": "[0-9]{4}",
    "MORETHANFOURDIGITS": "[0-9]{5,}", "ROMAN_NUMBER": "[IVXLCDM]+", "CAPITALANDDIGIT": "[A-Z]+[0-9]+", "YEAR_DECADE": "[0-9]{4}s", "MIXEDCAPS": "[A-Z][a-z]+[A-Z][A-Za-z]*",
    "MULTIDOT": r"\.\.+", "ENDSINDOT": r"[^.]+.*\.", "CONTAINSDASH": "[A-Za-z0-9]+-[A-Za-z0-9]*", "ACRONYM": r"[A-Z][A-Z.]*\.[A-Z.]*", "CAP_OTHER_PERIOD": r"[A-Z][a-z]+\.",
    "CAP_PERIOD": r"[A-Z]\.", "SINGLECHAR": "[A-Za-z]", "CAPLETTER": "[A-Z]", "PUNCTUATION": "[,.;:?!+-]", "QUOTE": "[\"'`]+", "CURRENCY": r"[$€£¥]", "OPEN_PAREN": "[(]", "CLOSE_PAREN": "[)]",
}


def whole_match(token: Column, pattern: str) -> Column:
    """FEA2: the pattern fits the whole token."""
    return token.rlike(rf"^(?:{pattern})$")


def flags(token: Column) -> Column:
    """FEA1/FEA2: names of all flags whose pattern the whole token fits."""
    return F.filter(F.array(*[F.when(token.rlike(f"^(?:{p})$"), F.lit(n)) for n, p in FLAGS.items()]), lambda x: x.isNotNull())


def is_numeric(token: Column) -> Column:
    """FEA3: a number in US format."""
    return token.rlike(r"^-?(?:[0-9][0-9,]*\.?[0-9]*|\.[0-9]+)$")


def year_bounds(token: Column) -> Column:
    """SEQ19: a year from 1000 to 2030."""
    return token.rlike(r"^[0-9]{4}$") & F.coalesce(F.try_to_number(token, F.lit("9999")).between(1000, 2030), F.lit(False))


def hour_minute(token: Column) -> Column:
    """SEQ19: h:mm; 24 and 60 are let through."""
    h, m = F.regexp_extract(token, r"^([0-9]{1,2}):([0-9]{2})$", 1), F.regexp_extract(token, r"^([0-9]{1,2}):([0-9]{2})$", 2)
    return (h != "") & F.coalesce(F.try_to_number(h, F.lit("99")) <= 24, F.lit(False)) & F.coalesce(F.try_to_number(m, F.lit("99")) <= 60, F.lit(False))


def arrays_meet(a: Column, b: Column) -> Column:
    """SET6: an empty side meets everything."""
    return (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)
