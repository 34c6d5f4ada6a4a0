"""Phonetic keys, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import name_form

LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Letters by their sound.
GROUPS = {"1": "bfpv", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}
CODES = "".join(next((d for d, ls in GROUPS.items() if c in ls), "0") for c in LETTERS)


def soundex_tr(c) -> Column:
    """First letter and three codes. Unlike the classic code, every letter without a code ends a run."""
    t = F.replace(name_form(c), F.lit(" "), F.lit(""))
    runs = F.regexp_replace(F.translate(t, LETTERS, CODES), r"(.)\1+", "$1")
    code = F.replace(F.substring(runs, 2, 1 << 30), F.lit("0"), F.lit(""))
    return F.when(t == "", "").otherwise(F.left(F.concat(F.upper(F.left(t, F.lit(1))), code, F.lit("000")), F.lit(4)))


def metaphone_tr(c) -> Column:
    """Consonants without repeats, twelve at most."""
    t = name_form(c)
    for a, b in (("ph", "f"), ("w", "v"), ("x", "ks"), ("q", "k")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(F.regexp_replace(t, "[aeiou]", ""), r"(.)\1+", "$1")
    return F.upper(F.left(F.replace(t, F.lit(" "), F.lit("")), F.lit(12)))


def consonant_key(c: Column) -> Column:
    """The first engine's key: A-Z without vowels and repeats, sixteen at most."""
    t = F.regexp_replace(F.regexp_replace(F.upper(c), "[^A-Z]", ""), "[AEIOU]", "")
    return F.left(F.regexp_replace(t, r"(.)\1+", "$1"), F.lit(16))
