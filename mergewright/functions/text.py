"""Normalization of names, ids, phones and e-mails, as column expressions that stay inside whole-stage code generation.

In clean columns the empty string means missing. Turkish letters are translated before the case changes, since engines differ in
how they map dotted and dotless i."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Turkish letters and what they become.
TURKISH = "İIĞÜŞÖÇığüşöçÞþ"
UPPER_ASCII = "IIGUSOCIGUSOCSS"
LOWER_ASCII = "iigusocigusocss"


def text(c: Column | str) -> Column:
    """As a string without outer white space; null: empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")


def present(c: Column | str) -> Column:
    return text(c) != ""


def tr_text(c) -> Column:
    """Upper case A-Z and digits; anything else parts words, which one space joins."""
    up = F.upper(F.translate(text(c), TURKISH, UPPER_ASCII))
    return F.trim(F.regexp_replace(F.regexp_replace(up, "[^A-Z0-9]", " "), " +", " "))


def name_form(c) -> Column:
    """The lower-case form that similarities compare."""
    low = F.lower(F.translate(text(c), TURKISH, LOWER_ASCII))
    return F.trim(F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]", " "), " +", " "))


def digits(c) -> Column:
    return F.regexp_replace(text(c), r"(?U)\D", "")


def clean_phone(c) -> Column:
    """Digits; of ten or more the last ten."""
    return F.right(digits(c), F.lit(10))


def clean_tc(c) -> Column:
    return digits(c)


def _compact(c) -> Column:
    return F.regexp_replace(text(c), r"(?U)\s", "")


def clean_email(c) -> Column:
    return F.lower(_compact(c))


def clean_muhatap_no(c) -> Column:
    return F.upper(_compact(c))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda x: x != "")


def canonical_name(c: Column) -> Column:
    """The distinct words in order."""
    return F.array_join(F.array_sort(F.array_distinct(tokens(c))), " ")


def first_name(c: Column) -> Column:
    return F.coalesce(F.get(tokens(c), F.lit(0)), F.lit(""))


def last_name(c: Column) -> Column:
    """The last of two or more words, else empty."""
    t = tokens(c)
    return F.when(F.size(t) > 1, F.element_at(t, -1)).otherwise("")


def surname_or_only(c: Column) -> Column:
    """The last word, also of one."""
    t = tokens(c)
    return F.when(F.size(t) > 0, F.element_at(t, -1)).otherwise("")


def email_key(c) -> Column:
    """For blocking: at the first @; without what follows + and without dots before it."""
    e = F.lower(text(c))
    user = F.replace(F.substring_index(F.substring_index(e, "@", 1), "+", 1), F.lit("."), F.lit(""))
    return F.when(F.instr(e, "@") > 0, F.concat(user, F.lit("@"), F.substring(e, F.instr(e, "@") + 1, F.length(e)))).otherwise(e)


def email_similarity_form(c) -> Column:
    """For similarity: at the last @; without what follows +, and in Gmail without dots."""
    e = F.lower(text(c))
    domain = F.substring_index(e, "@", -1)
    user = F.substring_index(F.left(e, F.length(e) - F.length(domain) - 1), "+", 1)
    user = F.when(domain.isin("gmail.com", "googlemail.com"), F.replace(user, F.lit("."), F.lit(""))).otherwise(user)
    return F.when(F.instr(e, "@") > 0, F.concat(user, F.lit("@"), domain)).otherwise(e)


def golden_email(c) -> Column:
    """The base address without a + part; empty if it isn't an address."""
    e = F.replace(F.lower(text(c)), F.lit(" "), F.lit(""))
    user = F.substring_index(F.substring_index(e, "@", 1), "+", 1)
    domain = F.substring(e, F.instr(e, "@") + 1, F.length(e))
    return F.when((F.instr(e, "@") > 0) & (user != "") & (domain != ""), F.concat(user, F.lit("@"), domain)).otherwise("")


def is_email_alias(c) -> Column:
    e = F.replace(F.lower(text(c)), F.lit(" "), F.lit(""))
    return (F.instr(e, "@") > 0) & F.contains(F.substring_index(e, "@", 1), F.lit("+")) & (golden_email(c) != "")


def golden_tc(c) -> Column:
    d = digits(c)
    return F.when(F.length(d) == 11, d).otherwise("")


def phone_last7(c: Column) -> Column:
    return F.right(c, F.lit(7))


def completeness(*cols: str) -> Column:
    """How many of the columns hold something."""
    out = F.lit(0)
    for c in cols:
        out = out + present(c).cast("int")
    return out


def blocking_key(tc: Column, last7: Column, email: Column, phonetic: Column, city: Column, ordered: Column) -> Column:
    """The first key that there is something for."""
    return (
        F.when(tc != "", F.concat(F.lit("tc:"), tc))
        .when(last7 != "", F.concat(F.lit("phone:"), last7))
        .when(email != "", F.concat(F.lit("email:"), email))
        .when((phonetic != "") & (city != ""), F.concat(F.lit("phonetic_city:"), phonetic, F.lit(":"), city))
        .when(ordered != "", F.concat(F.lit("name:"), ordered))
        .otherwise("")
    )


def ingestion_hash(payload: Column) -> Column:
    """A digest of a map that doesn't depend on the order of its entries."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(payload)))), 256)


def pick(columns: list[str], wanted: list[str]) -> Column:
    """The first non-empty of those wanted columns that there are."""
    found = [F.nullif(text(c), F.lit("")) for c in wanted if c in columns]
    return F.coalesce(*found, F.lit(""))


def parse_time(c: Column) -> Column:
    """A timestamp, taken as UTC, in one of three formats; null if in none."""
    formats = ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in formats))
