"""Which source column holds which field. Works on column names, on the driver; the data are only renamed."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What source columns are called, by field.
ALIASES = {
    "name": ["ad soyad", "ad", "soyad", "name", "full name", "fullname"],
    "tc": ["tc", "tckn", "tc kimlik no", "identity", "idnumber"],
    "phone": ["telefon", "phone", "tel", "mobile", "gsm", "cep telefonu"],
    "email": ["email", "e-mail", "e mail", "eposta", "e-posta", "mail", "email address"],
    "city": ["sehir", "şehir", "il", "city"],
    "address": ["adres", "acik adres", "açık adres", "ikamet adresi", "address"],
    "muhatap_no": ["muhatap no", "muhatap kodu", "muhatap", "customer id", "customerid", "donor id", "donorid", "musteri no", "müsteri no", "musteri kodu", "müşteri kodu"],
}
#: What the fields are called once mapped.
CANONICAL = {"name": "Ad Soyad", "tc": "TC", "phone": "Telefon", "email": "E-mail", "city": "Şehir", "address": "Adres", "muhatap_no": "Muhatap No"}
_TURKISH = str.maketrans("çğıöşüÇĞİÖŞÜI", "cgiosucgiosui")


def header(name: str | None) -> str:
    """Lower case ASCII words."""
    return " ".join(re.sub("[^a-z0-9]+", " ", (name or "").translate(_TURKISH).lower()).split())


_TARGETS = {form: field for field, names in ALIASES.items() for n in names for form in (header(n), header(n).replace(" ", ""))}


def field_of(column: str) -> str:
    """The field a column holds, or ignored."""
    form = header(column)
    return _TARGETS.get(form) or _TARGETS.get(form.replace(" ", "")) or "ignored"


def suggest(spark: SparkSession, columns: list[str]) -> DataFrame:
    """source_column_name, target_field_name, is_required, mapping_type."""
    rows = [(c, field_of(c), field_of(c) == "name", "ignored" if field_of(c) == "ignored" else "direct") for c in columns]
    return spark.createDataFrame(rows, "source_column_name string, target_field_name string, is_required boolean, mapping_type string")


def resolve(columns: list[str], explicit: dict[str, str] | None = None, saved: dict[str, str] | None = None) -> dict[str, list[str]]:
    """Of each field its columns in header order: as asked for, else as saved, else by name. Unknown columns in a mapping are ignored."""
    chosen = explicit or saved or {}
    out: dict[str, list[str]] = {}
    for c in columns:
        field = chosen.get(c) if chosen else field_of(c)
        if field in CANONICAL:
            out.setdefault(field, []).append(c)
    return out


def apply(df: DataFrame, explicit: dict[str, str] | None = None, saved: dict[str, str] | None = None) -> DataFrame:
    """The canonical columns: mapped, several source columns of a field joined by a space in header order, and empty where there is none.
    Raises ValueError without a name."""
    found = resolve(df.columns, explicit, saved)
    if "name" not in found:
        raise ValueError("no column holds the name")
    one = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    joined = lambda cs: one(cs[0]) if len(cs) == 1 else F.trim(F.concat_ws(" ", *map(one, cs)))
    return df.select(*(joined(found[f]).alias(c) if f in found else F.lit("").alias(c) for f, c in CANONICAL.items()))


def replace_mappings(current: DataFrame, upload_id: int, new: list[tuple[str, str, bool, str]]) -> DataFrame:
    """The table of mappings with those of one upload replaced; empty names and the target `other` are left out."""
    spark = current.sparkSession
    rows = [(upload_id, *r) for r in new if r[0].strip() and r[1].strip() and r[1] != "other"]
    own = spark.createDataFrame(rows, "upload_id long, source_column_name string, target_field_name string, is_required boolean, mapping_type string")
    return current.where(F.col("upload_id") != upload_id).select(own.columns).unionByName(own)
