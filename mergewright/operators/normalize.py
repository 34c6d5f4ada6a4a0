"""From mapped source rows to normalized records, their validation and its summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import phonetic as P
from ..functions import text as T

#: What is shown of a normalization's first rows.
PREVIEW = ["Ad Soyad", "Şehir", "Telefon", "TC", "E-mail", "Muhatap No", "clean_name", "first_name", "last_name", "ordered_name", "canonical_name", "name_phonetic", "name_phonetic_key", "clean_city", "clean_address", "clean_muhatap_no", "clean_phone", "phone_last7", "clean_tc", "clean_email", "email_normalized_key", "blocking_key", "is_valid"]


def normalize(df: DataFrame) -> DataFrame:
    """df: columns name, tc, phone, email, city, address, muhatap_no, and others, which stay -> the clean columns and keys."""
    clean = {
        "clean_name": T.tr_text("name"), "clean_city": T.tr_text("city"), "clean_address": T.tr_text("address"), "clean_tc": T.clean_tc("tc"),
        "clean_phone": T.clean_phone("phone"), "clean_email": T.clean_email("email"), "clean_muhatap_no": T.clean_muhatap_no("muhatap_no"),
    }
    c = F.col
    out = df.withColumns(clean).withColumns({
        "first_name": T.first_name(c("clean_name")), "last_name": T.last_name(c("clean_name")), "ordered_name": T.canonical_name(c("clean_name")),
        "phone_last7": T.phone_last7(c("clean_phone")), "email_normalized_key": T.email_key("clean_email"), "is_valid": T.present("clean_name"),
    })
    out = out.withColumns({"name_phonetic": P.soundex_tr("ordered_name"), "name_metaphone_key": P.metaphone_tr("ordered_name"), "clean_surname": T.surname_or_only(c("clean_name"))})
    return out.withColumns({
        "name_phonetic_key": c("name_phonetic"), "canonical_name": c("ordered_name"),
        "blocking_key": T.blocking_key(c("clean_tc"), c("phone_last7"), c("email_normalized_key"), c("name_phonetic"), c("clean_city"), c("ordered_name")),
    })


def validation(df: DataFrame) -> DataFrame:
    """Adds errors and warnings, arrays of codes, and row_status."""
    none = ~(T.present("clean_tc") | T.present("clean_phone") | T.present("clean_email"))
    out = df.withColumns({"errors": F.array_compact(F.array(F.when(~T.present("clean_name"), "missing_required_name"))), "warnings": F.array_compact(F.array(F.when(none, "missing_all_primary_identifiers")))})
    return out.withColumn("row_status", F.when(F.size("errors") > 0, "invalid").otherwise("valid"))


def warning_summary(validated: DataFrame) -> DataFrame:
    """code, n."""
    return validated.select(F.explode(F.concat("errors", "warnings")).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def preview(df: DataFrame, n: int = 50) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in PREVIEW if c in df.columns]).limit(n)


