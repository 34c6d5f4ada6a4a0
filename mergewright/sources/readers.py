"""Readers. All columns come as strings: ids and phone numbers must not turn into numbers."""

from __future__ import annotations

import io
import json
import re
import urllib.request
import zipfile
from urllib.parse import urlparse
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import pick

RECORD = "adSoyad string, tcKimlikNo string, telefon string, email string, sehir string, adres string"
#: What the fields of a record are called in sources.
RECORD_ALIASES = {
    "adSoyad": ["Ad Soyad", "adSoyad", "name", "fullName"],
    "tcKimlikNo": ["TC", "tcKimlikNo", "tc", "identity", "idNumber"],
    "telefon": ["Telefon", "telefon", "phone", "mobile"],
    "email": ["E-mail", "email", "mail"],
    "sehir": ["Şehir", "Sehir", "sehir", "city"],
    "adres": ["Adres", "adres", "address"],
}




def csv(spark: SparkSession, path: str) -> DataFrame:
    """With a header; UTF-8, or Latin-1 where any byte of the path isn't UTF-8."""
    bad = not spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty()
    return spark.read.options(header=True, encoding="ISO-8859-1" if bad else "UTF-8", multiLine=True, escape='"').csv(path)


class _Sheet(InputPartition):
    def __init__(self, path: str):
        self.path = path


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def sheet_rows(raw: bytes):
    """The rows of a workbook's first sheet, as lists of strings."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.parse(z.open("xl/sharedStrings.xml")).getroot().findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        sheet = min(n for n in names if re.match(r"xl/worksheets/[^/]+\.xml$", n))
        for _, row in ElementTree.iterparse(z.open(sheet)):
            if row.tag != f"{{{_NS['m']}}}row":
                continue
            out: list[str] = []
            for c in row.findall("m:c", _NS):
                at = 0
                for ch in re.match("[A-Z]*", c.get("r", "")).group():
                    at = at * 26 + ord(ch) - 64
                out += [""] * (max(at, len(out) + 1) - 1 - len(out))
                v = c.find("m:v", _NS)
                if c.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                elif c.get("t") == "s":
                    value = shared[int(v.text)] if v is not None else ""
                else:
                    value = v.text or "" if v is not None else ""
                out.append(value)
            yield out
            row.clear()


def header_names(first: list[str]) -> list[str]:
    return [h.strip() or f"column_{i}" for i, h in enumerate(first, 1)]


class _ExcelReader(DataSourceReader):
    def __init__(self, schema: StructType, paths: list[str]):
        self.names, self.paths = schema.names, paths

    def partitions(self):
        return [_Sheet(p) for p in self.paths]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            rows = sheet_rows(f.read())
        next(rows, None)
        for r in rows:
            if any(x.strip() for x in r):
                yield tuple((r + [""] * len(self.names))[: len(self.names)])


class ExcelSource(DataSource):
    """spark.read.format("mergewright_xlsx").load(path): one partition for each file; files must be reachable by path on every machine."""

    @classmethod
    def name(cls) -> str:
        return "mergewright_xlsx"

    def _paths(self) -> list[str]:
        return [p.removeprefix("file://") for p in self.options["path"].split(",")]

    def schema(self) -> StructType:
        with open(self._paths()[0], "rb") as f:
            first = next(sheet_rows(f.read()), [])
        if not first:
            raise ValueError("the sheet is empty")
        return StructType([StructField(h, StringType()) for h in header_names(first)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ExcelReader(schema, self._paths())


def excel(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ExcelSource)
    return spark.read.format("mergewright_xlsx").load(path)


def file(spark: SparkSession, path: str) -> DataFrame:
    """By suffix; other suffixes and files without rows are refused."""
    suffix = path.rpartition(".")[2].lower()
    if suffix not in ("csv", "xlsx", "parquet", "json"):
        raise ValueError(f"files of kind {suffix} can't be read")
    df = csv(spark, path) if suffix == "csv" else excel(spark, path) if suffix == "xlsx" else spark.read.format(suffix).load(path)
    if df.isEmpty():
        raise ValueError("the file has no rows")
    return df


def records(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Records with their six fields; others are ignored, missing ones empty."""
    names = [f.split()[0] for f in RECORD.split(", ")]
    return spark.createDataFrame([tuple("" if r.get(n) is None else str(r[n]) for n in names) for r in rows], RECORD)


def pick_records(df: DataFrame) -> DataFrame:
    """Any frame as records: of each field the first of its columns that holds something."""
    return df.select(*(pick(df.columns, names).alias(field) for field, names in RECORD_ALIASES.items()))


def payload_rows(payload) -> list[dict]:
    """A list, or the list under records or data."""
    if isinstance(payload, dict):
        payload = payload.get("records", payload.get("data"))
    if not isinstance(payload, list):
        raise ValueError("no list of records")
    return [r for r in payload if isinstance(r, dict)]


def url(spark: SparkSession, address: str, method: str = "GET", key: str | None = None, body: dict | None = None, timeout: float = 30) -> DataFrame:
    """Records from a JSON address."""
    if urlparse(address).scheme not in ("http", "https") or method not in ("GET", "POST"):
        raise ValueError("only http(s), GET and POST")
    request = urllib.request.Request(address, method=method, data=json.dumps(body or {}).encode() if method == "POST" else None)
    request.add_header("Content-Type", "application/json")
    if key:
        request.add_header("Authorization", f"Bearer {key}")
    with urllib.request.urlopen(request, timeout=timeout) as r:
        rows = payload_rows(json.load(r))
    flat = [{k: None if v is None else str(v) for k, v in r.items()} for r in rows]
    columns = list(dict.fromkeys(k for r in flat for k in r))
    df = spark.createDataFrame([tuple(r.get(c) for c in columns) for r in flat], ", ".join(f"`{c}` string" for c in columns))
    return pick_records(df)


def read_only(sql: str) -> str:
    """A single select or with statement; anything else raises ValueError."""
    text = sql.strip().rstrip(";").strip()
    if not re.match(r"(?is)(select|with)\b", text) or ";" in text:
        raise ValueError("only one select or with statement is allowed")
    return text


def identifier(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*){0,2}", name):
        raise ValueError("not the name of a table")
    return name


def jdbc_table(spark: SparkSession, options: dict, table: str, limit: int | None = None, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 32) -> DataFrame:
    """A table, in `parts` ranges of a numeric key if that is given with its bounds."""
    more = {"partitionColumn": key, "lowerBound": bounds[0], "upperBound": bounds[1], "numPartitions": parts} if key and bounds else {}
    df = spark.read.format("jdbc").options(**options, dbtable=identifier(table), **more).load()
    return df if limit is None else df.limit(limit)


def jdbc_query(spark: SparkSession, options: dict, sql: str) -> DataFrame:
    return spark.read.format("jdbc").options(**options, query=read_only(sql)).load()


def sql(spark: SparkSession, text: str) -> DataFrame:
    """A read-only statement on the session's catalog."""
    return spark.sql(read_only(text))


def tables(spark: SparkSession) -> DataFrame:
    """The catalog's tables in order."""
    rows = sorted((".".join(t.namespace or []), t.name) for t in spark.catalog.listTables())
    return spark.createDataFrame(rows, "table_schema string, table_name string")


def preview(spark: SparkSession, table: str, limit: int = 50) -> DataFrame:
    return spark.table(identifier(table)).limit(max(1, min(500, limit)))


def healthy(spark: SparkSession) -> bool:
    return spark.sql("select 1 as one").head().one == 1


def masked(options: dict) -> dict:
    """Connection options fit to be shown."""
    return {k: "***" if re.search("password|secret|token", k, re.I) else v for k, v in options.items()}


def scope(df: DataFrame, run_id: int | None = None, upload_id: int | None = None) -> DataFrame:
    """Rows of a normalization run, else of an upload, else all."""
    if run_id is not None:
        return df.where(F.col("normalization_run_id") == run_id)
    return df if upload_id is None else df.where(F.col("upload_id") == upload_id)
