"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two models of order 1 over the characters of TOKEN (all others count as one) are trained from labelled samples: random strings (label 1) and
ordinary identifiers (label 0). A token that no pattern has covered is reported, kind markov, if the mean over its characters of
log p(random) - log p(ordinary) is at least MARGIN. default_samples() labels the words of a bounded number of documents (SAMPLE_DOCS, those whose
ids hash lowest) 0, and what the patterns find there, with as many strings from a seeded generator, 1.

Spans are in code points, end exclusive. redact() replaces them, from which the text's digests and lengths follow.

Defined results: null and empty texts have no spans; an empty table gives no rows and models that rest on the generator alone;
very long texts are scanned whole; repeated rows and rows that share an id or have none are scanned each; other columns are ignored (redact() keeps
them, whatever their names).
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, map_rows, read, small_batches

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: A text without any of these, its ASCII letters in lower case, has no match of ASSIGN.
ASSIGN_HINTS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
#: Runs are maximal, so that asking for the length in the pattern drops exactly the runs that are too short.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN = 12
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WORDS = re.compile(r"[A-Za-z0-9+/_=-]{4,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MARGIN = 0.9
SAMPLE_DOCS = 2000
SAMPLE_TOKENS = 50_000
GENERATED = 4000


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind by the fixed patterns, by start, then in the order of KINDS."""
    found = []
    low = text.encode().lower()
    if any(x in low for x in ASSIGN_HINTS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    found += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def generated(n: int = GENERATED, seed: int = 7) -> list[str]:
    """Random strings as keys are written: hexadecimal, letters and digits, upper case and digits, base 64 and its variant for addresses."""
    r = random.Random(seed)
    kinds = ("0123456789abcdef", ALPHABET[:62], ALPHABET[:26] + ALPHABET[52:62], ALPHABET[:62] + "+/", ALPHABET[:62] + "_-")
    return ["".join(r.choices(kinds[i % len(kinds)], k=r.randint(20, 48))) for i in range(n)]


class Ratio:
    """The two models as one table of log ratios by (character before, character)."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @staticmethod
    def codes(token: str) -> np.ndarray:
        return _CODE[np.frombuffer(token.encode("ascii", "replace"), np.uint8)]

    @classmethod
    def train(cls, samples: pd.DataFrame, smooth: float = 0.5) -> Ratio:
        """samples: token, label (1: random). Starts are moves from a state of their own; counts are smoothed."""
        size = len(ALPHABET) + 2
        logs = []
        for label in (1, 0):
            counts = np.full((size, size), smooth)
            rows = [cls.codes(x) for x in samples.token[samples.label == label] if x]
            for codes in rows:
                np.add.at(counts, (np.concatenate([[size - 1], codes[:-1]]), codes), 1)
            logs.append(np.log(counts / counts.sum(1, keepdims=True)))
        return cls(logs[0] - logs[1])

    def __call__(self, token: str) -> float:
        codes = self.codes(token)
        return float(self.table[len(ALPHABET) + 1, codes[0]] + self.table[codes[:-1], codes[1:]].sum()) / len(codes) if len(codes) else 0.0


_CODE = np.full(256, len(ALPHABET), np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))


def scan(text: str, ratio: Ratio, margin: float = MARGIN) -> list[tuple[int, int, str]]:
    """The base spans, and those that the models add outside of them."""
    base = base_spans(text)
    extra = [m.span() for m in TOKEN.finditer(text) if ratio(m[0]) >= margin]
    extra = [(a, b, "markov") for a, b in extra if not any(x < b and a < y for x, y, _ in base)] if base else [(a, b, "markov") for a, b in extra]
    return sorted(base + extra, key=lambda x: (x[0], KINDS.index(x[2])))


def default_samples(docs: DataFrame, n_docs: int = SAMPLE_DOCS, n_tokens: int = SAMPLE_TOKENS) -> pd.DataFrame:
    """token, label. Of the sampled documents at most n_tokens distinct words are kept, those that hash lowest, and at most as many secrets."""

    def run(batches):
        for b in small_batches(batches, 0):
            out = set()
            for text in b.column(0).to_pylist():
                spans = base_spans(text or "")
                out.update((text[a:e] if kind != "assign" else ASSIGN.match(text, a)[2], 1) for a, e, kind in spans)
                out.update((m[0], 0) for m in WORDS.finditer(text or "") if not any(x < m.end() and m.start() < y for x, y, _ in spans))
            yield pa.record_batch([pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.int32())], names=["token", "label"])

    key = F.xxhash64(F.col("doc_id").cast("string"))
    some = docs.select("text", key.alias("k"), F.col("doc_id").cast("string").alias("i")).where("text is not null")
    last = some.select("k", "i").orderBy("k", "i").limit(n_docs).agg(F.max("k")).first()[0]
    words = cut(some.where(F.col("k") <= F.lit(last if last is not None else 0)).select("text").mapInArrow(run, "token string, label int").distinct(), "words")
    found = [words.where(F.col("label") == k).orderBy(F.xxhash64("token"), "token").limit(n_tokens).toPandas() for k in (0, 1)]
    drop(words)
    return pd.concat([*found, pd.DataFrame({"token": generated(), "label": 1})], ignore_index=True)


FIELDS = (("doc_id", pa.int64(), "long"), ("n_assign", pa.int64(), "long"), ("n_access", pa.int64(), "long"), ("n_hex", pa.int64(), "long"), ("n_markov", pa.int64(), "long"), ("base_sha256", pa.string(), "string"), ("spans", pa.string(), "string"))


def joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def report(docs: DataFrame, samples: pd.DataFrame | None = None, margin: float = MARGIN) -> DataFrame:
    """doc_id, text -> the counts and spans of each document."""
    ratio = Ratio.train(default_samples(docs) if samples is None else samples)

    def run(batches):
        for b in small_batches(batches, 1):
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                spans = scan(text or "", ratio, margin)
                kinds = [x[2] for x in spans]
                base = joined(x for x in spans if x[2] != "markov")
                out.append((doc_id, *(kinds.count(k) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), joined(spans)))
            if out:
                yield pa.record_batch([pa.array(c, f[1]) for c, f in zip(zip(*out), FIELDS)], names=[f[0] for f in FIELDS])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, ", ".join(f"{f[0]} {f[2]}" for f in FIELDS))


def redact(docs: DataFrame, samples: pd.DataFrame | None = None, margin: float = MARGIN) -> DataFrame:
    """The documents with every span replaced by <secret:kind> (overlapping spans by one, of the first one's kind); n_chars, if there, follows."""
    ratio = Ratio.train(default_samples(docs) if samples is None else samples)
    at = docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        if not text or not (spans := scan(text, ratio, margin)):
            return text
        out, end = [], 0
        for a, b, kind in spans:
            if a >= end:
                out += [text[end:a], f"<secret:{kind}>"]
            end = max(end, b)
        return "".join(out) + text[end:]

    def run(batches):
        for b in small_batches(batches, at):
            yield pa.RecordBatch.from_arrays([pa.array(map(clean, c.to_pylist()), c.type) if i == at else c for i, c in enumerate(b.columns)], schema=b.schema)

    out = map_rows(docs, run)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read(spark, sf_dir, "documents"))
