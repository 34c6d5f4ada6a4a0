"""A corpus from raw documents: quality, near-duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs. All but
the last return the columns of documents.

Defined results, of every stage: an empty table gives no rows; null and empty texts are documents like others (what each stage makes of them stands
with it); very long texts are read whole; rows that are equal or share an id, null ids among them, are documents of their own; other columns stay as they
are, whatever their names; every order is total, so that reruns agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mergewright.llm import bpe, mixing, neardup, quality, secrets
from mergewright.llm.common import cut, cut_tables, drop_since, read


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects (a score under 0.7). Null, empty and wordless texts share one score; equal texts
    are kept or dropped together; without labels every score is 0.5, so that all are dropped."""
    return quality.keep(docs, *quality.fitted(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on five-word shingles, the one with the smallest id stays; of equal rows one. Null, empty and
    wordless texts and rows with a null id are linked with nothing and stay."""
    return neardup.deduplicate(docs, 5, 80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts by a mark; n_chars follows. Null and empty texts stay as they are, and so do all rows."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, one row for each use, in the order of training; a use in part has the text's first words. Texts without words
    are taken by no mix and go; null sources are one source."""
    return mixing.materialise(docs, cut(mixing.mix(docs), "plan"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests of each document's tokens and of what they decode to, one row for each row of docs. Null text counts as empty and has no tokens."""
    return bpe.digest(docs, *bpe.default_vocabulary())


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("secrets", redact_secrets), ("mixing", mix_sources), ("tokens", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stage reads and the tables it cuts are deleted once its result is written."""
    docs, before = read(spark, sf_dir, "documents"), cut_tables()
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        drop_since(before, docs)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained classifier and Markov models aren't SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None
