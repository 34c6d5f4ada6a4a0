"""Toxicity by a weighted lexicon.

Texts are folded first: lower case, homoglyphs of Latin letters, and digits or signs that stand for letters inside words. The lexicon holds
whole words and word beginnings with weights, matched by an Aho-Corasick automaton; matches inside an exception phrase don't count.
The score is logistic in the weight found and in the weight per word, both damped, so that length is normalised.

Learning, from a bounded sample of labelled rows (TOXIC_ROWS, CLEAN_ROWS), a lexicon of at most ENTRIES entries out of CANDIDATES: candidates are words and beginnings whose log odds of
documents, near copies sharing one vote, favour label 1 enough (more so if it occurs in clean ones at all); then entries are taken greedily by their weight among
documents not yet well covered. Exceptions are the neighbours (one word before or after) with which an entry occurs in clean documents only.

Defined results: null and empty texts get the score of no match; without labels of both classes the lexicon is empty and every score is
the share of label 1 (0 if none); very long texts are read whole; repeated rows and rows that share an id or have none are scored each; ids that are null
or have labels of both kinds teach nothing; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, small_batches
from .labelled import fold as fold_of
from .labelled import sample
from .neardup import signature
from .shingles import shingle_sets

PARTS, HELD = 5, 0
TOXIC_ROWS, CLEAN_ROWS = 3000, 6000
PREFIXES = (3, 4, 5, 6)
MIN_ODDS, SURE_ODDS = 3.5, 5.0
MIN_VOTES = 2.5
DECAY = 0.6
CANDIDATES, ENTRIES = 2000, 400

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = str.maketrans({
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ο": "o", "ι": "i", "ν": "v", "κ": "k", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ε": "e", "ı": "i", "ɑ": "a", "ɡ": "g",
})
#: Digits and signs that stand for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_LOOKALIKE = re.compile("[" + "".join(map(chr, HOMOGLYPHS)) + "Ａ-ｚ]")
#: Begins where a run of letters begins, so that a very long word is read once.
_MIXED = re.compile(r"(?<![^\W\d_])[^\W\d_]++[0-9@$!]+(?=[^\W_])(?:[\w@$]|!(?=\w))*|(?<!\w)[0-9@$]{1,2}(?=[^\W\d_]{2})(?:[\w@$]|!(?=\w))*")
_GAP = re.compile(r"[\W_]+")


def _plain(m: re.Match) -> str:
    c = m[0]
    return chr(ord(c) - 0xFEE0).lower() if "Ａ" <= c <= "ｚ" else c.translate(HOMOGLYPHS)


def fold_text(text: str | None) -> str:
    """Words in folded form, each with one space on both sides."""
    low = (text or "").lower()
    if not low.isascii():
        low = _LOOKALIKE.sub(_plain, low)
    low = _MIXED.sub(lambda m: m[0].translate(LEET), low)
    return " " + _GAP.sub(" ", low).strip() + " "


class Lexicon:
    def __init__(self, entries: dict[str, float], exceptions=(), bias: float = -4.0, total: float = 1.0, rate: float = 1.0):
        """entries: " word " or " beginning" -> weight. exceptions: phrases of folded words."""
        self.entries, self.exceptions = entries, tuple(exceptions)
        self.bias, self.total, self.rate = bias, total, rate
        self._made = None

    def __getstate__(self):
        return self.__dict__ | {"_made": None}

    def _automaton(self):
        if self._made is None:
            self._made = ahocorasick.Automaton()
            for k, w in self.entries.items():
                self._made.add_word(k, (k, w))
            for k in self.exceptions:
                self._made.add_word(f" {k} ", (f" {k} ", None))
            if len(self._made):
                self._made.make_automaton()
        return self._made

    def matches(self, folded: str) -> list[tuple[int, str, float]]:
        """Start, entry and weight of what counts; of entries that start together, only the longest counts."""
        auto = self._automaton()
        if not len(auto):
            return []
        found, shields = {}, []
        for end, (k, w) in auto.iter(folded):
            start = end + 1 - len(k)
            if w is None:
                shields.append((start, end))
            elif start not in found or len(found[start][0]) < len(k):
                found[start] = (k, w)
        return [(a, k, w) for a, (k, w) in sorted(found.items()) if not any(s <= a and a + len(k.rstrip()) <= e + 1 for s, e in shields)]

    def features(self, folded: str) -> tuple[float, float]:
        weight = sum(w for *_, w in self.matches(folded))
        n = max(1, folded.count(" ") - 1)
        return math.log1p(weight), math.log1p(1000 * weight / n)

    def score(self, text: str | None) -> float:
        a, b = self.features(fold_text(text))
        z = self.bias + self.total * a + self.rate * b
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def terms(folded: str) -> set[str]:
    out = set()
    for w in set(folded.split()):
        if len(w) > 2:
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in PREFIXES if len(w) > k)
    return out


def learn(rows: DataFrame) -> Lexicon:
    """rows: doc_id, text, y (0 or 1), a bounded number."""

    def run(batches):
        for b in small_batches(batches, 1):
            texts = b.column(1).to_pylist()
            groups = [int(signature(s)[0]) if len(s) else -1 for s in shingle_sets(texts, 3)]
            folded = [fold_text(t) for t in texts]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(groups, pa.int64()), pa.array([sorted(terms(t)) for t in folded], pa.list_(pa.string()))], names=["doc_id", "y", "g", "terms"])

    own = cut(rows.selectExpr("cast(doc_id as bigint) doc_id", "text", "cast(y as int) y").mapInArrow(run, "doc_id long, y int, g long, terms array<string>"), "terms")
    own = own.join(own.groupBy("g").agg((1 / F.count("*")).alias("w")), "g")
    sums = {r.y: r.w for r in own.groupBy("y").agg(F.sum("w").alias("w")).collect()}
    if not sums.get(0) or not sums.get(1):
        return Lexicon({}, bias=30.0 if sums.get(1) else -30.0)
    p, n = F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0.0)), F.sum(F.when(F.col("y") == 0, F.col("w")).otherwise(0.0))
    stats = own.select("y", "w", F.explode("terms").alias("term")).groupBy("term").agg(p.alias("p"), n.alias("n")).where(F.col("p") >= MIN_VOTES)
    odds = F.log((F.col("p") + 0.5) / (sums[1] + 1.0)) - F.log((F.col("n") + 0.5) / (sums[0] + 1.0))
    stats = stats.withColumn("odds", odds).where((F.col("odds") >= MIN_ODDS) & ((F.col("n") < 1) | (F.col("odds") >= SURE_ODDS))).orderBy((F.col("p") * F.col("odds")).desc(), "term").limit(CANDIDATES)
    weight = {r.term: r.odds for r in stats.collect()}
    if not weight:
        return Lexicon({}, bias=math.log(sums[1] / sums[0]))
    names = sorted(weight, key=lambda t: (len(t), t))
    number = {t: i for i, t in enumerate(names)}
    toxic = own.where("y = 1").select("w", F.array_intersect("terms", F.array(*map(F.lit, names))).alias("terms")).collect()
    table = np.zeros((len(toxic), len(names)), bool)
    for i, r in enumerate(toxic):
        table[i, [number[t] for t in r.terms]] = True
    vote, left = np.array([r.w for r in toxic]), np.ones(len(toxic))
    odds_of, taken = np.array([weight[t] for t in names]), []
    while len(taken) < ENTRIES:
        votes = (vote * left) @ table
        gain = votes * odds_of
        gain[votes < min(MIN_VOTES, 0.02 * vote.sum() + 1)] = 0
        gain[[number[t] for t in taken]] = 0
        best = int(np.argmax(gain))
        if gain[best] <= 0:
            break
        best = int(np.flatnonzero(gain >= 0.98 * gain[best])[-1])  # of those about as good, the longest
        taken.append(names[best])
        left[table[:, best]] *= DECAY
    return calibrate(rows, Lexicon({t: float(weight[t]) for t in taken}))


def calibrate(rows: DataFrame, lexicon: Lexicon) -> Lexicon:
    """Adds exception phrases and the logistic coefficients."""

    def near(batches):
        for b in small_batches(batches, 1):
            seen = {0: Counter(), 1: Counter()}
            for text, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                folded = fold_text(text)
                for at, *_ in lexicon.matches(folded):
                    before, after = folded[:at].rsplit(" ", 1)[-1:], folded[at + 1 :].split(" ", 2)
                    word = after[0]
                    if before[0]:
                        seen[y][f"{before[0]} {word}"] += 1
                    if len(after) > 1 and after[1]:
                        seen[y][f"{word} {after[1]}"] += 1
            out = [(k, y, n) for y, c in seen.items() for k, n in c.items()]
            if out:
                yield pa.record_batch([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int64())], names=["phrase", "y", "n"])

    rows = rows.selectExpr("cast(doc_id as bigint) doc_id", "text", "cast(y as int) y")
    found = rows.mapInArrow(near, "phrase string, y int, n long").groupBy("phrase").agg(F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("clean"), F.sum("y").alias("toxic"))
    exceptions = [r.phrase for r in found.where("clean >= 3 and toxic = 0").orderBy("phrase").collect()]
    lexicon = Lexicon(lexicon.entries, exceptions)

    def measure(batches):
        for b in small_batches(batches, 1):
            f = [lexicon.features(fold_text(t)) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(2), pa.array([x[0] for x in f], pa.float64()), pa.array([x[1] for x in f], pa.float64())], names=["y", "a", "b"])

    got = rows.mapInArrow(measure, "y int, a double, b double").toPandas()
    x, y = np.column_stack([np.ones(len(got)), got.a, got.b]), got.y.to_numpy(float)
    order = np.lexsort((x[:, 2], x[:, 1], y))
    x, y = x[order], y[order]
    beta = np.zeros(3)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q) + 1e-6)[:, None]).T @ x + np.diag([1e-3, 0.05, 0.05]), x.T @ (y - q) - np.array([1e-3, 0.05, 0.05]) * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return Lexicon(lexicon.entries, exceptions, *map(float, beta))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    known = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        for b in small_batches(batches, 2):
            s = [known.value.score(t) for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold_of(PARTS) == HELD).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = cut(sample(docs, read(spark, sf_dir, "labels"), "toxic", PARTS, HELD, {1: TOXIC_ROWS, 0: CLEAN_ROWS}), "toxic")
    return score(docs, learn(rows))
