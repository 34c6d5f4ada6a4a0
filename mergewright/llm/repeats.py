"""Repeated passages by suffix arrays: every byte covered by a string of LENGTH bytes that also starts elsewhere is removed.

Equal texts are found by a digest first: such a text repeats as a whole, and one of them stands for all in what follows. A
window (LENGTH bytes at one place) belongs to its anchor, the least hash of the GRAM-byte strings in it, so equal windows have equal anchors.
Runs of windows with one anchor value are stretches; only those whose anchor stands at two places or more can hold a repeated
window. Their bytes, equal ones once, are dealt by anchor to shards of about SHARD bytes, or larger ones where that would be over SHARDS of them. A shard's
task streams its text into a file and sorts its suffixes there with common-prefix lengths (suffix.py: external induced sorting with a memory budget
well under a shard), which tells the windows that have a match; they go back to the documents.

An anchor with very many different stretches (over HOT bytes) is split: by the distance from anchor to window, in ranges of STEP, and by
a hash of the bytes that all windows of that range hold. What is hot even then is split into single windows, by their own bytes.

Positions are judged on the input. Defined results: null text is empty; texts under LENGTH bytes and empty ones lose nothing; very long texts are read
whole; rows with a null id and repeated rows count as documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, cut_tables, drop, drop_since, read, shuffles_freed, small_batches
from .shingles import _power_tables, mix
from .suffix import BUDGET, PAD, scratch, sorted_suffixes

LENGTH = 200
GRAM = 40
STEP = 16
HOT = 1 << 20
SHARD = 1 << 23
#: Beyond so many shards they grow instead; a shard may be far larger than memory.
SHARDS = 20_000


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    power, inverse = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
    n = len(raw) - GRAM + 1
    return mix((sums[GRAM:] - sums[:n]) * inverse[:n])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values in a row, from running minima of blocks of w in both directions."""
    n = len(x)
    blocks = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    blocks[:n] = x
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def windows(texts: list[bytes], length: int = LENGTH):
    """Of texts of at least `length` bytes, one after another: where each begins, the grams' hashes, each window's least, and which windows lie in one text."""
    firsts = np.cumsum([0, *(len(t) for t in texts)])
    grams = gram_hashes(np.frombuffer(b"".join(texts), np.uint8))
    least = sliding_min(grams, length - GRAM + 1)
    real = np.zeros(len(least) + 1, np.int64)
    np.add.at(real, firsts[:-1], 1)
    np.add.at(real, np.minimum(firsts[1:] - length + 1, len(least)), -1)
    return firsts, grams, least, np.cumsum(real)[:-1] > 0


def stretches(texts: list[bytes], length: int = LENGTH):
    """Runs of windows with one anchor: text number, first window, number of windows, anchor."""
    firsts, _, least, real = windows(texts, length)
    start = real.copy()
    start[1:] &= ~real[:-1] | (least[1:] != least[:-1])
    start[firsts[:-1]] = True
    at = np.flatnonzero(start)
    text = np.searchsorted(firsts, at, side="right") - 1
    stop = np.minimum(np.append(at[1:], len(least)), firsts[text + 1] - length + 1)
    return text, at - firsts[text], stop - at, least[at].view(np.int64)


def anchor_places(texts: list[bytes], length: int = LENGTH):
    """Text number and anchor of each place that is some window's anchor; a place is named at most twice for a text and anchor."""
    firsts, grams, least, real = windows(texts, length)
    w = length - GRAM + 1
    span = np.zeros(len(grams) + w - 1, np.uint64)
    span[w - 1 : w - 1 + len(least)] = np.where(real, least, 0)
    at = np.flatnonzero((grams == ~sliding_min(~span, w)) & (grams > 0))
    text, anchor = np.searchsorted(firsts, at, side="right") - 1, grams[at]
    order = np.lexsort((anchor, text))
    text, anchor = text[order], anchor[order]
    third = np.zeros(len(at), bool)
    third[2:] = (anchor[2:] == anchor[:-2]) & (text[2:] == text[:-2])
    return text[~third], anchor[~third].view(np.int64)


def _bytes(texts) -> list[bytes]:
    return [(t or "").encode() for t in texts]


def anchors(texts: DataFrame) -> DataFrame:
    """h, text -> h, anchors (an entry for each place of one, two at most)."""

    def run(batches):
        for b in small_batches(batches, 1):
            text, anchor = anchor_places(_bytes(b.column(1).to_pylist()))
            bounds = np.searchsorted(text, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(bounds), pa.array(anchor))], names=["h", "anchors"])

    return texts.mapInArrow(run, "h binary, anchors array<long>")


PIECES = "anchor long, cid binary, h binary, at int, piece binary"


def _piece_batch(rows) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary())
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["anchor", "cid", "h", "at", "piece"])


def pieces(texts: DataFrame) -> DataFrame:
    """h, text, again (the text's anchors that occur again) -> the bytes of its stretches with those anchors."""

    def run(batches):
        for b in small_batches(batches, 1):
            raw, hs = _bytes(b.column(1).to_pylist()), b.column(0).to_pylist()
            text, first, n, anchor = stretches(raw)
            again = np.unique(b.column(2).flatten().to_numpy())
            pick = np.flatnonzero(np.isin(anchor, again))
            for lo in range(0, len(pick), 4000):
                out = []
                for i in pick[lo : lo + 4000]:
                    t, a = text[i], int(first[i])
                    piece = raw[t][a : a + int(n[i]) + LENGTH - 1]
                    out.append((int(anchor[i]), hashlib.md5(piece).digest(), hs[t], a, piece))
                if out:
                    yield _piece_batch(out)

    return texts.mapInArrow(run, PIECES)


def split(some: DataFrame, step: int) -> DataFrame:
    """Pieces of one anchor each -> smaller ones whose new anchor also covers the bytes that all their windows hold (step 1: the window itself)."""

    def cuts(piece: bytes, at: int):
        raw = np.frombuffer(piece, np.uint8)
        if step == 1:
            for i in range(len(piece) - LENGTH + 1):
                yield i, 1, piece[i : i + LENGTH]
            return
        grams, w = gram_hashes(raw), LENGTH - GRAM + 1
        least = sliding_min(grams, w)
        place = np.flatnonzero(grams == least[0]) if (least == least[0]).all() else None
        starts = np.arange(len(least))
        first = place[np.searchsorted(place, starts)] if place is not None else np.array([i + int(np.argmin(grams[i : i + w])) for i in starts])
        band = (first - starts) // step
        edge = [0, *(np.flatnonzero((band[1:] != band[:-1]) | (first[1:] != first[:-1])) + 1), len(band)]
        for a, b in zip(edge, edge[1:]):
            p, k = int(first[a]), int(band[a])
            yield a, b - a, str(k).encode() + b":" + piece[max(0, p - step * k) : p - step * k - (step - 1) + LENGTH]

    def run(batches):
        for b in batches:
            out = []
            for anchor, _, h, at, piece in zip(*(c.to_pylist() for c in b.columns)):
                for a, n, core in cuts(piece, at):
                    own = piece[a : a + n + LENGTH - 1]
                    new = int.from_bytes(hashlib.md5(anchor.to_bytes(8, "little", signed=True) + core).digest()[:8], "little", signed=True)
                    out.append((new, hashlib.md5(own).digest(), h, at + a, own))
                if len(out) > 4000:
                    yield _piece_batch(out)
                    out = []
            if out:
                yield _piece_batch(out)

    return some.mapInArrow(run, PIECES)


def spread(all_pieces: DataFrame) -> DataFrame:
    """Splits the anchors whose different pieces are over HOT bytes."""
    for step in (STEP, 1):
        sizes = all_pieces.select("anchor", "cid", F.length("piece").alias("n")).distinct().groupBy("anchor").agg(F.sum("n").alias("n"))
        hot = cut(sizes.where(F.col("n") > HOT).select("anchor"), "hot")
        if not hot.take(1):
            break
        fine = split(all_pieces.join(hot, "anchor", "left_semi").select(*[x.split()[0] for x in PIECES.split(", ")]), step)
        before, all_pieces = all_pieces, cut(all_pieces.join(hot, "anchor", "left_anti").unionByName(fine), "pieces")
        drop(before, hot)
    return all_pieces


def matched_windows(path: str, firsts: np.ndarray, folder: str, budget: int = BUDGET, told: dict | None = None):
    """Of each part of a text in a file (its parts end in 255, which stands in no UTF-8 text; firsts: where each begins, and where the last one ends), the runs
    (first window, number) of windows that also start elsewhere in the text."""
    n = int(firsts[-1])
    hit = np.memmap(f"{folder}/hits", np.uint8, "w+", shape=(n,))
    before = None
    for pos, lcp in sorted_suffixes(path, n, LENGTH, folder, budget, told):
        long_ = np.flatnonzero(lcp >= LENGTH)
        hit[pos[long_]] = 1
        hit[np.concatenate([pos[:1] if before is None else before, pos[:-1]])[long_]] = 1
        before = pos[-1:]
    lo = 0
    while lo < len(firsts) - 1:
        hi = max(lo + 1, int(np.searchsorted(firsts, firsts[lo] + BUDGET, side="right")) - 1)
        base, own = int(firsts[lo]), firsts[lo : hi + 1]
        room = np.repeat(own[1:] - 1, np.diff(own)) - np.arange(base, int(firsts[hi]))
        good = (hit[base : int(firsts[hi])] > 0) & (room >= LENGTH)
        edge = np.diff(np.concatenate([[False], good, [False]]).astype(np.int8))
        starts, stops = np.flatnonzero(edge == 1) + base, np.flatnonzero(edge == -1) + base
        of = np.searchsorted(own, starts, side="right") - 1
        out: list[list[tuple[int, int]]] = [[] for _ in range(hi - lo)]
        for k, x, y in zip(of, starts, stops):
            out[k].append((int(x - own[k]), int(y - x)))
        yield from out
        lo = hi


RUNS = "anchor long, cid binary, runs array<struct<first:int,n:int>>"
_RUNS = (pa.int64(), pa.binary(), pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())])))


def shard_runs(batches, budget: int = BUDGET):
    """Batches of one shard (anchor, cid, n, piece) -> RUNS of the pieces with repeated windows. The shard's text goes to a file as it comes."""
    with scratch() as folder:
        with open(f"{folder}/text", "wb") as text, open(f"{folder}/parts", "wb") as parts:
            for b in small_batches(batches, 3):
                rows = list(zip(*(c.to_pylist() for c in b.columns)))
                text.write(b"".join(x for *_, piece in rows for x in (piece, b"\xff")))
                parts.write(np.array([(anchor, cid, n, len(piece)) for anchor, cid, n, piece in rows], _PART).tobytes())
        if not os.path.getsize(f"{folder}/parts"):
            return
        known = np.memmap(f"{folder}/parts", _PART, "r")
        _, which, often = np.unique(known["anchor"], return_inverse=True, return_counts=True)
        # a piece that occurs again matches as a whole, and if it is the only one of its anchor no other piece can have a window of it
        sorted_ = (known["n"] == 1) | (often[which] > 1)
        lengths = known["length"].astype(np.int64) + 1
        with open(f"{folder}/text", "rb") as text, open(f"{folder}/sorted", "wb") as own:
            at = 0
            for take, n in zip(sorted_.tolist(), lengths.tolist()):
                if take:
                    text.seek(at)
                    own.write(text.read(n))
                at += n
            own.write(bytes(LENGTH + PAD))
        os.unlink(f"{folder}/text")
        found = matched_windows(f"{folder}/sorted", np.concatenate([[0], np.cumsum(lengths[sorted_])]), folder, budget) if sorted_.any() else iter(())
        out = []
        for part, take in zip(known, sorted_.tolist()):
            runs = next(found) if take else ()
            runs = [(0, int(part["length"]) - LENGTH + 1)] if part["n"] > 1 else runs
            if runs:
                out.append((int(part["anchor"]), part["cid"].tobytes(), [{"first": a, "n": k} for a, k in runs]))
            if len(out) == 4000:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), _RUNS)], names=["anchor", "cid", "runs"])
                out = []
        if out:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), _RUNS)], names=["anchor", "cid", "runs"])


_PART = np.dtype([("anchor", np.int64), ("cid", "V16"), ("n", np.int64), ("length", np.int64)])


def repeated(texts: DataFrame) -> DataFrame:
    """h, text (each h once, texts of LENGTH bytes or more) -> h, spans: what is covered, as maximal spans (start, end) in bytes; texts without are absent."""
    keyed = texts.select("h", "text")
    own = cut(anchors(keyed).select("h", F.explode("anchors").alias("anchor")), "anchors")
    again = own.groupBy("anchor").count().where("count > 1").select("anchor")
    mine = cut(own.distinct().join(again, "anchor", "left_semi").groupBy("h").agg(F.collect_list("anchor").alias("again")), "again")
    drop(own)
    found = cut(pieces(keyed.join(mine, "h").select("h", "text", "again")), "pieces")
    drop(mine)
    found = spread(found)
    different = found.groupBy("anchor", "cid", "piece").agg(F.count("*").alias("n"))
    total = found.agg(F.sum(F.length("piece"))).first()[0] or 0
    shards = min(SHARDS, max(1, -(-total // SHARD)))
    told = different.repartition(shards, "anchor").select("anchor", "cid", "n", "piece").mapInArrow(shard_runs, RUNS)
    told = cut(told, "runs")
    spans = found.select("anchor", "cid", "h", "at").join(told, ["anchor", "cid"]).select("h", "at", F.explode("runs").alias("r"))
    spans = spans.select("h", (F.col("at") + F.col("r.first")).alias("start"), (F.col("at") + F.col("r.first") + F.col("r.n") + LENGTH - 1).alias("end"))
    return spans.groupBy("h").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in spans:
        if out and s["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["end"])
        else:
            out.append([s["start"], s["end"]])
    return [(a, b) for a, b in out]


def without(raw: bytes, spans) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join(out) + raw[at:]


def removal(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end in bytes): one row for each row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    with shuffles_freed(docs.sparkSession):
        base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.md5(text)).alias("h"), F.sha2(text, 256).alias("whole"))
        base = cut(base, "texts")
        rows = base.where(F.col("n_bytes") >= LENGTH).groupBy("h", "doc_id").agg(F.count("*").alias("n"))
        classes = cut(rows.groupBy("h").agg(F.sum("n").alias("copies"), F.min(F.struct("doc_id", "n")).alias("rep")), "classes")
        reps = classes.select(F.col("h").alias("h2"), F.col("rep.doc_id").alias("id2"))
        mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.octet_length("text") >= LENGTH).withColumn("h", F.unhex(F.md5("text")))
        texts = mine.join(reps, (F.col("h") == F.col("h2")) & F.col("doc_id").eqNullSafe(F.col("id2")), "left_semi").select("h", "text")
        if classes.where("rep.n > 1").take(1):
            texts = texts.dropDuplicates(["h"])
        texts = cut(texts, "text")
        before = cut_tables()
        spans = cut(repeated(texts), "spans")
        drop_since(before, spans)

        def run(batches):
            for b in small_batches(batches, 1):
                out = []
                for h, t, s in zip(*(c.to_pylist() for c in b.columns)):
                    s = merged(s)
                    out.append((h, sum(y - x for x, y in s), len(s), hashlib.sha256(without(t.encode(), s)).hexdigest(), [{"start": x, "end": y} for x, y in s]))
                if out:
                    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["h2", "removed", "parts", "sha", "spans"])

        single = classes.where("copies = 1").select("h")
        cutting = texts.join(spans.join(single, "h", "left_semi"), "h").select("h", "text", "spans")
        some = cut(cutting.mapInArrow(run, "h2 binary, removed long, parts long, sha string, spans array<struct<start:int,end:int>>"), "removed")
    out = base.join(some, F.col("h") == F.col("h2"), "left").join(classes.where("copies > 1").select(F.col("h").alias("h3")), F.col("h") == F.col("h3"), "left")
    all_ = F.col("h3").isNotNull()
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(all_, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_, 1).otherwise(F.coalesce("parts", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("sha", "whole")).alias("kept_sha256"),
        F.when(all_, F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end")))).otherwise(F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,end:int>>)"))).alias("spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal(read(spark, sf_dir, "documents")).drop("spans")
