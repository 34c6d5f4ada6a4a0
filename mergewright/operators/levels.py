"""Levels of agreement of all pairs of a block, from the block's rows: pairs are made in memory as numbers, each value is coded once, and a similarity is
told once for each two values that meet. Cells of many pairs are gone over as grids of rows, side by side, and their values meet as grids of one length by
another. What leaves is counts of patterns, or the pairs of the patterns asked for."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs looked at together; rows in a batch that leaves; the largest table of value pairs; the longest value that fits the bits of a word.
TOGETHER, LEAVES, TABLE, BITS = 1_000_000, 20_000, 1 << 24, 64
#: Pairs from which a cell is a grid; pairs of a grid looked at together, which should fit a core's own memory.
GRID, TILE = 1 << 14, 1 << 15


def winklers(values: list[str], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """linkage._winkler of values[x] and values[y], of 1 to 64 characters each: free and matched places are bits of a word."""
    n = np.array([len(v) for v in values], dtype=np.int64)
    at = np.repeat(np.arange(len(values)), n)
    place = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    letters, coded = np.unique(np.frombuffer("".join(values).encode("utf-32-le"), dtype="<u4"), return_inverse=True)
    text = np.full((len(values), max(4, n.max(initial=1))), -1, dtype=np.int64)
    text[at, place] = coded
    where = np.zeros((len(values), len(letters)), dtype=np.uint64)
    np.bitwise_or.at(where, (at, coded), np.uint64(1) << place.astype(np.uint64))
    one = np.uint64(1)
    upto = np.array([(1 << min(i, 64)) - 1 for i in range(130)], dtype=np.uint64)
    la, lb = n[x], n[y]
    reach = np.maximum(la, lb) // 2 - 1
    mine, theirs = np.zeros(len(x), dtype=np.uint64), np.zeros(len(x), dtype=np.uint64)
    for i in range(int(la.max(initial=0))):
        c = text[x, i]
        window = upto[np.clip(i + reach + 1, 0, 129)] & ~upto[np.clip(i - reach, 0, 129)]
        free = np.where(c >= 0, where[y, np.maximum(c, 0)], np.uint64(0)) & window & ~theirs
        first = free & (~free + one)
        theirs |= first
        mine |= np.where(first != 0, one << np.uint64(i), np.uint64(0))
    m, odd = np.zeros(len(x)), np.zeros(len(x))
    rest, a, b = np.flatnonzero(mine), mine.copy(), theirs.copy()
    while len(rest):
        p, q = a[rest] & (~a[rest] + one), b[rest] & (~b[rest] + one)
        m[rest] += 1
        odd[rest] += text[x[rest], np.log2(p.astype(float)).astype(int)] != text[y[rest], np.log2(q.astype(float)).astype(int)]
        a[rest] ^= p
        b[rest] ^= q
        rest = rest[a[rest] != 0]
    some = np.maximum(m, 1)
    j = np.where(m > 0, (m / la + m / lb + (m - odd / 2) / some) / 3.0, 0.0)
    j[(la == 1) & (lb == 1) & (text[x, 0] == text[y, 0])] = 1.0  # no place is within reach there, but equal values are alike
    alike = np.cumprod((text[x, :4] == text[y, :4]) & (text[x, :4] >= 0), axis=1).sum(axis=1)
    return np.where(j > 0.7, j + alike * 0.1 * (1.0 - j), j)


def reached(values: list[str], x: np.ndarray, y: np.ndarray, cuts: tuple[float, ...], winkler) -> np.ndarray:
    """How many of the cuts the similarity of values[x] and values[y] reaches."""
    out = np.zeros(len(x), dtype=np.int8)
    long = np.array([not 0 < len(v) <= BITS for v in values], dtype=bool)
    odd = long[x] | long[y]
    for k in np.flatnonzero(odd):
        out[k] = sum(winkler(values[x[k]], values[y[k]]) >= t for t in cuts)
    x, y = x[~odd], y[~odd]
    if len(x):
        short = [v if 0 < len(v) <= BITS else "?" for v in values]
        found = np.concatenate([winklers(short, x[i : i + TOGETHER], y[i : i + TOGETHER]) for i in range(0, len(x), TOGETHER)])
        out[~odd] = sum((found >= t).astype(np.int8) for t in cuts)
    return out


@lru_cache(4096)
def _told(la: int, lb: int, cuts: tuple[float, ...]) -> np.ndarray:
    """How many of the cuts values of two lengths reach, by matched places, those of them out of order, and equal letters at the start."""
    size = min(la, lb) + 1
    out = np.zeros((size, size, 5), dtype=np.int8)
    for m in range(1, size):
        for odd in range(m + 1):
            j = (m / la + m / lb + (m - odd / 2) / m) / 3.0
            for alike in range(min(4, size - 1) + 1):
                w = j + alike * 0.1 * (1.0 - j) if j > 0.7 else j
                out[m, odd, alike] = sum(w >= t for t in cuts)
    return out


def _one_length(a: np.ndarray, b: np.ndarray, told: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """reached() of all values of one length and all of one other, as letters; first and last ascend, and pairs whose first isn't under the last are left 0."""
    na, nb, size = a.shape[1], b.shape[1], len(told)
    kind = np.uint32 if max(na, nb) <= 32 else np.uint64
    one, full = kind(1), kind((1 << nb) - 1)
    letters, coded = np.unique(np.concatenate([a.ravel(), b.ravel()]), return_inverse=True)
    ta, tb = coded[: a.size].reshape(a.shape), coded[a.size :].reshape(b.shape)
    where = np.zeros((len(letters), len(b)), dtype=kind)
    for p in range(nb):
        where[tb[:, p], np.arange(len(b))] |= one << kind(p)
    heads, head = [], np.zeros(len(a) + len(b), dtype=np.int64)
    for p in range(min(4, na, nb)):
        head = np.unique(head * len(letters) + np.concatenate([ta[:, p], tb[:, p]]), return_inverse=True)[1]
        heads.append((head[: len(a)].astype(np.int32), head[len(a) :].astype(np.int32)))
    reach = max(na, nb) // 2 - 1
    window = [kind(((1 << max(0, min(nb, i + reach + 1))) - 1) & ~((1 << max(0, i - reach)) - 1)) for i in range(na)]
    out, flat = np.zeros((len(a), len(b)), dtype=np.int8), told.ravel()
    step = max(1, TILE // len(b))
    held, sign, signed = np.empty((na + 3, min(step, len(a)) * len(b)), dtype=kind), 8 * np.dtype(kind).itemsize - 1, np.dtype(kind).str.replace("u", "i")
    for r in range(0, len(a), step):
        t, c = ta[r : r + step], int(np.searchsorted(last, first[r], "right"))
        n, m = len(t), len(b) - c
        if not m:
            break
        bits, same = where[:, c:], (t == t[0]).all(axis=0)
        free, x, y, *masks = (v[: n * m].reshape(n, m) for v in held)
        free[:] = full
        for i in range(na):
            if same[i]:
                np.bitwise_and(free, bits[t[0, i]] & window[i], out=x)
            else:
                np.take(bits, t[:, i], axis=0, out=x, mode="clip")
                x &= window[i]
                x &= free
            np.negative(x, out=y)
            np.bitwise_or(x, y, out=masks[i])
            np.right_shift(masks[i].view(signed), sign, out=masks[i].view(signed))  # all bits where the place is matched
            x &= y
            free ^= x
        rest = free ^ full
        matched, hit = np.bitwise_count(rest), np.zeros((n, m), dtype=kind)
        for i in range(na):
            np.negative(rest, out=y)
            y &= rest
            y &= masks[i]
            rest ^= y
            if same[i]:
                y &= bits[t[0, i]]
            else:
                np.take(bits, t[:, i], axis=0, out=x, mode="clip")
                y &= x
            hit |= y
        at = (matched.astype(np.int32) * (size + 1) - np.bitwise_count(hit)) * 5
        for u, v in heads:
            at += u[r : r + step, None] == v[c:]
        out[r : r + step, c:] = flat.take(at)
    return out


def grid(left: list[str], right: list[str], cuts: tuple[float, ...], winkler, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
    """reached() of all values of left and all of right, by place. Pairs whose first isn't under the last needn't be told."""
    out = np.zeros((len(left), len(right)), dtype=np.int8)
    first = np.zeros(len(left), dtype=np.int64) if first is None else first
    last = np.ones(len(right), dtype=np.int64) if last is None else last
    sides = []
    for values, order in ((left, first), (right, last)):
        n = np.array([len(v) if len(v) <= BITS else -1 for v in values], dtype=np.int64)
        own = {}
        for size in np.unique(n):
            at = np.flatnonzero(n == size)
            at = at[np.argsort(order[at], kind="stable")]
            own[int(size)] = at, np.frombuffer("".join(values[i] for i in at).encode("utf-32-le"), dtype="<u4").reshape(len(at), -1) if size > 0 else None
        sides.append(own)
    for na, (i, a) in sides[0].items():
        for nb, (j, b) in sides[1].items():
            if a is None or b is None or na == nb == 1:
                for x in i:
                    for y in j:
                        if na and nb and first[x] < last[y]:
                            out[x, y] = sum(winkler(left[x], right[y]) >= t for t in cuts)
            else:
                out[np.ix_(i, j)] = _one_length(a, b, _told(na, nb, cuts), first[i], last[j])
    return out


def _empty(values: list[str]) -> int:
    return values.index("") if "" in values else -1


def _codes(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    d = pc.fill_null(column, "").dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()


def _level(codes: np.ndarray, values: list[str], a: np.ndarray, b: np.ndarray, cuts, winkler) -> np.ndarray:
    """-1 a side is missing, 0 different, up to the highest for equal."""
    empty = values.index("") if "" in values else -1
    x, y = codes[a], codes[b]
    none, same = (x == empty) | (y == empty), x == y
    g = np.where(none, -1, np.where(same, len(cuts) + 1, 0)).astype(np.int8)
    if cuts:
        told = np.flatnonzero(~none & ~same)
        here, local = np.unique(np.concatenate([x[told], y[told]]), return_inverse=True)
        k, own = len(here), [values[i] for i in here]
        key = local[: len(told)] * k + local[len(told) :]
        if k * k <= TABLE:
            seen = np.zeros(k * k, dtype=bool)
            seen[key] = True
            pairs = np.flatnonzero(seen)
            table = np.zeros(k * k, dtype=np.int8)
            table[pairs] = reached(own, pairs // max(k, 1), pairs % max(k, 1), cuts, winkler)
            g[told] = table[key]
        else:
            pairs, back = np.unique(key, return_inverse=True)
            g[told] = reached(own, pairs // k, pairs % k, cuts, winkler)[back]
    return g


class _Batch:
    """The struct fields of both sides' rows of the cells of a batch, coded, and the places of each cell's rows in them."""

    def __init__(self, batch: pa.RecordBatch, later: list[str], comparisons, winkler):
        sides = [batch.column(batch.schema.get_field_index(s)) for s in ("lefts", "rights")]
        flat = [s.flatten() for s in sides]
        self.rows = {f.name: pa.concat_arrays([v.field(f.name) for v in flat]) for f in flat[0].type}
        self.n, self.m = (pc.list_value_length(s).to_numpy(zero_copy_only=False).astype(np.int64) for s in sides)
        self.start, self.other = np.cumsum(self.n) - self.n, len(flat[0]) + np.cumsum(self.m) - self.m
        self.alone = batch.column(batch.schema.get_field_index("alone")).to_numpy(zero_copy_only=False)
        self.rank = np.unique(self.rows["id"].to_numpy(zero_copy_only=False), return_inverse=True)[1]
        self.keys = [_codes(self.rows[k]) for k in later]
        self.coded = [(*_codes(self.rows[c]), cuts) for _, c, cuts in comparisons]
        self.size, self.winkler = math.prod(len(cuts) + 3 for _, _, cuts in comparisons), winkler

    def small(self):
        """a, b (places of left and right) and the code of the pattern, for so many pairs at a time of cells of few."""
        some = np.flatnonzero(self.n * self.m < GRID)
        ends, first = np.cumsum((self.n * self.m)[some]), 0
        while first < len(some):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + TOGETHER, "right")))
            size = (self.n * self.m)[some[first:last]]
            cell = np.repeat(some[first:last], size)
            at = np.arange(len(cell)) - np.repeat(np.cumsum(size) - size, size)
            i, j = self.start[cell] + at // self.m[cell], self.other[cell] + at % self.m[cell]
            up = self.rank[i] < self.rank[j]
            good = up | (~self.alone[cell] & (self.rank[i] > self.rank[j]))
            for codes, values in self.keys:
                good &= (codes[i] != codes[j]) | (codes[i] == _empty(values))
            i, j, up = i[good], j[good], up[good]
            a, b = np.where(up, i, j), np.where(up, j, i)
            code = np.zeros(len(a), dtype=np.int64)
            for codes, values, cuts in self.coded:
                code = code * (len(cuts) + 3) + _level(codes, values, a, b, cuts, self.winkler) + 1
            yield a, b, code
            first = last

    def large(self):
        """Tiles of the cells of many pairs: places of lefts, places of rights and their pairs' codes by place; size where two rows aren't a pair."""
        for k in np.flatnonzero(self.n * self.m >= GRID):
            i, j = self.start[k] + np.arange(self.n[k]), self.other[k] + np.arange(self.m[k])
            i, j = (x[np.argsort(self.rank[x], kind="stable")] for x in (i, j))
            yield from self._tiles(i, j)
            if not self.alone[k]:
                yield from self._tiles(j, i)

    def _tiles(self, i: np.ndarray, j: np.ndarray):
        """Of rows i and j, each by rank, those pairs whose i is under its j. Fields of few values are told by profile, the others by value."""
        ri, rj = self.rank[i], self.rank[j]
        weights = np.cumprod([1, *(len(cuts) + 3 for _, _, cuts in self.coded[:0:-1])])[::-1]
        sides, apart = [np.zeros(len(i), dtype=np.int64), np.zeros(len(j), dtype=np.int64)], []
        fields = []
        for (codes, values, cuts), w in zip(self.coded, weights):
            own = codes[i], codes[j]
            many = len(np.unique(own[0])) * 8 > len(i)
            if many:
                apart.append((codes, values, cuts, int(w)))
                own = own[0] != _empty(values), own[1] != _empty(values)
            fields.append((codes, values, cuts, int(w), many))
            both = np.unique(np.concatenate(own), return_inverse=True)[1]
            k = int(both.max()) + 1
            both = np.unique(np.concatenate([sides[0] * k + both[: len(i)], sides[1] * k + both[len(i) :]]), return_inverse=True)[1]
            sides = [both[: len(i)], both[len(i) :]]
        (_, ia, pa_), (_, ib, pb_) = (np.unique(p, return_index=True, return_inverse=True) for p in sides)
        table = np.zeros((len(ia), len(ib)), dtype=np.int32)
        for codes, values, cuts, w, many in fields:
            x, y, empty = codes[i[ia]], codes[j[ib]], _empty(values)
            none = (x == empty)[:, None] | (y == empty)
            g = np.zeros(none.shape, dtype=np.int32) if many else self._values(x, y, values, cuts)
            table += w * (np.where(none, -1, g) + 1)
        table = table.take(pb_, axis=1)
        exact, fuzzy = [], []
        for codes, values, cuts, w in apart:
            x, y = codes[i].astype(np.int32), codes[j].astype(np.int32)
            empty = _empty(values)
            if not cuts:
                exact.append((np.where(x == empty, -1, x), np.where(y == empty, -2, y), w))
                continue
            (ux, fx, bx), (uy, _, by) = np.unique(x, return_index=True, return_inverse=True), np.unique(y, return_index=True, return_inverse=True)
            last = np.zeros(len(uy), dtype=np.int64)
            last[by] = rj  # ascends, so that the last remains
            fuzzy.append((bx, (self._values(ux, uy, values, cuts, ri[fx], last) * w).astype(np.int32).take(by, axis=1)))
        later = [(np.where(codes[i] == _empty(values), -1, codes[i]), np.where(codes[j] == _empty(values), -2, codes[j])) for codes, values in self.keys]
        step = max(1, TILE // len(j))
        for r in range(0, len(i), step):
            t = slice(r, min(len(i), r + step))
            c, sure = int(np.searchsorted(rj, ri[r], "right")), int(np.searchsorted(rj, ri[t.stop - 1], "right"))
            if c == len(j):
                break
            code = table[:, c:].take(pa_[t], axis=0)
            for bx, own in fuzzy:
                code += own[:, c:].take(bx[t], axis=0)
            for x, y, w in exact:
                same = x[t, None] == y[c:]
                if same.any():
                    code[same] += w
            for x, y in later:
                code[x[t, None] == y[c:]] = self.size
            code[:, : sure - c][rj[c:sure] <= ri[t, None]] = self.size
            yield i[t], j[c:], code

    def _values(self, x, y, values, cuts, first=None, last=None) -> np.ndarray:
        """Levels of all values x and y, given by code, without a look at empty ones."""
        if not cuts:
            return (x[:, None] == y).astype(np.int32)
        (ux, bx), (uy, by) = np.unique(x, return_inverse=True), np.unique(y, return_inverse=True)
        out = grid([values[k] for k in ux], [values[k] for k in uy], cuts, self.winkler, first, last)
        for k, at in enumerate(np.searchsorted(uy, ux)):
            if at < len(uy) and uy[at] == ux[k]:
                out[k, at] = len(cuts) + 1
        empty = _empty(values)
        out[ux == empty] = 0
        out[:, uy == empty] = 0
        return out.astype(np.int32) if first is not None else out.astype(np.int32)[bx][:, by]


def _spread(code: np.ndarray, comparisons) -> dict[str, np.ndarray]:
    out = {}
    for f, _, cuts in reversed(comparisons):
        out[f"g_{f}"] = (code % (len(cuts) + 3) - 1).astype(np.int32)
        code = code // (len(cuts) + 3)
    return {f"g_{f}": out[f"g_{f}"] for f, _, _ in comparisons}


def counter(comparisons, winkler):
    """For mapInArrow: g_ columns and n, once for each pattern of the partition."""

    def count(batches):
        total = np.zeros(math.prod(len(cuts) + 3 for _, _, cuts in comparisons) + 1, dtype=np.int64)
        for batch in batches:
            cells = _Batch(batch, [], comparisons, winkler)
            for _, _, code in cells.small():
                total += np.bincount(code, minlength=len(total))
            for _, _, code in cells.large():
                total += np.bincount(code.ravel(), minlength=len(total))
        code = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_pydict({**_spread(code, comparisons), "n": total[code]})

    return count


def _found(cells: _Batch, keep: np.ndarray):
    """a, b and code of the pairs whose pattern is kept."""
    keep = np.append(keep, False)
    for a, b, code in cells.small():
        hit = np.flatnonzero(keep[code])
        yield a[hit], b[hit], code[hit]
    for i, j, code in cells.large():
        hit = np.flatnonzero(keep.take(code))
        x, y = np.divmod(hit.astype(np.int32), np.int32(len(j)))
        yield i[x], j[y], code.ravel()[hit]


def finder(later: list[str], comparisons, winkler, kept: bytes, columns: list[str]):
    """For mapInArrow: the pairs whose pattern is kept, with their ids, g_ columns and both sides' columns."""

    def find(batches):
        keep = np.frombuffer(kept, dtype=bool)
        for batch in batches:
            cells = _Batch(batch, later, comparisons, winkler)
            for a, b, code in _found(cells, keep):
                for i in range(0, len(a), LEAVES):
                    out, some = {}, slice(i, i + LEAVES)
                    for s, at in (("left", pa.array(a[some])), ("right", pa.array(b[some]))):
                        out |= {f"{s}_{c}": cells.rows[c].take(at) for c in ["id", *columns]}
                    yield pa.RecordBatch.from_pydict(out | _spread(code[some].astype(np.int64), comparisons))

    return find
