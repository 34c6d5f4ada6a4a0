"""What linkage.brief() says of a block's pairs: a probability by pattern, and the linkage model's risk flags as bits."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

from ..functions import similarity as S
from .features import _name_scores
from .levels import _Batch, _codes, _empty, _found

#: The flags in the order of scoring.risk_flags; flag i is bit i.
FLAGS = ("tc_conflict", "muhatap_no_conflict", "shared_contact", "shared_contact_name_conflict", "household_risk", "same_surname_name_conflict", "email_high_identity_weak", "weak_identity_evidence", "cross_city_contact_mismatch", "sparse_data")
MUHATAP, EMAIL = 1 << 1, 1 << 6
#: The fields of which pairs of few are sparse, and the names that are scored.
COMMON = ("clean_tc", "clean_phone", "email_normalized_key", "clean_name", "clean_city", "clean_address", "clean_muhatap_no")
NAMES = ("clean_name_ordered", "clean_name", "first_name", "last_name")
BRIEF = ["clean_name", "clean_name_ordered", "clean_tc", "clean_phone", "clean_email", "email_normalized_key", "clean_city", "clean_address", "clean_muhatap_no", "name_phonetic_key", "first_name", "last_name"]
#: Tables of two profiles up to this size are kept as such.
TABLE = 1 << 24


def by_pattern(t: pd.DataFrame) -> np.ndarray:
    """The flags that a pattern of levels allows."""
    contact = t.phone_same | t.email_same
    none = ~t.tc_same & ~t.tc_differs & ~contact
    yes = pd.Series(True, index=t.index)
    return sum(c.to_numpy().astype(np.int32) << i for i, c in enumerate((t.tc_differs, yes, contact, contact, contact, yes, ~t.tc_same & ~t.phone_same, none, none & ~t.city_same, yes)))


class _Profiles:
    """The flags that names and present fields allow, told once for each two profiles of a batch that meet."""

    def __init__(self, rows: dict[str, pa.Array]):
        ids = np.zeros(len(rows["id"]), dtype=np.int64)
        coded = [_codes(rows[c]) for c in NAMES]
        self.has = sum((codes != _empty(values)).astype(np.int64) << i for i, (codes, values) in enumerate(_codes(rows[c]) for c in COMMON))
        for codes in (*(codes for codes, _ in coded), self.has):
            ids = np.unique(ids * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)[1]
        _, self.at, self.of = np.unique(ids, return_index=True, return_inverse=True)
        self.names = [[v[codes[k]] for k in self.at] for codes, v in coded]
        self.k = len(self.at)
        self.table = np.full(self.k * self.k, -1, dtype=np.int32) if self.k * self.k <= TABLE else None

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = self.of[a] * self.k + self.of[b]
        if self.table is None:
            new, back = np.unique(key, return_inverse=True)
            return self.told(new)[back]
        out = self.table[key]
        if (out < 0).any():
            new = np.unique(key[out < 0])
            self.table[new] = self.told(new)
            out = self.table[key]
        return out

    def told(self, key: np.ndarray) -> np.ndarray:
        x, y = np.divmod(key, self.k)
        sparse = np.bitwise_count(self.has[self.at[x]] & self.has[self.at[y]]) <= 2
        out, (ordered, names, firsts, lasts) = np.empty(len(key), dtype=np.int32), self.names
        for n, (i, j, few) in enumerate(zip(x, y, sparse)):
            s = _name_scores(ordered[i] or names[i], ordered[j] or names[j], names[i], names[j], firsts[i], firsts[j], lasts[i], lasts[j])
            first, last, full, conflict = s[0], s[1], s[5], s[11]
            out[n] = sum(bool(c) << b for b, c in enumerate((True, True, True, first < 0.55 and last >= 0.80, last >= 0.80 and first < 0.70, conflict, full < 0.80, full >= 0.80, True, few)))
        return out


def briefs(later: list[str], comparisons, winkler, table: pd.DataFrame):
    """For mapInArrow: left_id, right_id, match_probability, surfaced and flags as bits of the pairs that are kept. table: what holds for each pattern, by its code."""
    allowed, keep, surfaced = by_pattern(table), table.kept.to_numpy(), table.surfaced.to_numpy()
    p, tc = np.stack([table[f"p{i}"].to_numpy() for i in range(3)]), table.tc_differs.to_numpy()
    plain, other = np.where(tc, p[1], p[0]), np.where(tc, p[1], p[2])

    def find(batches):
        for batch in batches:
            cells = _Batch(batch, later, comparisons, winkler)
            profiles, mails = _Profiles(cells.rows), None
            codes, values = _codes(cells.rows["clean_muhatap_no"])
            codes, ids = np.where(codes == _empty(values), -1, codes), cells.rows["id"]
            for a, b, code in _found(cells, keep):
                x, y = codes[a], codes[b]
                conflict = (x != y) & (x >= 0) & (y >= 0)
                flags = profiles(a, b) & allowed[code]
                flags &= np.where(conflict, -1, ~MUHATAP).astype(np.int32)
                asked = np.flatnonzero(flags & EMAIL)
                if len(asked):
                    mails = mails or [cells.rows[c].to_pylist() for c in ("email_normalized_key", "clean_email")]
                    for k, i, j in zip(asked, a[asked], b[asked]):
                        if max(S.email(v[i] or "", v[j] or "") for v in mails) < 0.85:
                            flags[k] &= ~EMAIL
                yield pa.RecordBatch.from_pydict({"left_id": ids.take(pa.array(a)), "right_id": ids.take(pa.array(b)), "match_probability": np.where(conflict, other[code], plain[code]), "surfaced": surfaced[code], "flags": flags})

    return find
