"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

A token sequence is the BPE encoding of its bytes exactly if every two neighbours in it stay as they are when the two are encoded
alone. So the encoding of every prefix is found from left to right: among the tokens that end at a byte, one and only
one fits the encoding of the prefix before it. As a transducer: a hypothesis is a place in the trie of tokens (the bytes since
a boundary) and the last token before that boundary; reading a byte moves each hypothesis down the trie and, where a
fitting token ends, adds the new boundary's. A set of hypotheses is a state; states and moves are made when first met and kept (at
most MAX_MOVES moves; then the table starts anew, which changes no result). Tokens are emitted once all hypotheses of the state
share them: at a piece's end, where one is left, and within long pieces every WINDOW bytes. No hypothesis is further
behind than the longest token is long.

Pieces (matches of the split pattern) are encoded separately; a piece that is a token as it stands is that token. Results by
piece are kept in a table of bounded size, since pieces repeat.

Decoding composes tokens with a UTF-8 state machine: the state after each token (how many bytes of a character are open, and
the bounds of the next) is looked up by (state, token), so text comes out as it grows, with U+FFFD for ill-formed bytes.

Defined results: null text counts as empty and has no tokens; every byte is a token, so every text can be encoded; very long texts are encoded whole, their
long pieces in parts; repeated rows and rows that share an id or have none are encoded each; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from itertools import accumulate, chain
from operator import getitem
from sys import getsizeof

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import read, small_batches, tables

#: What a worker keeps at most. An executor has several workers, beside a JVM that earlier stages of a pipeline have filled.
MAX_MOVES = 300_000
MAX_FITS = 500_000
MAX_PIECES = 300_000
#: Bytes of pieces and of what is kept for them.
MAX_HELD = 48 << 20
#: Moves of the decoder.
MAX_STEPS = 120_000
#: Bytes after which a piece is emitted in parts.
WINDOW = 4096


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Plain BPE of a short string: the pair of lowest rank, leftmost first, is merged until none is left."""
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[x] for x in parts]


class State(dict):
    """Moves by byte, each made when first asked for. hypotheses: trie node * 2**20 + last token + 1 each, in 8 bytes; token: the one that ends the encoding
    of what has been read."""

    __slots__ = ("fst", "hypotheses", "length", "token")

    def __init__(self, fst: Transducer, hypotheses: bytes, token: int = -1, length: int = 0):
        super().__init__()
        self.fst, self.hypotheses, self.token, self.length = fst, hypotheses, token, length

    def __missing__(self, byte: int) -> State:
        return self.fst.move(self, byte)


class Transducer:
    """Reading bytes is a walk from state to state; the tokens emitted follow from the states by stepping back."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([i]) not in ranks for i in range(256)):
            raise ValueError("every byte must be a token")
        if max(ranks.values()) >= (1 << 20) - 1:
            raise ValueError("too many ranks")
        self.ranks, self.bytes_of = ranks, {v: k for k, v in ranks.items()}
        self.length = {v: len(k) for k, v in ranks.items()}
        self.trie: dict[int, int] = {}  # node * 256 + byte -> node
        self.token_at, self.depths, self.inner = array("i", [-1]), array("H", [0]), bytearray(1)
        for raw, rank in ranks.items():
            node = 0
            for b in raw:
                down = self.trie.get(node << 8 | b)
                if down is None:
                    down = self.trie[node << 8 | b] = len(self.token_at)
                    self.token_at.append(-1)
                    self.depths.append(self.depths[node] + 1)
                    self.inner[node] = 1
                    self.inner.append(0)
                node = down
            self.token_at[node] = rank
        self.edges: dict[int, tuple | None] = {}
        self.fits = array("q", [-1]) * MAX_FITS  # 2 * key + answer, the last one asked for of those that share a place
        self.states: dict[bytes, State] = {}
        self.forget()

    def forget(self) -> None:
        for state in self.states.values():  # they point at one another
            state.clear()
        self.start, self.made = State(self, bytes(8)), 0
        self.states = {self.start.hypotheses: self.start}

    def sides(self, token: int) -> tuple | None:
        """What stands at a token's left and right end while it is merged, each as (bytes, rank of the merge that takes it up); None if
        merging its bytes doesn't give it. The last flag: ranks rise along both, as those of trained merges do."""
        if token not in self.edges:
            raw = self.bytes_of[token]
            parts = [raw[i : i + 1] for i in range(len(raw))]
            left, right, rises, least = [], [], True, -1
            while len(parts) > 1:
                rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if rank == 1 << 60:
                    break
                rises &= rank >= least
                least = rank
                if at == 0:
                    left.append((parts[0], rank))
                if at == len(parts) - 2:
                    right.append((parts[-1], rank))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            whole = [(raw, 1 << 60)]
            self.edges[token] = (left + whole, right + whole, rises) if len(parts) == 1 else None
        return self.edges[token]

    def fit(self, last: int, token: int) -> bool:
        """Whether a token can follow another (or, -1, the start) in an encoding: no merge across the boundary comes before
        the merges that take up its two sides, and of equal ranks the leftmost merge comes first."""
        key = (last + 1) << 20 | token
        at = key % len(self.fits)
        if (known := self.fits[at]) >> 1 != key:
            b = self.sides(token)
            if b is None:
                known = False
            elif last < 0:
                known = True
            else:
                a, ranks = self.sides(last), self.ranks
                if a[2] and b[2]:
                    known = not any((r := ranks.get(x + y)) is not None and r < p and r <= q for x, p in a[1] for y, q in b[0])
                else:
                    known = merge(self.bytes_of[last] + self.bytes_of[token], ranks) == [last, token]
            self.fits[at] = key << 1 | known
            return known
        return bool(known & 1)

    def move(self, state: State, byte: int) -> State:
        kept, new, trie, token_at, inner = [], -1, self.trie, self.token_at, self.inner
        for h in memoryview(state.hypotheses).cast("Q"):
            down = trie.get(h >> 20 << 8 | byte)
            if down is None:
                continue
            last = (h & 0xFFFFF) - 1
            if new < 0 and (token := token_at[down]) >= 0 and self.fit(last, token):
                new = token
            if inner[down]:
                kept.append(down << 20 | last + 1)
        if new < 0:
            raise ValueError("the ranks are not those of a byte-level BPE")
        kept.append(new + 1)
        to = array("Q", kept).tobytes()
        found = self.states.get(to)
        if found is None:
            found = self.states[to] = State(self, to, new, self.length[new])
        self.made += 1
        state[byte] = found
        return found

    def encode(self, raw: bytes) -> tuple[int, ...]:
        """The tokens of one piece."""
        if (whole := self.ranks.get(raw)) is not None:
            return (whole,)
        if self.made > MAX_MOVES:
            self.forget()
        if len(raw) > WINDOW:
            return tuple(self.stream(raw))
        return self.back(list(accumulate(raw, getitem, initial=self.start)), len(raw))

    @staticmethod
    def back(path: list[State], at: int) -> tuple[int, ...]:
        """The encoding of the first `at` bytes; path: the states before and after every byte."""
        out = []
        while at > 0:
            state = path[at]
            out.append(state.token)
            at -= state.length
        return tuple(out[::-1])

    def stream(self, raw):
        """Yields tokens as bytes come, holding back only those that the live hypotheses don't share."""
        path = [self.start]
        for b in raw:
            path.append(path[-1][b])
            if len(path) > WINDOW:
                depth = {len(path) - 1 - k for k in self.open_bytes(path[-1])}
                paths = [self.back(path, at) for at in sorted(depth)]
                n = 0
                while all(len(p) > n and p[n] == paths[0][n] for p in paths):
                    n += 1
                yield from paths[0][:n]
                del path[: sum(self.length[t] for t in paths[0][:n])]
                if self.made > MAX_MOVES:
                    last = path[-1]
                    self.forget()
                    path[-1] = self.states[last.hypotheses] = State(self, last.hypotheses, last.token, last.length)
        yield from self.back(path, len(path) - 1)

    def open_bytes(self, state: State) -> list[int]:
        """How many bytes each live hypothesis has read since its boundary; they stand in the state from the most to the fewest."""
        return [self.depths[h >> 20] for h in memoryview(state.hypotheses).cast("Q")]


class Pieces(dict):
    """What `make` gives for a piece, of pieces up to 64 characters; when it is full, it starts anew and its last content helps out until it is full again."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older, self.held = make, {}, 0

    def __missing__(self, piece: str):
        got = self.older.get(piece) or self.make(piece)
        if len(piece) <= 64:
            size = getsizeof(piece) + getsizeof(got)
            if len(self) >= MAX_PIECES // 2 or self.held + size > MAX_HELD // 2:
                self.older, self.held = dict(self), 0
                self.clear()
            self[piece] = got
            self.held += size
        return got


class Encoder:
    """Texts to tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.fst, self.find = Transducer(ranks), regex.compile(pattern).findall
        self.pieces = Pieces(self.tokens)

    def tokens(self, piece: str) -> tuple[int, ...]:
        return self.fst.encode(piece.encode())

    def __call__(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.find(text))))


#: Well-formed UTF-8 (Unicode Standard, table 3-7): lead bytes, then the allowed range of the second byte and the number of bytes after it.
LEADS = (((0xC2, 0xDF), 0x80, 0xBF, 0), ((0xE0, 0xE0), 0xA0, 0xBF, 1), ((0xE1, 0xEC), 0x80, 0xBF, 1), ((0xED, 0xED), 0x80, 0x9F, 1), ((0xEE, 0xEF), 0x80, 0xBF, 1), ((0xF0, 0xF0), 0x90, 0xBF, 2), ((0xF1, 0xF3), 0x80, 0xBF, 2), ((0xF4, 0xF4), 0x80, 0x8F, 2))
LEAD = {b: rest for (lo, hi), *rest in LEADS for b in range(lo, hi + 1)}


class Decoder:
    """An incremental UTF-8 state machine over tokens. A state is the open bytes of an unfinished character."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of, self.table = {v: k for k, v in ranks.items()}, {}

    @staticmethod
    def step(open_: bytes, byte: int) -> tuple[str, bytes]:
        """The characters that end here and the bytes still open."""
        if open_:
            lo, hi, more = LEAD[open_[0]]
            if len(open_) > 1:
                lo, hi = 0x80, 0xBF
            if lo <= byte <= hi:
                grown = open_ + bytes([byte])
                return (grown.decode(), b"") if len(grown) == more + 2 else ("", grown)
            text, open_ = Decoder.step(b"", byte)
            return "�" + text, open_
        if byte < 0x80:
            return chr(byte), b""
        return ("", bytes([byte])) if byte in LEAD else ("�", b"")

    def token(self, open_: bytes, token: int) -> tuple[str, bytes]:
        key = (open_, token)
        if (got := self.table.get(key)) is None:
            out, now = [], open_
            for b in self.bytes_of[token]:
                text, now = self.step(now, b)
                out.append(text)
            if len(self.table) > MAX_STEPS:
                self.table.clear()
            got = self.table[key] = ("".join(out), now)
        return got

    def stream(self, ids):
        """Yields text as tokens come; what is open at the end comes as U+FFFD."""
        open_, table = b"", self.table
        for i in ids:
            text, open_ = table.get((open_, i)) or self.token(open_, i)
            if text:
                yield text
        if open_:
            yield "�"

    def decode(self, ids) -> str:
        return "".join(self.stream(ids))


class Digester:
    """Texts to what digest() tells of them. A piece ends with a whole character, so the decoder's state after each is the one it began with; what a piece's tokens
    are and what they decode to is kept by piece."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.encoder, self.decoder = Encoder(ranks, pattern), Decoder(ranks)
        self.names = {i: str(i) for i in self.decoder.bytes_of}
        self.pieces, self.differ = Pieces(self.both), False

    def both(self, piece: str) -> str | tuple[str, str]:
        """The tokens' numbers, joined; their text too if it isn't the piece."""
        ids = self.encoder.tokens(piece)
        joined, text = ",".join(map(self.names.__getitem__, ids)), self.decoder.decode(ids)
        if text == piece:
            return joined
        self.differ = True
        return joined, text

    def __call__(self, text: str) -> tuple[int, str, str]:
        found = self.encoder.find(text)
        told = list(map(self.pieces.__getitem__, found))
        if self.differ:
            found = [p if isinstance(x, str) else x[1] for p, x in zip(found, told)]
            told = [x if isinstance(x, str) else x[0] for x in told]
        ids, decoded = ",".join(told), "".join(found)
        return ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def codec(path: str, pattern: str) -> tuple[Encoder, Decoder]:
    """One of each for a worker process."""

    def make():
        ranks = load_ranks(path)
        return Encoder(ranks, pattern), Decoder(ranks)

    return tables((path, pattern), make)


def encode_column(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text -> doc_id, ids (array of int). The file of ranks is read on the executors: give a path they all have."""

    def run(batches):
        encode, _ = codec(path, pattern)
        for b in small_batches(batches, 1, (path, pattern)):
            yield pa.record_batch([b.column(0), pa.array([encode(x or "") for x in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_column(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids -> doc_id, text."""

    def run(batches):
        _, decoder = codec(path, pattern)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([decoder.decode(x or ()) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes, decodes and digests each text in one pass."""

    def run(batches):
        key = (path, pattern, "digest")
        told = tables(key, lambda: Digester(load_ranks(path), pattern))
        for b in small_batches(batches, 1, key):
            out = [(doc_id, *told(text or "")) for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents"), *default_vocabulary())
