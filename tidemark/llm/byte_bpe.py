"""Byte-level BPE: whole texts to ids of a public rank file, and back.

Pre-tokenisation without regular expressions: every code point gets a class from an array; a small automaton says where
a piece starts. A step of the automaton is a function from states to states, and composing such functions is
associative, so the scan runs over blocks: all blocks advance together, each from every state at once; the blocks'
functions are then composed in turn, and a second pass fills in the states that really occur. Two facts about the
following character (does white space end here, does an apostrophe start a contraction) are folded into the classes.

Pieces are byte slices of the text; a cache maps a piece to its ids, and a miss is merged by rank with a linked list and
a heap. Offsets of pieces are kept, so ids can be traced to bytes. Decoding joins the ids' bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import ship_package

# classes of code points
LETTER, NUMBER, OTHER, SPACE, BLANK = range(5)
# further classes once the neighbour is known; STOP parts texts
LAST_SPACE, LAST_BLANK, QUOTE, QUOTE2, QUOTE3, STOP = range(5, 11)
N_CLASSES = 11
# states after a character: what the piece under way may take next
S_NONE, S_LETTER, S_NUMBER, S_OTHER, S_JOIN, S_WHITE, S_ONE, S_TWO = range(8)
N_STATES = 8

#: Fixed by the vocabularies: the pattern that the automaton below implements.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed by Unicode's White_Space property.
WHITE = (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Fixed by the pattern: what may follow an apostrophe as a contraction.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

BLOCK = 512
#: Pieces that a worker remembers; at most one slice's new pieces more.
CACHE_SIZE = 250_000


def class_table() -> np.ndarray:
    """Code point -> class, from the Unicode categories."""
    t = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    cats = np.array([unicodedata.category(chr(i))[0] for i in range(sys.maxunicode + 1)])
    t[cats == "L"] = LETTER
    t[cats == "N"] = NUMBER
    t[list(WHITE)] = BLANK
    t[0x20] = SPACE
    return t


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, does a piece start here) by class and state.

    A run of letters, numbers or others goes on with its own kind, or after a single space that joins it. The last
    character of white space before other text stands alone, and joins if it is a space. Inside a contraction its
    letters are taken whatever follows; after it anything starts anew. An apostrophe inside a run of others stays there.
    """
    to = np.zeros((N_CLASSES, N_STATES), np.uint8)
    new = np.ones((N_CLASSES, N_STATES), bool)
    for cls, state in ((LETTER, S_LETTER), (NUMBER, S_NUMBER), (OTHER, S_OTHER), (QUOTE, S_OTHER)):
        to[cls] = state
        new[cls, [state, S_JOIN]] = False
    to[LETTER, S_ONE], new[LETTER, S_ONE] = S_NONE, False
    to[LETTER, S_TWO], new[LETTER, S_TWO] = S_ONE, False
    for cls, state in ((QUOTE2, S_ONE), (QUOTE3, S_TWO)):
        to[cls] = state
        to[cls, [S_OTHER, S_JOIN]] = S_OTHER
        new[cls, [S_OTHER, S_JOIN]] = False
    for cls in (SPACE, BLANK):
        to[cls] = S_WHITE
        new[cls, S_WHITE] = False
    to[LAST_SPACE] = S_JOIN
    to[LAST_BLANK] = S_NONE
    to[STOP] = S_NONE
    return to, new


def classify(points: np.ndarray, table: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Classes of code points with the neighbour folded in; ``stops`` are the positions that part texts."""
    c = table[points]
    c[stops] = STOP
    white = (c == SPACE) | (c == BLANK)
    nxt = np.append(c[1:], np.uint8(STOP))
    ends = white & (nxt != SPACE) & (nxt != BLANK) & (nxt != STOP)
    c[ends & (c == SPACE)] = LAST_SPACE
    c[ends & (c == BLANK)] = LAST_BLANK
    quote = np.flatnonzero((points == 0x27) & (c != STOP))
    c[quote] = QUOTE
    pad = np.concatenate((points, np.zeros(2, points.dtype)))
    for word in CONTRACTIONS:
        hit = pad[quote + 1] == ord(word[0])
        if len(word) == 2:
            hit &= pad[quote + 2] == ord(word[1])
        c[quote[hit]] = QUOTE2 if len(word) == 1 else QUOTE3
    return c


def piece_starts(classes: np.ndarray, to: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Positions where pieces (and stops) start, by a blocked scan of transition functions."""
    n = len(classes)
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, STOP, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)  # one row of the grid is the k-th character of every block
    flat_to, flat_new = to.ravel(), new.ravel()
    every = np.tile(np.arange(N_STATES, dtype=np.uint8), (rows, 1))
    for k in range(BLOCK):  # the function of each block, all states at once
        every = flat_to[(grid[k].astype(np.uint16) * N_STATES)[:, None] + every]
        if (every == every[:, :1]).all():  # mostly constant after a few characters: one state stands for all
            one = every[:, 0]
            for j in range(k + 1, BLOCK):
                one = flat_to[grid[j].astype(np.uint16) * N_STATES + one]
            every = np.repeat(one[:, None], N_STATES, axis=1)
            break
    state, first = S_NONE, np.empty(rows, np.uint8)
    for r, f in enumerate(every.tolist()):  # compose block functions in order
        first[r] = state
        state = f[state]
    starts = np.empty((BLOCK, rows), bool)
    now = first
    for k in range(BLOCK):
        at = grid[k].astype(np.uint16) * N_STATES + now
        starts[k] = flat_new[at]
        now = flat_to[at]
    return np.flatnonzero(starts.T.ravel()[:n])


SHIFT = 20


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """Rank of what two tokens make together, by their ranks packed as one number."""
    out = {}
    for piece, r in ranks.items():
        for i in range(1, len(piece)):
            a, b = ranks.get(piece[:i]), ranks.get(piece[i:])
            if a is not None and b is not None:
                out[a << SHIFT | b] = r
    return out


def merge_ids(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """Tokens of one piece from those of its bytes: the pair of least rank merges first, the leftmost of equals."""
    return _merge_short(ids, pairs) if len(ids) <= 64 else _merge_long(ids, pairs)


def _merge_short(ids: list[int], pairs: dict[int, int]) -> list[int]:
    get, none = pairs.get, 1 << 40
    pair = [get(a << SHIFT | b, none) for a, b in zip(ids, ids[1:])]
    while pair and (least := min(pair)) != none:
        i = pair.index(least)
        ids[i] = least
        del ids[i + 1], pair[i]
        if i < len(pair):
            pair[i] = get(least << SHIFT | ids[i + 1], none)
        if i:
            pair[i - 1] = get(ids[i - 1] << SHIFT | least, none)
    return ids


def _merge_long(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """The same with a heap and a linked list, in n log n steps."""
    n, get = len(ids), pairs.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << SHIFT | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue  # one side has merged otherwise since
        ids[i], ids[j] = r, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (q := get(r << SHIFT | ids[k])) is not None:
                heapq.heappush(heap, (q, i, r, ids[k]))
        if (h := before[i]) >= 0 and (q := get(ids[h] << SHIFT | r)) is not None:
            heapq.heappush(heap, (q, h, ids[h], r))
    return [x for x in ids if x >= 0]


def load_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Codec:
    """Encoder and decoder for one rank file; keeps a bounded cache of pieces."""

    def __init__(self, rank_file: bytes):
        self.ranks = load_ranks(rank_file)
        self.table = class_table()
        self.to, self.new = automaton()
        self.pairs = pair_ranks(self.ranks)
        self.byte_ids = [self.ranks[bytes([b])] for b in range(256)]
        self.cache: dict[bytes, bytes] = {}
        size = max(self.ranks.values()) + 1
        self.bytes_of = [b""] * size
        for piece, i in self.ranks.items():
            self.bytes_of[i] = piece

    def pieces(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(UTF-8 of all texts with a zero byte after each, byte offset of every piece and stop, index of each stop)."""
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        stops = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
        starts = piece_starts(classify(points, self.table, stops), self.to, self.new)
        raw = joined.encode("utf-8", "surrogatepass")
        if len(raw) != len(points):
            width = 1 + (points > 0x7F).astype(np.uint8) + (points > 0x7FF) + (points > 0xFFFF)
            at = np.cumsum(width, dtype=np.int64) - width
            return raw, at[starts], np.searchsorted(starts, stops)
        return raw, starts, np.searchsorted(starts, stops)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        raw, at, stop = self.pieces(texts)
        edges = at.tolist()
        edges.append(len(raw))
        slices = [raw[a:b] for a, b in zip(edges, edges[1:])]
        out = list(map(self.cache.get, slices))
        if None in out:
            if len(self.cache) > CACHE_SIZE:
                self.cache.clear()
            missed = {s: self._merge(s) for s in {s for s, o in zip(slices, out) if o is None}}
            self.cache.update(missed)
            out = [missed[s] if o is None else o for s, o in zip(slices, out)]
        cuts = stop.tolist()
        return [b"".join(out[a:b]) for a, b in zip([0] + [c + 1 for c in cuts[:-1]], cuts)]

    def _merge(self, piece: bytes) -> bytes:
        if (whole := self.ranks.get(piece)) is not None:
            return array("I", (whole,)).tobytes()
        return array("I", merge_ids([self.byte_ids[b] for b in piece], self.pairs)).tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, text: str) -> list[int]:
        """Byte offset of every piece of one text."""
        return self.pieces([text])[1].tolist()[:-1]


_CODECS: dict[bytes, Codec] = {}


def codec_for(rank_file: bytes) -> Codec:
    """One codec per worker process and rank file."""
    key = hashlib.sha256(rank_file).digest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(rank_file)
    return _CODECS[key]


def rank_bytes(path: str) -> bytes:
    """The rank file as the driver sees it; workers get its bytes (under 1 MB), not its path."""
    with open(path, "rb") as f:
        return f.read()


def encode_texts(df: DataFrame, rank_path: str, text_col: str = "text", carry: list[str] | None = None, decode: bool = False, pattern: str = PATTERN) -> DataFrame:
    """``carry`` columns (all by default) as a struct ``row``, and ``ids``: little-endian unsigned 32-bit integers.

    With ``decode``, also ``decoded``, the bytes of the ids, and ``round_trip``, whether they are the text's. Null text
    is empty. Repeated rows give repeated results; an empty table gives no rows. A batch is worked on in slices of about
    a million characters, each handed over before the next is met. Another ``pattern`` than ``PATTERN`` is an error.
    """
    if pattern != PATTERN:
        raise ValueError(f"pieces are those of {PATTERN!r} only")
    spark = df.sparkSession
    ship_package(spark)
    file = spark.sparkContext.broadcast(rank_bytes(rank_path))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in (carry or df.columns)]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    fields = [rows.schema["row"], T.StructField("ids", T.BinaryType())]
    if decode:
        fields += [T.StructField("decoded", T.BinaryType()), T.StructField("round_trip", T.BooleanType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(file.value)
        for batch in batches:
            lo, sizes = 0, pa.compute.binary_length(batch.column(1)).to_pylist()
            while lo < batch.num_rows:
                hi, n = lo, 0
                while hi < batch.num_rows and (hi == lo or n + sizes[hi] < 1_000_000):
                    n += sizes[hi]
                    hi += 1
                part = batch.slice(lo, hi - lo)
                texts = part.column(1).to_pylist()
                ids = codec.encode(texts)
                columns = [part.column(0), pa.array(ids, pa.binary())]
                if decode:
                    back = [codec.decode(x) for x in ids]
                    columns += [pa.array(back, pa.binary()), pa.array([x == t.encode("utf-8", "surrogatepass") for x, t in zip(back, texts)], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "ids", "decoded", "round_trip"][: len(columns)])
                lo = hi

    return rows.mapInArrow(run, T.StructType(fields))


def decode_ids(df: DataFrame, rank_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds ``out_col``: the bytes of the ids. Null ids give null."""
    spark = df.sparkSession
    ship_package(spark)
    file = spark.sparkContext.broadcast(rank_bytes(rank_path))

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = codec_for(file.value)
        for s in batches:
            yield pd.Series([None if x is None else codec.decode(x) for x in s], dtype=object)

    return df.withColumn(out_col, decode(F.col(ids_col)))


def bpe_digest(docs: DataFrame, rank_path: str, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row; digests of the ids and of the bytes they decode to.

    Empty and null texts have no tokens and the digests of nothing. Repeated rows give repeated results; other columns
    are ignored; an empty table gives no rows.
    """
    both = encode_texts(docs, rank_path, carry=["doc_id"], decode=True, pattern=pattern)
    return both.select(
        F.col("row.doc_id").alias("doc_id"),
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
