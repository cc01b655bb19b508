"""Encoding whole texts with a public byte-level BPE vocabulary.

Pre-tokenisation works on arrays: code points become classes, and the boundaries of pre-tokens come from a finite
automaton that is run as an associative scan over transition functions. All blocks of a batch advance together: first
each block's function from entry state to exit state, then the entry states by a scan over the blocks' functions, then
the states inside the blocks. The slices found are merged by rank once per distinct slice and remembered.
"""

from __future__ import annotations

import base64
import heapq
import os
import unicodedata
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

#: Distinct slices remembered by a worker before it forgets and starts again; bounds memory, not the result.
CACHE_SLICES = 200_000
#: Code points handled at once; a longer text is a batch of its own.
BATCH_POINTS = 1_000_000
BLOCK = 64

#: The white space of the public pattern (Unicode White_Space).
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SEPARATOR = 0x110000

# classes of code points, then symbols that also hold what follows
LETTER, NUMBER, OTHER, SPACE, END = range(5)
S_LETTER, S_NUMBER, S_OTHER, S_WHITE, S_LAST_BLANK, S_LAST_WHITE, S_SHORT, S_LONG, S_END = range(9)
# states: what the current pre-token is
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_BLANK, IN_WHITE, ONE_LEFT, TWO_LEFT = range(8)


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the public vocabulary files are installed; ``PUBLIC_TOKENIZERS`` names another folder."""
    if "PUBLIC_TOKENIZERS" in os.environ:
        return os.path.join(os.environ["PUBLIC_TOKENIZERS"], name)
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join("/opt/tokenizers", name)
    return str(public_tokenizers.path(name))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def _classes() -> np.ndarray:
    out = np.full(SEPARATOR + 1, OTHER, dtype=np.uint8)
    first = np.fromiter((ord(unicodedata.category(chr(i))[0]) for i in range(SEPARATOR)), dtype=np.uint8, count=SEPARATOR)
    out[:SEPARATOR][first == ord("L")] = LETTER
    out[:SEPARATOR][first == ord("N")] = NUMBER
    out[WHITE] = SPACE
    out[SEPARATOR] = END
    return out


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a pre-token starts here", by symbol and state."""
    step, starts = np.zeros((9, 8), dtype=np.uint8), np.ones((9, 8), dtype=bool)
    for symbol, inside in ((S_LETTER, IN_LETTERS), (S_NUMBER, IN_NUMBERS), (S_OTHER, IN_OTHERS)):
        step[symbol] = inside
        starts[symbol, [inside, AFTER_BLANK]] = False
    step[S_LETTER, TWO_LEFT], step[S_LETTER, ONE_LEFT] = ONE_LEFT, FRESH  # the letters of a contraction
    starts[S_LETTER, [TWO_LEFT, ONE_LEFT]] = False
    for symbol, left in ((S_SHORT, ONE_LEFT), (S_LONG, TWO_LEFT)):  # an apostrophe begins a contraction unless it continues something
        step[symbol] = left
        step[symbol, [IN_OTHERS, AFTER_BLANK]] = IN_OTHERS
        starts[symbol, [IN_OTHERS, AFTER_BLANK]] = False
    step[S_WHITE] = IN_WHITE
    starts[S_WHITE, IN_WHITE] = False
    step[S_LAST_BLANK], step[S_LAST_WHITE], step[S_END] = AFTER_BLANK, FRESH, FRESH
    return step, starts


_CLASSES: np.ndarray | None = None
_STEP, _STARTS = _automaton()


def _symbols(points: np.ndarray) -> np.ndarray:
    """Symbols of code points in which every text is followed by a separator."""
    global _CLASSES
    if _CLASSES is None:
        _CLASSES = _classes()
    kind = _CLASSES[points]
    ahead = lambda a, k, fill: np.concatenate([a[k:], np.full(min(k, len(a)), fill, dtype=a.dtype)])
    next_kind = ahead(kind, 1, END)
    out = np.array([S_LETTER, S_NUMBER, S_OTHER, S_WHITE, S_END], dtype=np.uint8)[kind]
    last = (kind == SPACE) & (next_kind != SPACE) & (next_kind != END)
    out[last] = S_LAST_WHITE
    out[last & (points == 0x20)] = S_LAST_BLANK
    mark = np.flatnonzero(points == 0x27)
    if len(mark):
        one, two = ahead(points, 1, SEPARATOR)[mark], ahead(points, 2, SEPARATOR)[mark]
        out[mark[np.isin(one, [ord(c) for c in "sdmt"])]] = S_SHORT
        pair = np.zeros(len(mark), dtype=bool)
        for a, b in ("ll", "ve", "re"):
            pair |= (one == ord(a)) & (two == ord(b))
        out[mark[pair]] = S_LONG
    return out


def boundaries(points: np.ndarray) -> np.ndarray:
    """True where a pre-token starts, for code points in which every text is followed by a separator."""
    symbols, n = _symbols(points), len(points)
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, S_END, dtype=np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    whole = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    flat = _STEP.ravel()
    for column in grid:
        whole = flat[column[:, None].astype(np.intp) * 8 + whole]
    shift, scan = 1, whole  # inclusive scan of the blocks' functions; composition is associative
    while shift < rows:
        later = scan.copy()
        later[shift:] = np.take_along_axis(scan[shift:], scan[:-shift].astype(np.intp), axis=1)
        scan, shift = later, shift * 2
    state = np.zeros(rows, dtype=np.uint8)
    state[1:] = scan[:-1, FRESH]
    found, begins = np.empty((BLOCK, rows), dtype=bool), _STARTS.ravel()
    for k, column in enumerate(grid):
        at = column.astype(np.intp) * 8 + state
        found[k], state = begins[at], flat[at]
    return found.T.ravel()[:n]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merging of one slice, lowest rank first, leftmost on ties."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    ends, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i]:
            continue
        j = ends[i]
        if j >= n or ends[j] != end:
            continue  # a part of this pair was merged meanwhile
        alive[j], ends[i] = False, end
        if end < n:
            before[end] = i
            if (r := ranks.get(piece[i : ends[end]])) is not None:
                heapq.heappush(heap, (r, i, ends[end]))
        if (k := before[i]) >= 0 and (r := ranks.get(piece[k:end])) is not None:
            heapq.heappush(heap, (r, k, end))
    return [ranks[piece[i : ends[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Encodes batches of texts; null and empty texts have no ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.known = ranks, {}

    def _ids(self, piece: str) -> list[int]:
        ids = self.known.get(piece)
        if ids is None:
            if len(self.known) >= CACHE_SLICES:
                self.known.clear()
            ids = merge(piece.encode("utf-8"), self.ranks)
            if len(piece) <= 64:
                self.known[piece] = ids
        return ids

    def pieces(self, texts: Iterable[str | None]) -> Iterable[list[str]]:
        """The pre-tokens of each text, in order."""
        group, size = [], 0
        for text in texts:
            text = text or ""
            if group and size + len(text) > BATCH_POINTS:
                yield from self._pieces(group)
                group, size = [], 0
            group.append(text)
            size += len(text) + 1
        if group:
            yield from self._pieces(group)

    def _pieces(self, texts: list[str]) -> Iterable[list[str]]:
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        points = np.full(int(lengths.sum()) + len(texts), SEPARATOR, dtype=np.uint32)
        keep = np.ones(len(points), dtype=bool)
        ends = np.cumsum(lengths + 1) - 1
        keep[ends] = False
        points[keep] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        at = np.flatnonzero(boundaries(points))  # the separators are starts too, so every slice ends at the next start
        first = np.searchsorted(at, ends - lengths)
        last = np.searchsorted(at, ends)
        for text, a, b, base in zip(texts, first.tolist(), last.tolist(), (ends - lengths).tolist()):
            cuts = (at[a : b + 1] - base).tolist()
            yield [text[i:j] for i, j in zip(cuts, cuts[1:])]

    def encode(self, texts: Iterable[str | None]) -> Iterable[list[int]]:
        for pieces in self.pieces(texts):
            ids: list[int] = []
            for p in pieces:
                ids += self._ids(p)
            yield ids

    def count(self, texts: Iterable[str | None]) -> Iterable[int]:
        for pieces in self.pieces(texts):
            yield sum(len(self._ids(p)) for p in pieces)


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if shared.id not in _ENCODERS:
        _ENCODERS[shared.id] = Encoder(shared.ranks.value)
    return _ENCODERS[shared.id]


class _Shared:
    """The ranks as a Spark broadcast: a vocabulary file, about a megabyte, whatever the corpus."""

    def __init__(self, spark: SparkSession, path: str):
        self.ranks = spark.sparkContext.broadcast(read_ranks(path))
        self.id = f"{path}:{self.ranks._jbroadcast.id()}" if self.ranks._jbroadcast is not None else path

    def __getstate__(self):
        return {"ranks": self.ranks, "id": self.id}


_SHARED: dict[tuple[str, str], _Shared] = {}


def _share(spark: SparkSession, path: str) -> _Shared:
    key = (spark.sparkContext.applicationId, path)
    if key not in _SHARED:
        _SHARED[key] = _Shared(spark, path)
    return _SHARED[key]


def token_ids(spark: SparkSession, text: Column, vocabulary: str | None = None) -> Column:
    """Column of token ids (array of int, no special tokens) of ``text``; null and empty texts give an empty array.

    Strings that look like special tokens are ordinary text. Whole texts are encoded, whatever their length.
    """
    shared = _share(spark, vocabulary or vocabulary_path())

    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_encoder(shared).encode(texts)), dtype=object)

    return F.pandas_udf(encode, ArrayType(IntegerType()))(text)


def token_count(spark: SparkSession, text: Column, vocabulary: str | None = None) -> Column:
    """Column of the number of tokens of ``text``: the size of ``token_ids`` without carrying the ids."""
    shared = _share(spark, vocabulary or vocabulary_path())

    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_encoder(shared).count(texts)), dtype="int64")

    return F.pandas_udf(count, LongType())(text)


SPANS = ArrayType(StructType([StructField("id", IntegerType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))


def token_spans(spark: SparkSession, text: Column, vocabulary: str | None = None) -> Column:
    """Like ``token_ids`` with the byte offsets of each token in the UTF-8 text: array of struct ``id, start, end``."""
    shared = _share(spark, vocabulary or vocabulary_path())

    def spans(texts: pd.Series) -> pd.Series:
        encoder = _encoder(shared)
        size = {i: len(b) for b, i in encoder.ranks.items()}
        out = []
        for ids in encoder.encode(texts):
            ends = np.cumsum([size[i] for i in ids]).tolist()
            out.append([{"id": i, "start": a, "end": b} for i, a, b in zip(ids, [0, *ends], ends)])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(spans, SPANS)(text)


def decoded(spark: SparkSession, ids: Column, vocabulary: str | None = None) -> Column:
    """The text of token ids; null ids give null. Bytes that are no UTF-8 become U+FFFD; ids outside the vocabulary raise an error."""
    shared = _share(spark, vocabulary or vocabulary_path())

    def decode(lists: pd.Series) -> pd.Series:
        words = {i: b for b, i in _encoder(shared).ranks.items()}
        return pd.Series([None if x is None else b"".join(words[int(i)] for i in x).decode("utf-8", "replace") for x in lists], dtype=object)

    return F.pandas_udf(decode, StringType())(ids)


def encode_documents(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, ids`` of every row of ``documents`` (``doc_id, text``; other columns are ignored, repeated rows stay)."""
    return documents.select("doc_id", token_ids(documents.sparkSession, F.col("text"), vocabulary).alias("ids"))
