"""Problem 7: token ids of whole texts by a public byte-level BPE vocabulary.

The text is split by the vocabulary's pattern; each piece is merged pair by pair. A segment tree over the byte
positions of the piece keeps, in its root, the leftmost pair of least rank; a merge changes three leaves (the
merged token, its live neighbour to the left, and the swallowed token), so a piece of n bytes takes
O(n log n), however long it is. Pieces repeat, so each worker keeps the ids of those it has seen.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lavra.session import ship_package

#: Folder of the public vocabulary files unless a caller names another.
TOKENIZER_DIR = os.environ.get("LAVRA_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the pattern that belongs to the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces a worker remembers at most; then it begins anew. Only speed depends on it.
REMEMBERED = 200_000
NO_PAIR = 1 << 60


def vocabulary_path(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    """The rank file of a vocabulary; where the folder is absent, that of the installed package."""
    path = os.path.join(folder or TOKENIZER_DIR, f"{name}.tiktoken")
    if not os.path.exists(path) and (spec := importlib.util.find_spec("public_tokenizers")):
        path = os.path.join(os.path.dirname(spec.origin), f"{name}.tiktoken")
    return path


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: again and again the leftmost pair of least rank becomes one token."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    size = 1 << (n - 1).bit_length()
    tree = [NO_PAIR] * (2 * size)
    end = list(range(1, n + 1))  # of the token that begins at a live position
    before = list(range(-1, n - 1))  # the live position to the left
    get = ranks.get
    for i in range(n - 1):
        tree[size + i] = get(piece[i : i + 2], NO_PAIR)
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b

    def put(i: int, rank: int) -> None:
        k = size + i
        tree[k] = rank
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a <= b else b
            if tree[k] == least:
                return
            tree[k] = least
            k >>= 1

    while (least := tree[1]) != NO_PAIR:
        k = 1
        while k < size:
            k = 2 * k if tree[2 * k] == least else 2 * k + 1
        i = k - size
        j = end[i]
        stop = end[i] = end[j]
        put(j, NO_PAIR)
        if stop < n:
            before[stop] = i
            put(i, get(piece[i : end[stop]], NO_PAIR))
        else:
            put(i, NO_PAIR)
        if (left := before[i]) >= 0:
            put(left, get(piece[left:stop], NO_PAIR))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Encodes texts by one vocabulary, remembering pieces."""

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        self.pieces = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str, into: array | None = None) -> array:
        """Ids of ``text``, appended to ``into``; special tokens' strings are ordinary text."""
        into = array("i") if into is None else into
        known, extend = self.known, into.extend
        for piece in self.pieces(text):
            ids = known.get(piece)
            if ids is None:
                ids = self._learn(piece)
            extend(ids)
        return into

    def count(self, text: str) -> int:
        known, n = self.known, 0
        for piece in self.pieces(text):
            ids = known.get(piece)
            n += len(self._learn(piece) if ids is None else ids)
        return n

    def _learn(self, piece: str) -> tuple[int, ...]:
        ids = array("i", merge_piece(piece.encode("utf-8", "surrogatepass"), self.ranks))
        if len(piece) <= 64:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = ids
        return ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path)


def token_ids(text: Column, path: str | None = None) -> Column:
    """Array of the token ids of ``text``, without special tokens; null and empty texts have an empty array.

    ``path``: the rank file, present on every worker.
    """
    path = path or vocabulary_path()
    ship_package()

    def encode(texts: pa.Array) -> pa.Array:
        enc, flat, offsets = encoder(path), array("i"), array("i", [0])
        for text in texts:
            if text.is_valid:
                enc.encode(text.as_py(), flat)
            offsets.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))

    return F.arrow_udf(encode, "array<int>")(text)


def token_count(text: Column, path: str | None = None) -> Column:
    """Number of tokens of ``text``; 0 for null and empty texts."""
    path = path or vocabulary_path()
    ship_package()

    def count(texts: pa.Array) -> pa.Array:
        enc = encoder(path)
        return pa.array([enc.count(t.as_py()) if t.is_valid else 0 for t in texts], pa.int64())

    return F.arrow_udf(count, "bigint")(text)
