"""Problem 9: long spans that stand verbatim in more than one text.

Content-defined chunking: a gear hash rolls over the code points (a window of 32), and a position is a cut
where the hash is the least of some window of ``CUT_WINDOW`` positions. Cuts depend on nearby text alone, so
an insertion moves them along and chunks (from cut to cut, of variable length) come out equal again. Chunks
are deduplicated by digest; only stretches all of whose chunks occur in another text are then checked exactly,
by 128-bit hashes of every span of the wanted length: one half is a polynomial, the other a tree of mixed halves, so
that what makes one of them fail says nothing about the other. Texts are read and hashed once, then once more
where they hold candidates; equal texts are told by 128 bits, too.

No span is lost: with hash windows of 32 and cut windows of 42 positions, two copies of a span of 200 have the same cuts
from its 73rd to its 158th position, and there are at least two of them, hence a whole common chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra.contracts import require_columns, require_range
from lavra.session import materialize, ship_package

GEAR_WINDOW = 32
#: Code points worked on at once by a worker; a longer text is worked on alone.
AT_ONCE = 1 << 20
MASK = (1 << 64) - 1


def cut_window(span: int) -> int:
    """The largest cut window with which every shared span holds a whole common chunk."""
    return (span - GEAR_WINDOW + 3) // 4


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mixer over an array of unsigned numbers."""
    x = (x.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


class SpanHasher:
    """Hashes of any stretch of an array of code points from running polynomial sums, modulo 2^64."""

    def __init__(self, seed: int) -> None:
        self.seed, self.base = seed, (seed * 0x2545F4914F6CDD1D | 5) & MASK
        self.powers = self.inverse = np.ones(1, np.uint64)

    def sums(self, codes: np.ndarray) -> np.ndarray:
        if len(self.powers) <= len(codes):
            n = max(len(codes) + 1, AT_ONCE)
            grow = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64))])
            self.powers, self.inverse = grow(self.base), grow(pow(self.base, -1, 1 << 64))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(codes, self.seed) * self.powers[: len(codes)])])

    def of(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((sums[stop] - sums[start]) * self.inverse[start] + (stop - start).astype(np.uint64), 1).view(np.int64)


class TreeHasher:
    """Hashes of every stretch of ``span`` code points: stretches of 1, 2, 4, ... are mixed from two halves each, and the
    span from those that make it up. Nothing in it is linear, unlike the running sums."""

    def __init__(self, span: int, seed: int) -> None:
        self.span, self.seed = span, seed

    def _join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = a * np.uint64(0x9FB21C651E98DF25) + b
        x ^= x >> np.uint64(35)
        x *= np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(28)
        return x

    def all(self, codes: np.ndarray) -> np.ndarray:
        """The hash of the span at each position that has a whole one, in order."""
        level, width, made, done = _mix(codes, self.seed), 1, None, 0
        count = len(codes) - self.span + 1
        if count <= 0:
            return np.zeros(0, np.int64)
        while True:
            if self.span & width:
                part = level[done : done + count]
                made, done = part if made is None else self._join(made, part), done + width
            if width * 2 > self.span:
                return made.view(np.int64)
            level, width = self._join(level[:-width], level[width:]), width * 2


def cuts(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """Sorted cut positions in texts that lie one after another in ``codes``."""
    h = _mix(codes, 7).astype(np.uint32)
    for s in (1, 2, 4, 8, 16):
        wider = h.copy()
        wider[s:] += h[:-s] << np.uint32(s)
        h = wider
    # The least hash of a window, the last of equals: one number holds the hash and the position.
    n = len(codes)
    key = (h.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    width = 1
    while width * 2 <= window:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < window:
        key = np.minimum(key[: len(key) - (window - width)], key[window - width :])
    whole = np.zeros(n + 1, np.int32)
    np.add.at(whole, starts + GEAR_WINDOW - 1, 1)
    np.add.at(whole, ends - window + 1, -1)
    inside = np.cumsum(whole[: len(key)]) > 0
    best = np.uint64(0xFFFFFFFF) - (key[inside] & np.uint64(0xFFFFFFFF))
    return np.unique(best).astype(np.int64)


def _groups(texts: list, least: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Texts of at least ``least`` code points, some at a time: their indices, code points and borders."""
    held, arrays, size = [], [], 0
    for i, text in enumerate(texts):
        if text is None or len(text) < least:
            continue
        held.append(i)
        arrays.append(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
        size += len(arrays[-1])
        if size >= AT_ONCE:
            yield held, np.concatenate(arrays), np.concatenate([[0], np.cumsum([len(a) for a in arrays])])
            held, arrays, size = [], [], 0
    if held:
        yield held, np.concatenate(arrays), np.concatenate([[0], np.cumsum([len(a) for a in arrays])])


def _chunks(codes: np.ndarray, borders: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunk borders ``p, q`` (two neighbouring cuts of one text) and the text's number. Chunks too near an end
    of the text to lie in the inner part of a span are left out."""
    at = cuts(codes, borders[:-1], borders[1:], window)
    text = np.searchsorted(borders, at, "right") - 1
    before, after = _reach(window)
    p, q, text = at[:-1], at[1:], np.where(text[:-1] == text[1:], text[:-1], -1)
    inner = (text >= 0) & (p - before >= borders[text]) & (q + after < borders[text + 1])
    return p[inner], q[inner], text[inner]


def _reach(window: int) -> tuple[int, int]:
    """How far the text that makes ``p`` and ``q`` neighbouring cuts reaches before ``p`` and after ``q``."""
    return GEAR_WINDOW + window - 2, window - 1


def _lists(values: np.ndarray, text: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    offsets = np.searchsorted(text, np.arange(n + 1), "left").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def chunk_digests(texts: DataFrame, span: int) -> DataFrame:
    """``digests`` beside all columns but the last, which is the text: the digests of its chunks in order. A digest covers
    the chunk and all code points on which its two cuts depend, 134 or so, so that stock phrases do not make chunks
    equal. Texts shorter than the span give no row."""
    window = cut_window(span)
    before, after = _reach(window)
    ship_package()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher(11)
        for batch in batches:
            names, columns = batch.schema.names[:-1], batch.columns[:-1]
            for held, codes, borders in _groups(batch.column(len(names)).to_pylist(), span):
                p, q, text = _chunks(codes, borders, window)
                digests = hasher.of(hasher.sums(codes), p - before, q + after + 1)
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(held)) for c in columns], _lists(digests, text, len(held), pa.int64())], [*names, "digests"])

    return texts.mapInArrow(run, ", ".join([*[f"{c} {k}" for c, k in texts.dtypes[:-1]], "digests array<bigint>"]))


def candidate_spans(texts: DataFrame, span: int) -> DataFrame:
    """``t, h1, h2`` (arrays) beside all columns but the last two: starts and hashes of the spans whose inner chunks are all
    shared. The last two columns are the text and the sorted indices of its shared chunks.
    """
    window = cut_window(span)
    ship_package()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = SpanHasher(11), TreeHasher(span, 29)
        for batch in batches:
            names, columns, shared = batch.schema.names[:-2], batch.columns[:-2], batch.columns[-1].to_pylist()
            for held, codes, borders in _groups(batch.columns[-2].to_pylist(), span):
                p, q, text = _chunks(codes, borders, window)
                begin = np.searchsorted(text, np.arange(len(held)), "left")
                known = np.zeros(len(p), bool)
                ends = np.append(begin[1:], len(p))
                for k, i in enumerate(held):
                    at = begin[k] + np.asarray(shared[i], np.int64)
                    known[at[at < ends[k]]] = True
                # A chunk that is not shared rules out the spans in whose inner part it lies.
                low = np.maximum(q - (span - window), borders[text])[~known]
                high = np.minimum(p - _reach(window)[0], borders[text + 1] - span)[~known]
                some = low <= high
                ruled = np.zeros(len(codes) + 1, np.int64)
                np.add.at(ruled, low[some], 1)
                np.add.at(ruled, high[some] + 1, -1)
                open_ = np.cumsum(ruled[:-1]) == 0
                for end in borders[1:]:
                    open_[max(0, end - span + 1) : end] = False
                t = np.flatnonzero(open_)
                of = np.searchsorted(borders, t, "right") - 1
                hashes = [first.of(first.sums(codes), t, t + span), second.all(codes)[t]]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[c.take(pa.array(held)) for c in columns],
                        _lists((t - borders[of]).astype(np.int32), of, len(held), pa.int32()),
                        *[_lists(h, of, len(held), pa.int64()) for h in hashes],
                    ],
                    [*names, "t", "h1", "h2"],
                )

    return texts.mapInArrow(run, ", ".join([*[f"{c} {k}" for c, k in texts.dtypes[:-2]], "t array<int>, h1 array<bigint>, h2 array<bigint>"]))


def _of_several(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one owner holds; pre-aggregated, so that a frequent key costs one row per task."""
    return rows.groupBy(*keys).agg(F.min("owner").alias("_a"), F.max("owner").alias("_b")).where("_a <> _b").select(*keys)


def shared_spans(documents: DataFrame, span: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, shared_chars`` of each document that shares a stretch of at least ``span`` code points with
    another document, and how many of its code points lie in such stretches.

    Equal texts are worked on once: all of a text that several documents have is shared. Null texts and texts
    shorter than the span share nothing; rows without id are left out. A stretch that occurs twice in one document only is not shared. Rows
    with one id count as one document.
    """
    require_columns(documents, [id_col, text_col], "documents")
    require_range("span", span, 100)
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where((F.length("text") >= span) & F.col("doc_id").isNotNull())
    # The one pass over all texts. o1 and o2 name a text; from here on only texts with candidates are read.
    named = docs.select("doc_id", F.xxhash64("text").alias("o1"), F.xxhash64(F.lit(29), "text").alias("o2"), F.length("text").alias("n"), "text")
    hashed = materialize(chunk_digests(named, span))
    known = hashed.groupBy("o1", "o2", "doc_id").agg(F.max("n").alias("n"))
    classes = known.groupBy("o1", "o2").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("_copies"))
    # Equal texts are worked on once, as the one of least document id. A document id may stand for several texts, so a place
    # is the text's number under its id (nearly always 0, so that it packs well) and the position.
    nth = F.row_number().over(Window.partitionBy("first_id").orderBy("o1", "o2")) - 1
    classes = materialize(classes.withColumn("nth", nth.cast("bigint")))
    firsts = hashed.join(classes, ["o1", "o2"]).where("doc_id = first_id")
    chunks = firsts.select(F.col("first_id").alias("owner"), F.shiftleft("nth", 32).alias("_nth"), F.posexplode("digests").alias("i", "digest"))
    chunks = chunks.select("owner", (F.col("_nth") + F.col("i")).alias("at"), "digest")
    twice = _of_several(chunks.select("owner", "digest"), ["digest"])
    shared = chunks.join(twice, "digest", "left_semi").groupBy(F.col("owner").alias("first_id"), F.shiftright("at", 32).alias("nth"))
    shared = shared.agg(F.array_sort(F.collect_set(F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))).alias("shared"))
    shared = materialize(shared.join(classes, ["first_id", "nth"]).select(F.col("first_id").alias("owner"), "nth", "o1", "shared"))
    texts = docs.select(F.col("doc_id").alias("owner"), F.xxhash64("text").alias("o1"), "text")
    spans = candidate_spans(texts.join(shared, ["owner", "o1"]).select("owner", "nth", "text", "shared"), span)
    rows = spans.select("owner", F.shiftleft("nth", 32).alias("_nth"), F.inline(F.arrays_zip("t", "h1", "h2")))
    rows = rows.select("owner", (F.col("_nth") + F.col("t")).alias("at"), "h1", "h2")
    again = _of_several(rows.select("owner", "h1", "h2"), ["h1", "h2"])
    held = rows.join(again, ["h1", "h2"], "left_semi").select("owner", "at")
    # A row that repeats has no gap to the next one and adds nothing.
    gap = F.lead("at").over(Window.partitionBy("owner").orderBy("at")) - F.col("at")
    covered = held.select("owner", "at", F.least(F.coalesce(gap, F.lit(span)), F.lit(span)).alias("c"))
    covered = covered.groupBy(F.col("owner").alias("first_id"), F.shiftright("at", 32).alias("nth")).agg(F.sum("c").alias("_covered"))
    totals = known.join(classes, ["o1", "o2"]).join(covered, ["first_id", "nth"], "left")
    amount: Column = F.when(F.col("_copies") > 1, F.col("n")).otherwise(F.col("_covered")).cast("bigint")
    return totals.groupBy("doc_id").agg(F.max(amount).alias("shared_chars")).where("shared_chars is not null")
