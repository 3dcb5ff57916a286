"""Benchmark decontamination with an FM-index for each training shard.

A shard is a run of documents of one task, about SHARD_SYMBOLS symbols long. Its text is the
sequence of word numbers in the benchmark's vocabulary; every stretch of other words, every
document end, and every stretch of vocabulary words too short to hold a window is one
separator, which no window contains (so nothing is lost). Over this sequence stands a suffix
array by prefix doubling, its Burrows-Wheeler transform as a wavelet tree of bit vectors with
running ranks, and a sample of suffix positions. All windows are searched backwards at once,
word by word, through the tree's ranks; the rows found step back to the nearest sampled
position. Occurrences are merged to removal spans, and items are counted by their windows.

The benchmark is read in blocks of at most BLOCK_WORDS words, and one job after the other searches one
block, so that what the driver and the tasks hold is bounded whatever its size; documents are never
sent. With several blocks the jobs read a table of row numbers and texts and write what they find
by row number, and the findings are merged and joined to the rows at the end.

Defined results: null has no words; an item without words is never found; an item of fewer
than WINDOW words is one window; equal items count each under its item_id (null item_id: never
counted, but its words are hit); equal rows are rows of their own. Empty tables: no document,
no row; no item, no hit. Extra columns travel inside a struct.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import written

WINDOW = 10
BLOCK_WORDS = 2_000_000
SHARD_SYMBOLS = 1 << 19
SAMPLE = 16

#: A-Z to a-z, 0-9, a-z and all non-ASCII bytes kept, all else a blank.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


class Phrases:
    """The windows of a block of items."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int) -> None:
        self.numbers: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set] = {}
        for item, text in items:
            ws = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text)]
            for i in range(max(1, len(ws) - window + 1) if ws else 0):
                windows.setdefault(tuple(ws[i : i + window]), set()).add(item)
        self.windows = list(windows)
        self.items = [sorted(str(x) for x in s if x is not None) for s in windows.values()]
        self.lengths = np.array([len(w) for w in self.windows], dtype=np.int64)
        self.grid = np.zeros((len(self.windows), window), dtype=np.int64)  # right-aligned
        for k, w in enumerate(self.windows):
            self.grid[k, window - len(w) :] = w
        self.shortest = int(self.lengths.min()) if len(self.windows) else window


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By prefix doubling; a suffix that ends first sorts first."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    rank = rank.astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        ranks = np.empty(n, dtype=np.int64)
        ranks[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank, step = ranks, 2 * step
        if step >= n or rank[order[-1]] == n - 1:
            return order


class WaveletTree:
    """Levels of bits, high bit first, each stably partitioned by the bit (a wavelet matrix)."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.bits = max(1, int(symbols.max(initial=0)).bit_length())
        self.ones, self.zeros = [], []
        rest = symbols
        for b in range(self.bits - 1, -1, -1):
            bit = rest >> b & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            rest = np.concatenate([rest[bit == 0], rest[bit == 1]])

    def _down(self, level: int, at: np.ndarray, bit: np.ndarray) -> np.ndarray:
        ones = self.ones[level][at]
        return np.where(bit, self.zeros[level] + ones, at - ones)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        lo = np.zeros_like(at)
        for level in range(self.bits):
            bit = symbol >> (self.bits - 1 - level) & 1
            lo, at = self._down(level, lo, bit), self._down(level, at, bit)
        return at - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for level in range(self.bits):
            bit = (self.ones[level][at + 1] - self.ones[level][at]).astype(np.int64)
            symbol, at = symbol << 1 | bit, self._down(level, at, bit)
        return symbol


class FMIndex:
    """Over symbols from 1; 0 ends the text."""

    def __init__(self, symbols: np.ndarray) -> None:
        text = np.append(symbols.astype(np.int64), 0)
        suffixes = suffix_array(text)
        self.tree = WaveletTree(text[suffixes - 1])
        top = int(text.max()) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])[: top + 1]
        self.sampled = suffixes % SAMPLE == 0
        self.position = np.where(self.sampled, suffixes, -1)
        self.top = top

    def search(self, grid: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix rows [lo, hi) of each right-aligned pattern."""
        lo, hi = np.zeros(len(grid), dtype=np.int64), np.full(len(grid), len(self.sampled), dtype=np.int64)
        for step in range(1, grid.shape[1] + 1):
            live = np.nonzero((lengths >= step) & (lo < hi))[0]
            symbol = grid[live, -step]
            known = symbol < self.top
            hi[live[~known]] = lo[live[~known]]
            live, symbol = live[known], symbol[known]
            lo[live] = self.before[symbol] + self.tree.rank(symbol, lo[live])
            hi[live] = self.before[symbol] + self.tree.rank(symbol, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        found, steps, at = np.full(len(rows), -1, dtype=np.int64), 0, rows.copy()
        open_ = np.arange(len(rows))
        while len(open_):
            hit = self.sampled[at]
            found[open_[hit]] = self.position[at[hit]] + steps
            open_, at = open_[~hit], at[~hit]
            symbol = self.tree.access(at)
            at, steps = self.before[symbol] + self.tree.rank(symbol, at), steps + 1
        return found


def occurrences(shard: list[np.ndarray], phrases: Phrases) -> Iterator[tuple[int, int, int]]:
    """(document, first word, window) of every occurrence in documents of word numbers, 0: another word."""
    pieces, places, owners = [], [], []
    for d, numbers in enumerate(shard):
        known = np.concatenate([[False], numbers > 0, [False]])
        edges = np.nonzero(np.diff(known))[0]
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= phrases.shortest:
                pieces += [numbers[a:b] + 1, [1]]  # 1: the separator
                places.append(np.arange(a, b + 1))
                owners.append(np.full(b + 1 - a, d))
    if not pieces:
        return
    index = FMIndex(np.concatenate(pieces))
    place, owner = np.concatenate(places), np.concatenate(owners)
    lo, hi = index.search(np.where(phrases.grid > 0, phrases.grid + 1, 0), phrases.lengths)
    count = np.maximum(hi - lo, 0)
    ends = np.cumsum(count)
    for at in range(0, int(ends[-1]), 1 << 18):
        flat = np.arange(at, min(at + (1 << 18), int(ends[-1])))
        window = np.searchsorted(ends, flat, side="right")
        where = index.locate(lo[window] + flat - (ends - count)[window])
        yield from zip(owner[where].tolist(), place[where].tolist(), window.tolist(), strict=True)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> list[DataFrame]:
    """Items in blocks of at most BLOCK_WORDS words (by bytes / 2, which no text exceeds), or one item."""
    rows = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // (2 * BLOCK_WORDS)))
    if parts == 1:
        return [rows]
    return [rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k) for k in range(parts)]


FOUND = "n_words long, items array<string>, first array<long>, last array<long>"


def _search(sent: Broadcast, window: int, text: Column) -> Column:
    """The struct FOUND of each text against the block of items `sent`; the shards are cut from Arrow batches."""

    @F.pandas_udf(FOUND)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        phrases = Phrases(sent.value, window)
        get = phrases.numbers.get
        for batch in batches:
            out, shard, held = [], [], 0

            def done(shard: list[np.ndarray], out: list[tuple]) -> None:
                spans, found = [[] for _ in shard], [set() for _ in shard]
                for d, first, w in occurrences(shard, phrases):
                    spans[d].append((first, first + int(phrases.lengths[w])))
                    found[d].update(phrases.items[w])
                for numbers, s, f in zip(shard, spans, found, strict=True):
                    s = merged(s)
                    out.append((len(numbers), sorted(f), [x for x, _ in s], [y - 1 for _, y in s]))

            for t in batch:
                ws = words(t)
                shard.append(np.fromiter((get(w, 0) for w in ws), dtype=np.int64, count=len(ws)))
                held += len(ws)
                if held >= SHARD_SYMBOLS:
                    done(shard, out)
                    shard, held = [], 0
            done(shard, out)
            yield pd.DataFrame(out, columns=["n_words", "items", "first", "last"])

    return of(text)


def _merge(spans: Column) -> Column:
    @F.pandas_udf("array<struct<first: long, last: long>>")
    def of(series: pd.Series) -> pd.Series:
        return series.map(lambda s: [{"first": a, "last": b - 1} for a, b in merged([(x["first"], x["last"] + 1) for x in s])])

    return of(spans)


def with_removal_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                       item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(row, n_words, items, spans, n_hit) for each row of `docs`: its columns as a struct, the
    ids of items with occurring windows (strings, sorted), merged spans (word numbers from 0,
    last one inclusive) and the words within them."""
    blocks = benchmark_blocks(benchmark, item_col, item_text_col)
    send = lambda block: docs.sparkSession.sparkContext.broadcast([(r["item"], r["text"]) for r in block.collect()])
    if len(blocks) == 1:
        rows = docs.select(F.struct("*").alias("row"), _search(send(blocks[0]), window, F.col(text_col)).alias("found"))
        rows = rows.select("row", "found.n_words", "found.items", F.arrays_zip(F.col("found.first").alias("first"), F.col("found.last").alias("last")).alias("spans"))
    else:
        numbered = written(docs.select(F.monotonically_increasing_id().alias("row_id"), F.struct("*").alias("row"), F.col(text_col).alias("text")), "decontaminate-rows")
        parts = []
        for k, block in enumerate(blocks):
            sent = send(block)
            found = numbered.select("row_id", _search(sent, window, F.col("text")).alias("found")).select("row_id", "found.*")
            parts.append(written(found if k == 0 else found.where("size(first) > 0"), "decontaminate-found"))  # the first has all rows
            sent.destroy()
        every = reduce(DataFrame.unionByName, parts).groupBy("row_id").agg(
            F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.flatten(F.collect_list(F.arrays_zip(F.col("first").alias("first"), F.col("last").alias("last")))).alias("spans"))
        rows = numbered.select("row_id", "row").join(every, "row_id").select("row", "n_words", "items", _merge(F.col("spans")).alias("spans"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return rows.withColumn("n_hit", hit)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **columns: str) -> DataFrame:
    """The rows of `docs` that hold no window, with its columns."""
    return with_removal_spans(docs, benchmark, **columns).where("n_hit = 0").select("row.*")
