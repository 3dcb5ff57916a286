"""Mixture-controlled packing of documents into training sequences.

Every source has a queue of tokens. A window of 1024 tokens serves the queues by deficit
round-robin: each is credited its target share of the window, the whole tokens of its credit are
taken, and the places that rounding leaves go in turn to the queues with the largest remaining
credit. Credits carry over from window to window and across partitions. Target shares are those of
the corpus, so that the queues end together, or `weights`: then a queue that cannot fill its share of
a window gives what it has, and it and later windows are filled by the others in proportion to their
weights. Nothing is dropped or repeated.

Between two such ends, of `Mixture.phases`, queue i has been served floor(x) or floor(x) + 1 tokens
since the phase began, with x = windows * 1024 * its weight / all weights; those with the largest
fractions get the extra token, so that the windows sum exactly. The layout of every window is thus
known without a pass over the windows before it, and each task lays out its own documents from the
phases and the queue offsets of its partition.

A source with less than one token a window (so at most 1024 sources have more) shares a stream with
others. There documents are ordered by their place in their own source: the
tokens before them as a fraction of the source's, plus a part of their own that a hash of the
source gives, so that sources of one document are spread too. Up to any place of the stream each
source has thus had its share of tokens to within about a document, whatever their number. Only
these documents are shuffled, by range.

The tokens after the last full window are cut into sequences whose lengths are powers of two,
so no padding is written at all.

Defined results: a null text counts as empty and holds the end id alone; a null source is a
queue like any other. Rows with equal doc_id are packed each on its own. An empty table gives
an empty table. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import written
from ridgeline.llm.token_ids import encoder

WINDOW = 1024
#: Offsets of queues in partitions are broadcast up to so many rows (about 16 MB), and joined beyond.
MAX_OFFSETS = 1 << 18
#: Figures of windows laid out at once.
CHUNK = 1 << 19
#: Weights add up to about this, so that products fit in 64 bits.
SCALE = 1 << 26

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def queue_names(docs: DataFrame, source_col: str, listed: list[str]) -> list[str | None]:
    """The sources with a queue of their own: those with a given weight, and all with a token's share
    of a window by bytes of text, at most WINDOW of them."""
    if len(listed) > WINDOW:
        raise ValueError(f"weights for more than {WINDOW} sources")
    size = F.sum(F.octet_length("text") + 1).alias("n")
    every = docs.agg(size).first()["n"] or 0
    rows = docs.groupBy(F.col(source_col).cast("string").alias("s")).agg(size).where(F.col("n") * WINDOW >= every)
    large = [r["s"] for r in rows.orderBy(F.desc("n"), "s").collect()]
    return [*listed, *(s for s in large if s not in set(listed))]


def tokenised(docs: DataFrame, path: str, end_id: int, names: list[str | None], source_col: str) -> DataFrame:
    """(part, queue, source, local_start, n, doc_id, ids): local_start counts the source's ids in this part."""
    place = {name: k for k, name in enumerate(names)}

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end, part = encoder(path).encode, np.array([end_id], dtype="<u2").tobytes(), TaskContext.get().partitionId()
        seen: dict[str | None, int] = {}
        for batch in batches:
            for at in range(0, len(batch), 1000):
                rows = batch.iloc[at : at + 1000]
                ids = [encode(t if isinstance(t, str) else None) + end for t in rows["text"]]
                sources = [s if isinstance(s, str) else None for s in rows["source"]]
                starts = []
                for s, x in zip(sources, ids, strict=True):
                    starts.append(seen.get(s, 0))
                    seen[s] = starts[-1] + len(x) // 2
                yield pd.DataFrame({"part": part, "queue": [place.get(s, len(names)) for s in sources], "source": pd.Series(sources, dtype=object), "local_start": starts, "n": [len(x) // 2 for x in ids],
                                    "doc_id": rows["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None), "ids": ids})

    return docs.mapInPandas(of, "part int, queue int, source string, local_start long, n long, doc_id long, ids binary")


class Mixture:
    """The layout of all windows from the totals and weights of the streams."""

    def __init__(self, totals: list[int], weights: list[float] | None = None) -> None:
        self.totals, self.all = totals, sum(totals)
        self.windows = self.all // WINDOW
        shares = [float(w) for w in (totals if weights is None else weights)]
        if weights is None and self.all <= SCALE:
            self.weights = list(totals)
        else:
            self.weights = [max(1, round(x / sum(shares) * SCALE)) if x > 0 else 0 for x in shares]
        self.kind = np.int64 if (SCALE + len(totals)) * (self.windows + 2) < 1 << 62 else object
        phases, w, served = [], 0, [0] * len(totals)
        while w < self.windows:
            rate, length = self._phase(served, self.windows - w)
            phases.append((w, served, rate))
            served, w = self._after(served, rate, length), w + length
        phases.append((self.windows, served, [0] * len(totals)))
        self.starts = np.array([p[0] for p in phases], dtype=np.int64)
        self.served_then = np.array([p[1] for p in phases], dtype=np.int64).reshape(len(phases), len(totals))
        self.rates = np.array([p[2] for p in phases], dtype=np.int64).reshape(len(phases), len(totals))

    def _phase(self, served: list[int], most: int) -> tuple[list[int], int]:
        """Rates and length of the next phase: as long as all queues can fill their shares, or one
        window in which the short ones give all they have."""
        left = [t - s for t, s in zip(self.totals, served, strict=True)]
        rate = [w if n else 0 for w, n in zip(self.weights, left, strict=True)]
        if not any(rate):
            rate = left
        every = sum(rate)
        length = min((n - 1) * every // (WINDOW * v) for n, v in zip(left, rate, strict=True) if v)
        if length > 0:
            return rate, min(length, most)
        give, places, open_ = [0] * len(left), WINDOW, [i for i, v in enumerate(rate) if v]
        while short := [i for i in open_ if left[i] * every <= places * rate[i]]:
            for i in short:
                give[i] = left[i]
            places -= sum(left[i] for i in short)
            open_ = [i for i in open_ if not give[i]]
            every = sum(rate[i] for i in open_)
        if places and not open_:  # only queues without a weight are left
            return self._top_up(give, left, places), 1
        if places:
            by_rest = sorted(open_, key=lambda i: (-(places * rate[i] % every), i))
            for i in open_:
                give[i] = places * rate[i] // every
            for i in by_rest[: WINDOW - sum(give)]:
                give[i] += 1
        return give, 1

    @staticmethod
    def _top_up(give: list[int], left: list[int], places: int) -> list[int]:
        for i, n in enumerate(left):
            more = min(places, n - give[i])
            give[i], places = give[i] + more, places - more
        return give

    def _after(self, served: list[int], rate: list[int], length: int) -> list[int]:
        every = sum(rate)
        taken = [length * WINDOW * v // every for v in rate]
        rest = sorted(range(len(rate)), key=lambda i: (-(length * WINDOW * rate[i] % every), i))
        for i in rest[: length * WINDOW - sum(taken)]:
            taken[i] += 1
        return [s + t for s, t in zip(served, taken, strict=True)]

    def served(self, w: np.ndarray) -> np.ndarray:
        """(len(w), streams) tokens taken before window w; all of them after the last."""
        out = np.empty((len(w), len(self.totals)), dtype=np.int64)
        phase = np.searchsorted(self.starts, w, side="right") - 1
        for p in np.unique(phase):
            at = phase == p
            done = (w[at] - self.starts[p]).astype(self.kind)
            rate = self.rates[p].astype(self.kind)
            every = max(int(rate.sum()), 1)
            part = done[:, None] * (WINDOW * rate % every)[None, :]
            fraction = part % every
            taken = done[:, None] * (WINDOW * rate // every)[None, :] + part // every
            extra = WINDOW * done - taken.sum(axis=1) if rate.any() else 0 * done
            order = np.argsort(-fraction, axis=1, kind="stable")
            rank = np.argsort(order, axis=1, kind="stable")
            out[at] = self.served_then[p] + taken + (rank < extra[:, None])
        return np.where((w > self.windows)[:, None], np.array(self.totals, dtype=np.int64)[None, :], out)

    def window_of(self, stream: np.ndarray, place: np.ndarray) -> np.ndarray:
        """About the window that holds each place of its stream, to within two."""
        found = np.empty(len(place), dtype=np.int64)
        for s in np.unique(stream):
            at = stream == s
            phase = np.searchsorted(self.served_then[:, s], place[at], side="right") - 1
            pace = np.maximum(self.rates[phase, s], 1) / np.maximum(self.rates[phase].sum(axis=1), 1) * WINDOW
            found[at] = self.starts[phase] + np.floor((place[at] - self.served_then[phase, s]) / pace).astype(np.int64)
        return np.clip(found, 0, self.windows)

    def tail(self) -> list[tuple[int, int, int]]:
        """(from, to, sequence id) of the power-of-two sequences after the full windows."""
        left, at, out = self.all - WINDOW * self.windows, 0, []
        for bit in range(WINDOW.bit_length() - 1, -1, -1):
            if left >> bit & 1:
                out.append((at, at + (1 << bit), self.windows + len(out)))
                at += 1 << bit
        return out

    def pieces(self, stream: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Document rows to (row, from, to, sequence_id, offset), from and to within the stream."""
        lo = np.clip(self.window_of(stream, start) - 2, 0, self.windows)
        hi = np.clip(self.window_of(stream, start + n - 1) + 2, 0, self.windows)
        count = hi - lo + 1
        ends = np.cumsum(count)
        found = []
        chunk = max(64, CHUNK // max(len(self.totals), 1))
        for at in range(0, int(ends[-1]), chunk):
            flat = np.arange(at, min(at + chunk, int(ends[-1])))
            row = np.searchsorted(ends, flat, side="right")
            w = lo[row] + flat - (ends[row] - count[row])
            some, back = np.unique(w, return_inverse=True)
            before, after = self.served(some), self.served(some + 1)
            first = np.cumsum(after - before, axis=1) - (after - before)  # where each stream's share begins
            s, k = stream[row], np.arange(len(row))
            b, a, f = before[back][k, s], after[back][k, s], first[back][k, s]
            left, right = np.maximum(b, start[row]), np.minimum(a, (start + n)[row])
            use = left < right
            found.append(np.stack([x[use].astype(np.int64) for x in (row, left, right, w, f + left - b)]))
        row, left, right, w, offset = np.concatenate(found, axis=1)
        last = w == self.windows
        if not last.any():
            return row, left, right, w, offset
        full, cut = np.stack([row, left, right, w, offset])[:, ~last], []
        for r, a, b, _, o in zip(*(x[last].tolist() for x in (row, left, right, w, offset)), strict=True):
            for x, y, sequence in self.tail():
                if (c := max(o, x)) < (d := min(o + b - a, y)):
                    cut.append((r, a + c - o, a + d - o, sequence, c - x))
        return tuple(np.concatenate([full, np.array(cut, dtype=np.int64).reshape(-1, 5).T], axis=1))


def streams(shares: dict[int, float]) -> dict[int, int]:
    """Queue to stream. A queue with a share of less than one token a window joins the next larger."""
    groups = sorted(([n], [q]) for q, n in shares.items())
    groups = [(sum(n), q) for n, q in groups]
    every = sum(shares.values())
    while len(groups) > 1 and groups[0][0] * WINDOW < every:
        (a, p), (b, q), *rest = groups
        groups = sorted([(a + b, p + q), *rest])
    return {q: k for k, (_, qs) in enumerate(groups) for q in qs}


def target_shares(totals: dict[int, int], names: list[str | None], weights: dict[str, float]) -> dict[int, float]:
    """The share of each queue: its part of the tokens, or by `weights`; sources without a weight keep
    the part that they hold, and the others share the rest."""
    every = max(sum(totals.values()), 1)
    given = {q: weights[names[q]] for q in totals if q < len(names) and names[q] in weights}
    free = sum(totals[q] for q in given) / every
    scale = free / sum(given.values()) if sum(given.values()) > 0 else 0.0
    return {q: given[q] * scale if q in given else n / every for q, n in totals.items()}


def _sent(offsets: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(offsets) if rows <= MAX_OFFSETS else offsets


def spread(tokens: DataFrame, sums: DataFrame) -> DataFrame:
    """(doc_id, stream, at, n, ids) of the documents of shared streams, each source spread evenly."""
    source, order = Window.partitionBy("source"), ["stream", "place", "source", "start"]
    before = F.sum("n").over(source.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col("part").alias("p"), F.col("source").alias("s"), F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(source).alias("total"))
    rows = tokens.join(sums, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    start, phase = F.col("before") + F.col("local_start"), F.pmod(F.xxhash64("source"), F.lit(1 << 20)) / (1 << 20)
    rows = rows.select("stream", ((start + phase * F.col("n")) / F.col("total")).alias("place"), "source", start.alias("start"), "n", "doc_id", "ids")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            starts = []
            for k, n in zip(batch["stream"].tolist(), batch["n"].tolist(), strict=True):
                starts.append(seen.get(k, 0))
                seen[k] = starts[-1] + n
            yield pd.DataFrame({"part": part, "stream": batch["stream"], "local_start": starts, "n": batch["n"],
                                "doc_id": batch["doc_id"], "ids": batch["ids"]})

    counted = written(rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(
        count, "part int, stream int, local_start long, n long, doc_id string, ids binary"), "packing-spread")
    before = F.sum("n").over(Window.partitionBy("stream").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = written(counted.groupBy("part", "stream").agg(F.sum("n").alias("n")), "packing-spread-sums")
    offsets = sums.select("part", "stream", F.coalesce(before, F.lit(0)).alias("before"))
    return counted.join(_sent(offsets, sums.count()), ["part", "stream"]).select(
        F.col("doc_id").cast("long").alias("doc_id"), "stream", (F.col("before") + F.col("local_start")).alias("at"), "n", "ids")


def pack(docs: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         with_ids: bool = True, weights: dict[str, float] | None = None) -> DataFrame:
    """Pieces of documents with their place, and the ids themselves if `with_ids`. `weights`: target
    proportions by source; the corpus's own where none are given."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       F.col(source_col).cast("string").alias("source"))
    names = queue_names(rows, "source", list(weights or ()))
    tokens = written(tokenised(rows, path, end_id, names, "source"), "packing-ids")
    sums = written(tokens.groupBy("part", "queue", "source").agg(F.sum("n").alias("n")), "packing-sums")
    totals = {r["queue"]: r["n"] for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # WINDOW + 1 rows, or 2 * WINDOW with weights
    shares = target_shares(totals, names, weights or {})
    of = streams({q: x for q, x in shares.items()})
    several = range(max(of.values(), default=-1) + 1)
    mixture = Mixture([sum(n for q, n in totals.items() if of[q] == k) for k in several], [sum(x for q, x in shares.items() if of[q] == k) for k in several] if weights else None)
    shared = {q for q in totals if q == len(names) or sum(of[other] == of[q] for other in totals) > 1}
    queue_table = F.broadcast(docs.sparkSession.createDataFrame([(q, of[q]) for q in totals], "queue int, stream int"))
    alone, among = ~F.col("queue").isin(*shared), F.col("queue").isin(*shared)
    before = F.sum("n").over(Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.where(alone).select("part", "queue", F.coalesce(before, F.lit(0)).alias("base")).join(queue_table, "queue")
    placed = tokens.where(alone).join(_sent(offsets, sums.where(alone).count()), ["part", "queue"]).select(
        "doc_id", "stream", (F.col("base") + F.col("local_start")).alias("at"), "n", "ids")
    if shared:
        placed = placed.unionByName(spread(tokens.where(among).join(queue_table, "queue"), sums.where(among)))

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                rows = batch.iloc[at : at + 1000]
                start, n = rows["at"].to_numpy(dtype=np.int64), rows["n"].to_numpy(dtype=np.int64)
                row, left, right, sequence, offset = mixture.pieces(rows["stream"].to_numpy(dtype=np.int64), start, n)
                packed = rows["ids"].tolist()
                wide = [np.frombuffer(x, dtype="<u2").astype("<u4") for x in packed]
                left, right = left - start[row], right - start[row]
                crc = [zlib.crc32(wide[r][a:b]) for r, a, b in zip(row.tolist(), left.tolist(), right.tolist(), strict=True)]
                ids = [packed[r][2 * a : 2 * b] for r, a, b in zip(row.tolist(), left.tolist(), right.tolist(), strict=True)] if with_ids else None
                yield pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None)[row], "start": left, "length": right - left, "ids_crc32": crc,
                                    "doc_tokens": n[row], "sequence_id": sequence, "offset": offset, "ids": ids})

    return placed.mapInPandas(lay, PIECE)
