"""SimHash near-dedup by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into four segments of 16 bits. Of two fingerprints that differ in
at most three bits, either two segments are equal, or one is equal and each of the other three
differs in one bit (pigeonhole). For the first case every pair of whole segments is a key of
32 bits. For the second the key is a whole segment and the codewords of the next two: each is
decoded with the perfect (23, 12) Golay code, where every 23-bit word lies within three bits
of one codeword, and words at distance three have five more codewords at distance four. If two
words differ in one bit, the nearest codeword of either is among the codewords within four
bits of the other. So one side is keyed by (whole, codewords near the second, nearest of the
third) and the other by (whole, nearest of the second, codewords near the third), 40 bits;
every link meets on some key. Spark joins the sides on the key and verifies the distance in
the join.

Only distinct fingerprints are keyed, so copies cost nothing. In a dense bucket all members
within three bits of the bucket's smallest fingerprint are linked to it once; a pair of such
members is already connected and is not emitted. Components come from alternating star
contraction, each round cut by a checkpoint.

Defined results: null text counts as empty; a text without words has fingerprint zero, which
links like any other; fewer than three words are one shingle. Rows with equal doc_id are rows
of their own. A null doc_id never names a component unless all its documents have none. An
empty table gives an empty table. Extra columns travel inside a struct.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import checkpointed, written

SHINGLE = 3
DISTANCE = 3
SEGMENTS = 4
BITS = 64 // SEGMENTS
#: Generator polynomial of the binary Golay code, a fixed value.
GOLAY_POLY = 0b110001110101


def fingerprint(text: str | None, seed: int = 42) -> int:
    """Bit b is set if it is set in over half of the shingles' XXH64."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        hashes = [digest(b" ".join(words), seed)]
    else:
        hashes = [digest(b" ".join(s), seed) for s in zip(words, words[1:], words[2:], strict=False)]
    values = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(values), 1 << 14):
        bits = np.unpackbits(values[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype="uint64").astype("int64")

    return of(text)


class Golay:
    """Tables over the 2048 syndromes: error patterns of weight at most four."""

    def __init__(self) -> None:
        light = np.array([w for n in range(5) for w in sorted(sum(1 << b for b in bits) for bits in combinations(range(23), n))], dtype=np.int64)
        syndromes = self.syndrome(light)
        order = np.argsort(syndromes, kind="stable")
        starts = np.searchsorted(syndromes[order], np.arange(2048))
        sizes = np.diff(np.append(starts, len(order)))
        self.patterns = np.full((2048, 6), -1, dtype=np.int64)
        for k in range(6):
            has = sizes > k
            self.patterns[has, k] = light[order[starts[has] + k]]

    @staticmethod
    def syndrome(words: np.ndarray) -> np.ndarray:
        rest = words.copy()
        for bit in range(22, 10, -1):
            rest ^= np.where(rest >> bit & 1, GOLAY_POLY << (bit - 11), 0)
        return rest

    def keys(self, words: np.ndarray) -> np.ndarray:
        """(n, 6) indices of the codewords within four bits, nearest first, -1 where fewer."""
        errors = self.patterns[self.syndrome(words)]
        return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)


def golay_keys(prints: DataFrame) -> DataFrame:
    """`prints(fp)` to (key, side, fp); side 2 stands on both sides."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = Golay()
        for batch in batches:
            fps = batch["fp"].to_numpy(dtype=np.int64)
            for at in range(0, len(fps), 8192):
                part = fps[at : at + 8192]
                whole = [(part.view(np.uint64) >> np.uint64(BITS * s)).astype(np.int64) & ((1 << BITS) - 1) for s in range(SEGMENTS)]
                near = [code.keys(w) for w in whole]
                for p, (a, b) in enumerate(combinations(range(SEGMENTS), 2)):
                    yield pd.DataFrame({"key": (p << 2 * BITS) | (whole[a] << BITS) | whole[b], "side": np.int32(2), "fp": part})
                for a in range(SEGMENTS):
                    b, c = (a + 1) % SEGMENTS, (a + 2) % SEGMENTS
                    for side, many, one in ((0, near[b], near[c]), (1, near[c], near[b])):
                        row, col = np.nonzero(many >= 0)
                        high, low = (many[row, col], one[row, 0]) if side == 0 else (one[row, 0], many[row, col])
                        yield pd.DataFrame({"key": (SEGMENTS + a << 40) | (whole[a][row] << 24) | (high << 12) | low, "side": np.int32(side), "fp": part[row]})

    return prints.mapInPandas(of, "key long, side int, fp long")


def links(prints: DataFrame) -> DataFrame:
    """Distinct (src, dst) that connect all fingerprints of `prints(fp)`, distinct, which
    lie within DISTANCE bits of each other, directly or by way of a bucket's pivot."""
    far = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
    keyed = written(golay_keys(prints), "golay-keys")
    # only keys with rows on both sides and two fingerprints can link
    live = keyed.groupBy("key").agg(
        F.min("fp").alias("pivot"), F.max("fp").alias("top"), F.min("side").alias("s0"), F.max("side").alias("s1")
    ).where("pivot < top and (s0 < s1 or s0 = 2)").select("key", "pivot")
    rows = written(keyed.join(live, "key").select("key", "side", "fp", "pivot", (far("fp", "pivot") <= DISTANCE).alias("near")), "golay-rows")
    to_pivot = rows.where("near and fp <> pivot").select(F.col("fp").alias("src"), F.col("pivot").alias("dst"))
    a = rows.where("side <> 1").select("key", F.col("fp").alias("src"), F.col("near").alias("near_a"))
    b = rows.where("side <> 0").select("key", F.col("fp").alias("dst"), F.col("near").alias("near_b"))
    others = a.join(b, "key").where(
        (F.col("src") < F.col("dst")) & ~(F.col("near_a") & F.col("near_b")) & (far("src", "dst") <= DISTANCE)
    ).select("src", "dst")
    return to_pivot.union(others).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for the nodes of `edges(src, dst)`; root is the smallest node reachable.
    Alternating large and small star until nothing changes (Kiveris et al. 2014)."""
    star = checkpointed(edges.where("src <> dst").select(
        F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).distinct())
    state = None
    for _ in range(max_rounds):
        both = star.unionByName(star.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("m"))
        large = both.join(least, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(least, "hi")
        small = joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(joined.select("hi", F.col("m").alias("lo")))
        star = checkpointed(small.where("hi <> lo").distinct())
        now = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return star.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def clusters(tagged: DataFrame) -> DataFrame:
    """`tagged(doc_id, row_id, fp)` with first(doc_id, row_id), the first row of its component."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")).alias("first")
    prints = written(tagged.groupBy("fp").agg(first), "fingerprints")
    found = written(components(links(prints.select("fp"))), "components")
    linked = prints.join(found, prints["fp"] == found["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first")
    tops = linked.groupBy("root").agg(F.min("first").alias("first"))
    of = linked.select("fp", "root").join(tops, "root").select("fp", "first")
    return tagged.join(of, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, fingerprint, component_id."""
    tagged = written(docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row_id"),
                                 fingerprint_column(F.col(text_col)).alias("fp")), "simhash")
    return clusters(tagged).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay: of each component the first by doc_id, then by row."""
    tagged = written(docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row_id"),
                                 fingerprint_column(F.col(text_col)).alias("fp")), "simhash")
    found = clusters(tagged.select("doc_id", "row_id", "fp"))
    gone = found.where("row_id <> first.row_id").select("row_id")
    return tagged.join(gone, "row_id", "left_anti").select("row.*")
