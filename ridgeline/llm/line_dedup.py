"""Line dedup by a sharded minimal perfect hash that documents probe.

A line's key is the line without blanks at both ends, A-Z lower-cased. Keys of at least `min_chars`
code points in at least `min_docs` documents lose all their lines but those of the document with the
largest id. One aggregate over 128-bit key hashes, combined before its shuffle, counts documents and finds
that largest id; only hashes that repeat often enough go on. They are dealt to shards by hash, and one
task for each shard lays a minimal perfect hash over its hashes: levels of bits, a hash standing where
it alone falls, its slot the rank of its bit. By slot lie compact arrays of fingerprints, counts and
keeping ids. Documents never meet lines in a join: each task hashes the lines of its own documents and
probes the arrays.

A slice of at most SLICE_SHARDS shards (some 26 MB) is sent to the tasks at a time. If there is one slice,
documents are read, probed and cut in one pass. If there are more, the hashes of lines are laid out by slice
once, each slice is probed by its own lines alone, and the lines found come back to the documents.

Defined results: null or empty text is one empty line and gives the empty string. Every row is a document, so equal rows count each; rows
that share the largest id all keep the line. A null id is the smallest, and only if all
holders have one, all keep the line. A document that loses all lines becomes the empty string. Hashes of
128 bits stand for keys, and a slot answers only to its 64-bit fingerprint. An empty table
gives an empty table. Extra columns travel inside a struct.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import ascii_lower, written

MIN_CHARS, MIN_DOCS = 20, 3
SHARD_KEYS = 1 << 18
SLICE_SHARDS = 4
#: Bits of a level for each hash that comes to it.
LOAD = 2
BLANKS = " \t\n\x0b\x0c\r"
IMAGE = "shard long, n long, sizes array<long>, bits binary, fingerprint binary, count binary, keeper binary, nobody binary"


def mixed(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    x = h1 ^ ((h2 + np.uint64(level)) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class PerfectHash:
    """A bijection of n different hashes (pairs of 64-bit words) to 0 .. n - 1; other hashes get any slot or -1."""

    sizes: np.ndarray  # bits of each level, multiples of 64
    words: np.ndarray  # all levels' bits, 64 in a word

    def __post_init__(self) -> None:
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])

    @staticmethod
    def of(h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        sizes, words, level = [], [], 0
        while len(h1):
            size = 64 * math.ceil(LOAD * len(h1) / 64)
            at = (mixed(h1, h2, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = ~alone[at]
            h1, h2, level = h1[left], h2[left], level + 1
        return PerfectHash(np.array(sizes, dtype=np.int64), np.concatenate(words) if words else np.zeros(0, dtype=np.uint64))

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out, open_, start = np.full(len(h1), -1, dtype=np.int64), np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = (mixed(h1[open_], h2[open_], level) % np.uint64(size)).astype(np.int64) + start
            word, bit = self.words[at >> 6], np.uint64(1) << (at & 63).astype(np.uint64)
            hit = (word & bit) != 0
            out[open_[hit]] = self.before[at[hit] >> 6] + np.bitwise_count(word[hit] & (bit[hit] - np.uint64(1)))
            open_, start = open_[~hit], start + size
        return out


@dataclass
class Shard:
    hash: PerfectHash
    fingerprint: np.ndarray
    count: np.ndarray
    keeper: np.ndarray
    nobody: np.ndarray  # no holder has an id

    def dropped(self, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> np.ndarray:
        """Whether a line with this hash goes from the document with this id."""
        slot = self.hash.slots(h1, h2)
        found = slot >= 0
        found[found] = self.fingerprint[slot[found]] == h2[found]
        s = slot[found]
        found[found] = ~self.nobody[s] & (no_id[found] | (self.keeper[s] != ids[found]))
        return found


def image(keys: pd.DataFrame) -> pd.DataFrame:
    """The arrays of one shard from its keys (shard, h1, h2, n, keeper)."""
    h1, h2 = keys["h1"].to_numpy(np.int64).view(np.uint64), keys["h2"].to_numpy(np.int64).view(np.uint64)
    perfect = PerfectHash.of(h1, h2)
    order = np.argsort(perfect.slots(h1, h2))
    none = keys["keeper"].isna().to_numpy()
    keeper = keys["keeper"].astype("Int64").fillna(0).to_numpy(np.int64)
    count = np.minimum(keys["n"].to_numpy(np.int64), (1 << 32) - 1).astype(np.uint32)
    return pd.DataFrame({
        "shard": [int(keys["shard"].iloc[0])], "n": [len(keys)], "sizes": [perfect.sizes], "bits": [perfect.words.tobytes()], "fingerprint": [h2[order].tobytes()],
        "count": [count[order].tobytes()], "keeper": [keeper[order].tobytes()], "nobody": [none[order].tobytes()]})


def shard_of(row: tuple) -> Shard:
    _, _, sizes, bits, fingerprint, count, keeper, nobody = row
    read = np.frombuffer
    return Shard(PerfectHash(np.array(sizes, dtype=np.int64), read(bits, np.uint64)), read(fingerprint, np.uint64), read(count, np.uint32), read(keeper, np.int64), read(nobody, np.bool_))


def line_hashes(text: Column, min_chars: int) -> Column:
    """For each line the struct (h1, h2) of its key; zeros if the key is too short to count."""
    def one(key: Column) -> Column:
        hashes = F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"))
        none = F.struct(F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"))
        return F.when(F.length(key) >= min_chars, hashes).otherwise(none)

    # letters are lowered in whole texts; a line break stays what it is
    keys = F.transform(lines(ascii_lower(F.coalesce(text, F.lit("")))), lambda line: F.btrim(line, F.lit(BLANKS)))
    return F.transform(keys, one)


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def repeated(docs: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h1, h2, n, keeper): hashes of keys in at least `min_docs` documents, how many, and the largest id."""
    each = docs.select(F.col(id_col).cast("long").alias("id"), F.explode(F.array_distinct(line_hashes(F.col(text_col), min_chars))).alias("k"))
    found = each.where("k.h1 <> 0 or k.h2 <> 0").groupBy(F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2"))
    return found.agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs)


def index(keys: DataFrame) -> tuple[DataFrame, int]:
    """The shards' images of a table of repeated keys, written, and the number of shards."""
    keys = written(keys, "line-keys")
    shards = max(1, math.ceil(keys.count() / SHARD_KEYS))
    dealt = keys.withColumn("shard", F.pmod("h1", F.lit(shards)))
    return written(dealt.groupBy("shard").applyInPandas(image, IMAGE), "line-index"), shards


def _flat(arrays: pd.Series, dtype: type) -> np.ndarray:
    return np.concatenate([np.asarray(a, dtype=dtype) for a in arrays]) if len(arrays) else np.zeros(0, dtype)


def _probe(rows: list[tuple], shards: int, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> np.ndarray:
    out, shard = np.zeros(len(h1), dtype=bool), np.mod(h1, shards)
    a, b = h1.view(np.uint64), h2.view(np.uint64)
    some = (h1 != 0) | (h2 != 0)
    for row, images in rows:
        at = np.nonzero(some & (shard == row))[0]
        if len(at):
            out[at] = images.dropped(a[at], b[at], ids[at], no_id[at])
    return out


def _flags(sent, shards: int, hashes: Column, doc_id: Column) -> Column:
    """For each line of a document whether it goes."""

    @F.pandas_udf("array<boolean>")
    def of(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        loaded = [(r[0], shard_of(r)) for r in sent.value]
        for h1, h2, ids in batches:
            sizes = np.array([len(a) for a in h1], dtype=np.int64)
            no_id, known = ids.isna().to_numpy(), ids.astype("Int64").fillna(0).to_numpy(np.int64)
            gone = _probe(loaded, shards, _flat(h1, np.int64), _flat(h2, np.int64), np.repeat(known, sizes), np.repeat(no_id, sizes))
            yield pd.Series(np.split(gone, np.cumsum(sizes)[:-1]) if len(sizes) else [])

    return of(hashes["h1"], hashes["h2"], doc_id)


def _places(n_lines: Column, places: Column) -> Column:
    """Flags of a document of `n_lines` lines from the numbers of lines that go."""

    @F.pandas_udf("array<boolean>")
    def of(ns: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for n, some in zip(ns, places, strict=True):
            flags = np.zeros(n, dtype=bool)
            if some is not None:
                flags[np.asarray(some, dtype=np.int64)] = True
            out.append(flags)
        return pd.Series(out)

    return of(n_lines, places)


def _in_slices(docs: DataFrame, images: DataFrame, shards: int, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(row, gone) by one job for each slice of the index; each reads the hashes of its own slice alone."""
    spark, slices = docs.sparkSession, math.ceil(shards / SLICE_SHARDS)
    rows = written(docs.select(F.monotonically_increasing_id().alias("row_id"), F.struct("*").alias("row")), "line-rows")
    text, doc_id = F.col(f"row.`{text_col}`"), F.col(f"row.`{id_col}`").cast("long")
    each = rows.select("row_id", doc_id.alias("id"), F.posexplode(line_hashes(text, min_chars)).alias("place", "k")).where("k.h1 <> 0 or k.h2 <> 0")
    each = each.select("row_id", "id", "place", "k.h1", "k.h2", F.expr(f"int(pmod(k.h1, {shards}L) div {SLICE_SHARDS})").alias("slice"))
    laid = written(each.repartition(16 * slices, "slice", F.pmod("row_id", F.lit(16))), "line-hashes", partition_by="slice")
    found = []
    for k in range(slices):
        sent = spark.sparkContext.broadcast([tuple(r) for r in images.where(F.col("shard").between(k * SLICE_SHARDS, (k + 1) * SLICE_SHARDS - 1)).collect()])

        def hits(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            loaded = [(r[0], shard_of(r)) for r in sent.value]
            for b in batches:
                no_id, ids = b["id"].isna().to_numpy(), b["id"].astype("Int64").fillna(0).to_numpy(np.int64)
                gone = _probe(loaded, shards, b["h1"].to_numpy(np.int64), b["h2"].to_numpy(np.int64), ids, no_id)
                yield b.loc[gone, ["row_id", "place"]]

        found.append(written(laid.where(F.col("slice") == k).mapInPandas(hits, "row_id long, place int"), "line-found"))
        sent.destroy()
    places = reduce(DataFrame.unionByName, found).groupBy("row_id").agg(F.collect_list("place").alias("places"))
    joined = rows.join(places, "row_id", "left")
    return joined.select("row", _places(F.size(lines(text)), F.col("places")).alias("gone"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(row, n_lines, n_dropped, kept_text) for each row of `docs`, its columns as a struct."""
    images, shards = index(repeated(docs, id_col, text_col, min_chars, min_docs))
    if shards <= SLICE_SHARDS:
        sent = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in images.collect()])  # one slice at most
        marked = docs.select(F.struct("*").alias("row"), _flags(sent, shards, line_hashes(F.col(text_col), min_chars), F.col(id_col).cast("long")).alias("gone"))
    else:
        marked = _in_slices(docs, images, shards, id_col, text_col, min_chars)
    own = lines(F.col(f"row.`{text_col}`"))
    left = F.filter(F.arrays_zip(own.alias("line"), F.col("gone").alias("gone")), lambda x: ~x["gone"])
    return marked.select("row", F.size("gone").cast("long").alias("n_lines"), (F.size("gone") - F.size(F.filter("gone", lambda g: ~g))).cast("long").alias("n_dropped"),
                         F.array_join(F.transform(left, lambda x: x["line"]), "\n").alias("kept_text"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """The rows of `docs` with their repeated lines dropped from the text."""
    kept = deduplicated(docs, id_col, text_col, **limits)
    return kept.select(*[F.col("kept_text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
