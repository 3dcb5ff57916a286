"""Token ids as patched frame-of-reference shard files.

Documents are dealt by ranges of doc_id and sorted; each task writes shard images of about
SHARD_IDS ids. Spark's own writer commits the images (one row each, a binary column) in the
shared folder, so a lost task leaves nothing behind and any store works. Reading decodes the
images where they lie; only the sums of the parts are needed to number the ids globally. An image
is a complete file of the format: `export` writes each as a file of its own in the shared folder.

Image: the header, the document index (doc_ids, id counts, null flags), the block index
(minimum, width, exception count and byte offset of each block), then the blocks. A block of
BLOCK ids stores value minus block minimum at the smallest width that holds PERCENTILE of the
block; larger values are patched from its exception list (positions, then values).

Defined results: null text counts as empty and holds the end id alone. Rows with null doc_id
come first; rows with equal doc_id keep the order in which they are read. An empty table gives no shard
and no row. Extra columns are not read.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import written
from ridgeline.llm.token_ids import encoder

MAGIC = b"PFOR0001"
BLOCK = 512
PERCENTILE = 0.9
SHARD_IDS = 1 << 19
#: magic, documents, ids, blocks
HEADER = struct.Struct("<8sQQQ")
BLOCK_INDEX = np.dtype([("least", "<u4"), ("width", "u1"), ("patches", "<u2"), ("at", "<u4")])


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The block index and the blocks of `ids`; the last block is filled up with its last id."""
    count = -(-len(ids) // BLOCK)
    grid = np.empty(count * BLOCK, dtype=np.uint32)
    grid[: len(ids)] = ids
    grid[len(ids) :] = ids[-1] if len(ids) else 0
    grid = grid.reshape(count, BLOCK)
    least = grid.min(axis=1) if count else np.zeros(0, dtype=np.uint32)
    delta = grid - least[:, None]
    at = min(BLOCK - 1, int(PERCENTILE * BLOCK))
    width = np.frexp(np.partition(delta, at, axis=1)[:, at].astype(np.float64))[1] if count else np.zeros(0, dtype=np.int32)
    patched = delta >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    index = np.zeros(count, dtype=BLOCK_INDEX)
    index["least"], index["width"], index["patches"] = least, width, patched.sum(axis=1)
    sizes = width.astype(np.int64) * (BLOCK // 8) + index["patches"].astype(np.int64) * 6
    index["at"] = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), dtype=np.uint8)
    for w in np.unique(width[width > 0]):
        rows = np.nonzero(width == w)[0]
        bits = np.unpackbits(delta[rows].astype("<u4").view(np.uint8).reshape(len(rows), BLOCK, 4), axis=2, bitorder="little")[:, :, :w]
        packed = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
        out[index["at"][rows].astype(np.int64)[:, None] + np.arange(packed.shape[1])] = packed
    for b in np.nonzero(index["patches"])[0]:
        where = np.nonzero(patched[b])[0]
        tail = where.astype("<u2").tobytes() + delta[b, where].astype("<u4").tobytes()
        at = int(index["at"][b]) + int(width[b]) * (BLOCK // 8)
        out[at : at + len(tail)] = np.frombuffer(tail, dtype=np.uint8)
    return index, out.tobytes()


def decode_blocks(index: np.ndarray, blocks: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(blocks, dtype=np.uint8)
    delta = np.zeros((len(index), BLOCK), dtype=np.uint32)
    for w in np.unique(index["width"]):
        if w == 0:
            continue
        rows = np.nonzero(index["width"] == w)[0]
        packed = raw[index["at"][rows].astype(np.int64)[:, None] + np.arange(int(w) * (BLOCK // 8))]
        bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), BLOCK, int(w))
        full = np.zeros((len(rows), BLOCK, 32), dtype=np.uint8)
        full[:, :, :w] = bits
        delta[rows] = np.packbits(full, axis=2, bitorder="little").view("<u4")[:, :, 0]
    for b in np.nonzero(index["patches"])[0]:
        k, at = int(index["patches"][b]), int(index["at"][b]) + int(index["width"][b]) * (BLOCK // 8)
        where = np.frombuffer(blocks, dtype="<u2", count=k, offset=at)
        delta[b, where] = np.frombuffer(blocks, dtype="<u4", count=k, offset=at + 2 * k)
    return (delta + index["least"][:, None]).reshape(-1)[:n]


def write_image(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    index, blocks = encode_blocks(ids)
    return b"".join([
        HEADER.pack(MAGIC, len(doc_ids), len(ids), len(index)),
        np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes(), np.array(counts, dtype="<u8").tobytes(),
        np.array([d is None for d in doc_ids], dtype="u1").tobytes(), index.tobytes(), blocks])


def read_image(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, id counts and all ids of a shard image."""
    magic, docs, n, count = HEADER.unpack_from(image)
    if magic != MAGIC:
        raise ValueError("not a shard image")
    at = HEADER.size
    doc_ids = np.frombuffer(image, dtype="<i8", count=docs, offset=at)
    counts = np.frombuffer(image, dtype="<u8", count=docs, offset=at + 8 * docs).astype(np.int64)
    nulls = np.frombuffer(image, dtype="u1", count=docs, offset=at + 16 * docs)
    index = np.frombuffer(image, dtype=BLOCK_INDEX, count=count, offset=at + 17 * docs)
    ids = decode_blocks(index, image[at + 17 * docs + index.nbytes :], n)
    return [None if x else d for d, x in zip(doc_ids.tolist(), nulls.tolist(), strict=True)], counts, ids


def shard_images(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, shard, n, image) of all documents in ascending doc_id order by part and shard."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row_id"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "row_id").drop("row_id")

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end, part = encoder(path).encode, np.array([end_id], dtype="<u2").tobytes(), TaskContext.get().partitionId()
        doc_ids, packed, held, shard = [], [], 0, 0

        def image() -> pd.DataFrame:
            ids = np.frombuffer(b"".join(packed), dtype="<u2").astype(np.uint32)
            return pd.DataFrame({"part": [part], "shard": [shard], "n": [len(ids)],
                                 "image": [write_image(doc_ids, [len(x) // 2 for x in packed], ids)]})

        for batch in batches:
            for d, t in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                doc_ids.append(None if d is None or d != d else int(d))
                packed.append(encode(t) + end)
                held += len(packed[-1]) // 2
                if held >= SHARD_IDS:
                    yield image()
                    doc_ids, packed, held, shard = [], [], 0, shard + 1
        if packed:
            yield image()

    return rows.mapInPandas(of, "part int, shard int, n long, image binary")


def read_documents(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row for each document of `shards`, decoded: doc_id, start, n_tokens, ids_crc32."""
    sums = shards.select("part", "shard", "n")
    w = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.groupBy("part").agg(F.sum("n").alias("part_n"))  # a row for each task that wrote
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_n").over(over), F.lit(0)).alias("before"))
    bases = sums.withColumn("within", F.coalesce(F.sum("n").over(w), F.lit(0))).join(parts, "part").select(
        "part", "shard", (F.col("before") + F.col("within")).alias("base"))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, shard, image in zip(batch["part"], batch["shard"], batch["image"], strict=True):
                doc_ids, counts, ids = read_image(image)
                ends = np.cumsum(counts)
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                out = {"part": part, "shard": shard, "doc_id": pd.array(doc_ids, dtype="Int64"), "at": ends - counts, "n_tokens": counts, "ids_crc32": crc}
                if with_ids:
                    out["ids"] = [wide[e - n : e].tobytes() for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pd.DataFrame(out)

    kind = "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    decoded = shards.select("part", "shard", "image").mapInPandas(of, kind)
    rest = ["n_tokens", "ids_crc32"] + ["ids"] * with_ids
    return decoded.join(bases, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), *rest)


def token_shards(docs: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shard images and returns them reread from the shared folder."""
    return written(shard_images(docs, path, end_id, id_col, text_col), "token-shards")


def export(shards: DataFrame, folder: str) -> DataFrame:
    """Each image as the file <folder>/part-shard.pfor on a path that all executors mount: (part, shard,
    n, file). A task that runs again writes the same bytes, and a rename puts a file in place whole."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names = [f"{folder}/{p:06}-{s:06}.pfor" for p, s in zip(batch["part"], batch["shard"], strict=True)]
            for name, image in zip(names, batch["image"], strict=True):
                own = f"{name}.{uuid.uuid4().hex}"
                with open(own, "wb") as f:
                    f.write(image)
                os.replace(own, name)
            yield pd.DataFrame({"part": batch["part"], "shard": batch["shard"], "n": batch["n"], "file": names})

    return shards.mapInPandas(of, "part int, shard int, n long, file string")
