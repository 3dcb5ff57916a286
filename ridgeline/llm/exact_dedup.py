"""Exact dedup by two Bloom passes, with DataFrame functions only.

The filter is a blocked Bloom filter: a text digest picks one bucket of 32,768 bits and two cells in
it. Pass 1 counts how many rows fall on each cell (summed before the shuffle; what moves is cell
numbers, never texts) and keeps the cells hit at least twice as one 4 KB bitmap for each bucket. Pass 2
probes the bitmaps where the rows lie. A row with a cell of its own cannot be repeated and passes
straight through; only the rest shuffle by digest and are grouped.

The filter has BITS_PER_ROW bits a row. It is broadcast in slices of SLICE_BUCKETS buckets (64 MB), one
job after the other, so that what a task holds is bounded. One slice serves 33 million rows; with
more, the rows are first written by slice, so that each job reads its own rows only and nothing but
possibly repeated rows is ever shuffled.

Groups larger than a 10,000th of all rows number less than 10,000: their results are broadcast to
their rows. All other groups are too small to be a hot key in the join.

Defined results: null text counts as empty, empty texts equal each other; of equal texts the
row with the largest doc_id stays (null smallest; among rows that tie on doc_id, one: the one
with the largest row hash, or the last row). An empty table gives an empty table. Extra columns
travel inside a struct, so their names cannot clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import ascii_lower, hashable, scratch, written

BITS_PER_ROW = 16
BUCKET_BITS = 1 << 15
SLICE_BUCKETS = 1 << 14
#: Groups above this part of all rows are few and are broadcast.
HOT_GROUPS = 10_000


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256))


def bucket_count(rows: int) -> int:
    return max(1, -(-rows * BITS_PER_ROW // BUCKET_BITS))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest", F.lit(0)), F.lit(buckets))


def _cells() -> list[Column]:
    own = F.xxhash64("digest", F.lit(1))
    return [F.pmod(own, F.lit(BUCKET_BITS)), F.pmod(F.shiftrightunsigned(own, 32), F.lit(BUCKET_BITS))]


def repeat_filter(digests: DataFrame, buckets: int) -> DataFrame:
    """Bitmaps (bucket, bitmap) of the cells that two or more rows of `digests(digest)` hit. A row whose
    two cells are one counts once there."""
    cells = digests.select(_bucket(buckets).alias("bucket"), F.explode(F.array_distinct(F.array(*_cells()))).alias("cell"))
    return cells.groupBy("bucket", "cell").count().where("count > 1").groupBy("bucket").agg(F.bitmap_construct_agg("cell").alias("bitmap"))


def _bit(bitmap: Column, cell: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (cell / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    mask = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (cell % 8).cast("int") + 1)
    return F.coalesce(byte.bitwiseAND(mask) > 0, F.lit(False))


def probe(rows: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """`rows(digest, ...)` with `maybe`: both cells are in the filter slice `filters`, which is broadcast."""
    side = F.broadcast(filters.select(F.col("bucket").alias("filter_bucket"), "bitmap"))
    one, two = _cells()
    found = rows.join(side, _bucket(buckets) == F.col("filter_bucket"), "left")
    return found.withColumn("maybe", _bit(F.col("bitmap"), one) & _bit(F.col("bitmap"), two)).drop("filter_bucket", "bitmap")


def maybe_repeated(rows: DataFrame, digests: DataFrame, count: int) -> list[DataFrame]:
    """`rows(digest, ...)` with `maybe`, one frame for each slice of the filter over `digests`."""
    buckets = bucket_count(count)
    filters = repeat_filter(digests, buckets)
    if buckets <= SLICE_BUCKETS:
        return [probe(rows, filters, buckets)]
    filters = written(filters, "filter")
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "by-slice")
    rows.withColumn("slice", F.floor(_bucket(buckets) / SLICE_BUCKETS)).write.partitionBy("slice").parquet(path)
    placed = spark.read.parquet(path)
    found = []
    for k in range(-(-buckets // SLICE_BUCKETS)):
        part = filters.where(F.col("bucket").between(k * SLICE_BUCKETS, (k + 1) * SLICE_BUCKETS - 1))
        found.append(written(probe(placed.where(F.col("slice") == k).drop("slice"), part, buckets), "probed"))
    return found


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = written(
        docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row_id"),
                    text_digest(F.col(text_col)).alias("digest")), "digests")
    count = rows.count()
    probed = _union(maybe_repeated(rows, rows, count))
    single = probed.where("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    again = probed.where("maybe").drop("maybe")
    groups = written(again.groupBy("digest").agg(
        F.max(F.struct("doc_id", "row_id")).alias("last"), F.count(F.lit(1)).alias("group_size")), "groups")
    is_hot = F.col("group_size") * HOT_GROUPS > count  # fewer than HOT_GROUPS
    hot = groups.where(is_hot)
    columns = ["doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("last.row_id")).alias("kept"), "digest"]
    in_hot = again.join(F.broadcast(hot), "digest", "left")
    of_hot = in_hot.where("last is not null").select(*columns)
    of_rest = in_hot.where("last is null").drop("last", "group_size").join(groups.where(~is_hot), "digest").select(*columns)
    return _union([single, of_hot, of_rest]).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with its columns. Single texts do not shuffle; repeated
    ones meet as one row for each text and task, already reduced to the row that stays."""
    tie = F.struct(F.col(id_col), F.xxhash64(*[F.col(c) for c in hashable(docs)]))
    rows = docs.select(F.struct("*").alias("row"), text_digest(F.col(text_col)).alias("digest"), tie.alias("rank"))
    digests = written(rows.select("digest"), "digests")
    probed = maybe_repeated(rows, digests, digests.count())
    kept = _union([p.where("maybe") for p in probed]).groupBy("digest").agg(F.max_by("row", "rank").alias("row"))
    return _union([p.where("not maybe") for p in probed]).select("row.*").unionByName(kept.select("row.*"))
