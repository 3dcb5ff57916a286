"""Ranked lexical search by branch and bound over FP-trees of documents.

Words are numbered by the benchmark items: only those can score. One pass over the documents counts their
terms and reduces each to its restricted vector, the numbers and occurrences (tf) of the items' terms in it;
a narrow table. Sums over it give the corpus figures (documents with a term, all terms, documents with each
term), and with them each term's weight and rank by frequency.

A shard is some SHARD_DOCS documents of one task. Its vectors, each in order of frequency, stand in a
prefix tree (FP-tree): documents with the same leading terms share a path. Branches of at most LEAF documents
are leaves. Every branch keeps, for the terms below it, the largest tf, and the smallest m (the length
factor) of its documents. As the score of a term rises with tf and falls with m, these two bound the score of
every document below, for every item. The tree is searched depth first, the most promising branch first, by
all items at once: an item leaves a branch whose bound is below its 50th best score so far, and a leaf
that an item reaches is scored exactly for it. Equal bounds are kept, as ties go to the smaller doc_id.

A first search over about 1 / FIRST of the documents sets the scores from which on the search over all
documents starts, so that tasks give out few rows beside the best: about FIRST * top for each item, whatever
the number of tasks. Ranks are taken in Spark.

Items are read in blocks of at most BLOCK_ITEMS items and some BLOCK_BYTES bytes, one job after the other, so
what the driver and the tasks hold is bounded. Documents are never sent.

Defined results: null text has no terms; documents without terms count nowhere. Every item row is an item, so
equal items and equal item_ids are ranked each. Equal rows are documents of their own; a null doc_id
comes after all others. An item without terms, or none of whose terms occurs, has no row. Empty tables: no
row. Ids are integers. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import written
from ridgeline.llm.decontaminate import words

TOP = 50
LEAF = 32
SHARD_DOCS = 4096
TASK_DOCS = 4 * SHARD_DOCS
FIRST = 16
BLOCK_ITEMS = 256
BLOCK_BYTES = 1 << 18
LAST_ID = (1 << 63) - 1


def tf_score(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Items:
    """The terms of a block of items, numbered."""

    def __init__(self, texts: list[str | None]) -> None:
        self.numbers: dict[bytes, int] = {}
        self.terms = [sorted({self.numbers.setdefault(w, len(self.numbers)) for w in words(t)}) for t in texts]


def restricted(docs: DataFrame, items: Items, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of documents with a term: all their terms counted, and their restricted vectors."""
    sent = docs.sparkSession.sparkContext.broadcast(items.numbers)

    @F.pandas_udf("n long, terms array<int>, tfs array<int>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        get = sent.value.get
        for texts in batches:
            out = []
            for t in texts:
                ws = words(t)
                at = np.fromiter(map(get, ws, repeat(-1)), dtype=np.int32, count=len(ws))
                terms, tfs = np.unique(at[at >= 0], return_counts=True)
                out.append((len(ws), terms, tfs.astype(np.int32)))
            yield pd.DataFrame(out, columns=["n", "terms", "tfs"])

    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), of(F.col(text_col)).alias("f"))
    return written(found.select("doc_id", "f.*").where("n > 0"), "search-vectors")


class Branch:
    """A subtree: documents lo..hi of the shard's order, its children, and what bounds its scores."""

    __slots__ = ("children", "hi", "lo", "m", "terms", "tops")

    def __init__(self, lo: int, hi: int) -> None:
        self.lo, self.hi, self.children = lo, hi, []


class Tree:
    """The FP-tree of a shard: `vectors` are (terms, tfs) with terms as ranks, the most frequent first."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], m: np.ndarray) -> None:
        order = sorted(range(len(vectors)), key=[v[0].astype(">u4").tobytes() for v in vectors].__getitem__)
        self.order = np.array(order, dtype=np.int64)
        self.m = m[self.order]
        size = np.array([len(vectors[i][0]) for i in order], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(size)])
        self.terms = np.concatenate([vectors[i][0] for i in order]).astype(np.int64)
        self.tfs = np.concatenate([vectors[i][1] for i in order]).astype(np.int64)
        self.score = tf_score(self.tfs, np.repeat(self.m, size))
        self.shared = np.zeros(len(order), dtype=np.int64)  # leading terms shared with the document before
        for i in range(1, len(order)):
            a, b = self.terms[self.start[i - 1] : self.start[i]], self.terms[self.start[i] : self.start[i + 1]]
            k = min(len(a), len(b))
            differ = np.nonzero(a[:k] != b[:k])[0]
            self.shared[i] = differ[0] if len(differ) else k
        self.root = self._grown(Branch(0, len(order)))

    def _grown(self, root: Branch) -> Branch:
        made, open_ = [], [root]
        while open_:
            b = open_.pop()
            made.append(b)
            if b.hi - b.lo > LEAF:
                inner = self.shared[b.lo + 1 : b.hi]
                cuts = [b.lo, *(np.nonzero(inner == inner.min())[0] + b.lo + 1).tolist(), b.hi]
                if len(cuts) - 1 == b.hi - b.lo:  # all differ here, or all are alike: plain runs of LEAF
                    cuts = [*range(b.lo, b.hi, LEAF), b.hi]
                ends = [cuts[0]]
                for a, z in zip(cuts, cuts[1:], strict=False):  # small neighbours share a leaf
                    if z - ends[-1] > LEAF and ends[-1] != a:
                        ends.append(a)
                b.children = [Branch(x, y) for x, y in zip(ends, [*ends[1:], b.hi], strict=True)]
                open_ += b.children
        for b in reversed(made):  # children before parents
            if b.children:
                terms, tops = np.concatenate([c.terms for c in b.children]), np.concatenate([c.tops for c in b.children])
                b.m = min(c.m for c in b.children)
            else:
                at = slice(self.start[b.lo], self.start[b.hi])
                terms, tops, b.m = self.terms[at], self.tfs[at], int(self.m[b.lo : b.hi].min())
            order = np.argsort(terms, kind="stable")
            terms, tops = terms[order], tops[order]
            first = np.nonzero(np.append(True, terms[1:] != terms[:-1]))[0] if len(terms) else np.zeros(0, np.int64)
            b.terms, b.tops = terms[first], (np.maximum.reduceat(tops, first) if len(first) else tops)
        return root


class Best:
    """The best `top` documents of each item so far, and the score below which none can enter."""

    def __init__(self, floor: np.ndarray, top: int) -> None:
        self.top, self.floor = top, np.maximum(floor, 1).astype(np.float64)
        self.scores, self.ids = [np.zeros(0, np.int64) for _ in floor], [np.zeros(0, np.int64) for _ in floor]

    def put(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.append(self.scores[item], scores), np.append(self.ids[item], ids)
        if len(scores) > self.top:
            order = np.lexsort((ids, -scores))[: self.top]
            scores, ids = scores[order], ids[order]
        self.scores[item], self.ids[item] = scores, ids
        if len(scores) == self.top:
            self.floor[item] = max(self.floor[item], scores.min())


def search_tree(tree: Tree, ids: np.ndarray, weights: np.ndarray, best: Best) -> None:
    """Branch and bound by all items: `weights` (terms by items) are exact in doubles, as are their sums."""
    ids = ids[tree.order]
    stack = [(tree.root, np.arange(weights.shape[1]), np.full(weights.shape[1], np.inf))]
    while stack:
        b, items, bound = stack.pop()
        items = items[bound >= best.floor[items]]
        if not len(items):
            continue
        if not b.children:
            at = slice(tree.start[b.lo], tree.start[b.hi])
            grid = np.zeros((b.hi - b.lo, len(b.terms)))
            grid[np.repeat(np.arange(b.hi - b.lo), np.diff(tree.start[b.lo : b.hi + 1])), np.searchsorted(b.terms, tree.terms[at])] = tree.score[at]
            scores = grid @ weights[np.ix_(b.terms, items)]
            hit = scores >= best.floor[items]
            for k in np.nonzero(hit.any(axis=0))[0]:
                rows = np.nonzero(hit[:, k])[0]
                best.put(items[k], scores[rows, k].astype(np.int64), ids[b.lo + rows])
            continue
        found = []
        for c in b.children:
            above = tf_score(c.tops, np.int64(c.m)).astype(np.float64) @ weights[np.ix_(c.terms, items)]
            live = above >= best.floor[items]
            if live.any():
                found.append((float((above[live] / best.floor[items[live]]).max()), len(found), (c, items[live], above[live])))
        stack += [x for _, _, x in sorted(found)]  # the most promising last, so first


def best_of(vectors: DataFrame, floor: np.ndarray, top: int, weights: list[tuple[list[int], list[int]]], rank: np.ndarray, docs: int, terms: int) -> DataFrame:
    """(item, doc_id, score): the best of each task of `vectors`. `weights`: terms as ranks and weights of each item."""
    sent = vectors.sparkSession.sparkContext.broadcast((floor, weights, rank))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floor, weights, rank = sent.value
        dense = np.zeros((len(rank), len(weights)))
        for k, (at, w) in enumerate(weights):
            dense[at, k] = w
        best = Best(floor, top)

        def shard(held: list[pd.DataFrame]) -> None:
            b = pd.concat(held)
            # Python's integers, as 50 * n * docs can pass 64 bits
            m = np.array([50 + 50 * n * docs // terms for n in b["n"].tolist()], dtype=np.int64)
            vectors = []
            for ts, fs in zip(b["terms"], b["tfs"], strict=True):
                ts = rank[np.asarray(ts, dtype=np.int64)]
                order = np.argsort(ts)
                vectors.append((ts[order], np.asarray(fs, dtype=np.int64)[order]))
            search_tree(Tree(vectors, m), b["doc_id"].astype("Int64").fillna(LAST_ID).to_numpy(np.int64), dense, best)

        held, n = [], 0
        for b in batches:
            for at in range(0, len(b), SHARD_DOCS):
                part = b.iloc[at : at + SHARD_DOCS]
                if n + len(part) > SHARD_DOCS:
                    shard(held)
                    held, n = [], 0
                held.append(part)
                n += len(part)
        if n:
            shard(held)
        for item, (scores, ids) in enumerate(zip(best.scores, best.ids, strict=True)):
            if len(ids):
                yield pd.DataFrame({"item": item, "doc_id": ids, "score": scores})

    return vectors.mapInPandas(of, "item int, doc_id long, score long")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def _block(docs: DataFrame, items: list[tuple[object, str | None]], id_col: str, text_col: str, top: int) -> DataFrame | None:
    """(item, doc_id, score, rank) of a block; items are numbers in the block."""
    block = Items([t for _, t in items])
    if not block.numbers:
        return None
    vectors = restricted(docs, block, id_col, text_col)
    n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return None
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).alias("w")
    counts = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", "df", weight).collect()  # terms of the block
    frequency, w = np.zeros(len(block.numbers), np.int64), np.zeros(len(block.numbers), np.int64)
    for r in counts:
        frequency[r["term"]], w[r["term"]] = r["df"], r["w"]
    rank = np.empty(len(frequency), dtype=np.int64)
    rank[np.lexsort((np.arange(len(rank)), -frequency))] = np.arange(len(rank))
    weights = [(rank[t], w[t]) for t in block.terms]
    tasks = math.ceil(n_docs / TASK_DOCS)
    parts = vectors.repartition(tasks)  # as many documents in each task, whatever the files
    floor = np.zeros(len(items), dtype=np.int64)
    search = lambda rows, floor: best_of(rows, floor, top, weights, rank, n_docs, n_terms)
    if tasks > 1:
        some = vectors.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(FIRST)) == 0).repartition(math.ceil(tasks / FIRST))
        for r in _ranked(search(some, floor), top).where(F.col("rank") == top).collect():  # a row for each item
            floor[r["item"]] = r["score"]
    return _ranked(search(parts, floor), top)


def blocks(benchmark: DataFrame, item_col: str, text_col: str) -> list[DataFrame]:
    rows = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"))
    count, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, math.ceil(count / BLOCK_ITEMS), math.ceil(size / BLOCK_BYTES))
    return [rows] if parts == 1 else [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) for k in range(parts)]


def search(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` best documents of each item."""
    spark, found = docs.sparkSession, []
    item_type = benchmark.schema[item_col].dataType.simpleString()
    schema = f"item_id {item_type}, rank int, doc_id long, score long"
    several = blocks(benchmark, item_col, item_text_col)
    for block in several:
        items = [tuple(r) for r in block.collect()]
        ranked = _block(docs, items, id_col, text_col, top) if items else None
        if ranked is not None:
            names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(items)], f"item int, item_id {item_type}")
            doc_id = F.when(F.col("doc_id") != LAST_ID, F.col("doc_id")).alias("doc_id")
            rows = ranked.join(F.broadcast(names), "item").select("item_id", "rank", doc_id, "score")
            found.append(rows if len(several) == 1 else written(rows, "search-found"))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)
