"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, of their stems (the first STEM bytes
of longer words), of its pairs of neighbouring words and of its pairs one word apart. FTRL-proximal (McMahan et al. 2013) gives each coordinate a
rate of its own and, by L1, an exact zero to most of them; what is left is sent to the tasks
as (index, weight). Training reads a bounded hash sample of labelled rows, by class
(`train_rows` each, texts of at most `train_chars` characters); scoring reads whole texts. The rate of descent
is the one of RATES with the least log loss on a fifth of the training rows, learned on the others. As classes
are sampled each for itself, the intercept is moved by the difference of the log odds of all labels
and of the sample, so scores mean the same whatever the size of the table.

Defined results: null text counts as empty and scores the intercept. Without labelled rows
every score is 0.5 or the class's rate. Labels other than 0 and 1 are not learned from; several
labels of a document count each. Equal rows are scored alike. An empty table gives an empty
table. Extra columns travel inside a struct.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import hash_sample
from ridgeline.llm.decontaminate import words

BITS = 20
STEM = 5
RATES = (0.25, 0.5, 1.0, 2.0, 4.0)


def features(text: str | None) -> np.ndarray:
    """Feature numbers of a text, with repeats."""
    ws = words(text)
    h = np.fromiter(map(zlib.crc32, ws), dtype=np.uint64, count=len(ws))
    mix = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)
    pairs = [h[:-k] * np.uint64(0x100000001B3) + h[k:] * np.uint64(31) + np.uint64(k) for k in (1, 2) if len(h) > k]
    stems = np.fromiter((zlib.crc32(w[:STEM]) for w in ws if len(w) > STEM), dtype=np.uint64) * np.uint64(7)
    return np.concatenate([mix(h), mix(stems), *map(mix, pairs)])


@dataclass
class Model:
    index: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS, dtype=np.float64)
        w[self.index] = self.weight
        return w


def score(dense: np.ndarray, bias: float, text: str | None) -> float:
    f = features(text)
    f = np.unique(f[dense[f] != 0])
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, bias + dense[f].sum()))))


Example = tuple[np.ndarray, int]


def example(text: str | None, label: int) -> Example:
    return np.unique(features(text)).astype(np.int32), label


def train(examples: list[Example], epochs: int = 5, alpha: float = 1.0, beta: float = 1.0, l1: float = 3.0, l2: float = 0.1, seed: int = 8) -> Model:
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bz, bn = 0.0, 0.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            f, y = examples[i]
            zf, root = z[f], np.sqrt(n[f])
            w = np.where(np.abs(zf) <= l1, 0.0, -(zf - np.sign(zf) * l1) / ((beta + root) / alpha + l2))
            b = -bz / ((beta + math.sqrt(bn)) / alpha)
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum() + b))))
            g = p - y
            z[f] = zf + g - (np.sqrt(n[f] + g * g) - root) / alpha * w
            n[f] += g * g
            bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / alpha * b
            bn += g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    index = np.nonzero(w)[0]
    return Model(index, w[index], -bz / ((beta + math.sqrt(bn)) / alpha))


def loss(model: Model, examples: list[Example]) -> float:
    dense, total = model.dense(), 0.0
    for f, y in examples:
        p = 1 / (1 + math.exp(-max(-35.0, min(35.0, model.bias + dense[f].sum()))))
        total -= math.log(max(p if y else 1 - p, 1e-12))
    return total


def best_rate(examples: list[Example], seed: int = 8) -> float:
    """The rate that does best on a fifth of the training rows after learning from the rest."""
    order = np.random.default_rng(seed).permutation(len(examples))
    kept, seen = ([examples[i] for i in part] for part in (order[: len(order) // 5], order[len(order) // 5 :]))
    return min(RATES, key=lambda rate: loss(train(seen, alpha=rate), kept)) if kept else RATES[len(RATES) // 2]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        train_rows: int = 5000, train_chars: int = 20_000) -> Model:
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y in (0, 1)")
    every = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") <= train_chars)
    examples = []
    for y in (0, 1):
        chosen = hash_sample(marked.where(F.col("y") == y).distinct(), F.col("id"), train_rows, 8)
        # at most 2 * train_rows ids: a bounded broadcast, and as many rows
        rows = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text")).orderBy("id").collect()
        examples += [example(r["text"], y) for r in rows]
    model = train(examples, alpha=best_rate(examples))
    taken = [sum(y == label for _, label in examples) for y in (0, 1)]
    if all(taken):
        model.bias += math.log(every[1] / every[0]) - math.log(taken[1] / taken[0])
    return model


def toxicity(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dense = model.dense()
        for texts in batches:
            yield pd.Series([score(dense, model.bias, t) for t in texts], dtype="float64")

    return of(text)
