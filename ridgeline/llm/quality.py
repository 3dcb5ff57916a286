"""Quality by co-training a text-content and a page-metadata classifier.

Each view is a logistic regression over hashed features (AdaGrad): the text view over words
and surface marks (repetition, capitals, symbols), the metadata view over source, language,
length and their pairs. They learn from a bounded labelled sample. In each round both score the
whole unlabelled table in Spark, and each gives the rows that it is surest of, a `share` of the distinct
rows in the classes' proportion, to the other's training rows. These stay a table of features that grows with the
corpus: they are dealt by hash into shards of about SHARD_ROWS, each shard trains the labelled sample and its own rows in a
task, and the shards' weights are averaged (one shard is plain training). A part of the labelled rows that neither view
learns from calibrates both (Platt) and the weights that combine them; the combined model then scores all documents.

Who is surest is found without a sort: counts by steps of 1/STEPS of the logit, and within the step that the quota ends in by
buckets of the content hash. At most the quota is taken, and less only where a bucket holds several rows.

Defined results: null or empty text has no text features and is scored by intercept and
metadata; a null column is a value of its own. Without labels of both classes every score is
the class rate, 0.5 without any. Of labels that share an id the smallest counts, of documents that share an id the one with the
smallest content hash teaches. Equal rows are scored alike and give one pseudo-label, so a large group of copies does not fill
the quota. Texts of any length teach, as their features. An empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import hash_sample, written
from ridgeline.llm.decontaminate import words

BITS = 16
#: Log odds beyond which a view is sure of a row.
SURE = 2
#: Steps of a unit of the logit, and where it is clipped.
STEPS, CLIP = 1 << 10, 35
#: Pseudo-labels that a task trains with.
SHARD_ROWS = 3000
#: Keys that are broadcast at most, 8 bytes each.
SENT_KEYS = 1_000_000
Row = tuple[str | None, str | None, str | None, int | None]  # text, source, lang, n_chars


View = tuple[np.ndarray, np.ndarray]  # feature numbers and values


def _view(names: list[bytes], each: float) -> View:
    f = np.unique(np.array([zlib.crc32(x) for x in names], dtype=np.int64) & ((1 << BITS) - 1))
    return f, np.full(len(f), each)


def text_view(row: Row) -> View:
    text = row[0] or ""
    ws = words(text)
    n, size = max(len(ws), 1), max(len(text), 1)
    own = set(ws)
    surface = {
        "new": len(own) / n, "again": sum(a == b for a, b in zip(ws, ws[1:], strict=False)) / n,
        "capitals": sum(map(str.isupper, text)) / size, "marks": sum(map(text.count, "!#$%&*@^~|<>{}[]=_")) / size * 4,
        "commas": (text.count(",") + text.count(".")) / n, "lines": text.count("\n") / n * 4,
    }
    marks = _view([f"{k}:{min(int(v * 20), 20)}".encode() for k, v in surface.items()] + [f"size:{int(math.log2(n))}".encode()], 1.0)
    content = _view(sorted(own), 1 / math.sqrt(len(own) + 1))
    return np.concatenate([marks[0], content[0]]), np.concatenate([marks[1], content[1]])


def meta_view(row: Row) -> View:
    _, source, lang, n = row
    size = "none" if n is None or n != n else str(int(math.log2(max(int(n), 1)) * 2))
    return _view([p.encode() for p in (f"s:{source}", f"l:{lang}", f"n:{size}", f"sl:{source}:{lang}", f"ln:{lang}:{size}")], 0.5)


VIEWS = (text_view, meta_view)
Example = tuple[View, View]


def example(row: Row) -> Example:
    return text_view(row), meta_view(row)


@dataclass
class Logistic:
    weight: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS) + 1))

    def logit(self, x: View) -> float:
        return float(self.weight[x[0]] @ x[1] + self.weight[-1])

    def fit(self, xs: list[View], ys: list[int], epochs: int = 4, rate: float = 0.3, seed: int = 6) -> Logistic:
        square, rng = np.full(len(self.weight), 1e-6), np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(xs)):
                f, value = np.append(xs[i][0], len(self.weight) - 1), np.append(xs[i][1], 1.0)
                g = (_sigmoid(self.logit(xs[i])) - ys[i]) * value
                square[f] += g * g
                self.weight[f] -= rate * (g / np.sqrt(square[f]) + 1e-4 * self.weight[f])
        return self


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def _platt(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weights of the columns of x and an intercept, by damped Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w -= np.linalg.solve(hess, x.T @ (p - y) + 1e-2 * w)
    return w


@dataclass
class Model:
    views: list[Logistic]
    platt: list[np.ndarray]
    mix: np.ndarray
    rate: float = 0.5

    def scores(self, row: Row) -> tuple[float, float, float]:
        """Combined, text and metadata score."""
        if not self.views:
            return self.rate, self.rate, self.rate
        z = [p[0] * v.logit(view(row)) + p[1] for v, p, view in zip(self.views, self.platt, VIEWS, strict=True)]
        return _sigmoid(float(np.dot(self.mix[:2], z) + self.mix[2])), _sigmoid(z[0]), _sigmoid(z[1])


class ListPool:
    """Unlabelled rows in a list, as one shard: what co-training does, plainly. A row is given once."""

    def __init__(self, rows: list[Row], share: float = 0.05) -> None:
        self.left, self.quota = {i: example(r) for i, r in enumerate(rows)}, round(share * len(rows))
        self.given: list[list[tuple[View, int]]] = [[], []]  # for each view what it learns from

    def choose(self, views: list[Logistic], rate: float) -> None:
        gone, high = set(), round(self.quota * rate)
        for k in range(2):
            z = sorted((views[k].logit(x[k]), i) for i, x in self.left.items())
            ends = [(i, 0) for x, i in z[: self.quota - high] if x < -SURE] + [(i, 1) for x, i in z[max(len(z) - high, 0) :] if x > SURE]
            self.given[1 - k] += [(self.left[i][1 - k], y) for i, y in ends]
            gone |= {i for i, _ in ends}
        for i in gone:
            del self.left[i]

    def trained(self, marked: list[tuple[Example, int]]) -> list[Logistic]:
        return [Logistic().fit([x[k] for x, _ in marked] + [f for f, _ in self.given[k]], [y for _, y in marked] + [y for _, y in self.given[k]]) for k in range(2)]


surest_of = ListPool


def _key(cols: list[str]) -> Column:
    return F.xxhash64(*cols)


def _packed(x: Example) -> tuple[bytes, bytes, bytes, bytes]:
    return tuple(part for f, value in x for part in (f.astype("<i4").tobytes(), value.astype("<f8").tobytes()))


def _unpacked(f: bytes, value: bytes) -> View:
    return np.frombuffer(f, dtype="<i4").astype(np.int64), np.frombuffer(value, dtype="<f8")


def packed_features(*cols: Column) -> Column:
    """The features of both views: (f0, v0, f1, v1)."""

    @F.pandas_udf("f0 binary, v0 binary, f1 binary, v1 binary")
    def of(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for some in batches:
            yield pd.DataFrame([_packed(example(row)) for row in zip(*some, strict=True)], columns=["f0", "v0", "f1", "v1"])

    return of(*cols)


def _step(z: float) -> int:
    return math.floor(max(-CLIP, min(CLIP, z)) * STEPS)


@dataclass
class Cut:
    """Rows of a view beyond `step` at one end (y: 0 below, 1 above), and of those on it the ones with a lower bucket."""

    view: int
    y: int
    step: int
    bucket: int = 0

    def column(self) -> Column:
        """`takes` over (key, s0, s1)."""
        step = F.col(f"s{self.view}")
        return (step > self.step if self.y else step < self.step) | ((step == self.step) & (F.shiftrightunsigned("key", 48) < self.bucket))

    def takes(self, step: int, bucket: int) -> bool:
        return (step > self.step if self.y else step < self.step) or (step == self.step and bucket < self.bucket)


def _reached(counts: list[tuple[int, int]], quota: int) -> tuple[int | None, int]:
    """The first place whose count does not fit, and what is left of the quota there."""
    for at, n in counts:
        if n > quota:
            return at, quota
        quota -= n
    return None, quota


class TablePool:
    """Unlabelled rows of a table, without those that have a `given` content hash (the labelled sample's). `share`: of its distinct
    rows, what a view gives in a round."""

    def __init__(self, docs: DataFrame, cols: list[str], given: list[int], share: float) -> None:
        keyed = docs.select(_key(cols).alias("key"), *cols)
        self.rows = keyed.where(F.expr(f"key not in ({', '.join(map(str, given))})")) if given else keyed
        self.cols, self.share, self.quota, self.chosen = cols, share, None, None

    def cuts(self, views: list[Logistic], rate: float) -> tuple[list[Cut], DataFrame]:
        """The cuts and the keys within them. One scan scores; from then on the rows are narrow, and counts of bounded size are collected."""
        z = _steps(views, *map(F.col, self.cols))
        one = written(self.rows.select("key", z.alias("z")).groupBy("key").agg(F.first("z.s0").alias("s0"), F.first("z.s1").alias("s1")), "quality-pool")
        if self.quota is None:
            self.quota = round(self.share * one.count())
        if self.chosen is not None:
            one = one.join(self.chosen.select("key").distinct(), "key", "left_anti")
        sides = F.explode(F.array(*[F.struct(F.lit(k).alias("view"), F.col(f"s{k}").alias("step")) for k in range(2)]))
        sides = one.select(F.shiftrightunsigned("key", 48).cast("int").alias("bucket"), sides.alias("x")).select("bucket", "x.*")
        sides = sides.where((F.col("step") < -SURE * STEPS) | (F.col("step") >= SURE * STEPS))
        counts = sides.groupBy("view", "step").count().collect()  # at most 2 * CLIP * STEPS rows a view
        high = round(self.quota * rate)
        cuts, over = [], {}
        for view in range(2):
            for y, quota in ((0, self.quota - high), (1, high)):
                end = sorted(((r["step"], r["count"]) for r in counts if r["view"] == view and (r["step"] > 0) == bool(y)), reverse=bool(y))
                step, left = _reached(end, quota)
                cuts.append(Cut(view, y, step if step is not None else (SURE * STEPS - 1 if y else -SURE * STEPS)))
                if step is not None:
                    over[view, step] = left
        on = F.expr(" or ".join(f"(view = {v} and step = {s})" for v, s in over)) if over else F.lit(False)
        ties = sides.where(on).groupBy("view", "step", "bucket").count().collect() if over else []  # 4 * 65,536 rows at most
        for cut in cuts:
            if (cut.view, cut.step) in over:
                own = sorted((r["bucket"], r["count"]) for r in ties if (r["view"], r["step"]) == (cut.view, cut.step))
                at, _ = _reached(own, over[cut.view, cut.step])
                cut.bucket = 1 << 16 if at is None else at
        return cuts, written(one.where(reduce(or_, [c.column() for c in cuts])).select("key"), "quality-keys")

    def choose(self, views: list[Logistic], rate: float) -> None:
        """One more scan gives the features of the rows within the cuts to the other view. Up to SENT_KEYS keys go to all
        tasks, so only their rows are scored again; beyond that all are, with the same outcome."""
        (cuts, keys), cols, rows = self.cuts(views, rate), self.cols, self.rows
        if keys.count() <= SENT_KEYS:
            rows = rows.join(F.broadcast(keys), "key", "left_semi")

        def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for some in batches:
                out = []
                for key, row in zip(some["key"], some[cols].itertuples(index=False, name=None), strict=True):
                    x = example(row)
                    for cut in cuts:
                        if cut.takes(_step(views[cut.view].logit(x[cut.view])), (key & (1 << 64) - 1) >> 48):
                            out.append((key, 1 - cut.view, cut.y, *_packed(x)[2 - 2 * cut.view :][:2]))
                yield pd.DataFrame(out, columns=["key", "view", "y", "f", "v"])

        found = rows.mapInPandas(of, "key long, view int, y int, f binary, v binary").dropDuplicates(["key", "view", "y"])
        if self.chosen is not None:
            found = found.join(self.chosen.select("key").distinct(), "key", "left_anti").unionByName(self.chosen)
        self.chosen = written(found, "quality-pseudo")

    def trained(self, marked: list[tuple[Example, int]]) -> list[Logistic]:
        """The mean of the shards' models of each view; the labelled rows alone where a view was given nothing."""
        plain = lambda k: Logistic().fit([x[k] for x, _ in marked], [y for _, y in marked])
        if self.chosen is None:
            return [plain(k) for k in range(2)]
        size = {r["view"]: r["count"] for r in self.chosen.groupBy("view").count().collect()}
        shards = {k: -(-size.get(k, 0) // SHARD_ROWS) for k in range(2)}
        of_view = F.when(F.col("view") == 0, max(shards[0], 1)).otherwise(max(shards[1], 1))

        def fit_shard(rows: pd.DataFrame) -> pd.DataFrame:
            k, rows = int(rows["view"].iloc[0]), rows.sort_values(["key", "y"])
            xs = [x[k] for x, _ in marked] + [_unpacked(f, v) for f, v in zip(rows["f"], rows["v"], strict=True)]
            weight = Logistic().fit(xs, [y for _, y in marked] + rows["y"].tolist()).weight
            at = np.flatnonzero(weight)
            return pd.DataFrame({"view": k, "at": np.append(at, -1), "weight": np.append(weight[at], 1.0)})  # -1 counts the shards

        models = self.chosen.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(6)), of_view)).groupBy("view", "shard").applyInPandas(fit_shard, "view int, at int, weight double")
        total = models.groupBy("view", "at").agg(F.sum("weight").alias("weight")).collect()  # a row for each weight of both views
        found = []
        for k in range(2):
            own = {r["at"]: r["weight"] for r in total if r["view"] == k}
            if not own:
                found.append(plain(k))
                continue
            n, model = own.pop(-1), Logistic()
            model.weight[list(own)] = np.array(list(own.values())) / n
            found.append(model)
        return found


def _steps(views: list[Logistic], *cols: Column) -> Column:
    @F.pandas_udf("s0 int, s1 int")
    def of(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for some in batches:
            yield pd.DataFrame([[_step(m.logit(view(row))) for m, view in zip(views, VIEWS, strict=True)] for row in zip(*some, strict=True)], columns=["s0", "s1"])

    return of(*cols)


def co_train(marked: list[tuple[Row, int]], pool: ListPool | TablePool, rounds: int = 2, seed: int = 6) -> Model:
    return co_train_examples([(example(row), y) for row, y in marked], pool, rounds, seed)


def co_train_examples(marked: list[tuple[Example, int]], pool: ListPool | TablePool, rounds: int = 2, seed: int = 6) -> Model:
    ys = [y for _, y in marked]
    if len(set(ys)) < 2:
        return Model([], [], np.zeros(3), float(np.mean(ys)) if ys else 0.5)
    order = np.random.default_rng(seed).permutation(len(marked))
    held, seen = order[: len(order) // 4], order[len(order) // 4 :]
    if len({ys[i] for i in held}) < 2 or len({ys[i] for i in seen}) < 2:
        held = seen = order
    taught = [marked[i] for i in seen]
    rate = float(np.mean([y for _, y in taught]))
    views = pool.trained(taught)
    for _ in range(rounds):
        pool.choose(views, rate)
        views = pool.trained(taught)
    y = np.array([ys[i] for i in held], dtype=float)
    z = np.array([[v.logit(marked[i][0][k]) for k, v in enumerate(views)] for i in held])
    platt = [_platt(z[:, [k]], y) for k in range(2)]
    calibrated = np.column_stack([platt[k][0] * z[:, k] + platt[k][1] for k in range(2)])
    return Model(views, platt, _platt(calibrated, y))


def fit(docs: DataFrame, labels: DataFrame, unlabelled: DataFrame, id_col: str = "doc_id", train_rows: int = 3000, share: float = 0.05) -> Model:
    """`labels(doc_id, quality)` of `docs`, about `train_rows` of them; pseudo-labels come from all of `unlabelled` but copies of the
    labelled sample, whose rows also calibrate. Only features of the sample reach the driver."""
    cols = ["text", "source", "lang", "n_chars"]
    marks = labels.where("quality in (0, 1)").where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("quality").alias("quality"))
    chosen = hash_sample(marks, F.col(id_col), train_rows, 6)
    one = docs.select(id_col, *cols).join(F.broadcast(chosen), id_col).groupBy(id_col).agg(
        F.min("quality").alias("quality"), F.min(_key(cols)).alias("key"), F.min_by(F.struct(*cols), _key(cols)).alias("row"))
    rows = one.select("key", "quality", packed_features(*[F.col(f"row.{c}") for c in cols]).alias("x")).orderBy("key").collect()  # one for each id sent
    pool = TablePool(unlabelled, cols, sorted({r["key"] for r in rows}), share)
    return co_train_examples([((_unpacked(r["x"]["f0"], r["x"]["v0"]), _unpacked(r["x"]["f1"], r["x"]["v1"])), r["quality"]) for r in rows], pool)


def quality(model: Model, text: Column, source: Column, lang: Column, n_chars: Column) -> Column:
    """The struct (score, text_score, meta_score)."""

    @F.pandas_udf("score double, text_score double, meta_score double")
    def of(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for cols in batches:
            yield pd.DataFrame([model.scores(r) for r in zip(*cols, strict=True)], columns=["score", "text_score", "meta_score"])

    return of(text, source, lang, n_chars)
