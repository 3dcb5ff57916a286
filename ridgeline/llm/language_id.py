"""Language identification by averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its hashed byte n-grams (letters lower-cased, all
other ASCII a blank); a linear softmax reads the language from it. Embeddings and softmax are
trained together by stochastic gradient descent in numpy, on a bounded hash sample of labelled rows: of each language
an equal part of `train_rows`, but at most half of its rows and at least one, so rare languages are learnt however large the table.
Texts of any length teach: tasks reduce them to shares of buckets, and only these reach the driver. Copies of a text teach once. A part
of the sample that the descent does not see sets the temperature, so that scores are calibrated.

A text is rejected for either of two figures: the score, and how typical its n-grams are (the mean
logarithm of their shares in the sample), which is low for gibberish and for languages never seen,
where a softmax may still be sure. All labelled rows outside the sample, scored whole in Spark,
set both levels: at most `reject_rate` of known texts fall below one or the other. The levels are
conformal: below 2 / `reject_rate` such rows they promise nothing, so none is rejected for its figures and
the model is not `levelled`.

For scoring the two layers and the shares are one table of buckets, broadcast (0.5 MB).

Defined results: `und` with score 0 if the text is null or has no letter, or if nothing was
labelled. Ties go to the first language by name. Equal rows are scored alike, each on its own.
An empty table gives an empty table. Extra columns travel inside a struct.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
DIM = 16
ORDERS = (2, 3, 4)
SLICE = 1 << 20
#: Steps of the figures that set the rejection levels.
STEPS = 1 << 12
UNKNOWN = "und"
#: Least number of steps of the descent.
LEAST_STEPS = 2500
_LETTER = re.compile(r"[^\W\d_]")
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def subwords(text: str) -> Iterator[np.ndarray]:
    """Buckets of all byte n-grams of a text, by slices."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass").translate(_BYTES), dtype=np.uint8)
    for at in range(0, max(len(raw) - 1, 1), SLICE):
        part = raw[at : at + SLICE + max(ORDERS) - 1].astype(np.uint32)
        for n in ORDERS:
            stop = min(SLICE, len(part) - n + 1)
            if stop > 0:
                h = np.full(stop, n, dtype=np.uint32)
                for k in range(n):
                    h = h * np.uint32(0x01000193) + part[k : k + stop]
                yield (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS by languages, then the log share of each bucket
    bias: np.ndarray
    temperature: float = 1.0
    level: float = 0.0
    typical_level: float = -np.inf

    @property
    def levelled(self) -> bool:
        """Whether there were rows enough to set a rejection level."""
        return self.level > 0 or self.typical_level > -np.inf

    def figures(self, text: str | None) -> tuple[str, float, float]:
        """Language, calibrated score, and how typical the text is."""
        if not text or not self.langs or not _LETTER.search(text):
            return UNKNOWN, 0.0, -np.inf
        total, n = np.zeros(len(self.langs) + 1), 0
        for h in subwords(text):
            total += self.table[h].sum(axis=0, dtype=np.float64)
            n += len(h)
        total /= max(n, 1)
        z = (total[:-1] + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(np.argmax(p))
        return self.langs[best], float(p[best]), float(total[-1])

    def rejects(self, score: float, typical: float) -> bool:
        return score == 0 or score < self.level or typical < self.typical_level

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        lang, score, typical = self.figures(text)
        return lang, score, self.rejects(score, typical)


Example = tuple[np.ndarray, np.ndarray, str]  # buckets, their shares, language


def shares(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams and their shares; a slice at a time, so long texts need no room."""
    count = np.zeros(BUCKETS, dtype=np.int64)
    for part in subwords(text):
        count += np.bincount(part, minlength=BUCKETS)
    bucket = np.flatnonzero(count)
    return bucket, (count[bucket] / max(count.sum(), 1)).astype(np.float32)


def train(rows: list[tuple[str, str]], **settings: float) -> Model:
    """`rows`: (text, language)."""
    return train_examples([(*shares(t), lang) for t, lang in rows if t and _LETTER.search(t)], **settings)


def train_examples(rows: list[Example], epochs: int = 5, rate: float = 0.5, reject_rate: float = 1e-3, seed: int = 7) -> Model:
    langs = sorted({lang for *_, lang in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 1), dtype=np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    number = {lang: k for k, lang in enumerate(langs)}
    label = [number[lang] for *_, lang in rows]
    order = rng.permutation(len(rows))
    held = order[: len(order) // 5] if len(order) >= 50 else order
    seen = order[len(order) // 5 :] if len(order) >= 50 else order
    emb, soft, bias = rng.normal(0, 0.1, (BUCKETS, DIM)), np.zeros((DIM, len(langs))), np.zeros(len(langs))
    epochs = max(epochs, -(-LEAST_STEPS // len(seen)))
    scale, steps, total = 40.0, 0, epochs * len(seen)  # an average of many buckets moves slowly
    for _ in range(epochs):
        for i in rng.permutation(seen):
            bucket, value, y = rows[i][0], rows[i][1].astype(np.float64), label[i]  # of one text at a time
            hidden = value @ emb[bucket]
            z = hidden @ soft + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y] -= 1
            step = rate * (1 - steps / total)
            back = soft @ g
            soft -= step * np.outer(hidden, g)
            bias -= 0.05 * step * g
            emb[bucket] -= step * scale * value[:, None] * back[None, :]
            steps += 1
    common = np.full(BUCKETS, 0.01)
    for i in seen:
        np.add.at(common, rows[i][0], rows[i][1])
    model = Model(langs, np.column_stack([emb @ soft, np.log(common / common.sum())]).astype(np.float32), bias)
    means = np.array([rows[i][1].astype(np.float64) @ model.table[rows[i][0]] for i in held])
    z, y = means[:, :-1] + bias, np.array([label[i] for i in held])

    def probabilities(t: float) -> np.ndarray:
        e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    grid = [2.0**k for k in np.arange(-8, 4.25, 0.25)]
    model.temperature = min(grid, key=lambda t: -np.log(probabilities(t)[np.arange(len(y)), y] + 1e-12).mean())
    k = int(reject_rate / 2 * (len(held) + 1))
    if k:
        model.level = float(np.sort(probabilities(model.temperature).max(axis=1))[k - 1])
        model.typical_level = float(np.sort(means[:, -1])[k - 1])
    return model


def in_sample(counts: dict[str, int], train_rows: int) -> Column:
    """Whether a row (id, text, lang) is in the training sample, by a hash of id and text; `counts` are rows by language."""
    part = train_rows // max(len(counts), 1)
    bounds = [F.when(F.col("lang") == lang, F.lit(int(max(min(part, n // 2), 1) / n * (1 << 40)))) for lang, n in sorted(counts.items()) if n > 1]
    hashed = F.pmod(F.xxhash64("id", "text", F.lit(4)), F.lit(1 << 40))
    return hashed < F.coalesce(*bounds, F.lit(1 << 40))  # the only row of a language is in


def sampled(rows: DataFrame, inside: Column) -> list[Example]:
    """The sample of `rows(id, text, lang)` as bucket shares, at most 96 KB a row; equal texts of a language once.
    The driver holds six bytes a bucket in two buffers, which the examples are views of."""

    @F.pandas_udf("bucket binary, share binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [shares(t) if _LETTER.search(t) else (np.zeros(0, int), np.zeros(0, np.float32)) for t in texts]
            yield pd.DataFrame([(b.astype("<u2").tobytes(), v.astype("<f4").tobytes()) for b, v in found], columns=["bucket", "share"])

    taken = rows.where(inside).select("lang", F.xxhash64("text").alias("key"), of("text").alias("x"))
    one = taken.groupBy("lang", "key").agg(F.first("x").alias("x")).where("length(x.bucket) > 0").orderBy("lang", "key")
    bucket, share, ends, langs = bytearray(), bytearray(), [0], []
    for r in one.toLocalIterator():
        bucket += r["x"]["bucket"]
        share += r["x"]["share"]
        ends.append(len(share) // 4)
        langs.append(r["lang"])
    buckets, values = np.frombuffer(bucket, "<u2"), np.frombuffer(share, "<f4")
    return [(buckets[a:b], values[a:b], lang) for a, b, lang in zip(ends, ends[1:], langs, strict=False)]


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = 5000,
        reject_rate: float = 1e-3) -> Model:
    """About `train_rows` rows are learnt from, or one for each language if these are more; the number of languages is taken to be bounded."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    inside = in_sample(counts, train_rows)
    model = train_examples(sampled(rows, inside), reject_rate=reject_rate)
    if model.langs:
        levels = rejection_levels(model, rows.where(~inside), reject_rate)
        model.level, model.typical_level = levels.get("score", 0.0), levels.get("typical", -np.inf)
    return model


def rejection_levels(model: Model, rows: DataFrame, reject_rate: float) -> dict[str, float]:
    """For each figure the largest step with at most reject_rate / 2 * (n + 1) of the n texts below it."""
    counts = step_counts(model, rows).collect()  # at most STEPS + 16 * STEPS rows
    levels = {}
    for figure in ("score", "typical"):
        own = sorted((r["step"], r["count"]) for r in counts if r["figure"] == figure)
        left = int(reject_rate / 2 * (sum(n for _, n in own) + 1))
        if not left:
            continue
        for step, n in own:
            left -= n
            if left <= 0:
                levels[figure] = step / STEPS
                break
    return levels


def step_counts(model: Model, rows: DataFrame) -> DataFrame:
    """(figure, step, count) of the texts that have a letter."""
    found = rows.select(identify(model, F.col("text")).alias("f")).where("f.score > 0")  # 0: no letter
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("figure"), F.floor(F.col(f"f.{k}") * STEPS).alias("step")) for k in ("score", "typical")]))
    return found.select(each.alias("x")).groupBy("x.figure", "x.step").count()


def identify(model: Model, text: Column) -> Column:
    """The struct (lang, score, typical, rejected) of each text. It counts as nondeterministic: a filter on it is then not
    pushed below, where each text would be scored twice and each task would hold a second Python worker."""

    @F.pandas_udf("lang string, score double, typical double, rejected boolean")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [model.figures(t) for t in texts]
            yield pd.DataFrame([(*f, model.rejects(f[1], f[2])) for f in found], columns=["lang", "score", "typical", "rejected"])

    return of.asNondeterministic()(text)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose language is told with enough confidence."""
    rows = docs.select(F.struct("*").alias("row"), identify(model, F.col(text_col)).alias("found"))
    return rows.where("not found.rejected").select("row.*")
