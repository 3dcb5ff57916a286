"""Trained operators against plain re-implementations and on held-out rows, with the queries' defaults."""

import math
import zlib

import numpy as np

from ridgeline.llm import entries, quality, toxicity
from ridgeline.llm.decontaminate import words

SF = "/root/testdata/sf0.1"


def plain_ftrl(rows, epochs, alpha=2.0, beta=1.0, l1=3.0, l2=0.1, seed=8):
    """FTRL-proximal with dictionaries, one coordinate at a time."""
    z, n, rng = {}, {}, np.random.default_rng(seed)
    weight = lambda i, a, b: 0.0 if abs(z.get(i, 0.0)) <= a else -(z[i] - math.copysign(a, z[i])) / ((beta + math.sqrt(n[i])) / alpha + b)
    sets = [set(toxicity.features(t).tolist()) for t, _ in rows]
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            ws = {i: weight(i, l1, l2) for i in sets[k]}
            bias = weight("bias", 0.0, 0.0) if "bias" in z else 0.0
            g = 1 / (1 + math.exp(-(sum(ws.values()) + bias))) - rows[k][1]
            for i, w in (*ws.items(), ("bias", bias)):
                before = n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(before)) / alpha * w
    return {i: w for i in z if i != "bias" and (w := weight(i, l1, l2))}, weight("bias", 0.0, 0.0)


def test_toxicity_training_is_plain_ftrl():
    rng = np.random.default_rng(1)
    rows = [(" ".join(f"w{i}" for i in rng.integers(0, 40, 12)) + (" awful thing" if y else ""), y) for y in rng.integers(0, 2, 40).tolist()]
    model = toxicity.train([toxicity.example(*row) for row in rows], epochs=3, alpha=2.0)
    want, bias = plain_ftrl(rows, 3)
    assert set(want) == set(model.index.tolist()) and abs(bias - model.bias) < 1e-9
    assert all(abs(want[i] - w) < 1e-9 for i, w in zip(model.index.tolist(), model.weight.tolist(), strict=True))
    text = rows[3][0] + " unseen words " * 40_000
    plain = 1 / (1 + math.exp(-(bias + sum(want.get(i, 0.0) for i in set(toxicity.features(text).tolist())))))
    assert abs(toxicity.score(model.dense(), model.bias, text) - plain) < 1e-9


def test_quality_logit_is_the_sum_of_its_parts():
    rng = np.random.default_rng(2)
    row = ("Some words, some words. " * 9 + "ODD !! line\n", "s1", "en", 250)
    model = quality.Logistic(rng.normal(size=(1 << quality.BITS) + 1))
    at = lambda names: {zlib.crc32(x) % (1 << quality.BITS) for x in names}
    ws = words(row[0])
    content = sum(model.weight[i] for i in at(set(ws))) / math.sqrt(len(set(ws)) + 1)
    text, n = row[0], len(ws)
    surface = {"new": len(set(ws)) / n, "again": sum(a == b for a, b in zip(ws, ws[1:])) / n, "capitals": sum(c.isupper() for c in text) / len(text),
               "marks": sum(c in "!#$%&*@^~|<>{}[]=_" for c in text) / len(text) * 4, "commas": (text.count(",") + text.count(".")) / n, "lines": text.count("\n") / n * 4}
    marks = [f"{k}:{min(int(v * 20), 20)}".encode() for k, v in surface.items()] + [f"size:{int(math.log2(n))}".encode()]
    assert abs(model.logit(quality.text_view(row)) - content - sum(model.weight[i] for i in at(marks)) - model.weight[-1]) < 1e-9


def test_quality_pseudo_labels_are_the_surest_rows_of_the_whole_table(spark, docs_of, monkeypatch):
    """Two rounds against a sort, with a third of the rows copies of few; then the mean of the shards' models against plain training."""
    monkeypatch.setattr(quality, "SHARD_ROWS", 4)
    rng, cols = np.random.default_rng(4), ["text", "source", "lang", "n_chars"]
    pool = docs_of([(i, " ".join(f"w{k}" for k in rng.integers(0, 60, 8)), "en", f"s{i}") for i in range(200)] + [(300, "word " * 30_000, "en", None), (301, None, None, "s1")])
    copies = pool.where("doc_id % 3 = 0").selectExpr("explode(sequence(1000, 1099)) as doc_id", *cols)
    keyed = {r["key"]: tuple(r[c] for c in cols) for r in pool.select(quality._key(cols).alias("key"), *cols).collect()}
    table = quality.TablePool(pool.unionByName(copies.select(pool.columns)), cols, [min(keyed)], 0.1)
    left, want = {k: r for k, r in keyed.items() if k != min(keyed)}, set()
    for sent in (quality.SENT_KEYS, 0):
        monkeypatch.setattr(quality, "SENT_KEYS", sent)
        views = [quality.Logistic(rng.normal(size=(1 << quality.BITS) + 1) * 4) for _ in quality.VIEWS]
        table.choose(views, 0.4)
        gone = set()
        for k, view in enumerate(quality.VIEWS):
            place = {key: (quality._step(views[k].logit(view(r))), key % (1 << 64) >> 48) for key, r in left.items()}
            low = sorted((x for x in place if place[x][0] < -2 * quality.STEPS), key=place.get)[: 20 - 8]
            high = sorted((x for x in place if place[x][0] >= 2 * quality.STEPS), key=lambda x: (-place[x][0], place[x][1]))[:8]
            want |= {(x, 1 - k, y) for y, found in ((0, low), (1, high)) for x in found}
            gone |= {*low, *high}
        left = {k: r for k, r in left.items() if k not in gone}
        got = table.chosen.collect()
        assert len(got) == len(want) > 20 and {(r["key"], r["view"], r["y"]) for r in got} == want
    marked = [(quality.example(r), i % 2) for i, r in enumerate(list(keyed.values())[:30])]
    for k, model in enumerate(table.trained(marked)):
        own = sorted((x, y) for x, view, y in want if view == k)
        n = -(-len(own) // 4)
        frame = spark.createDataFrame([(x,) for x, _ in own], "key long")
        shard = {r["key"]: r["s"] for r in frame.selectExpr("key", f"pmod(xxhash64(key, 6), {n}) as s").collect()}
        plain = [quality.Logistic().fit([x[k] for x, _ in marked] + [quality.VIEWS[k](keyed[x]) for x, _ in own if shard[x] == s],
                                        [y for _, y in marked] + [y for x, y in own if shard[x] == s]).weight for s in sorted(set(shard.values()))]
        assert len(plain) > 1 and np.allclose(model.weight, np.mean(plain, axis=0), atol=1e-9)


def test_quality_pool_grows_with_the_table_and_holds_long_texts(spark, docs_of, monkeypatch):
    keep = quality.TablePool.choose
    rows = [(i, f"fine words of number {i} and {i * 7}, well put." if i % 2 else f"junk!! {i} " * 9, "en", f"s{i % 2}") for i in range(400)] + [(900, "junk!! " * 40_000, "en", "s0")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(0, 1)] * 200, "doc_id long, quality int")
    sizes = []
    for n in (200, 1000):
        docs, made = docs_of(rows[:n]), []
        monkeypatch.setattr(quality.TablePool, "choose", lambda self, *a: (keep(self, *a), made.append(self.chosen.count()))[0])
        model = quality.fit(docs, labels, docs, share=0.1)
        sizes.append(made[-1])
        text, lang, source = rows[301][1:]
        assert model.scores((text, source, lang, len(text)))[0] > 0.5 > model.scores((rows[-1][1], "s0", "en", 280_000))[0]
    assert sizes[1] > 1.5 * sizes[0] > 0


def held(spark, query, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(f"{label} in (0, 1)").select("doc_id", label)
    rows = query(spark, SF).where("held_out").join(labels, "doc_id").collect()
    return np.array([r[label] for r in rows]), np.array([r["predicted"] for r in rows])


def test_toxicity_of_held_out_documents(spark):
    y, guess = held(spark, entries.op8_toxicity, "toxic")
    assert y.sum() > 20 and guess[y == 1].mean() > 0.8 and guess[y == 0].mean() < 0.01


def test_quality_of_held_out_documents(spark):
    y, guess = held(spark, entries.op6_quality, "quality")
    assert len(y) > 300 and (y == guess).mean() > 0.95


def test_empty_tables_and_clashing_columns(spark, docs_of):
    docs = docs_of([(1, "some text", "en", "a"), (None, None, None, None), (2, "x " * 300_000, "en", "a")]).selectExpr("*", "1 as id", "2 as f", "3 as y", "4 as row")
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    for rows, marks in ((docs, labels), (docs.limit(0), labels), (docs, labels.limit(0))):
        tox = toxicity.fit(rows, marks)
        good = quality.fit(rows, marks, rows)
        scored = rows.select("doc_id", toxicity.toxicity(tox, entries.F.col("text")).alias("t"), quality.quality(good, *map(entries.F.col, ("text", "source", "lang", "n_chars"))).alias("q")).collect()
        assert len(scored) == rows.count() and all(0 <= r["t"] <= 1 and 0 <= r["q"]["score"] <= 1 for r in scored)


def test_toxicity_prior_is_that_of_all_labels_whatever_the_sample(spark):
    """1,500 clean and 60 toxic rows without a telling word: the scores stay near the true rate when classes are sampled alike."""
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(f"w{i}" for i in rng.integers(0, 30, 8))) for k in range(1560)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 26 == 0)) for k in range(1560)], "doc_id long, toxic int")
    for train_rows in (40, 5000):
        scores = [r["s"] for r in docs.select(toxicity.toxicity(toxicity.fit(docs, labels, train_rows=train_rows), entries.F.col("text")).alias("s")).collect()]
        assert 0.01 < np.mean(scores) < 0.12, train_rows


def test_toxicity_rate_is_chosen_on_training_rows_and_repeated_ids_do_not_crowd_out(spark):
    rng = np.random.default_rng(6)
    rows = [(k, " ".join(f"w{i}" for i in rng.integers(0, 50, 20)) + (" nastyword" if k % 2 else "")) for k in range(200)]
    examples = [toxicity.example(t, k % 2) for k, t in rows]
    assert toxicity.best_rate(examples) in toxicity.RATES and toxicity.best_rate([]) in toxicity.RATES
    docs = spark.createDataFrame([(0, "copy of a row")] * 500 + rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(0, 0)] * 300, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, train_rows=120)
    dense = model.dense()
    assert toxicity.score(dense, model.bias, "w1 w2 nastyword w3") > 0.5 > toxicity.score(dense, model.bias, "w1 w2 w3")
