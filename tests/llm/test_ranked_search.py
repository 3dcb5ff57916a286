"""Ranked search against a plain version over all pairs."""

import math
import random

import numpy as np
import pytest

from ridgeline.llm import ranked_search
from ridgeline.llm.decontaminate import words


def brute(docs, items, top=50):
    """(item_id, rank, doc_id, score) over rows (doc_id, text) and (item_id, text)."""
    bags = []
    for doc_id, text in docs:
        ws = words(text)
        bags.append((doc_id, len(ws), {w: ws.count(w) for w in set(ws)} if len(ws) < 3000 else dict(zip(*[x.tolist() for x in np.unique(ws, return_counts=True)], strict=True))))
    n = sum(size > 0 for _, size, _ in bags)
    total = sum(size for _, size, _ in bags)
    out = []
    for item_id, text in items:
        found = []
        weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in b for _, _, b in bags) + 1))) for t in set(words(text))}
        for doc_id, size, bag in bags:
            if size:
                m = 100 - 50 + (50 * size * n) // total
                score = sum(w * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 20 * m)) for t, w in weights.items() if t in bag)
                if score > 0:
                    found.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, k + 1, f[3], -f[0]) for k, f in enumerate(sorted(found, key=lambda f: f[:3])[:top])]
    return out


def corpus(n, seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    weight = [1 / (k + 1) for k in range(60)]
    rows = [(k, " ".join(rng.choices(vocabulary, weight, k=rng.randrange(1, 60)))) for k in range(n)]
    rows += [(n + k, "W1 w2 w2 w59") for k in range(40)] + [(n + 100, None), (n + 101, ""), (n + 102, "... !"), (None, "w59 w58"), (None, "w1")]
    rows += [(n + 103, "w7 " * 20_000 + "w8"), (n + 104, "no such term"), (5, "w1 w2"), (5, "w1 w2")]
    rng.shuffle(rows)
    items = [("a", "w1 w2 w59"), ("b", "W58, w57-w56; w3"), ("c", None), ("d", "unknown words"), ("e", "w7 w7 w8 é"), ("a", "w1 w2 w59"), ("f", " ".join(vocabulary)), (None, "w5")]
    return rows, items


@pytest.mark.parametrize("small", [False, True])
def test_search_against_brute_force(spark, docs_of, monkeypatch, small):
    if small:  # several shards, tasks, a first search, blocks
        for name, value in {"SHARD_DOCS": 64, "TASK_DOCS": 128, "FIRST": 4, "LEAF": 4, "BLOCK_ITEMS": 3}.items():
            monkeypatch.setattr(ranked_search, name, value)
    rows, items = corpus(500)
    docs = docs_of([(i, t, "en", "s") for i, t in rows]).selectExpr("*", "1 as item", "2 as rank", "3 as n", "4 as terms").repartition(3)
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = [tuple(r) for r in ranked_search.search(docs, bench, top=10).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows, items, 10), key=repr)


def test_a_subtree_bounds_its_documents():
    rng = np.random.default_rng(4)
    vectors = [(np.sort(rng.choice(40, rng.integers(0, 20), replace=False)), None) for _ in range(300)]
    vectors = [(t, rng.integers(1, 9, len(t))) for t, _ in vectors]
    m = rng.integers(50, 400, 300)
    tree = ranked_search.Tree(vectors, m)
    open_, leaves = [tree.root], 0
    while open_:
        b = open_.pop()
        above = dict(zip(b.terms.tolist(), ranked_search.tf_score(b.tops, np.int64(b.m)).tolist(), strict=True))
        for k in range(b.lo, b.hi):
            at = slice(tree.start[k], tree.start[k + 1])
            assert all(above[t] >= s for t, s in zip(tree.terms[at].tolist(), tree.score[at].tolist(), strict=True))
        if b.children:
            assert [c.lo for c in b.children] + [b.hi] == [b.lo] + [c.hi for c in b.children]
            open_ += b.children
        else:
            leaves += 1
            assert b.hi - b.lo <= ranked_search.LEAF
    assert leaves > 5


def test_empty_tables(spark, docs_of):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked_search.search(docs_of([]), bench).collect() == []
    assert ranked_search.search(docs_of([(1, "a")]), bench.where("false")).collect() == []
    assert ranked_search.search(docs_of([(1, None)]), bench).collect() == []
    assert ranked_search.search(docs_of([(1, "c")]), bench).collect() == []
