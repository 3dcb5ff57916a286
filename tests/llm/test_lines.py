"""Line dedup against a plain version, and its perfect hash."""

import numpy as np
import pytest

from ridgeline.llm import line_dedup

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars=20, min_docs=3):
    """(doc_id, lines, dropped, text) of each row (doc_id, text)."""
    split = [(t or "").split("\n") for _, t in rows]
    keys = [[x.strip(BLANKS).translate(LOWER) for x in ls] for ls in split]
    holders = {}
    for k, own in enumerate(keys):
        for key in set(own):
            if len(key) >= min_chars:
                holders.setdefault(key, []).append(rows[k][0])
    out = []
    for (doc_id, _), ls, own in zip(rows, split, keys, strict=True):
        gone = []
        for key in own:
            ids = holders.get(key, [])
            known = [i for i in ids if i is not None]
            gone.append(len(ids) >= min_docs and bool(known) and doc_id != max(known))
        out.append((doc_id, len(ls), sum(gone), "\n".join(x for x, g in zip(ls, gone, strict=True) if not g)))
    return out


A, B, LONG = "The same line in many texts.", "Ñandú y otras aves del campo", "x" * 300
TEXTS = [
    (1, f"{A}\nown line of the first text\n{B}"), (2, f"  {A.upper()}\t\r\n{B}\n{B}"), (3, f"{A}\n{A}\nshort\n\n"), (4, f"{B}\nshort\n" + "z" * 19), (5, "short\n" + "z" * 19), (6, "z" * 19 + "\nshort"),
    (None, f"{A}\n{LONG}"), (None, LONG), (None, LONG), (7, None), (8, ""), (9, "\n\n"), (10, f"{A}\n{B}"), (10, f"{A}\nlast"), (11, "Ñ" * 20), (12, "ñ" * 20), (13, "Ñ" * 20), (14, "Ñ" * 20),
    (15, "\n".join([A] * 3000 + [f"line number {k} of a very long text" for k in range(3000)]))]


@pytest.mark.parametrize("slices", [False, True])
def test_lines_against_brute_force(spark, docs_of, monkeypatch, slices):
    if slices:
        monkeypatch.setattr(line_dedup, "SHARD_KEYS", 2)
        monkeypatch.setattr(line_dedup, "SLICE_SHARDS", 1)
    docs = docs_of([(i, t, "en", "s") for i, t in TEXTS]).selectExpr("*", "1 as gone", "'x' as row", "2 as n_lines")
    got = [(r["row"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.deduplicated(docs).collect()]
    order = lambda rows: sorted(rows, key=repr)
    assert order(got) == order(brute(TEXTS))
    kept = line_dedup.dedup_lines(docs)
    assert kept.columns == docs.columns and sorted(r["text"] for r in kept.collect()) == sorted(x[3] for x in brute(TEXTS))


def test_other_limits_and_an_empty_table(spark, docs_of):
    rows = [(1, "ab\ncd"), (2, "ab\nef"), (3, "cd")]
    got = [(r["row"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.deduplicated(docs_of(rows), min_chars=2, min_docs=2).collect()]
    assert sorted(got) == sorted(brute(rows, 2, 2)) == [(1, 2, 2, ""), (2, 2, 0, "ab\nef"), (3, 1, 0, "cd")]
    assert line_dedup.deduplicated(docs_of([])).collect() == []


def test_the_hash_is_perfect_and_minimal():
    rng = np.random.default_rng(3)
    h1, h2 = rng.integers(0, 1 << 63, 20_000).astype(np.uint64), rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    h1[:50] = h1[50]  # equal first words are told apart by the second
    h = line_dedup.PerfectHash.of(h1, h2)
    assert sorted(h.slots(h1, h2).tolist()) == list(range(20_000))
    assert h.sizes.sum() < 5 * 20_000
    others = h.slots(h2, h1)
    assert others.min() >= -1 and others.max() < 20_000
    assert line_dedup.PerfectHash.of(h1[:0], h2[:0]).slots(h1[:3], h2[:3]).tolist() == [-1, -1, -1]
