"""Whitening against a dense decomposition, and its updates."""

import math

import numpy as np
import pytest

from ridgeline.llm import whitening


@pytest.mark.parametrize("case", ["plain", "copies", "flat", "one", "few", "axes"])
def test_updates_are_a_decomposition_of_the_scatter(case):
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(80, 12)) * np.linspace(1, 6, 12)
    if case == "copies":
        rows[:, 3], rows[40:] = rows[:, 4], rows[:40]
    elif case == "flat":
        rows[:, 2:] = 0
    elif case == "one":
        rows[:] = rows[0]
    elif case == "few":
        rows = rows[:4]
    elif case == "axes":
        rows = np.eye(12)[rng.integers(0, 12, 80)]
    spectrum = whitening.Spectrum.empty(12)
    for row in rows:
        spectrum.values, spectrum.vectors = whitening.updated(spectrum.values, spectrum.vectors, row)
    blocks = whitening.Spectrum.empty(12)
    for at in range(0, len(rows), 30):
        blocks.add(rows[at : at + 30])
    joined = whitening.Spectrum.empty(12)
    joined.add(rows[:2])
    rest = whitening.Spectrum.empty(12)
    rest.add(rows[2:])
    joined.join(rest.values, rest.vectors)
    scatter = rows.T @ rows
    for s in (spectrum, blocks, joined):
        size = scatter.max()
        assert np.abs(s.vectors.T @ s.vectors - np.eye(12)).max() < 1e-12
        assert np.abs((s.vectors * s.values) @ s.vectors.T - scatter).max() < 1e-12 * size
        assert (np.diff(s.values) >= 0).all()


def brute(rows, components=16):
    """{(id, component): values} of rows (id, vector)."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    ints = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in good]
    fit = np.array(sorted(set(map(tuple, ints))), dtype=np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    x = fit - sums / n
    e, u = np.linalg.eigh(x.T @ x / n)
    e, u = e[::-1], u[:, ::-1]
    out = []
    for (i, _), own in zip(good, ints, strict=True):
        deviation = int(((n * np.array(own) - sums) ** 2).sum())
        for k in range(min(components, len(e))):
            if e[k] > 1e-12 * e[0]:
                out.append((i, k + 1, n, deviation, float((np.array(own) - sums / n) @ u[:, k] / math.sqrt(e[k])), e[k] / e.sum()))
    return out


def test_whitening_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(120, 20)) * np.linspace(0.5, 3, 20)
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(base)] + [(200 + k, [float(np.float32(c)) for c in base[0]]) for k in range(60)]
    rows += [(300, None), (301, []), (302, [1.0, None] + [0.0] * 18), (303, [float("nan")] * 20), (304, [float("inf")] * 20), (305, [float("-inf")] + [0.0] * 19)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, n int").repartition(7)
    got = whitening.by_component(whitening.whiten(table, block=16)).collect()
    want = {(r[0], r[1]): r for r in brute(rows)}
    assert len(got) == len(want) == 180 * 16
    signs = {r["component"]: np.sign(r["whitened"] * want[0, r["component"]][4]) for r in got if r["vec_id"] == 0}
    for r in got:
        _, k, n, deviation, whitened, explained = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert math.isclose(r["whitened"] * signs[k], whitened, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r["explained"], explained, rel_tol=1e-10)
        assert r["identity_error"] < 1e-9


def test_degenerate_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = lambda t: whitening.by_component(whitening.whiten(t)).collect()
    assert rows(make([])) == []
    assert rows(make([(1, None), (2, [])])) == []
    assert rows(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])) == []  # a single distinct vector
    line = rows(make([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [5.0, 2.0]), (4, [7.0])]))
    assert [(r["vec_id"], r["component"], r["n"]) for r in sorted(line)] == [(1, 1, 3), (2, 1, 3), (3, 1, 3)]
    assert math.isclose(abs(line[0]["whitened"]), math.sqrt(1.5), rel_tol=1e-12) and line[0]["explained"] == 1.0
