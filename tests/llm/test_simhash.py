"""SimHash near-dedup against brute force."""

import numpy as np
import xxhash

from ridgeline.llm import simhash


def brute_components(fps: list[int]) -> list[int]:
    """Index of the smallest member of each fingerprint's component, by all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= simhash.DISTANCE:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_golay_keys_meet_within_one_bit():
    code, words = simhash.Golay(), np.random.default_rng(0).integers(0, 1 << 23, 2000)
    near = code.keys(words)
    for bit in range(23):
        other = code.keys(words ^ (1 << bit))
        assert (near[:, :1] == other).any(axis=1).all() and (other[:, :1] == near).any(axis=1).all()


def test_fingerprint_is_the_majority_of_shingle_hashes():
    text = "The cat  SAT on\tthe mat the cat sat"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("One Two") == xxhash.xxh64_intdigest("one two", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \t\n") == 0


def test_links_connect_exactly_the_brute_force_components(spark):
    rng = np.random.default_rng(1)
    fps = []
    for _ in range(60):
        base = int(rng.integers(0, 1 << 63))
        fps.append(base)
        for _ in range(int(rng.integers(0, 6))):
            flips = rng.choice(64, size=int(rng.integers(1, 6)), replace=False)
            fps.append(fps[-1] ^ int(sum(1 << int(b) for b in flips)))
    center = int(rng.integers(0, 1 << 63))  # a dense group
    fps += [center ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (150, 2))]
    fps = sorted({f if f < 1 << 63 else f - (1 << 64) for f in fps} | {0})
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(frame)).collect()}
    unsigned = [f % (1 << 64) for f in fps]
    want = brute_components(unsigned)
    assert [found.get(f, f) for f in fps] == [fps[i] for i in want]


def test_whole_operator(spark, docs_of):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(1, text), (2, text.upper()), (3, text + " tail"), (4, "quite another text of words"), (5, None), (6, ""), (None, text), (2, text)]
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs_of(rows)).collect()}
    fps = {d: f"{simhash.fingerprint(t):016x}" for d, t in rows}
    assert {(4, fps[4], 4), (5, "0" * 16, 5), (6, "0" * 16, 5), (1, fps[1], 1), (2, fps[1], 1), (None, fps[1], 1)} <= got
    kept = simhash.near_dedup(docs_of(rows).withColumn("fp", simhash.F.lit("clash")))
    assert kept.columns == [*docs_of(rows).columns, "fp"]
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] != 3) == [1, 4, 5]
    assert simhash.near_duplicates(docs_of([])).count() == 0 == simhash.near_dedup(docs_of([])).count()
