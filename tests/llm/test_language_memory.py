"""What the driver holds while the language model is trained."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from ridgeline.llm import language_id


def owned(array):
    """The array at the end of its views."""
    while isinstance(array.base, np.ndarray):
        array = array.base
    return array


def test_sample_is_six_bytes_a_bucket_in_two_buffers(spark):
    texts = ["the quick brown fox", "le renard brun et rapide", "der schnelle braune fuchs", "a lazy dog sleeps", "12 34"]
    rows = spark.createDataFrame([(k, t, "en" if k % 2 else "fr") for k, t in enumerate(texts)], "id long, text string, lang string")
    found = language_id.sampled(rows, F.lit(True))
    assert len(found) == 4  # one has no letter
    assert sum(b.nbytes + v.nbytes for b, v, _ in found) == 6 * sum(len(b) for b, _, _ in found)
    assert len({id(owned(b)) for b, _, _ in found}) == 1 and len({id(owned(v)) for _, v, _ in found}) == 1
    want = {(lang, *map(tuple, language_id.shares(t))) for t, lang in ((t, "en" if k % 2 else "fr") for k, t in enumerate(texts[:4]))}
    assert {(lang, tuple(b), tuple(v)) for b, v, lang in found} == want
    assert language_id.sampled(rows.limit(0), F.lit(True)) == []


def test_training_copies_one_text_at_a_time(monkeypatch):
    monkeypatch.setattr(language_id, "LEAST_STEPS", 1)
    rng, n, size = np.random.default_rng(3), 400, 8192
    bucket = np.sort(rng.integers(0, language_id.BUCKETS, (n, size)), axis=1).astype(np.uint16)
    share = np.full((n, size), 1 / size, dtype=np.float32)
    rows = [(b, v, "en" if k % 2 else "fr") for k, (b, v) in enumerate(zip(bucket, share, strict=True))]
    tracemalloc.start()
    language_id.train_examples(rows, epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < n * size * 8 / 2  # half of the sample's shares as doubles
