"""The corpus pipeline, stage by stage, against plain Python, and the registered queries' contracts."""

import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from ridgeline.llm import decontaminate, entries, language_id, simhash


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    words = {"en": ["the", "and", "thing", "over", "water", "night"], "de": ["der", "und", "schule", "über", "wasser", "nacht"]}
    make = lambda lang, n: " ".join(rng.choice(words[lang], n)) + f" {lang}{int(rng.integers(0, 1 << 30))}"
    rows = [(i, make(lang := "en" if i % 3 else "de", 60), lang, f"s{i % 4}" if i % 5 else "hot") for i in range(90)]
    bench = [(0, "a bench passage of eleven words stands here for all to find"), (1, "short item"), (2, None)]
    rows += [(100 + i, rows[i][1].upper() if i % 2 else rows[i][1], rows[i][2], "copies") for i in range(10)]
    rows += [(200 + i, f"{rows[20 + i][1]} tail", rows[20 + i][2], "near") for i in range(5)]
    rows += [(300, f"{make('en', 40)} {bench[0][1].title()} {make('en', 10)}", "en", "leak"), (301, "short, ITEM", "en", "leak"), (302, None, None, None), (303, "", "en", None), (304, "12 34 !", "en", "hot")]
    base = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(*r, len(r[1]) if r[1] else None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 2), int(i % 7 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return base


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_each_stage_against_plain_python(spark, sf_dir):
    docs = entries.documents(spark, sf_dir)
    every = docs
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "simhash_dedup", "decontaminate", "packing"]

    told = stages["language_id"](spark, docs, sf_dir)
    model = language_id.fit(docs.where(~entries.held_out(entries.F.col("doc_id"), 3, 1)))
    before = texts(every)
    assert texts(told) == {d: t for d, t in before.items() if not model.predict(t)[2]}
    assert before.keys() - texts(told).keys() == {302, 303, 304}
    assert told.columns == docs.columns

    single = stages["exact_dedup"](spark, told, sf_dir)
    last = {}
    for d, t in sorted(texts(told).items()):
        last[t.encode().lower()] = d
    assert sorted(texts(single)) == sorted(last.values()) and single.columns == docs.columns

    apart = stages["simhash_dedup"](spark, single, sf_dir)
    left = texts(single)
    root = {d: d for d in left}
    prints = {d: simhash.fingerprint(t) for d, t in left.items()}
    changed = True
    while changed:
        changed = False
        for a in left:
            for b in left:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    assert sorted(texts(apart)) == sorted(set(root.values())) and apart.columns == docs.columns

    clean = stages["decontaminate"](spark, apart, sf_dir)
    bench = [decontaminate.words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = {tuple(b[i : i + 10]) for b in bench if b for i in range(max(1, len(b) - 9))}
    hit = lambda t: any(tuple(w[i : i + n]) in windows for w in [decontaminate.words(t)] for n in (2, 10) for i in range(len(w)))
    assert texts(clean) == {d: t for d, t in texts(apart).items() if not hit(t)} and not {300, 301} & texts(clean).keys()

    pieces = stages["packing"](spark, clean, sf_dir).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for d, t in texts(clean).items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        own = sorted((p["start"], bytes(p["ids"])) for p in pieces if p["doc_id"] == d)
        assert b"".join(x for _, x in own) == np.array(ids, dtype="<u2").tobytes()
    assert {p["doc_id"] for p in pieces} == texts(clean).keys()
    assert sum(p["length"] for p in corpus_pipeline.run(spark, sf_dir).collect()) == sum(p["length"] for p in pieces)


COLUMNS = {
    "op1_simhash": {"doc_id", "fingerprint", "component_id"}, "op2_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op3_license_scan": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
    "op4_language_id": {"doc_id", "held_out", "lang_pred", "score"}, "op5_decontaminate": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op6_quality": {"doc_id", "score"}, "op7_token_files": {"doc_id", "start", "n_tokens", "ids_crc32"}, "op8_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op9_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op10_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op11_line_dedup": {"doc_id", "n_lines", "n_dropped", "kept_sha256"},
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_queries_return_their_columns_for_every_document(spark, sf_dir, name):
    got = entries.queries()[name](spark, sf_dir)
    assert COLUMNS[name] <= set(got.columns)
    rows = got.collect()
    docs = {r["doc_id"] for r in entries.documents(spark, sf_dir).select("doc_id").collect()}
    assert {r["doc_id"] for r in rows} == docs
    if name != "op9_packing":
        assert len(rows) == len(docs)
    for r in rows:
        if "held_out" in got.columns:
            n, k = (3, 1) if name.startswith("op4") else (5, 0)
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % n == k)
        if "predicted" in got.columns:
            assert r["predicted"] == int(r["score"] >= 0.5)


def test_levels_score_each_text_once(spark, sf_dir):
    """A filter on the score beside the figures made two Python workers a task, each scoring every text."""
    model = language_id.train([("the night and the water", "en"), ("der und die schule", "de")])
    rows = entries.documents(spark, sf_dir).select("text")
    counts = language_id.step_counts(model, rows)
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    scored = [s for t in texts(entries.documents(spark, sf_dir)).values() if (s := model.figures(t)[1]) > 0]
    assert sum(r["count"] for r in counts.collect() if r["figure"] == "score") == len(scored) > 50


def test_golay_table_is_built_in_little_memory():
    tracemalloc.start()
    simhash.Golay()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8e6
