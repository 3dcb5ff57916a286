"""Edge cases and brute-force comparisons of the text operators."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from ridgeline.llm import decontaminate, exact_dedup, language_id, license_scan, packing, pfor, pii, quality, toxicity
from ridgeline.llm.token_ids import Encoder

LONG = " ".join(f"word{i % 700}" for i in range(30_000))
ROWS = [
    (1, "The Quick brown fox", "en", "a"), (2, "the quick BROWN fox", "en", "a"), (3, None, None, None), (4, "", "en", "b"), (None, "the quick brown fox", "fr", "a"),
    (5, "Écoute la rivière", "fr", "b"), (6, "écoute la rivière", "fr", "c"), (7, LONG, "en", "a"), (2, "the quick BROWN fox", "en", "a"), (8, " \n\t ", "de", "c"),
]


@pytest.mark.parametrize("slice_buckets, hot", [(exact_dedup.SLICE_BUCKETS, 10_000), (1, 3)])
def test_exact_dedup_groups(spark, docs_of, monkeypatch, slice_buckets, hot):
    monkeypatch.setattr(exact_dedup, "SLICE_BUCKETS", slice_buckets)
    monkeypatch.setattr(exact_dedup, "HOT_GROUPS", hot)
    monkeypatch.setattr(exact_dedup, "BITS_PER_ROW", 16 if hot > 3 else 1 << 13)
    rows = ROWS + [(100 + i, "Copied", "en", "hot") for i in range(30)]
    got = exact_dedup.duplicate_groups(docs_of(rows)).collect()
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    sizes = Counter(lower(t) for _, t, *_ in rows)
    shas = {hashlib.sha256(t.encode()).hexdigest(): t for t in sizes}
    assert len(got) == len(rows)
    assert all(r["group_size"] == sizes[shas[r["text_sha256"]]] for r in got)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(sizes) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert {r["keep_id"] for r in got if shas[r["text_sha256"]] == "the quick brown fox"} == {2}
    assert exact_dedup.duplicate_groups(docs_of([])).count() == 0
    docs = docs_of(rows).selectExpr("*", "1 as digest", "'x' as row", "2 as maybe", "3 as slice", "4 as bitmap")
    single = exact_dedup.exact_dedup(docs)
    assert single.columns == docs.columns
    assert sorted(lower(r["text"]) for r in single.collect()) == sorted(sizes)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_bloom_filter_passes_no_repeated_row(spark):
    rows = spark.range(4000).selectExpr("unhex(sha2(cast(id % 3900 as string), 256)) as digest", "id")
    [probed] = exact_dedup.maybe_repeated(rows, rows, 4000)
    ids = [r["id"] for r in probed.where("not maybe").collect()]
    assert all(100 <= i < 3900 for i in ids) and len(ids) > 3500


def brute_license(text):
    words = re.findall(license_scan.WORD, (text or "").encode().lower().decode())
    places = [(label, i) for label, p in license_scan.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), places


def test_license_base_places(spark, docs_of):
    texts = ["All rights reserved. CC BY cc by", "all rights all rights reserved, general public license general public", "x", None, "", "released under the MIT license",
             "Licensed under the really Apache License, version 2", LONG + " all rights reserved"]
    docs = docs_of([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])]).selectExpr("*", "1 as tmpl", "2 as hash")
    got = license_scan.report(license_scan.scan(docs)).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        n, places = brute_license(texts[r["doc_id"]])
        starts = [i for _, i in places]
        assert (r["n_words"], r["n_base"]) == (n, len(places))
        assert (r["first_word"], r["last_word"]) == ((min(starts), max(starts)) if starts else (None, None))
        assert r["base_labels"] == ",".join(sorted({label for label, _ in places}))
        assert 0 <= r["score"] <= 1
    by = {r["doc_id"]: r["labels"] for r in got}
    assert by[5] == "mit" and by[6] == "apache" and by[3] == ""
    assert license_scan.report(license_scan.scan(docs_of([]))).count() == 0


def brute_labels(text, notices):
    """Labels by trying every stretch of the text against every band of diagonals of every template."""
    ws, found = re.findall(license_scan.WORD, (text or "").encode().lower().decode()), set()
    for label, notice in notices:
        tw = notice.split()
        hits = [(p, t) for p in range(len(ws) - 1) for t in range(len(tw) - 1) if ws[p : p + 2] == tw[t : t + 2]]
        diagonals, bands = sorted({p - t for p, t in hits}), []
        for d in diagonals:
            if bands and d - bands[-1][-1] <= license_scan.BAND:
                bands[-1].append(d)
            else:
                bands.append([d])
        reach = int((len(tw) - 1) * license_scan.STRETCH)
        for band in bands:
            own = [(p, t) for p, t in hits if p - t in band]
            if any(len({t for q, t in own if p <= q < p + reach}) >= license_scan.COVERED * (len(tw) - 1) for p, _ in own):
                found.add(label)
    return found


def test_license_windows_against_brute_force(spark, docs_of):
    rng = np.random.default_rng(3)
    long = " ".join(f"w{i % 61} x{i}" for i in range(70))
    notices = [*license_scan.NOTICES, ("long", long)]
    texts = ["licensed under cc by nc", "licensed under cc by nc" + " by nc" * 6, "by nc by nc licensed under cc by nc", f"some {long} more", f"{long[:560]} a few other words", long[:300],
             "permission is hereby granted to any person free of charge obtaining a copy of this software"]
    pool = [n.split() for _, n in notices[:-1]]
    for _ in range(40):
        out = []
        for _ in range(int(rng.integers(1, 6))):
            ws = pool[int(rng.integers(len(pool)))]
            out += [w for w in ws if rng.random() > 0.12] + ["extra"] * int(rng.integers(0, 3)) + ws[-2:] * int(rng.integers(0, 4))
        texts.append(" ".join(out))
    table = spark.createDataFrame(notices, "label string, text string")
    base = [(label, phrase) for label, phrase in license_scan.BASE]
    for given in (notices, table):
        got = {r["doc_id"]: set(r["labels"].split(",")) - {""} for r in license_scan.report(license_scan.scan(docs_of(list(enumerate(texts))), notices=given)).collect()}
        for i, t in enumerate(texts):
            plain = {label for label, phrase in base if f" {phrase} " in f" {t} "}
            assert got[i] == brute_labels(t, notices) | plain, t
    assert got[1] == {"cc-by", "cc-by-nc"} and got[3] == got[4] == {"long"} and got[5] == set()


def test_language_model_learns_and_rejects():
    rng = np.random.default_rng(0)
    def text(syllables):
        return " ".join("".join(rng.choice(syllables, 3)) for _ in range(30))
    rows = [(text(["the", "ing", "and", "er"]), "en") for _ in range(120)] + [(text(["sch", "ung", "ein", "ö"]), "de") for _ in range(120)]
    model = language_id.train(rows, reject_rate=0.05)
    assert model.predict("theinganding anderthe")[0] == "en" and model.predict("schungein einungö")[0] == "de"
    assert model.predict(None) == ("und", 0.0, True) == model.predict("123 !?")
    assert language_id.train([]).predict("text") == ("und", 0.0, True)
    assert model.level > 0


def test_language_scoring(spark, docs_of):
    model = language_id.train([("the and ing", "en"), ("sch ung ein", "de")] * 5)
    docs = docs_of(ROWS).selectExpr("*", "1 as found")
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, None, 5, 6, 7}
    assert language_id.keep_identified(docs.limit(0), model).count() == 0


def test_language_stage_rejects_gibberish_with_its_defaults(spark, docs_of):
    import corpus_pipeline

    rng = np.random.default_rng(4)
    syllables = {"en": ["the", "ing", "and", "er"], "de": ["sch", "ung", "ein", "ö"]}
    make = lambda lang: " ".join("".join(rng.choice(syllables[lang], 3)) for _ in range(12))
    clean = [(i, make(lang := "en" if i % 2 else "de"), lang) for i in range(7000)]
    odd = [(10_000, "qzx vkjw pqtr zzxg wvvk", None), (10_002, "Привет как дела сегодня", None), (10_004, "xkcd qqqq wxyz jjjk vbvb 99", None), (10_006, "日本語の文章です", None),
           (10_008, "ahbx piq oomf upka gwu", None)]
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs_of(clean + odd), "").select("doc_id").collect()}
    assert not kept & {d for d, *_ in odd}
    assert len(kept) >= 0.998 * len(clean)


def test_language_levels_are_quantiles_of_the_rows_outside_the_sample(spark, docs_of):
    model = language_id.train([("the and ing", "en"), ("sch ung ein", "de")] * 5)
    texts = [f"the {'and ' * (i % 40)} {'ung ' * (i % 7)} x{i}x" for i in range(300)]
    levels = language_id.rejection_levels(model, docs_of(list(enumerate([*texts, None, "12"]))), 0.2)
    for k, figure in ((1, "score"), (2, "typical")):
        own = sorted(model.figures(t)[k] for t in texts)
        assert levels[figure] <= own[29] < levels[figure] + 1 / language_id.STEPS
    assert language_id.rejection_levels(model, docs_of(list(enumerate(texts))), 1e-3) == {}


def test_language_of_held_out_documents(spark):
    """Accuracy and calibration with the defaults of the query."""
    from ridgeline.llm import entries

    rows = entries.op4_language_id(spark, "/root/testdata/sf0.1").join(
        entries.documents(spark, "/root/testdata/sf0.1").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    right = np.array([r["lang_pred"] == r["lang"] for r in rows])
    score = np.array([r["score"] for r in rows])
    assert len(rows) > 2000 and right.mean() > 0.99
    assert abs(right.mean() - score.mean()) < 0.02
    assert np.mean([r["rejected"] for r in rows]) < 0.005


def test_language_sample_holds_rare_languages_long_texts_and_no_copies(spark, docs_of):
    rng = np.random.default_rng(8)
    make = lambda parts, n: " ".join("".join(rng.choice(parts, 3)) for _ in range(n))
    many = [(i, make(["the", "ing", "and", "er"], 12), "en") for i in range(3000)] + [(None, "the same text anding", "en")] * 1000
    rare = [(9000 + i, make(["sch", "ung", "ein", "ö"], 12_000), "de") for i in range(4)] + [(9500, "solo los niños", "es")]
    rows = docs_of(many + rare).selectExpr("doc_id as id", "text", "lang").repartition(7)
    inside = language_id.in_sample({"en": 4000, "de": 4, "es": 1}, 600)
    found = language_id.sampled(rows, inside)
    by = {lang: sum(x[2] == lang for x in found) for lang in ("en", "de", "es")}
    assert 100 < by["en"] < 300 and by["es"] == 1 and by["de"] <= 4
    assert rows.where(inside).count() + rows.where(~inside).count() == 4005
    model = language_id.fit(docs_of(many + rare), train_rows=600)
    assert {"en", "es"} <= set(model.langs) and model.figures("theinganding erand")[0] == "en" and model.levelled
    bucket, share = language_id.shares(rare[0][1])
    grams = np.concatenate(list(language_id.subwords(rare[0][1])))
    assert abs(share.sum() - 1) < 1e-4 and set(bucket) == set(grams.tolist())


def plain_figures(model, text):
    """The score without slices or tables: every byte n-gram by itself."""
    raw = text.lower().encode().translate(language_id._BYTES)
    grams = []
    for n in language_id.ORDERS:
        for i in range(len(raw) - n + 1):
            h = n
            for byte in raw[i : i + n]:
                h = (h * 0x01000193 + byte) % (1 << 32)
            grams.append((h * 0x9E3779B1) % (1 << 32) >> 18)
    mean = sum(model.table[g].astype(float) for g in grams) / len(grams)
    z = (mean[:-1] + model.bias) / model.temperature
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    return model.langs[int(p.argmax())], p.max(), mean[-1]


def test_language_figures_against_plain_python(monkeypatch):
    model = language_id.train([("the and ing over", "en"), ("sch ung ein öl", "de"), ("los ñan de", "es")] * 9)
    monkeypatch.setattr(language_id, "SLICE", 50)
    for text in ("the thing", "Schöne  neue 1 Welt", "ñ", LONG[:3000], "El niño – de los años"):
        lang, score, typical = model.figures(text)
        want = plain_figures(model, text)
        assert lang == want[0] and abs(score - want[1]) < 1e-6 and abs(typical - want[2]) < 1e-6


def brute_hits(text, items, window):
    ws, hit, found = decontaminate.words(text), set(), set()
    for item, body in items:
        iw = decontaminate.words(body)
        for i in range(max(1, len(iw) - window + 1) if iw else 0):
            w = iw[i : i + window]
            for j in range(len(ws) - len(w) + 1):
                if ws[j : j + len(w)] == w:
                    hit |= set(range(j, j + len(w)))
                    if item is not None:
                        found.add(str(item))
    return len(ws), len(hit), sorted(found)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WORDS, 20])
def test_decontamination_against_brute_force(spark, docs_of, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    rng = np.random.default_rng(5)
    make = lambda n, k: " ".join(f"v{i}" for i in rng.integers(0, k, n))
    items = [(i, make(int(n), 5)) for i, n in enumerate(rng.integers(1, 14, 12))] + [(20, None), (21, "?!"), (None, "v1 v1 v2"), (0, "v4 v4 v4")]
    texts = [make(int(n), 6) for n in rng.integers(0, 120, 25)] + [None, "", LONG, items[3][1].upper()]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of([(i, t) for i, t in enumerate(texts)]).selectExpr("*", "1 as n_hit", "2 as found0")
    got = decontaminate.with_removal_spans(docs, bench, window=4).selectExpr("row.doc_id", "n_words", "n_hit", "items", "spans").collect()
    for r in got:
        assert (r["n_words"], r["n_hit"], list(r["items"])) == brute_hits(texts[r["doc_id"]], items, 4)
    kept = decontaminate.with_removal_spans(docs, bench, window=4).where("n_hit = 0").select("row.*")
    assert kept.columns == docs.columns
    none = decontaminate.with_removal_spans(docs, bench.limit(0)).collect()
    assert len(none) == len(texts) and all(r["n_hit"] == 0 for r in none)
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_the_library(name):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    texts = ["don't stop's  x", "a\n\nb", " lead", "trail ", "İstanbul ŉ’s", "x's 'll it'd 12,5.", "tab\there", "", "　é ﬁ", "É́ é", "<|endoftext|> hi", "hi<|endoftext|>x <|STARTOFTEXT|> <|", "a <|startoftext|>", "a... b!? c.;d", "ß. ÿ ªº µx.", LONG[:500]]
    encoder = Encoder(path)
    for t in texts + texts:
        assert np.frombuffer(encoder.encode(t), dtype="<u2").tolist() == library.encode(t, add_special_tokens=False).ids
    assert encoder.encode(None) == b""


def test_pfor_blocks_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 511, 512, 513, 3000):
        ids = rng.integers(0, 300, n).astype(np.uint32)
        ids[rng.random(n) < 0.05] = 49_000
        doc_ids, counts, back = pfor.read_image(pfor.write_image([7, None], [n, 0], ids))
        assert doc_ids == [7, None] and counts.tolist() == [n, 0] and (back == ids).all()
    constant = np.full(512, 40_000, dtype=np.uint32)
    assert len(pfor.encode_blocks(constant)[1]) == 0


def test_token_shards_are_the_concatenation(spark, docs_of, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [*ROWS, (2, "another <|endoftext|> text", "en", "a"), (None, "no id", None, None)]
    shards = pfor.token_shards(docs_of(rows).coalesce(1).selectExpr("*", "1 as part", "2 as ids"), path)
    got = sorted(pfor.read_documents(shards, with_ids=True).collect(), key=lambda r: r["start"])
    start = 0
    for r, (d, t, *_) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        raw = np.array(ids, dtype="<u4").tobytes()
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (d, start, len(ids), zlib.crc32(raw), raw)
        start += len(ids)
    files = pfor.export(shards, str(tmp_path)).collect()
    assert sum(f["n"] for f in files) == start
    assert sum(len(pfor.read_image((tmp_path / f["file"].split("/")[-1]).read_bytes())[2]) for f in files) == start
    assert pfor.read_documents(pfor.token_shards(docs_of([]), path)).count() == 0


def test_packing_places_every_id_once(spark, docs_of):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i, f"text number {i} " * (1 + i % 50), "en", f"s{i % 7}" if i % 3 else "big") for i in range(200)] + [(500, None, None, None), (501, LONG, "en", "tiny")]
    got = packing.pack(docs_of(rows).selectExpr("*", "1 as part", "2 as queue"), path).collect()
    library = Tokenizer.from_file(path)
    for d, t, *_ in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u2")
        pieces = sorted((r["start"], r["length"], bytes(r["ids"]), r["ids_crc32"], r["doc_tokens"]) for r in got if r["doc_id"] == d)
        assert b"".join(p[2] for p in pieces) == ids.tobytes()
        assert [p[0] for p in pieces] == [0, *np.cumsum([p[1] for p in pieces])[:-1].tolist()]
        assert all(p[4] == len(ids) and p[3] == zlib.crc32(np.frombuffer(p[2], "<u2").astype("<u4")) for p in pieces)
    filled = {}
    for r in got:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.WINDOW and at.bit_count() == 1
    assert packing.pack(docs_of([]), path).count() == 0


def test_packing_spreads_each_of_many_sources(spark, docs_of):
    path = public_tokenizers.path("byte_bpe_50k.json")
    long = [(k * 100 + i, f"source {k} text {i} of several words", "en", f"s{k:03}" if k else None) for k in range(130) for i in range(40)]
    single = [(1 << 60 | k, "a source of one text only", "en", f"z{k}") for k in range(400)]
    got = packing.pack(docs_of([*long, *single]), path, with_ids=False).select("doc_id", "sequence_id", "offset", "length", "doc_tokens").collect()
    assert sum(r["length"] for r in got) == sum({r["doc_id"]: r["doc_tokens"] for r in got}.values())
    assert {r["doc_id"] for r in got} == {d for d, *_ in long + single}
    full = max(r["sequence_id"] for r in got if r["offset"] + r["length"] == packing.WINDOW)
    source = {d: s for d, _, _, s in long}
    for cut in np.linspace(0, full, 9)[1:-1].astype(int):
        share, done = (cut + 1) * packing.WINDOW / sum(r["length"] for r in got), {}
        for r in got:
            if r["sequence_id"] <= cut:
                s = source.get(r["doc_id"], "single")
                done[s] = done.get(s, 0) + r["length"]
        every = {}
        for r in got:
            s = source.get(r["doc_id"], "single")
            every[s] = every.get(s, 0) + r["length"]
        assert all(abs(done.get(s, 0) - share * n) < (30 if s != "single" else 0.1 * n) for s, n in every.items())


def test_mixture_keeps_proportions_in_every_window():
    mixture = packing.Mixture([50_000, 9_000, 1_300, 137_123])
    taken = np.diff(mixture.served(np.arange(mixture.windows + 1)), axis=0)
    share = np.array(mixture.totals) / mixture.all * packing.WINDOW
    assert (taken.sum(axis=1) == packing.WINDOW).all() and (np.abs(taken - share) < 2).all() and (taken >= 0).all()


@pytest.mark.parametrize("totals, weights", [
    ([50_000, 9_000, 1_300, 137_123], [1, 1, 1, 1]), ([50_000, 9_000, 1_300, 137_123], [5, 0.5, 0, 2]), ([3_000, 2_000], [0, 0]), ([1 << 36, 1 << 35, 1 << 28], None),
    ([1024, 1, 5, 5000], [1, 3, 3, 1]), ([7], None), ([], None)])
def test_mixture_by_weights(totals, weights):
    mixture = packing.Mixture(totals, weights)
    w = np.arange(mixture.windows + 2) if mixture.windows < 10_000 else np.unique(np.concatenate([np.arange(3000), mixture.starts, mixture.windows + 1 - np.arange(3000)]))
    served = mixture.served(w)
    assert (np.diff(served, axis=0) >= 0).all() and (served <= np.array(totals, dtype=np.int64)).all() and served[-1].tolist() == totals
    full = w <= mixture.windows
    assert (served[full].sum(axis=1) == packing.WINDOW * w[full]).all()
    if weights and any(weights) and min(totals) > packing.WINDOW:
        end = mixture.starts[1]
        want = np.array(weights) / sum(weights) * packing.WINDOW
        assert (np.abs(np.diff(mixture.served(np.arange(end + 1)), axis=0) - want) < 2).all()
    for s, total in enumerate(totals):
        place = np.unique(np.linspace(0, total - 1, 50).astype(np.int64))
        at = mixture.window_of(np.full(len(place), s), place)
        before, after = mixture.served(np.maximum(at - 2, 0))[:, s], mixture.served(np.minimum(at + 2, mixture.windows) + 1)[:, s]
        assert (before <= place).all() and (place < after).all()


def test_packing_by_weights(spark, docs_of):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i, f"text number {i} of some words", "en", "abc"[i % 3]) for i in range(900)] + [(i, "same id", "en", "a") for i in (5, 5)]
    got = packing.pack(docs_of(rows), path, with_ids=False, weights={"a": 3, "b": 1}).collect()
    source = {i: s for i, _, _, s in rows}
    taken = Counter()
    for r in got:
        if r["sequence_id"] < 4:
            taken[source[r["doc_id"]]] += r["length"]
    every = sum(r["length"] for r in got)
    own = {s: sum(r["length"] for r in got if source[r["doc_id"]] == s) for s in "abc"}
    free = 1 - own["c"] / every
    assert all(abs(taken[s] - 4096 * x) < 8 for s, x in {"a": 0.75 * free, "b": 0.25 * free, "c": own["c"] / every}.items())
    assert sum(r["length"] for r in got if r["start"] == 0 and r["doc_id"] == 5) > 0
    assert len([r for r in got if r["doc_id"] == 5 and r["start"] == 0]) == 3


def test_toxicity_learns_rare_words():
    rng = np.random.default_rng(2)
    clean = [" ".join(f"w{i}" for i in rng.integers(0, 300, 60)) for _ in range(300)]
    bad = [f"{c} nastyword" for c in clean[:60]]
    model = toxicity.train([toxicity.example(c, 0) for c in clean[60:]] + [toxicity.example(b, 1) for b in bad])
    dense = model.dense()
    assert toxicity.score(dense, model.bias, "quite new text with nastyword inside") > 0.5 > toxicity.score(dense, model.bias, clean[0])
    assert len(model.index) < 2000
    assert 0 < toxicity.score(dense, model.bias, None) == toxicity.score(dense, model.bias, "") < 0.5
    assert toxicity.score(*[(m := toxicity.train([])).dense(), m.bias], "x") == 0.5


def test_toxicity_query_columns(spark, docs_of):
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs_of(ROWS), labels)
    scored = docs_of(ROWS).select("doc_id", toxicity.toxicity(model, exact_dedup.F.col("text")).alias("score")).collect()
    assert len(scored) == len(ROWS) and all(0 <= r["score"] <= 1 for r in scored)


def brute_pii(text):
    pats = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    def luhn(d):
        return sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1], 1)) % 10 == 0
    out = []
    for kind in pii.BASE_KINDS:
        for m in re.finditer(pats[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_spans(spark, docs_of, monkeypatch):
    monkeypatch.setattr(pii, "SAMPLE_ROWS", 3)
    texts = ["mail a.b+c@x-y.example.org, a@b.c_d@e.f and a@b..c@d.e", "1.2.3.4.5.6.7.8 010.0.0.255 999.1.1.1 1.2.3", "card 4111 1111 1111 1111 and 4111111111111112 é 4111-1111-1111-1111-",
             "+1 (705) 555-6638 in +49.30.1234567. +12 +5 5555555555555555", None, "", "é😀 +1 (705) 555-6638", "9" * 6000 + " " + "1-" * 3000 + "x@" * 500, LONG + " z@z.zz", "b@c.d" * 3]
    docs = docs_of([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])]).selectExpr("*", "1 as kind", "2 as value")
    got = pii.report(pii.spans(docs)).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        want = brute_pii(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(w[0] == k for w in want) for k in pii.BASE_KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r["spans"].split(","))  or not want
    assert pii.report(pii.spans(docs_of([]))).count() == 0


def test_pii_adds_what_no_strict_format_takes(spark, docs_of, monkeypatch):
    monkeypatch.setattr(pii, "SAMPLE_ROWS", 12)
    cases = [("secret", 'token = "', "9b0b3c6a43eb78aa99cbd7049c572391524f37a8", '"'), ("phone", "call ", "(212) 555-0173", ""), ("card", "card ", "4111.1111.1111.1111", ""),
             ("iban", "", "DE89370400440532013000", ""), ("email", "", "jane.doe (at) example (dot) org", ""), (None, "commit ", "9b0b3c6a43eb78aa99cbd7049c572391524f37a8", ""),
             (None, "order ", "4111111111111113", ""), (None, "", "DE88370400440532013000", ""), (None, "on ", "2024-05-12", ""), (None, "total ", "1.234.567", "")]
    rng = np.random.default_rng(9)
    some = lambda: " ".join(rng.choice(["river", "stone", "of", "the", "under", "light", "and"], 12))
    texts, want = [], {}
    for i, (kind, lead, value, tail) in enumerate(cases * 4):
        before = f"{some()} {lead}"
        texts.append(f"{before}{value}{tail} {some()}")
        want[i] = f"{kind}:{len(before)}:{len(before) + len(value)}" if kind else ""
    got = {r["doc_id"]: r for r in pii.report(pii.spans(docs_of([*enumerate(texts), (900, None), (901, "plain"), *((1000 + i, f"{some()} {some()} {some()}") for i in range(400))]))).collect()}
    assert sum(got[i]["spans"] == w for i, w in want.items()) >= len(want) - 2
    assert all(not got[i]["spans"] for i, w in want.items() if not w)
    assert got[900]["n_spans"] == got[901]["n_added"] == 0
    assert sum(r["n_added"] for r in got.values()) >= 18


def test_pii_overlap_choice_against_brute_force(spark):
    rng = np.random.default_rng(10)
    told, base = [], []
    for row in range(12):
        for g in pii.LOOSE:
            at = 0
            for _ in range(int(rng.integers(0, 8))):
                begin = at + int(rng.integers(0, 6))
                at = begin + int(rng.integers(1, 9))
                told.append((row, g, pii.GENERATORS[g][0], begin, at, float(rng.integers(50, 56)) / 100))
        base += [(row, b := int(rng.integers(0, 40)), b + 3) for _ in range(int(rng.integers(0, 3)))]
    crosses = lambda a, b: a[0] == b[0] and a[-2] < b[-1] and b[-2] < a[-1]
    ends = lambda t: (t[0], t[3], t[4])
    free = [t for t in told if not any(crosses(ends(t), b) for b in base)]
    better = lambda a, b: (-a[5], a[1], a[3]) < (-b[5], b[1], b[3])
    want = {(t[0], t[2], t[3], t[4]) for t in free if not any(o is not t and crosses(ends(o), ends(t)) and better(o, t) for o in free)}
    got = pii.chosen(spark.createDataFrame(told, "row_id long, g int, kind string, begin long, stop long, p double"),
                     spark.createDataFrame(base, "row_id long, begin long, stop long")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_pii_choice_in_a_dense_text(spark):
    """60,000 spans of one text: three generators side by side, a base span over each tenth place."""
    import time

    n, g = 20_000, list(pii.LOOSE)[:3]
    k = pii.F.col("id")
    told = spark.range(n).select(pii.F.lit(1).alias("row_id"), (k * 10).alias("begin")).select(
        "row_id", pii.F.inline(pii.F.array(*[pii.F.struct(pii.F.lit(x).alias("g"), pii.F.lit(pii.GENERATORS[x][0]).alias("kind"), (pii.F.col("begin") + 2 * i).alias("at"), pii.F.lit(0.9 - i / 10).alias("p")) for i, x in enumerate(g)])), )
    told = told.select("row_id", "g", "kind", pii.F.col("at").alias("begin"), (pii.F.col("at") + 4).alias("stop"), "p")
    base = spark.range(0, n, 10).select(pii.F.lit(1).alias("row_id"), (k * 10 + 3).alias("begin"), (k * 10 + 4).alias("stop"))
    start = time.perf_counter()
    found = pii.chosen(told, base).agg(pii.F.count("*"), pii.F.min("begin"), pii.F.sum("begin")).first()
    # the likeliest of three stays; the third crosses no first span, but loses to the second; at base spans only the third is free
    free = sum(10 * x for x in range(n) if x % 10) + sum(10 * x + 4 for x in range(0, n, 10))
    assert (found[0], found[2]) == (n, free)
    assert time.perf_counter() - start < 20


def test_pii_redaction(spark):
    found = spark.createDataFrame([("é call (212) 555-0173 or a@b.c", [(3, 7, 21), (0, 25, 30)])], "text string, spans array<struct<kind: int, begin: long, stop: long>>")
    assert found.select(pii.redact(pii.F.col("text"), pii.F.col("spans"))).first()[0] == "é call [phone] or [email]"


def test_quality_views_and_empty_labels(spark, docs_of):
    rng = np.random.default_rng(3)
    good = [(" ".join(f"w{i}" for i in rng.integers(0, 400, 80)), "s1", "en", 500) for _ in range(80)]
    bad = [("junk!! " * 60, "s2", "en", 400) for _ in range(80)]
    model = quality.co_train([(g, 1) for g in good[:60]] + [(b, 0) for b in bad[:60]], quality.surest_of(good[60:] + bad[60:]))
    assert model.scores(good[70])[0] > 0.5 > model.scores(bad[70])[0]
    assert all(0 <= s <= 1 for s in model.scores((None, None, None, None)))
    assert quality.co_train([], quality.surest_of([])).scores((None, None, None, None)) == (0.5, 0.5, 0.5)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    empty = quality.fit(docs_of(ROWS), labels, docs_of(ROWS))
    assert empty.scores(("x", None, None, 1))[0] == 0.5
