"""The registered queries of the text operators, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
from pyspark.sql import functions as F

from ridgeline.llm import decontaminate, exact_dedup, language_id, license_scan, line_dedup, packing, pfor, pii, ranked_search, simhash, toxicity, whitening
from ridgeline.llm import quality as quality_model
from ridgeline.llm.common import documents, held_out

WORD_TOKENS, BYTE_TOKENS = "word_bpe_49k.json", "byte_bpe_50k.json"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(documents(spark, sf_dir))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(license_scan.scan(documents(spark, sf_dir)))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = held_out(F.col("doc_id"), 3, 1)
    model = language_id.fit(docs.where(~held))
    found = docs.select("doc_id", held.alias("held_out"), language_id.identify(model, F.col("text")).alias("f"))
    return found.select("doc_id", "held_out", F.col("f.lang").alias("lang_pred"), F.col("f.score").alias("score"), F.col("f.rejected").alias("rejected"), F.lit(model.levelled).alias("levelled"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.with_removal_spans(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = held_out(F.col("doc_id"), 5, 0)
    model = quality_model.fit(docs, labels.where(~held), docs.where(~held))
    found = docs.select("doc_id", held.alias("held_out"), quality_model.quality(model, *map(F.col, ("text", "source", "lang", "n_chars"))).alias("f"))
    return found.select("doc_id", "held_out", "f.score", "f.text_score", "f.meta_score", (F.col("f.score") >= 0.5).cast("int").alias("predicted"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfor.read_documents(pfor.token_shards(documents(spark, sf_dir), public_tokenizers.path(WORD_TOKENS)))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = held_out(F.col("doc_id"), 5, 0)
    model = toxicity.fit(docs, labels.where(~held))
    found = docs.select("doc_id", held.alias("held_out"), toxicity.toxicity(model, F.col("text")).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path(BYTE_TOKENS), with_ids=False).drop("ids")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.spans(documents(spark, sf_dir)))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.deduplicated(documents(spark, sf_dir))
    return kept.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_simhash, op2_exact_dedup, op3_license_scan, op4_language_id, op5_decontaminate, op6_quality, op7_token_files, op8_toxicity,
        op9_packing, op10_pii, op11_line_dedup, op12_whitening, op13_ranked_search)}


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WORDS = f"regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP2 = f"""
    with d as (select doc_id, sha256({LOWER}) as text_sha256 from documents)
    select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
           doc_id = max(doc_id) over w as kept, text_sha256
    from d window w as (partition by text_sha256)"""

TEMPLATES = ", ".join(f"({k}, '{label}', {k < len(license_scan.BASE)}, '{text}')" for k, (label, text) in enumerate(license_scan.BASE + license_scan.NOTICES))

OP3 = f"""
    with d as (select doc_id, row_number() over () as rid, {WORDS} as ws from documents),
    p as (select rid, unnest(ws) as w1, unnest(list_concat(ws[2:], [null])) as w2, unnest(range(len(ws))) as p from d),
    t0 as (select tmpl, label, base, string_split(txt, ' ') as ws from (values {TEMPLATES}) as v(tmpl, label, base, txt)),
    t as (select tmpl, label, base, len(ws) - 1 as pairs, unnest(ws[:len(ws) - 1]) as w1, unnest(ws[2:]) as w2, unnest(range(len(ws) - 1)) as t from t0),
    hits as (select rid, tmpl, label, base, pairs, p, t, p - t as diagonal from p join t using (w1, w2)),
    marked as (select *, case when diagonal - lag(diagonal) over o <= case when base then 0 else {license_scan.BAND} end then 0 else 1 end as fresh
               from hits window o as (partition by rid, tmpl order by diagonal, p)),
    banded as (select *, sum(fresh) over (partition by rid, tmpl order by diagonal, p) as band,
                      cast(floor(pairs * {license_scan.STRETCH}) as int) - 1 as reach from marked),
    windows as (select *, count(distinct t) over w as held, max(p) over w + 1 as last
                from banded window w as (partition by rid, tmpl, band order by p range between current row and reach following)),
    best as (select *, held / pairs as coverage, row_number() over (partition by rid, tmpl, band order by held desc, last - p, p) as k from windows),
    spans as (select *, p as first, coverage >= case when base then 1 else {license_scan.COVERED} end as fits from best where k = 1),
    found as (select rid, count(*) filter (fits and base) as n_base, min(first) filter (fits and base) as first_word,
                     max(first) filter (fits and base) as last_word,
                     string_agg(distinct label, ',' order by label) filter (fits and base) as base_labels,
                     string_agg(distinct label, ',' order by label) filter (fits) as labels, max(coverage) as score
              from spans group by rid)
    select doc_id, len(ws) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels,
           coalesce(labels, '') as labels, coalesce(score, 0.0) as score
    from d left join found using (rid)"""

OP5 = f"""
    with d as (select doc_id, row_number() over () as rid, {WORDS} as ws from documents),
    b as (select item_id, {WORDS} as ws from benchmark),
    win as (select distinct item_id, k, array_to_string(ws[i + 1:i + k], ' ') as phrase
            from (select item_id, ws, least(10, len(ws)) as k, unnest(range(greatest(len(ws) - 9, 1))) as i from b where len(ws) > 0)),
    sizes as (select distinct k from win),
    dw as (select rid, k, i, array_to_string(ws[i + 1:i + k], ' ') as phrase
           from (select rid, ws, k, unnest(range(len(ws) - k + 1)) as i from d, sizes where len(ws) >= k)),
    hits as (select rid, i, k, item_id from dw join win using (k, phrase)),
    hit_words as (select rid, count(distinct w) as n_hit from (select rid, unnest(range(i, i + k)) as w from hits) group by rid),
    items as (select rid, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hits group by rid)
    select doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
           sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from d left join hit_words using (rid) left join items using (rid)"""


OP11 = """
    with d as (select doc_id, row_number() over () as rid, string_split(coalesce(text, ''), chr(10)) as ls from documents),
    l as (select doc_id, rid, unnest(ls) as line, unnest(range(len(ls))) as i from d),
    k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
    hot as (select key, max(doc_id) as keeper from k where length(key) >= 20 group by key having count(distinct rid) >= 3),
    f as (select rid, line, i, keeper is not null and doc_id is distinct from keeper as gone from k left join hot using (key))
    select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
           sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
    from f join d using (rid) group by rid"""

TERMS = f"regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP13 = f"""
    with b as (select item_id, row_number() over () as item, {TERMS} as ts from benchmark),
    q as (select distinct item, unnest(ts) as term from b),
    d as (select doc_id, row_number() over () as rid, {TERMS} as ts from documents),
    size as (select doc_id, rid, len(ts) as n from d where len(ts) > 0),
    total as (select count(*) as docs, cast(sum(n) as bigint) as terms from size),
    tf as (select rid, term, count(*) as tf from (select rid, unnest(ts) as term from d) where term in (select term from q) group by all),
    weight as (select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w from tf, total group by term, docs),
    s as (select item, rid, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms))))) as bigint) as score
          from q join tf using (term) join weight using (term) join size using (rid), total group by item, rid),
    ranked as (select item, doc_id, score, row_number() over (partition by item order by score desc, doc_id) as k from s join size using (rid) where score > 0)
    select item_id, cast(k as int) as rank, doc_id, score from ranked join b using (item) where k <= 50"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2, "op3_license_scan": OP3, "op5_decontaminate": OP5, "op11_line_dedup": OP11, "op13_ranked_search": OP13}
