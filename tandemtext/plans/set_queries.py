"""Joins, unions, deduplication, ranking, sampling and splitting over whole tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tandemtext.functions import text as T
from tandemtext.operators import sampling as S
from tandemtext.operators import upsert as U
from tandemtext.plans.base import Registry, audited, audited_sql, collapse, lab, num, pairs, pairs_sql, s, space_words, strip, texts
from tandemtext.sources.tables import label, number, once, table

R = Registry()
P, A = f"WITH {pairs_sql()} ", f"WITH {audited_sql()} "


@R.add(f"{P} SELECT pair_id, sbert_similarity, tfidf_similarity, nli_entailment_prob FROM p")
def j01_score_merge(spark, d):
    """Three keyed score tables joined to the pairs."""
    p = pairs(spark, d)
    out = p.select("pair_id")
    for c in ("sbert_similarity", "tfidf_similarity", "nli_entailment_prob"):
        out = out.join(p.select("pair_id", c).where(F.col(c).isNotNull()), "pair_id", "left")
    return out


@R.add(f"{P}, k AS (SELECT DISTINCT pair_id FROM train_normalized) SELECT p.pair_id FROM p SEMI JOIN k USING (pair_id)")
def j07_keep_keys(spark, d):
    return pairs(spark, d).select("pair_id").join(table(spark, d, "train_normalized").select("pair_id").distinct(), "pair_id", "left_semi")


_UP = f"""WITH {pairs_sql('train_normalized')}, b AS (SELECT pair_id, ai, hu, {strip('ai')} AS k FROM p),
n AS (SELECT {strip('"AI Text"')} AS k, max(cache_id) AS cache_id FROM regenerated_cache WHERE "AI Text" IS NOT NULL GROUP BY 1),
v AS (SELECT n.k, any_value(c."New Human Text") AS hu FROM n JOIN regenerated_cache c USING (cache_id) GROUP BY n.k), l AS (SELECT k, max(pair_id) AS pair_id FROM b WHERE k IS NOT NULL GROUP BY k)
SELECT b.pair_id, b.ai, CASE WHEN v.k IS NOT NULL THEN v.hu ELSE b.hu END AS hu, CASE WHEN v.k IS NOT NULL THEN 'updated' ELSE 'kept' END AS origin FROM b LEFT JOIN l ON l.pair_id = b.pair_id LEFT JOIN v ON v.k = l.k
UNION ALL SELECT NULL, v.k, v.hu, 'appended' FROM v WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.k = v.k)"""


@R.add(_UP)
def j08_w03_u02_upsert(spark, d):
    base = pairs(spark, d, "train_normalized").select("pair_id", "ai", "hu")
    news = table(spark, d, "regenerated_cache").select(F.col("AI Text").alias("ai"), F.col("New Human Text").alias("hu"), "cache_id")
    return U.upsert(base, news, "ai", ["hu"], "pair_id", "cache_id")


@R.add(f"{P} SELECT pair_id, source_model FROM p WHERE source_model IS DISTINCT FROM 'tern_large' UNION ALL SELECT pair_id, 'tern_large' AS source_model FROM (SELECT DISTINCT pair_id FROM regenerated_cache WHERE {lab('source_model')} = 'tern_large')")
def f26_replace_source(spark, d):
    news = table(spark, d, "regenerated_cache").where(label("source_model") == "tern_large").select("pair_id").distinct().withColumn("source_model", F.lit("tern_large"))
    return U.replace_source(pairs(spark, d).select("pair_id", "source_model"), news, "source_model", "tern_large")


@R.add(A + ", x AS (SELECT category, human_source, count(*) AS before, count(*) FILTER (WHERE ratio BETWEEN 0.7 AND 0.95) AS after FROM a WHERE category IS NOT NULL AND human_source IS NOT NULL GROUP BY ALL) SELECT category, human_source, before, after, round(100.0 * after / before, 2) AS retention FROM x")
def j11_a09_retention(spark, d):
    a = audited(spark, d).where("category IS NOT NULL AND human_source IS NOT NULL")
    g = a.groupBy("category", "human_source").agg(F.count("*").alias("before"), F.count_if(F.col("ratio").between(0.7, 0.95)).alias("after"))
    return g.withColumn("retention", F.round(F.lit(100.0) * F.col("after") / F.col("before"), 2))


@R.add(f"{P}, k AS (SELECT pair_id, row_number() OVER (PARTITION BY lower({collapse('ai')}) || '|||' || lower({collapse('hu')}) ORDER BY pair_id) AS r FROM p) SELECT pair_id FROM k WHERE r = 1")
def u03_w02_dedup_pairs(spark, d):
    """First of each normalised pair; keys are grouped by hash, so texts are not shuffled."""
    p = pairs(spark, d).select("pair_id", F.sha2(F.concat_ws("|||", T.normal_form(F.col("ai")), T.normal_form(F.col("hu"))), 256).alias("key"))
    return p.groupBy("key").agg(F.min("pair_id").alias("pair_id")).select("pair_id")


@R.add(f"{P}, k AS (SELECT pair_id, row_number() OVER (PARTITION BY lower({collapse('hu')}) ORDER BY pair_id) AS r FROM p) SELECT pair_id FROM k WHERE r = 1")
def u04_dedup_target(spark, d):
    p = pairs(spark, d).select("pair_id", F.sha2(T.normal_form(F.col("hu")), 256).alias("key"))
    return p.groupBy("key").agg(F.min("pair_id").alias("pair_id")).select("pair_id")


@R.add(f"{P}, k AS (SELECT pair_id, row_number() OVER (PARTITION BY coalesce(ai, '') ORDER BY pair_id) AS r FROM p) SELECT pair_id FROM k WHERE r = 1")
def u05_dedup_source(spark, d):
    p = pairs(spark, d).select("pair_id", F.sha2(F.coalesce(F.col("ai"), F.lit("")), 256).alias("key"))
    return p.groupBy("key").agg(F.min("pair_id").alias("pair_id")).select("pair_id")


@R.add(f'SELECT pair_id, \'scored\' AS origin FROM (SELECT DISTINCT pair_id FROM final_scored) UNION ALL SELECT pair_id, \'train\' FROM (SELECT DISTINCT pair_id FROM train_normalized)')
def u01_union_all(spark, d):
    a = table(spark, d, "final_scored").select("pair_id").distinct().withColumn("origin", F.lit("scored"))
    return a.unionByName(table(spark, d, "train_normalized").select("pair_id").distinct().withColumn("origin", F.lit("train")))


@R.add(f"{P} SELECT pair_id, sbert_similarity AS score, NULL::VARCHAR AS reviewer FROM p UNION ALL SELECT pair_id, NULL, reviewer FROM pair_review")
def u02_union_missing(spark, d):
    a = pairs(spark, d).select("pair_id", F.col("sbert_similarity").alias("score"))
    return a.unionByName(table(spark, d, "pair_review").select("pair_id", "reviewer"), allowMissingColumns=True)


@R.add(f"{P} SELECT pair_id FROM p WHERE NOT coalesce(sbert_similarity >= 0.7, false)")
def u07_complement(spark, d):
    return pairs(spark, d).where(~F.coalesce(F.col("sbert_similarity") >= 0.7, F.lit(False))).select("pair_id")


# The order of the samples: md5 of key and seed.
def _h(c: str, seed: int = 42) -> str:
    return f"md5({c}::VARCHAR || '|{seed}')"


@R.add(f"SELECT doc_id FROM documents ORDER BY {_h('doc_id')}, doc_id LIMIT 200")
def l05_seeded_sample(spark, d):
    return S.sample(texts(spark, d).select("doc_id"), "doc_id", 200)


@R.add("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100")
def l04_head(spark, d):
    return texts(spark, d).select("doc_id").orderBy("doc_id").limit(100)


@R.add(f"{P}, r AS (SELECT pair_id, category, row_number() OVER (PARTITION BY category ORDER BY {_h('pair_id')}, pair_id) AS rank, count(*) OVER (PARTITION BY category) AS size FROM p) SELECT pair_id FROM r WHERE rank <= round(0.3 * size)")
def l06_sample_fraction(spark, d):
    r = S.ranked(pairs(spark, d).select("pair_id", "category"), "pair_id", ["category"])
    return r.where(F.col("rank") <= F.round(F.lit(0.3) * F.col("size"))).select("pair_id")


_SPLIT = "SELECT pair_id, CASE WHEN size < 10 OR rank <= round(size * 0.8) THEN 'train' WHEN rank <= round(size * 0.9) THEN 'validation' ELSE 'test' END AS split FROM r"


@R.add(f"{P}, r AS (SELECT pair_id, row_number() OVER (PARTITION BY category ORDER BY {_h('pair_id')}, pair_id) AS rank, count(*) OVER (PARTITION BY category) AS size FROM p) {_SPLIT}")
def l10_stratified_split(spark, d):
    return S.split(pairs(spark, d).select("pair_id", "category"), "pair_id", ["category"]).select("pair_id", "split")


@R.add(f"{P}, r AS (SELECT pair_id, row_number() OVER (ORDER BY {_h('pair_id')}, pair_id) AS rank, count(*) OVER () AS size FROM p) {_SPLIT}")
def l09_random_split(spark, d):
    return S.split(pairs(spark, d).select("pair_id"), "pair_id", []).select("pair_id", "split")


@R.add(f"SELECT doc_id, row_number() OVER (ORDER BY {_h('doc_id', 7)}, doc_id) <= 50 AS held_out FROM documents")
def l11_holdout(spark, d):
    return S.ranked(texts(spark, d).select("doc_id"), "doc_id", [], 7).select("doc_id", (F.col("rank") <= 50).alias("held_out"))


@R.add(f"SELECT doc_id, row_number() OVER (ORDER BY {_h('doc_id', 3)}, doc_id) AS place FROM documents")
def l12_shuffle(spark, d):
    return S.ranked(texts(spark, d).select("doc_id"), "doc_id", [], 3).select("doc_id", F.col("rank").alias("place"))


@R.add(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY {_h('doc_id')}, doc_id) AS k FROM documents) WHERE k <= 20")
def l13_w04_quota_stop(spark, d):
    r = S.ranked(table(spark, d, "documents").select("doc_id", "source"), "doc_id", ["source"])
    return r.where("rank <= 20").select("doc_id")


@R.add()
def l08_proportional_quota(spark, d):
    return S.quota_draw(pairs(spark, d).select("pair_id", "category"), "pair_id", "category", 200)


_MIX = {"0.70-0.80": 0.37, "0.80-0.90": 0.33, "0.90-0.95": 0.30}
_BINS = "CASE WHEN ratio < 0.7 THEN '<0.70' WHEN ratio < 0.8 THEN '0.70-0.80' WHEN ratio < 0.9 THEN '0.80-0.90' WHEN ratio <= 0.95 THEN '0.90-0.95' ELSE '>0.95' END"


@R.add(
    A + f", b AS (SELECT pair_id, {_BINS} AS bin FROM a), n AS (SELECT count(*) FILTER (WHERE bin IN {tuple(_MIX)}) AS core FROM b), r AS (SELECT pair_id, bin, row_number() OVER (PARTITION BY bin ORDER BY {_h('pair_id')}, pair_id) AS rank FROM b) "
    "SELECT pair_id, bin FROM r, n WHERE rank <= CASE bin " + " ".join(f"WHEN '{b}' THEN round(core * {v})" for b, v in _MIX.items()) + " ELSE 0 END"
)
def l07_mix_resample(spark, d):
    from tandemtext.functions import metrics as M

    b = audited(spark, d).select("pair_id", M.ratio_bin(F.col("ratio")).alias("bin"))
    core = b.agg(F.count_if(F.col("bin").isin(*_MIX)).alias("core"))
    want = F.lit(0.0)
    for name, share in _MIX.items():
        want = F.when(F.col("bin") == name, F.round(F.col("core") * F.lit(share))).otherwise(want)
    return S.ranked(b, "pair_id", ["bin"]).crossJoin(F.broadcast(core)).where(F.col("rank") <= want).select("pair_id", "bin")


@R.add(
    f"WITH t AS (SELECT pair_id, any_value({lab('category')}) AS category, coalesce(contains(any_value({lab('human_source')}), 'llm_regenerated'), false) AS regen, any_value({num('quality_score')}) AS q FROM train_filtered GROUP BY pair_id), "
    "k AS (SELECT pair_id, category, regen, row_number() OVER (PARTITION BY category, regen ORDER BY q DESC NULLS LAST, pair_id) AS r, count(*) FILTER (WHERE NOT regen) OVER (PARTITION BY category) AS own FROM t WHERE category IS NOT NULL) "
    "SELECT pair_id FROM k WHERE NOT regen OR r <= floor(0.15 / 0.85 * own)"
)
def w01_source_cap(spark, d):
    """Regenerated pairs up to 15 % of a category, best quality first."""
    from tandemtext.operators.distributed import ranked_in
    from tandemtext.operators.rules import regenerated

    t = table(spark, d, "train_filtered").select("pair_id", label("category").alias("category"), label("human_source").alias("human_source"), number("quality_score").alias("q"))
    t = once(t.withColumn("regen", regenerated()), "pair_id").where("category IS NOT NULL")
    # One row per category.
    most = t.groupBy("category").agg(F.floor(F.lit(0.15 / 0.85) * F.count_if(~F.col("regen"))).alias("most"))
    ranked = ranked_in(t.where("regen"), "rank", ["category"], "pair_id", F.col("q").desc_nulls_last(), F.col("pair_id"))
    kept = ranked.join(F.broadcast(most), "category").where("rank <= most").select("pair_id")
    return t.where("NOT regen").select("pair_id").unionByName(kept)


@R.add(f"{P} SELECT pair_id, round(avg(sbert_similarity) OVER (), 6) AS mean, round(coalesce(sbert_similarity, avg(sbert_similarity) OVER ()), 6) AS filled FROM p")
def w07_mean_fill(spark, d):
    p = pairs(spark, d).select("pair_id", "sbert_similarity")
    mean = p.agg(F.avg("sbert_similarity").alias("mean"))
    return p.crossJoin(F.broadcast(mean)).select("pair_id", F.round("mean", 6).alias("mean"), F.round(F.coalesce("sbert_similarity", "mean"), 6).alias("filled"))
