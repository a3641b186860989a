"""Grouped reports over whole tables.  Groups of a null key are left out, as in the tables the reports are compared with."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tandemtext.functions import metrics as M
from tandemtext.functions import text as T
from tandemtext.plans.base import SPLIT_SQL, Registry, audited, audited_sql, lab, num, derived, pairs, pairs_sql, s, sents, space_words
from tandemtext.operators.distributed import quantiles
from tandemtext.session import checkpointed
from tandemtext.sources.tables import label, number, split_label, table

R = Registry()
P, A = f"WITH {pairs_sql()} ", f"WITH {audited_sql()} "
METRICS = ("ratio", "burstiness", "contraction_rate", "human_cliche_density", "ai_cliche_density", "min_cov", "mean_cov", "copy_rate", "sent_count_ratio", "struct_change")
POINTS = (0.10, 0.25, 0.50, 0.75, 0.90)


@R.add(f"{P} SELECT category, count(*) AS n FROM p WHERE category IS NOT NULL GROUP BY category")
def a01_value_counts(spark, d):
    return pairs(spark, d).where("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("n"))


@R.add(f"{P}, c AS (SELECT source_model, count(*) AS n FROM p WHERE source_model IS NOT NULL GROUP BY 1) SELECT source_model, n, round(100.0 * n / sum(n) OVER (), 8) AS share FROM c")
def a02_w06_value_shares(spark, d):
    c = pairs(spark, d).where("source_model IS NOT NULL").groupBy("source_model").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(W.partitionBy()), 8))


@R.add(
    A + "SELECT category, human_source, count(*) AS n, " + ", ".join(f"round(quantile_cont({m}, {q}), 8) AS {m}_p{int(q * 100)}" for m in METRICS for q in POINTS) + " FROM a WHERE category IS NOT NULL AND human_source IS NOT NULL GROUP BY ALL"
)
def a03_percentiles(spark, d):
    a = checkpointed(audited(spark, d).where("category IS NOT NULL AND human_source IS NOT NULL").select("category", "human_source", *METRICS))
    by = ["category", "human_source"]
    q = a.groupBy(*by).agg(F.count("*").alias("n")).join(quantiles(a, by, dict.fromkeys(METRICS, POINTS)), by)
    return q.select("category", "human_source", "n", *[F.round(F.col(m)[i], 8).alias(f"{m}_p{int(p * 100)}") for m in METRICS for i, p in enumerate(POINTS)])


@R.add(A + "SELECT round(quantile_cont(ratio, 0.1), 6) AS p10, round(quantile_cont(ratio, 0.5), 6) AS p50, round(quantile_cont(human_cliche_density, 0.9), 6) AS cliche_p90 FROM a")
def a04_global_quantiles(spark, d):
    q = quantiles(audited(spark, d), [], {"ratio": (0.1, 0.5), "human_cliche_density": (0.9,)})
    return q.select(F.round(F.col("ratio")[0], 6).alias("p10"), F.round(F.col("ratio")[1], 6).alias("p50"), F.round(F.col("human_cliche_density")[0], 6).alias("cliche_p90"))


@R.add(A + "SELECT category, round(quantile_cont(human_cliche_density, 0.5), 6) AS median FROM a WHERE category IS NOT NULL AND contains(human_source, 'hf_dataset_import') GROUP BY category")
def a05_medians(spark, d):
    from tandemtext.operators import rules

    return rules.medians(audited(spark, d), "human_cliche_density").select("category", F.round("median", 6).alias("median"))


@R.add(f"{P} SELECT category, round(avg({space_words('ai')}), 8) AS ai_mean, min({space_words('ai')}) AS ai_min, max({space_words('ai')}) AS ai_max, round(avg({space_words('hu')}), 8) AS human_mean, min({space_words('hu')}) AS human_min, max({space_words('hu')}) AS human_max FROM p WHERE category IS NOT NULL GROUP BY category")
def a06_word_stats(spark, d):
    w = derived(spark, d, "pair_id", "category", T.space_words(F.col("ai")).alias("a"), T.space_words(F.col("hu")).alias("h")).where("category IS NOT NULL").groupBy("category")
    return w.agg(F.round(F.avg("a"), 8).alias("ai_mean"), F.min("a").alias("ai_min"), F.max("a").alias("ai_max"), F.round(F.avg("h"), 8).alias("human_mean"), F.min("h").alias("human_min"), F.max("h").alias("human_max"))


@R.add(f"{P} SELECT round(avg(sbert_similarity), 6) AS mean, round(quantile_cont(sbert_similarity, 0.5), 6) AS median, min(sbert_similarity) AS least, max(sbert_similarity) AS most FROM p")
def a07_score_stats(spark, d):
    c = "sbert_similarity"
    p = checkpointed(derived(spark, d, "pair_id", c))
    median = quantiles(p, [], {c: (0.5,)}).select(F.round(F.col(c)[0], 6).alias("median"))
    return p.agg(F.round(F.avg(c), 6).alias("mean"), F.min(c).alias("least"), F.max(c).alias("most")).crossJoin(F.broadcast(median))


_STAGES = "SELECT *, 'before' AS stage FROM a UNION ALL SELECT *, 'after' FROM a WHERE ratio BETWEEN 0.7 AND 0.95"


def _means_and_medians(df, by: str, metrics):
    medians = quantiles(df, [by], dict.fromkeys(metrics, (0.5,))).select(by, *[F.round(F.col(m)[0], 8).alias(f"{m}_median") for m in metrics])
    return df.groupBy(by).agg(*[F.round(F.avg(m), 8).alias(f"{m}_mean") for m in metrics]).join(medians, by)


@R.add(A + f", s AS ({_STAGES}) SELECT stage, " + ", ".join(f"round(avg({m}), 8) AS {m}_mean, round(quantile_cont({m}, 0.5), 8) AS {m}_median" for m in METRICS[:5]) + " FROM s GROUP BY stage")
def a08_before_after(spark, d):
    a = audited(spark, d).select("pair_id", *METRICS[:5])
    both = a.withColumn("stage", F.explode(F.when(F.col("ratio").between(0.7, 0.95), F.array(F.lit("before"), F.lit("after"))).otherwise(F.array(F.lit("before")))))
    return _means_and_medians(checkpointed(both), "stage", METRICS[:5])


@R.add(A + "SELECT count(*) FILTER (WHERE ratio < 0.7) AS short, round(avg(coalesce((ratio < 0.7)::INT, 0)), 6) AS short_share, count(*) FILTER (WHERE copy_rate > 0.75) AS copied, round(avg(coalesce((copy_rate > 0.75)::INT, 0)), 6) AS copied_share FROM a")
def a10_rule_shares(spark, d):
    share = lambda c: F.round(F.avg(F.coalesce(c.cast("int"), F.lit(0))), 6)
    short, copied = F.col("ratio") < 0.7, F.col("copy_rate") > 0.75
    return audited(spark, d).agg(F.count_if(short).alias("short"), share(short).alias("short_share"), F.count_if(copied).alias("copied"), share(copied).alias("copied_share"))


@R.add(f"{P}, w AS (SELECT category, human_source, {space_words('hu')} / greatest({space_words('ai')}, 1) AS r FROM p WHERE category IS NOT NULL AND human_source IS NOT NULL) SELECT category, human_source, count(*) AS n, round(avg(r), 8) AS mean_ratio, round(quantile_cont(r, 0.5), 8) AS p50, round(quantile_cont(r, 0.1), 8) AS p10, count(*) FILTER (WHERE r < 0.7) AS short FROM w GROUP BY ALL")
def a11_length_ratio_audit(spark, d):
    """Length ratios per category and source; the flagship query."""
    r = derived(spark, d, "pair_id", "category", "human_source", (T.space_words(F.col("hu")) / F.greatest(T.space_words(F.col("ai")), F.lit(1))).alias("r")).where("category IS NOT NULL AND human_source IS NOT NULL")
    r, by = checkpointed(r), ["category", "human_source"]
    q = quantiles(r, by, {"r": (0.5, 0.1)}).select(*by, F.round(F.col("r")[0], 8).alias("p50"), F.round(F.col("r")[1], 8).alias("p10"))
    return r.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("r"), 8).alias("mean_ratio"), F.count_if(F.col("r") < 0.7).alias("short")).join(q, by)


@R.add(A + "SELECT split, " + ", ".join(f"count(*) FILTER (WHERE category = '{c}') AS {c}" for c in T.CATEGORIES) + " FROM a WHERE split IS NOT NULL GROUP BY split")
def a12_pivot(spark, d):
    return audited(spark, d).where("split IS NOT NULL").groupBy("split").pivot("category", list(T.CATEGORIES)).agg(F.count(F.lit(1))).na.fill(0)


@R.add(A + ", x AS (SELECT category, 100.0 * avg(contains(coalesce(human_source, ''), 'llm_regenerated')::INT) AS share FROM a WHERE category IS NOT NULL GROUP BY category) SELECT category, round(share, 8) AS share, CASE WHEN share <= 15.01 THEN 'PASS' ELSE 'EXCEEDS' END AS status FROM x")
def a13_source_share(spark, d):
    from tandemtext.operators import rules

    g = audited(spark, d).where("category IS NOT NULL").groupBy("category").agg((F.lit(100.0) * F.avg(rules.regenerated().cast("int"))).alias("share"))
    return g.select("category", F.round("share", 8).alias("share"), F.when(F.col("share") <= 15.01, "PASS").otherwise("EXCEEDS").alias("status"))


@R.add(f"{P}, t AS (SELECT 'ai' AS side, unnest(regexp_extract_all(lower(ai), {s(T.WORD)})) AS term FROM p UNION ALL SELECT 'human', unnest(regexp_extract_all(lower(hu), {s(T.WORD)})) FROM p) SELECT term, count(*) AS n FROM t GROUP BY term HAVING count(*) >= 20")
def a17_term_counts(spark, d):
    both = F.concat(F.coalesce(T.words(F.col("ai")), F.array().cast("array<string>")), F.coalesce(T.words(F.col("hu")), F.array().cast("array<string>")))
    return pairs(spark, d).select(F.explode(both).alias("term")).groupBy("term").agg(F.count("*").alias("n")).where("n >= 20")


@R.add(f"{P} SELECT count(DISTINCT category) AS categories, count(DISTINCT human_source) AS sources, count(DISTINCT contributor) AS contributors FROM p")
def a18_distinct_values(spark, d):
    return pairs(spark, d).agg(F.count_distinct("category").alias("categories"), F.count_distinct("human_source").alias("sources"), F.count_distinct("contributor").alias("contributors"))


@R.add(f"WITH c AS (SELECT DISTINCT cache_id, {lab('category')} AS category, \"AI Text\" AS ai FROM regenerated_cache) SELECT category, count(*) AS done, count(DISTINCT ai) AS texts FROM c WHERE category IS NOT NULL GROUP BY category")
def a19_done_stats(spark, d):
    c = table(spark, d, "regenerated_cache").select("cache_id", label("category").alias("category"), F.xxhash64("AI Text").alias("ai"), F.col("AI Text").isNotNull().alias("has")).distinct()
    return c.where("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("done"), F.count_distinct(F.when(F.col("has"), F.col("ai"))).alias("texts"))


_EVAL = ("ratio", "burstiness", "contraction_rate", "human_cliche_density", "copy_rate", "mean_cov", "sent_count_ratio")


@R.add(A + "SELECT split, " + ", ".join(f"round(avg({m}), 8) AS {m}_mean, round(quantile_cont({m}, 0.5), 8) AS {m}_median" for m in _EVAL) + " FROM a WHERE split IN ('validation', 'test') GROUP BY split")
def a20_evaluation(spark, d):
    return _means_and_medians(checkpointed(audited(spark, d).where("split IN ('validation', 'test')").select("split", *_EVAL)), "split", _EVAL)


_MIX = {"0.70-0.80": 37.0, "0.80-0.90": 33.0, "0.90-0.95": 30.0}
_BIN = "CASE WHEN ratio < 0.7 THEN '<0.70' WHEN ratio < 0.8 THEN '0.70-0.80' WHEN ratio < 0.9 THEN '0.80-0.90' WHEN ratio <= 0.95 THEN '0.90-0.95' ELSE '>0.95' END"


@R.add(
    A + f", b AS (SELECT {_BIN} AS bin FROM a), t(bin, target) AS (VALUES ('<0.70', 0.0), ('0.70-0.80', 37.0), ('0.80-0.90', 33.0), ('0.90-0.95', 30.0), ('>0.95', 0.0)), c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin) "
    "SELECT t.bin, target::DOUBLE AS target, coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / (SELECT count(*) FROM b), 8) AS share FROM t LEFT JOIN c USING (bin)"
)
def a21_ratio_mix(spark, d):
    a = audited(spark, d)
    c = a.groupBy(M.ratio_bin(F.col("ratio")).alias("bin")).agg(F.count("*").alias("n"))
    goal = spark.createDataFrame([(b, _MIX.get(b, 0.0)) for b in M.RATIO_BINS], "bin string, target double")
    total = c.agg(F.sum("n").alias("total"))
    j = F.broadcast(goal).join(c, "bin", "left").crossJoin(F.broadcast(total))
    return j.select("bin", "target", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.lit(100.0) * F.coalesce("n", F.lit(0)) / F.col("total"), 8).alias("share"))


@R.add(f"{P}, s AS (SELECT unnest({sents('hu')}) AS sentence FROM p) SELECT count(*) AS sentences, count(DISTINCT sentence) AS distinct_sentences FROM s")
def a22_u06_sentence_counts(spark, d):
    """Distinct sentences are counted by 128 bits of hash, in two steps, so sentences are not shuffled."""
    sent = pairs(spark, d).select(F.explode(T.sentences(F.col("hu"))).alias("x")).select(F.xxhash64("x").alias("a"), F.xxhash64(F.reverse("x")).alias("b"))
    return sent.groupBy("a", "b").agg(F.count("*").alias("n")).agg(F.sum("n").alias("sentences"), F.count("*").alias("distinct_sentences"))


@R.add(f"{P}, t AS (SELECT category, unnest(regexp_extract_all(lower(hu), {s(T.WORD)})) AS w FROM p WHERE category IS NOT NULL) SELECT category, count(*) AS tokens, count(DISTINCT w) AS types, round(count(DISTINCT w) / count(*), 6) AS type_token FROM t GROUP BY category")
def x_lexical_diversity(spark, d):
    t = pairs(spark, d).where("category IS NOT NULL").select("category", F.explode(T.words(F.col("hu"))).alias("w")).groupBy("category", "w").agg(F.count("*").alias("n"))
    return t.groupBy("category").agg(F.sum("n").alias("tokens"), F.count("*").alias("types"), F.round(F.count("*") / F.sum("n"), 6).alias("type_token"))


@R.add(f"{P}, c AS (SELECT category, count(*) AS n FROM p WHERE category IS NOT NULL GROUP BY category) SELECT category, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM c")
def x_category_weights(spark, d):
    c = pairs(spark, d).where("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("n"))
    every = W.partitionBy()
    return c.withColumn("weight", F.round(F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")), 6))
