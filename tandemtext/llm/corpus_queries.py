"""Queries of ranking, sampling and capping, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemtext.llm import capping, quota_sampling, ranking
from tandemtext.session import checkpointed
from tandemtext.sources.tables import label, number, once, table

SCORES = {"sbert_similarity": 1, "nli_entailment_prob": 1, "tfidf_similarity": 1}


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "final_scored").select("pair_id", *[ranking.fraction(c).alias(c) for c in SCORES])


def p1_ranking(spark: SparkSession, d: str) -> DataFrame:
    return ranking.principal_ranking(_scores(spark, d), "pair_id", SCORES)


def p1_projection(spark: SparkSession, d: str) -> DataFrame:
    return p1_ranking(spark, d).select("pair_id", F.round("projection", 6).alias("projection"))


def p1_loadings(spark: SparkSession, d: str) -> DataFrame:
    """Loadings of the first component, and whether each points in its score's declared direction."""
    rows = checkpointed(once(_scores(spark, d), "pair_id"))
    load, _, _ = ranking.loadings(ranking.with_midranks(rows, "pair_id", list(SCORES)), list(SCORES.values()))
    return spark.createDataFrame([(c, round(v, 6), k, v * k >= 0) for (c, k), v in zip(SCORES.items(), load)], "score string, loading double, direction int, agrees boolean")


def p1_midranks(spark: SparkSession, d: str) -> DataFrame:
    rows = checkpointed(once(_scores(spark, d), "pair_id"))
    ranks = ranking.with_midranks(rows, "pair_id", list(SCORES))
    return ranks.select("pair_id", *[F.round(f"u{i}", 6).alias(f"{c}_rank") for i, c in enumerate(SCORES)])


def _sampled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    goals = table(spark, d, "sample_targets")
    bounds = [(r["bucket"], r["lower_bound"], r["upper_bound"]) for r in goals.where("dimension = 'ratio'").collect()]
    ratios = table(spark, d, "audit_scores").select("pair_id", number("ratio").alias("audit_ratio"))
    ratios = ratios.groupBy("pair_id").agg(F.max("audit_ratio").alias("audit_ratio"))
    pairs = once(table(spark, d, "train_filtered").select("pair_id", label("category").alias("category")), "pair_id")
    joined = pairs.join(ratios, "pair_id", "left")
    dims = {"category": F.col("category"), "ratio": quota_sampling.ratio_bucket(F.col("audit_ratio"), bounds)}
    return quota_sampling.quota_sample(joined, "pair_id", dims, quota_sampling.read_targets(goals))


def p6_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d)[0]


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d)[1]


def p6_available(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d)[1].select("dimension", "bucket", "available")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    # One row per category: a fixed small table.
    caps = table(spark, d, "source_caps").groupBy(label("category").alias("cap_category")).agg(F.max("max_share").alias("max_share"))
    rows = table(spark, d, "train_filtered").select("pair_id", "category", "human_source", "quality_score")
    rows = rows.join(F.broadcast(caps), label("category") == F.col("cap_category"), "left")
    gone = capping.over_limit(rows, "pair_id", F.col("cap_category"), label("human_source"), "quality_score", F.col("max_share"))
    return gone.select("pair_id")


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """What stays, per category and source."""
    gone = p7_found(spark, d)
    rows = once(table(spark, d, "train_filtered").select("pair_id", label("category").alias("category"), label("human_source").alias("human_source")), "pair_id")
    return rows.join(gone, "pair_id", "left_anti").groupBy("category", "human_source").agg(F.count("*").alias("kept"))


QUERIES = {"p1_ranking": p1_ranking, "p1_midranks": p1_midranks, "p1_projection": p1_projection, "p1_loadings": p1_loadings, "p6_sample": p6_sample, "p6_report": p6_report, "p6_available": p6_available, "p7_found": p7_found, "p7_kept": p7_kept}

_LABEL = "nullif(replace(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '-', '_'), '')"


def _fraction(c: str) -> str:
    return f"CASE WHEN {c}::VARCHAR = 'nan' THEN NULL WHEN {c} BETWEEN 0 AND 1 THEN {c} WHEN {c} > 1 AND {c} <= 100 THEN {c} / 100 END"


def _midrank(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN round((rank() OVER (PARTITION BY {c} IS NULL ORDER BY {c}) - 1 + count(*) OVER (PARTITION BY {c}) / 2.0) / count({c}) OVER (), 6) END AS {c}_rank"


def _exact_midrank(c: str, name: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY {c} IS NULL ORDER BY {c}) - 1 + count(*) OVER (PARTITION BY {c}) / 2.0) / count({c}) OVER () END AS {name}"


_PCA = f"""WITH RECURSIVE t AS (SELECT DISTINCT pair_id, {', '.join(f'{_fraction(c)} AS {c}' for c in SCORES)} FROM final_scored),
m AS (SELECT pair_id, {', '.join(_exact_midrank(c, n) for c, n in zip(SCORES, 'abc'))} FROM t), u AS (SELECT pair_id, coalesce(a, 0.5) AS a, coalesce(b, 0.5) AS b, coalesce(c, 0.5) AS c FROM m),
r AS (SELECT corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM u),
p(i, x, y, z) AS (SELECT 0, 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT i + 1, (x + ab * y + ac * z) / s, (ab * x + y + bc * z) / s, (ac * x + bc * y + z) / s FROM (SELECT p.*, r.*, sqrt((x + ab * y + ac * z) ** 2 + (ab * x + y + bc * z) ** 2 + (ac * x + bc * y + z) ** 2) AS s FROM p, r) WHERE i < 300),
v AS (SELECT x, y, z FROM p WHERE i = 300)"""


_P7 = f"""
WITH t AS (
  SELECT pair_id, any_value({_LABEL.format(c="category")}) AS category, any_value({_LABEL.format(c="human_source")}) AS source,
         any_value(CASE WHEN quality_score::VARCHAR IN ('nan', 'inf', '-inf') THEN NULL ELSE quality_score END) AS q
  FROM train_filtered GROUP BY pair_id),
n AS (SELECT category, count(*) AS n FROM t GROUP BY category),
r AS (
  SELECT t.*, row_number() OVER (PARTITION BY t.category, source ORDER BY q DESC NULLS LAST, pair_id) AS nth,
         greatest(floor(max_share * n + 1e-9), 1) AS most
  FROM t JOIN n USING (category) JOIN source_caps c ON c.category = t.category),
gone AS (SELECT pair_id FROM r WHERE source IS NOT NULL AND nth > most)
"""

SQL = {
    # The first component by power iteration.
    "p1_loadings": _PCA + " SELECT unnest(['sbert_similarity', 'nli_entailment_prob', 'tfidf_similarity']) AS score, unnest([round(x, 6), round(y, 6), round(z, 6)]) AS loading, 1::INTEGER AS direction, unnest([x >= 0, y >= 0, z >= 0]) AS agrees FROM v",
    "p1_projection": _PCA + ", w AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, stddev_pop(a) AS sa, stddev_pop(b) AS sb, stddev_pop(c) AS sc FROM u) SELECT pair_id, round(x * (a - ma) / sa + y * (b - mb) / sb + z * (c - mc) / sc, 6) AS projection FROM u, w, v",
    "p1_midranks": f"WITH t AS (SELECT DISTINCT pair_id, {', '.join(f'{_fraction(c)} AS {c}' for c in SCORES)} FROM final_scored) SELECT pair_id, {', '.join(map(_midrank, SCORES))} FROM t",
    "p6_available": f"""
WITH t AS (SELECT pair_id, any_value({_LABEL.format(c="category")}) AS category FROM train_filtered GROUP BY pair_id),
a AS (SELECT pair_id, max(CASE WHEN ratio::VARCHAR IN ('nan', 'inf', '-inf') THEN NULL ELSE ratio END) AS ratio FROM audit_scores GROUP BY pair_id),
c AS (SELECT * FROM sample_targets WHERE dimension = 'category'), r AS (SELECT * FROM sample_targets WHERE dimension = 'ratio'),
j AS (SELECT t.pair_id, c.bucket AS cb, r.bucket AS rb FROM t JOIN a USING (pair_id) JOIN c ON c.bucket = t.category
      JOIN r ON (r.lower_bound IS NULL OR a.ratio >= r.lower_bound) AND (r.upper_bound IS NULL OR a.ratio < r.upper_bound) AND a.ratio IS NOT NULL)
SELECT s.dimension, s.bucket, count(j.pair_id) AS available FROM sample_targets s
LEFT JOIN j ON s.bucket = CASE WHEN s.dimension = 'category' THEN j.cb ELSE j.rb END GROUP BY s.dimension, s.bucket""",
    "p7_found": _P7 + "SELECT pair_id FROM gone",
    "p7_kept": _P7 + "SELECT category, source AS human_source, count(*) AS kept FROM t WHERE pair_id NOT IN (SELECT pair_id FROM gone) GROUP BY category, source",
}
