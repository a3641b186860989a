"""Ranking, capping and sampling: edge cases and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandemtext.llm import capping, quota_sampling, ranking
from tandemtext.llm.quota_sampling import Target
from tandemtext.operators import distributed


def brute_ranking(rows):
    ids = sorted(rows)
    cols = []
    for c in range(3):
        vals = [rows[i][c] for i in ids]
        have = [v for v in vals if v is not None]
        cols.append([None if v is None else (sum(x < v for x in have) + sum(x == v for x in have) / 2) / len(have) for v in vals])
    u = np.array([[0.5 if x is None else x for x in c] for c in cols])
    z = (u - u.mean(1, keepdims=True)) / np.where(u.std(1, keepdims=True) < 1e-9, 1, u.std(1, keepdims=True))
    vec = np.abs(np.linalg.eigh(np.corrcoef(u))[1][:, -1])
    return dict(zip(ids, vec @ z))


@pytest.mark.parametrize("limit", [0, 10**6])
def test_principal_ranking_is_the_first_component(spark, monkeypatch, limit):
    monkeypatch.setattr(ranking, "BROADCAST_VALUES", limit)
    rnd = random.Random(1)
    rows = {}
    for i in range(300):
        q = rnd.random()
        # A third of the rows share one value; scales differ wildly.
        rows[i] = (0.5 if i % 3 == 0 else round(q, 3), 1000 * q**5 + rnd.random(), None if i % 11 == 0 else round(q + rnd.gauss(0, 0.3), 2))
    df = spark.createDataFrame([(i, *map(lambda x: None if x is None else float(x), r), "clash") for i, r in rows.items()], "id long, a double, b double, c double, projection string")
    got = ranking.principal_ranking(df.union(df.limit(5)), "id", {"a": 1, "b": 1, "c": 1}).collect()
    want = brute_ranking(rows)
    assert sorted(r.rank_position for r in got) == list(range(1, 301))
    for r in got:
        assert abs(r.projection - want[r.id]) < 1e-6
    by = sorted(got, key=lambda r: r.rank_position)
    assert all((-x.projection, x.id) <= (-y.projection, y.id) for x, y in zip(by, by[1:]))


def test_ranking_of_nothing_and_of_nulls(spark):
    schema = "id long, a double, b double"
    assert ranking.principal_ranking(spark.createDataFrame([], schema), "id", {"a": 1, "b": -1}).count() == 0
    got = ranking.principal_ranking(spark.createDataFrame([(1, None, float("nan")), (2, None, None), (None, 1.0, 1.0)], schema), "id", {"a": 1, "b": -1}).collect()
    assert [(r.id, r.rank_position, r.scores_present) for r in sorted(got)] == [(1, 1, 0), (2, 2, 0)]


def test_a_negative_direction_turns_the_ranking(spark):
    df = spark.createDataFrame([(i, float(i), float(-i)) for i in range(20)], "id long, a double, b double")
    got = {r.id: r.rank_position for r in ranking.principal_ranking(df, "id", {"a": 1, "b": -1}).collect()}
    assert got == {i: 20 - i for i in range(20)}


def test_a_score_against_its_direction_keeps_its_loading(spark):
    df = spark.createDataFrame([(i, float(i), float(i), float(-i)) for i in range(20)], "id long, a double, b double, c double")
    load, _, _ = ranking.loadings(ranking.with_midranks(df, "id", ["a", "b", "c"]), [1, 1, 1])
    assert load[0] > 0.5 and load[1] > 0.5 and load[2] < -0.5


def test_fraction_scales_and_drops(spark):
    df = spark.createDataFrame([(0.5,), (58.0,), (-1.0,), (250.0,), (float("nan"),), (None,), (1.0,)], "v double")
    assert [r[0] for r in df.select(ranking.fraction("v")).collect()] == [0.5, 0.58, None, None, None, None, 1.0]


def capped(rows, share):
    gone, groups = set(), {}
    for k, g, c, s in {r[0]: r for r in rows if r[0] is not None and r[1] is not None}.values():
        groups.setdefault(g, []).append((k, c, s))
    for g, xs in groups.items():
        most = max(math.floor(share * len(xs) + 1e-9), 1)
        for c in {x[1] for x in xs} - {None}:
            own = sorted((x for x in xs if x[1] == c), key=lambda x: (x[2] is None or x[2] != x[2], -(x[2] or 0) if x[2] == x[2] else 0, x[0]))
            gone |= {x[0] for x in own[most:]}
    return gone


@pytest.mark.parametrize("bins, broadcast, kind", [(1, 10**6, "long"), (4, 0, "long"), (256, 10**6, "string")])
def test_capping_is_exact_however_fine_the_bins(spark, monkeypatch, bins, broadcast, kind):
    monkeypatch.setattr(distributed, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(capping, "BINS", bins)
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["x", "x", "y", None]), rnd.choice(["big"] * 5 + ["a", "b", None]), rnd.choice([None, float("nan"), 1.0, 1.0, 1.0, 2.5, rnd.random()])) for i in range(400)]
    rows = [(f"key{i:05d}" if kind == "string" else 2**60 + i, *r) for i, *r in rows]
    df = spark.createDataFrame([(*r, 0) for r in rows + rows[:20]], f"id {kind}, grp string, src string, q double, n int")
    got = {r.id for r in capping.over_limit(df, "id", F.col("grp"), F.col("src"), "q", F.lit(0.3)).collect()}
    assert got == capped(rows, 0.3)


def test_capping_of_nothing(spark):
    df = spark.createDataFrame([], "id long, grp string, src string, q double")
    assert capping.over_limit(df, "id", F.col("grp"), F.col("src"), "q", F.lit(0.3)).count() == 0


def quota(spark, rows, targets, **more):
    df = spark.createDataFrame(rows, "id long, a string, b string")
    return quota_sampling.quota_sample(df, "id", {"a": F.col("a"), "b": F.col("b")}, targets, **more)


def test_sample_meets_shares_and_floors(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice("xxxxy"), "rare" if i % 97 == 0 else rnd.choice("pq")) for i in range(3000)]
    goals = [Target("a", "x", 0.5, 5), Target("a", "y", 0.5, 5), Target("b", "p", 0.6, 5), Target("b", "q", 0.39, 5), Target("b", "rare", 0.01, 20)]
    sample, report = quota(spark, rows + [(None, "x", "p"), (9999, None, "p"), (1, "x", "p")], goals, size=600)
    got = sample.collect()
    assert len({r.id for r in got}) == len(got) and 600 <= len(got) <= 640
    share = lambda i, v: sum(r[i] == v for r in got) / len(got)
    assert abs(share(1, "x") - 0.5) < 0.03 and abs(share(2, "p") - 0.6) < 0.03
    assert sum(r.b == "rare" for r in got) >= 20
    assert {r.id for r in quota(spark, rows, goals, size=600)[0].collect()} == {r.id for r in quota(spark, rows, goals, size=600)[0].collect()}
    assert all(r.floor_met for r in report.collect())


def test_sample_reports_what_cannot_be_met(spark):
    goals = [Target("a", "x", 0.5, 3), Target("a", "none", 0.5, 3), Target("b", "p", 1.0, 1)]
    sample, report = quota(spark, [(i, "x", "p") for i in range(10)], goals, size=4)
    lines = {(r.dimension, r.bucket): r for r in report.collect()}
    assert not lines[("a", "none")].floor_met and lines[("a", "none")].reason == "no rows"
    assert lines[("a", "x")].reason == "all rows taken" or lines[("a", "x")].reason == "other targets lack rows"
    assert quota(spark, [], goals)[0].count() == 0


def test_ratio_bucket_bounds(spark):
    df = spark.createDataFrame([(0.1,), (0.7,), (0.8,), (None,)], "r double")
    bounds = [("low", None, 0.7), ("mid", 0.7, 0.8), ("high", 0.8, None)]
    assert [r[0] for r in df.select(quota_sampling.ratio_bucket(F.col("r"), bounds)).collect()] == ["low", "mid", "high", None]


