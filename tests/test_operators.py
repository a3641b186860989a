"""Ranking, capping, sampling and text functions: edge cases and brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tandemtext.functions import metrics as M
from tandemtext.functions import text as T
from tandemtext.operators import distributed, rules, sampling, similarity, upsert
from tandemtext.operators.distributed import numbered, running_sum
from tandemtext.sources import files


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()[0]


def test_numbered_and_running_sum_over_partitions(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("g")).repartition(8)
    got = {r.id: r.n for r in numbered(df, "n", F.col("g").desc(), F.col("id")).collect()}
    want = {i: k for k, i in enumerate(sorted(range(1000), key=lambda i: (-(i % 7), i)), 1)}
    assert got == want
    sums = {r.id: r.s for r in running_sum(df, "s", F.col("g"), F.col("id")).collect()}
    total = 0
    for i in range(1000):
        assert sums[i] == total
        total += i % 7


def test_split_sizes_and_disjointness(spark):
    df = spark.range(207).select("id", F.when(F.col("id") < 7, "tiny").when(F.col("id") < 107, "a").alias("g"))
    got = {r.id: r.split for r in sampling.split(df, "id", ["g"]).collect()}
    assert len(got) == 207
    assert {got[i] for i in range(7)} == {"train"}
    assert [sum(got[i] == s for i in range(7, 107)) for s in ("train", "validation", "test")] == [80, 10, 10]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 500), min_size=1), st.integers(1, 300))
def test_quotas_add_up(counts, n):
    if sum(counts.values()):
        q = sampling.quotas(counts, n)
        assert all(1 <= v <= counts[k] for k, v in q.items())
        assert sum(q.values()) == max(min(n, sum(counts.values())), len(q))


def test_upsert_updates_the_last_and_appends(spark):
    base = spark.createDataFrame([(1, "a", "old"), (2, " a ", "old"), (3, None, "old")], "pair_id long, ai string, hu string")
    news = spark.createDataFrame([("a", "first", 1), ("a", "new", 2), ("b", "added", 3), (None, "no", 4)], "ai string, hu string, at int")
    got = sorted((r.pair_id or 0, r.hu, r.origin) for r in upsert.upsert(base, news, "ai", ["hu"], "pair_id", "at").collect())
    assert got == [(0, "added", "appended"), (1, "old", "kept"), (2, "new", "updated"), (3, "old", "kept")]


@pytest.mark.parametrize(
    "column,text,want",
    [
        (T.collapse, " a  b\n", "a b"), (T.collapse, None, ""), (T.word_count, "L’été, don't", 2), (T.space_words, "", 0), (T.space_words, None, 0),
        (T.normalize, "a<br/>b&nbsp;&amp;<b>c</b>​\n\n\n\nd", "a b &c\n\nd"), (T.normalize, None, None), (T.tidy_lines, " a \r\n\n\n\nb ", "a\n\nb"),
        (T.model_output, "<think>x</think>Here is the rewritten text:\n\"Hi there.\"", "Hi there."), (T.after_thinking, "x</think> \"y\"", "y"),
        (T.strip_artifacts, "Title: x\nBody (Smith, 2018) text.\nReferences\nA. B.", "Body text."), (T.truncated_source, "and so on... ", True), (T.truncated_source, None, False),
        (T.sentences, "One. Two! 3 is", ["One.", "Two!", "3 is"]), (T.sentences, None, []), (M.letter_run, "sooooo", 5), (M.letter_run, "", 0), (M.letter_run, None, 0),
        (M.burstiness, "One two. Three four five six.", 1.0), (M.burstiness, "One.", 0.0), (M.contraction_rate, "don't do it", 33.33),
    ],
)
def test_text_functions(spark, column, text, want):
    assert one(spark, column(F.col("t")), t=text) == want


def test_repair_drops_half_sentences(spark):
    got = one(spark, T.repair(F.col("t"), F.col("c")), t="and so it was. It don?t end here. And then (it", c="general")
    assert got == "It don't end here."


def test_target_words_rounds_half_to_even(spark):
    df = spark.createDataFrame([(25,), (35,), (0,)], "n int")
    assert [r[0] for r in df.select(M.target_words(F.col("n"))).collect()] == [20, 40, 0]


@settings(max_examples=15, deadline=None, suppress_health_check=[])
@given(st.text(max_size=60))
def test_normalising_twice_changes_nothing_more(spark, text):
    once = one(spark, T.collapse(F.col("t")), t=text)
    assert one(spark, T.collapse(F.col("t")), t=once) == once


def test_file_helpers(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"\nc'), (2, "NA")], "id int, text string")
    path = f"file://{tmp_path}/csv"
    files.write_csv(df, path)
    assert sorted(tuple(r) for r in files.read_csv(spark, path, "id int, text string").collect()) == [(1, 'a "b"\nc'), (2, None)]
    assert files.first_existing(spark, [f"{path}x", path]) == path
    moved = files.backup(spark, path, "20260101")
    assert moved and files.backup(spark, path, "20260101") is None and spark.read.text(moved).count() > 0
    assert files.markdown(spark.range(2)) == "| id |\n| --- |\n| 0 |\n| 1 |"
    with pytest.raises(ValueError):
        files.markdown(spark.range(5), most=3)
    calls = []

    def fails():
        calls.append(1)
        raise OSError

    assert files.read_with_retry(fails, lambda: spark.range(0), wait=0).count() == 0 and len(calls) == 3
    assert files.resolve(df, ("Text",)) == "text"


LONG = "Word " * 40


@pytest.mark.parametrize(
    "ai, human, want",
    [
        (LONG + "end.", LONG + "end.", True),
        (LONG + "end.", "(" + LONG + "end.", False),  # a bracket opens no sentence
        ("# " + LONG + "end.", LONG + "end.)", True),
        (LONG + "end.", "# " + LONG + "end.", False),
        (LONG + "end.", LONG + 'end"', False),  # a quote alone closes none
        (LONG + "end.", LONG + "see (abc] end.", False),
        (LONG + "end.", "Too short.", False),
        (None, LONG + "end.", False),
    ],
)
def test_valid_pair(spark, ai, human, want):
    assert one(spark, rules.valid_pair(F.col("a"), F.col("h")), a=ai, h=human) is want


@pytest.mark.parametrize(
    "ai, human, want",
    [
        (LONG, LONG + "more", True),
        ("Sure, here you are. " + LONG, LONG, False),
        ("I won't say more. " + LONG, LONG, True),  # not among the markers
        ("Here is the rewritten text: " + LONG, LONG + "more", True),  # a lead-in goes before the markers are looked for
        ("<think>I cannot</think>" + LONG, LONG + "more", True),
        (LONG, " " + LONG, False),
        ("", LONG, False),
    ],
)
def test_quality_gate(spark, ai, human, want):
    assert one(spark, rules.passes_quality(F.col("a"), F.col("h")), a=ai, h=human) is want


def test_excluded_phrases(spark):
    ok = lambda text, category: one(spark, rules.consistent(F.col("t"), F.col("c")), t=text, c=category)
    assert not ok("Dear Sir, no.", "essay") and ok("Dear Sir, no.", "email") and ok("My dear friend", "essay")
    assert not ok("My dear friend", "academic") and not ok("With love, Ann", "document") and ok("abstract", "general") and ok("x", None) and ok(None, "essay")


def test_semantic_status_of_short_pairs(spark):
    df = spark.createDataFrame([(0.9, 0.1, 1.0, 29, 50), (0.9, 0.1, 1.0, 30, 30), (0.6, 0.1, 1.0, 5, 5), (0.6, 0.4, 1.0, 5, 5), (0.75, 0.1, 1.0, 40, 40)], "s double, c double, r double, a int, h int")
    got = [r[0] for r in df.select(rules.semantic_status(*map(F.col, "scrah"))).collect()]
    assert got == ["LENGTH_MISMATCH", "HIGH_CONFIDENCE", "LOW_SIMILARITY", "CONTRADICTION", "ACCEPTABLE"]


AUDITED = "category string, human_source string, ratio double, min_cov double, mean_cov double, copy_rate double, human_cliche_density double, fact_retention double, has_title_leakage boolean, has_trailing_references boolean, clean_ratio double, clean_cliches double, clean_stems double, median double"


def audited_row(category="general", source="hf_dataset_import", **other):
    base = {"ratio": 0.8, "min_cov": 0.6, "mean_cov": 0.8, "copy_rate": 0.1, "human_cliche_density": 1.0, "fact_retention": 0.9, "title": False, "refs": False, "clean_ratio": 0.8, "clean_cliches": 1.0, "clean_stems": 1.0, "median": 0.0}
    return (category, source, *{**base, **other}.values())


@pytest.mark.parametrize(
    "which, row, want",
    [
        ("audit_rules", audited_row(human_cliche_density=0.0), ""),
        ("audit_rules", audited_row("essay", copy_rate=0.61, human_cliche_density=0.0), "copying"),
        ("audit_rules", audited_row("email", copy_rate=0.75, human_cliche_density=0.0), ""),
        ("audit_rules", audited_row(human_cliche_density=10.1, median=5.0, refs=True), "cliches; artifacts"),
        ("first_filter", audited_row(clean_ratio=0.69, ratio=0.9), "short"),
        ("first_filter", audited_row("academic", copy_rate=0.7, mean_cov=0.74), "coverage; copying"),
        ("first_filter", audited_row(clean_cliches=4.0), ""),
        ("first_filter", audited_row(clean_cliches=4.1), "cliches"),
        ("final_filter", audited_row(clean_ratio=0.96), "ratio"),
        ("final_filter", audited_row("email", mean_cov=0.1, copy_rate=0.99), ""),
        ("final_filter", audited_row(None, mean_cov=0.1), "coverage"),
        ("final_filter", audited_row("essay", "llm_regenerated_1_to_1", copy_rate=0.51), "copying"),
        ("final_filter", audited_row("essay", copy_rate=0.85), ""),
        ("final_filter", audited_row("essay", copy_rate=0.86, fact_retention=0.59, clean_stems=4.5), "cliches; facts; copying"),
        ("final_filter", audited_row("essay", copy_rate=None, fact_retention=None, mean_cov=None), ""),
    ],
)
def test_filters(spark, which, row, want):
    assert rules.filtered(spark.createDataFrame([row], AUDITED), getattr(rules, which)()).first()["reason"] == want


def test_sweep_counts(spark):
    rows = [audited_row("essay", copy_rate=0.7), audited_row("general", copy_rate=0.8), audited_row("general", "llm_regenerated_1_to_1", copy_rate=0.55), audited_row("email", copy_rate=1.0, mean_cov=0.0), audited_row(clean_ratio=0.5), audited_row("essay", mean_cov=0.7, fact_retention=0.65)]
    df = spark.createDataFrame(rows, AUDITED)
    for c in ("burstiness", "contraction_rate", "quality_score"):
        df = df.withColumn(c, F.lit(1.0))
    got = {(r.t_mean_cov, r.t_fact, r.t_copy_regenerated, r.t_copy_collected, r.t_cliche_factor): (r.survivors, r.n_essay, r.n_general, r.n_email, r.n_regenerated) for r in rules.sweep(df).collect()}
    assert len(got) == 108
    assert got[(0.65, 0.60, 0.50, 0.60, 2.0)] == (3, 1, 1, 1, 0)
    assert got[(0.70, 0.60, 0.60, 0.75, 3.0)] == (5, 2, 2, 1, 1)
    assert got[(0.75, 0.80, 0.60, 0.85, 3.0)] == (4, 1, 2, 1, 1)


def test_densities(spark):
    text = "Furthermore, we delve and delved. In conclusion: navigating landscapes, a landscape of labor. It's don't."
    n = len(text.split())
    assert one(spark, M.cliche_density(F.col("t")), t=text) == round(4 * 1000 / n, 2)  # furthermore, delve, in conclusion, landscape
    assert one(spark, M.stem_density(F.col("t")), t=text) == round(6 * 1000 / n, 2)  # furthermore, delve, delved, in conclusion, navigating, labor
    assert one(spark, M.contraction_rate(F.col("t")), t=text) == round(200 / n, 2)


def test_audit_of_sentences(spark):
    rows = [(1, "Cats sleep. Dogs bark.", "Cats sleep. Cats sleep. Birds sing."), (2, "", "One."), (3, "One.", None), (4, "A b. C d.", "A b. C d.")]
    got = {r.pair_id: tuple(r)[1:] for r in similarity.audited_sentences(spark.createDataFrame(rows, "pair_id long, ai string, hu string")).collect()}
    assert got[2] == got[3] == (0.0, 0.0, 0.0, 0.0, 0.0, None)
    assert got[4] == (1.0, 1.0, 1.0, 1.0, 0.0, pytest.approx(1.0))
    assert got[1][2:5] == (0.5, 1.5, 1.0) and got[1][5] == pytest.approx(1.0)


def test_audit_moves_no_vectors(spark):
    df = spark.createDataFrame([(1, "Cats sleep.", "Cats sleep.")], "pair_id long, ai string, hu string")
    plan = similarity.audited_sentences(df)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("encoded, held, kept", [(1, 1, 0), (2, 5, 3), (1024, 8192, 32768)])
def test_audit_in_parts(spark, monkeypatch, encoded, held, kept):
    from tandemtext.operators import models

    for name, value in (("ENCODED", encoded), ("HELD", held), ("KEPT", kept)):
        monkeypatch.setattr(similarity, name, value)
    texts = [" ".join(f"Word{(i * k) % 11} says {'so ' * (k % 3)}much." for k in range(i % 6)) for i in range(40)]
    df = spark.createDataFrame([(i if i else None, t, texts[i * 7 % 40] if i % 9 else None) for i, t in enumerate(texts)], "pair_id long, ai string, hu string").coalesce(1)
    split = {r.pair_id: (r.a, r.h) for r in df.select("pair_id", T.sentences(F.col("ai")).alias("a"), T.sentences(F.col("hu")).alias("h")).collect()}
    got = {r.pair_id: r for r in similarity.audited_sentences(df).collect()}
    assert got.keys() == split.keys()
    model = models.hashed_encoder()()
    for key, (a, h) in split.items():
        if not a or not h:
            assert tuple(got[key])[1:] == (0.0, 0.0, 0.0, 0.0, 0.0, None)
            continue
        sim = [[sum(x * y for x, y in zip(u, v)) for v in model(h)] for u in model(a)]
        best = [max(row) for row in sim]
        assert got[key].min_cov == pytest.approx(min(best), abs=1e-4) and got[key].mean_cov == pytest.approx(sum(best) / len(best), abs=1e-4)
        assert got[key].sent_count_ratio == round(len(h) / len(a), 3) and got[key].opening == pytest.approx(max(row[0] for row in sim), abs=1e-6)


def test_audit_encodes_a_sentence_once_in_a_task():
    import pyarrow as pa

    seen = []

    def make():
        return lambda texts: seen.append(list(texts)) or [[1.0, float(len(t))] for t in texts]

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([["a", "b"], ["b"], ["z"]]), pa.array([["a"], ["c", "a"], []], pa.list_(pa.string()))], ["pair_id", "ai", "hu"])
    out = list(similarity._audit(make, 2, 3, 100)(iter([batch, batch, batch.slice(0, 0)])))
    assert [o.num_rows for o in out] == [3, 3, 0] and out[0].equals(out[1])
    assert seen == [["a", "b"], ["c"]]


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_ranks_in_groups(spark, monkeypatch, broadcast):
    monkeypatch.setattr(distributed, "BROADCAST_ROWS", broadcast)
    df = spark.range(500).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 10).alias("v")).repartition(5)
    got = {r.id: r.rank for r in distributed.ranked_in(df, "rank", ["g"], "id", F.col("v").desc(), F.col("id")).collect()}
    for g in range(3):
        own = sorted((i for i in range(500) if i % 3 == g), key=lambda i: (-(i % 10), i))
        assert [got[i] for i in own] == list(range(1, len(own) + 1))


def test_padding_to_the_longest_of_a_batch(spark):
    from tandemtext.operators import models

    df = spark.createDataFrame([(i, "w " * (i % 7 + 1), "a") for i in range(20)], "pair_id long, ai string, hu string")
    got = models.collate(models.encode_examples(df, most=100), 4).collect()
    assert len(got) == 20
    for b in {r.batch for r in got}:
        rows = [r for r in got if r.batch == b]
        assert len({len(r.input_ids) for r in rows}) == 1 and max(sum(r.attention_mask) for r in rows) == len(rows[0].input_ids)
        assert all(len(r.labels) == len(r.input_ids) == len(r.attention_mask) and r.labels[sum(r.attention_mask):] == [-100] * (len(r.labels) - sum(r.attention_mask)) for r in rows)


@pytest.mark.parametrize("window", [0, 10**6])
def test_quantiles_equal_those_of_the_whole_group(spark, monkeypatch, window):
    monkeypatch.setattr(distributed, "WINDOW_ROWS", window)
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, 0.5, rnd.random()]), float(i % 5)) for i in range(400)] + [("empty", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(4)
    got = {r.g: r for r in distributed.quantiles(df, ["g"], {"x": (0.1, 0.5, 0.9), "y": (0.5,)}).collect()}
    assert set(got) == {"a", "b", None, "empty"} and got["empty"].x == [None] * 3 and list(got["empty"].y) == [1.0]
    for g in ("a", "b", None):
        for c, i in (("x", 1), ("y", 2)):
            own = [r[i] for r in rows if r[0] == g and r[i] is not None]
            assert np.allclose(got[g][c], np.quantile(own, (0.1, 0.5, 0.9) if c == "x" else (0.5,)))
    assert np.allclose(distributed.quantiles(df, [], {"y": (0.25,)}).first().y, np.quantile([r[2] for r in rows], 0.25))
    assert distributed.quantiles(df.limit(0), ["g"], {"y": (0.5,)}).count() == 0


def test_prompts_are_the_callers(spark):
    got = one(spark, T.messages(F.col("t"), F.col("c"), F.lit(20), system="S", template="{style}/{target}/{task}/{text}", guides={"email": "E", "auto": "A"}, default="auto"), t="a {task}", c="email")
    assert [(m.role, m.content) for m in got] == [("system", "S"), ("user", "email/20/E/a {task}")]
    assert one(spark, T.regeneration_prompt(F.col("t"), F.col("c"), F.lit(15), template="{low}-{high} {task}: {text}", guides={"auto": "A"}, default="auto"), t="x", c="essay") == "13-16 A: x"
