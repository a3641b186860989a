"""Similarity of the two texts of a pair, by terms and by sentence vectors.

Everything is keyed by pair: terms are joined on (pair, term) and sentences on pair, never corpus against corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tandemtext.functions import metrics as M
from tandemtext.functions import text as T
from tandemtext.operators import models

#: Cosine from which a sentence counts as copied, and below which it has no counterpart (fixed values).
COPIED, WEAK = 0.9, 0.6
#: Sentences that the encoder is given at once, whose pairs are worked on together, and whose vectors a task keeps for its next pairs.
ENCODED, HELD, KEPT = 1_024, 8_192, 32_768


def _letters() -> tuple[str, str]:
    """Accented letters and their base letters, from Unicode's own decompositions up to U+024F."""
    import unicodedata

    got = [(chr(c), b) for c in range(0xC0, 0x250) if len(b := "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))) == 1 and b != chr(c)]
    return "".join(a for a, _ in got), "".join(b for _, b in got)


def plain_terms(c: Column) -> Column:
    """Words of two characters or more, and neighbouring pairs of them, without case and accents."""
    have, want = _letters()
    words = F.regexp_extract_all(F.translate(F.lower(F.coalesce(c, F.lit(""))), have, want), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    two = F.element_at(F.transform(F.array(words), lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, y: F.concat(x, F.lit(" "), y))), 1)
    return F.concat(words, two)


def tfidf_pairs(df: DataFrame) -> DataFrame:
    """(pair_id, ai, hu) to the cosine of their TF-IDF vectors (sublinear tf, smoothed idf over all texts of both sides).

    A null or empty text has no terms and similarity 0.
    """
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("ai").alias("t")), F.struct(F.lit(1).alias("side"), F.col("hu").alias("t")))
    terms = df.select("pair_id", F.inline(sides)).select("pair_id", "side", F.explode(plain_terms(F.col("t"))).alias("term"))
    # Both sides of a term in one row: the term's counts are then joined once.
    tf = terms.groupBy("pair_id", "term").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("h"))
    often = tf.groupBy("term").agg((F.count_if(F.col("a") > 0) + F.count_if(F.col("h") > 0)).alias("df"))
    n = df.agg((2 * F.count("*")).alias("n"))
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    weight = lambda c: F.when(F.col(c) > 0, (1 + F.log(F.col(c))) * idf).otherwise(0.0)
    x = tf.join(often, "term").crossJoin(F.broadcast(n)).select("pair_id", weight("a").alias("a"), weight("h").alias("h"))
    sums = x.groupBy("pair_id").agg(F.sum(F.col("a") * F.col("h")).alias("dot"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("h") * F.col("h")).alias("hh"))
    cosine = F.when((F.col("aa") > 0) & (F.col("hh") > 0), F.col("dot") / F.sqrt(F.col("aa") * F.col("hh"))).otherwise(0.0)
    return df.select("pair_id").join(sums, "pair_id", "left").select("pair_id", F.round(F.coalesce(cosine, F.lit(0.0)), 5).alias("similarity"))


def sentence_vectors(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Test sentences from a table of vectors: ten make a pair's machine side, blends with the next pair's its human side."""
    e = embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    pair, at = F.floor(F.col("vec_id") / 10).cast("long"), F.pmod("vec_id", F.lit(10)).cast("int")
    n = embeddings.agg((F.max("vec_id") + 1).alias("n"))
    other = e.crossJoin(F.broadcast(n)).select(F.pmod(F.col("vec_id") - 10, F.col("n")).alias("vec_id"), F.col("v").alias("b"))
    k = 0.12 * F.pmod(F.col("vec_id") + pair, F.lit(7))
    hu = e.join(other, "vec_id").where((at != F.pmod(pair, F.lit(10))) | (F.pmod(pair, F.lit(3)) == 0)).select(pair.alias("pair_id"), at.alias("j"), F.zip_with("v", "b", lambda x, y: (1 - k) * x + k * y).alias("v"))
    return e.select(pair.alias("pair_id"), at.alias("i"), "v"), hu


def sentence_similarity(ai: DataFrame, hu: DataFrame) -> DataFrame:
    """(pair_id, i, j, sim): cosine of every sentence of one side with every sentence of the other, within each pair."""
    norm = F.sqrt(M.dot(F.col("v"), F.col("v")))
    a = ai.select("pair_id", "i", F.col("v").alias("a"), norm.alias("na"))
    h = hu.select("pair_id", "j", F.col("v").alias("h"), norm.alias("nh"))
    return a.join(h, "pair_id").select("pair_id", "i", "j", (M.dot(F.col("a"), F.col("h")) / F.greatest(F.col("na") * F.col("nh"), F.lit(1e-12))).alias("sim"))


def coverage(sim: DataFrame) -> DataFrame:
    best = sim.groupBy("pair_id", "i").agg(F.max("sim").alias("best"))
    copied = F.avg(F.when(F.col("best") > 0.9, 1.0).otherwise(0.0))
    return best.groupBy("pair_id").agg(F.round(F.min("best"), 4).alias("min_cov"), F.round(F.avg("best"), 4).alias("mean_cov"), F.round(copied, 4).alias("copy_rate"))


def counterparts(sim: DataFrame) -> DataFrame:
    """(pair_id, j, i, sim): the best machine sentence of every human one, the lowest number in a tie."""
    best = F.max(F.struct(F.round("sim", 9).alias("r"), (-F.col("i")).alias("m"), F.col("sim"))).alias("t")
    return sim.groupBy("pair_id", "j").agg(best).select("pair_id", "j", (-F.col("t.m")).alias("i"), "t.sim")


def structure_change(sim: DataFrame) -> DataFrame:
    """Share of human sentences whose best machine sentence (lowest number in a tie) is another's too, or is far from it."""
    top = counterparts(sim)
    shared = F.count("*").over(W.partitionBy("pair_id", "i"))
    moved = F.when((F.col("shared") > 1) | (F.col("sim") < 0.6), 1.0).otherwise(0.0)
    return top.withColumn("shared", shared).groupBy("pair_id").agg(F.round(F.avg(moved), 4).alias("struct_change"))


def opening(sim: DataFrame) -> DataFrame:
    first = sim.groupBy("pair_id", "j").agg(F.max("sim").alias("best")).groupBy("pair_id").agg(F.min(F.struct("j", "best"))["best"].alias("best"))
    return first.select("pair_id", F.round("best", 4).alias("opening"))


def _audit(make: models.Encoder, encoded: int, held: int, kept: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["pair_id", "min_cov", "mean_cov", "copy_rate", "sent_count_ratio", "struct_change", "opening"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, vectors = make(), {}
        for batch in batches:
            n = pc.add(pc.list_value_length(batch.column("ai")), pc.list_value_length(batch.column("hu"))).to_numpy(zero_copy_only=False)
            # Pairs whose sentences begin in the same stretch of ``held`` sentences are taken together.
            cuts = [0, *(np.flatnonzero(np.diff((np.cumsum(n) - n) // held)) + 1).tolist(), batch.num_rows]
            out = []
            for begin, end in zip(cuts, cuts[1:]):
                part = batch.slice(begin, end - begin)
                pairs = list(zip(part.column("ai").to_pylist(), part.column("hu").to_pylist()))
                new = [s for s in dict.fromkeys(s for ai, hu in pairs if ai and hu for s in (*ai, *hu)) if s not in vectors]
                for at in range(0, len(new), encoded):
                    some = new[at : at + encoded]
                    vectors.update(zip(some, np.array(model(some), dtype=np.float32)))
                out += [_audited(*(np.array([vectors[s] for s in side], dtype=np.float64) for side in p)) if all(p) else (0.0, 0.0, 0.0, 0.0, 0.0, None) for p in pairs]
                for s in list(islice(vectors, max(0, len(vectors) - kept))):
                    del vectors[s]
            yield pa.RecordBatch.from_arrays([batch.column("pair_id"), *(pa.array(list(c), pa.float64()) for c in (zip(*out) if out else [[]] * 6))], names)

    return run


def _audited(ai: np.ndarray, hu: np.ndarray) -> tuple[float, ...]:
    sim = ai @ hu.T
    best, scores, at = sim.max(axis=1), sim.max(axis=0), sim.argmax(axis=0)
    moved = (np.bincount(at, minlength=len(ai))[at] > 1) | (scores < WEAK)
    return round(float(best.min()), 4), round(float(best.mean()), 4), round(float((best > COPIED).mean()), 4), round(len(hu) / len(ai), 3), round(float(moved.mean()), 4), float(scores[0])


def audited_sentences(df: DataFrame, encoder: models.Encoder | None = None) -> DataFrame:
    """(pair_id, ai, hu) to how well the machine's sentences are covered by the human ones, and the other way round.

    Sentences are encoded where their pair is, so no vector is shuffled or broadcast; a task encodes a sentence again only after
    ``KEPT`` others.  Sentences meet within their pair only.  ``min_cov``, ``mean_cov`` and ``copy_rate`` are of the machine
    sentences' best cosines, ``struct_change`` is the share of human sentences that share their best counterpart or have none,
    ``opening`` the best cosine of the first human sentence.  Where a side has no sentence they are 0 and ``opening`` is null.
    """
    kind = df.schema["pair_id"].dataType.simpleString()
    names = ("min_cov", "mean_cov", "copy_rate", "sent_count_ratio", "struct_change", "opening")
    run = _audit(encoder or models.hashed_encoder(), ENCODED, HELD, KEPT)
    return df.select("pair_id", T.sentences(F.col("ai")).alias("ai"), T.sentences(F.col("hu")).alias("hu")).mapInArrow(run, f"pair_id {kind}, " + ", ".join(f"{n} double" for n in names))
