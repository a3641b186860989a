"""Places where a model is plugged in, each with a deterministic stand-in that needs no files.

A plug-in is a factory: it is called once per Python worker and returns a function over a list of inputs, so a real model is
loaded once and fed in batches.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Encoder = Callable[[], Callable[[list[str]], list[list[float]]]]
Entailer = Callable[[], Callable[[list[tuple[str, str]]], list[tuple[float, float, float]]]]
Rewriter = Callable[[], Callable[[list[str]], list[str]]]
Tokenizer = Callable[[], Callable[[str], list[int]]]


def _words(text: str | None) -> list[str]:
    return re.findall(r"\w+", (text or "").lower())


def _hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")


def hashed_encoder(dims: int = 64) -> Encoder:
    """Bag of hashed words, normalised to length 1."""

    def make():
        def run(texts: list[str]) -> list[list[float]]:
            out = []
            for t in texts:
                v = [0.0] * dims
                for w in _words(t):
                    h = _hash(w)
                    v[h % dims] += 1.0 if h >> 63 else -1.0
                norm = sum(x * x for x in v) ** 0.5 or 1.0
                out.append([x / norm for x in v])
            return out

        return run

    return make


def overlap_entailer() -> Entailer:
    """Probabilities from the share of words kept and from negations that only one side has."""

    def make():
        def run(rows):
            out = []
            for a, b in rows:
                x, y = set(_words(a)), set(_words(b))
                kept = len(x & y) / max(1, len(y))
                odd = 0.3 if ("not" in x) != ("not" in y) else 0.05
                total = kept + odd + 0.4
                out.append((kept / total, 0.4 / total, odd / total))
            return out

        return run

    return make


def same_text() -> Rewriter:
    return lambda: lambda texts: list(texts)


def word_tokenizer() -> Tokenizer:
    return lambda: lambda text: [_hash(w) % 50_000 for w in re.findall(r"\w+|[^\w\s]", text or "")]


def encode(df: DataFrame, text: str, encoder: Encoder | None = None) -> DataFrame:
    """(text, vector) of each row; give distinct texts, so each is encoded once."""
    make = encoder or hashed_encoder()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model(b.column(0).to_pylist()), pa.list_(pa.float32()))], [text, "vector"])

    return df.select(text).mapInArrow(run, f"{text} string, vector array<float>")


def entailment(df: DataFrame, entailer: Entailer | None = None) -> DataFrame:
    """(pair_id, ai, hu) to the probabilities of entailment, neutrality and contradiction; they add up to 1."""
    make = entailer or overlap_entailer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            e, n, c = zip(*model(list(zip(b.column(1).to_pylist(), b.column(2).to_pylist())))) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(x), pa.float64()) for x in (e, n, c))], ["pair_id", "nli_entailment_prob", "nli_neutral_prob", "nli_contradiction_prob"])

    return df.select("pair_id", "ai", "hu").mapInArrow(run, "pair_id long, nli_entailment_prob double, nli_neutral_prob double, nli_contradiction_prob double")


def rewrite(df: DataFrame, text: str, rewriters: list[Rewriter] | None = None, least_words: int = 20) -> DataFrame:
    """Ask the rewriters in turn until one answers with enough words; (pair_id, rewritten, provider), nulls if none does."""
    makers = rewriters or [same_text()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [m() for m in makers]
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            out: list[str | None] = [None] * len(texts)
            by: list[int | None] = [None] * len(texts)
            for k, model in enumerate(models):
                open_ = [i for i, o in enumerate(out) if o is None]
                try:
                    answers = model([texts[i] for i in open_])
                except Exception:  # noqa: BLE001 - a provider that fails is passed over
                    continue
                for i, answer in zip(open_, answers):
                    if len((answer or "").split()) > least_words:
                        out[i], by[i] = answer, k
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(by, pa.int32())], ["pair_id", "rewritten", "provider"])

    return df.select("pair_id", text).mapInArrow(run, "pair_id long, rewritten string, provider int")


def encode_examples(df: DataFrame, most: int, tokenizer: Tokenizer | None = None) -> DataFrame:
    """Token ids of prompt and answer with the prompt's labels masked; an example above ``most`` tokens is left out, not cut."""
    make = tokenizer or word_tokenizer()
    kind = pa.struct([("input_ids", pa.list_(pa.int32())), ("attention_mask", pa.list_(pa.int32())), ("labels", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = make()
        for b in batches:
            keys, rows = [], []
            for key, prompt, answer in zip(*(b.column(i).to_pylist() for i in range(3))):
                p, a = tokens(prompt), tokens(answer)
                if len(p) + len(a) <= most:
                    keys.append(key)
                    rows.append({"input_ids": p + a, "attention_mask": [1] * (len(p) + len(a)), "labels": [-100] * len(p) + a})
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(rows, kind)], ["pair_id", "example"])

    return df.select("pair_id", "ai", "hu").mapInArrow(run, "pair_id long, example struct<input_ids:array<int>,attention_mask:array<int>,labels:array<int>>")


def collate(examples: DataFrame, size: int, pad: int = 0, ignore: int = -100) -> DataFrame:
    """(pair_id, example) to (batch, pair_id, input_ids, attention_mask, labels) padded to the longest example of its batch.

    Examples are put in batches of ``size`` by length, so that little is padded.
    """
    from tandemtext.operators.distributed import numbered

    n = F.size("example.input_ids")
    rows = numbered(examples.select("pair_id", "example", n.alias("n")), "at", F.col("n"), F.col("pair_id"))
    rows = rows.withColumn("batch", F.floor((F.col("at") - 1) / size).cast("long"))
    rows = rows.withColumn("more", F.max("n").over(Window.partitionBy("batch")) - F.col("n"))
    padded = lambda c, v: F.concat(F.col(f"example.{c}"), F.array_repeat(F.lit(v), F.col("more"))).alias(c)
    return rows.select("batch", "pair_id", padded("input_ids", pad), padded("attention_mask", 0), padded("labels", ignore))
