"""Token ids of a public tokenizer for every text, and texts from ids.

Texts are cut into overlapping chunks that are pre-tokenised by themselves.  Inside the overlap the boundaries of neighbouring
chunks resynchronise: the end of a run of letters or digits is a boundary wherever the tokenisation began, and the pattern
never looks back, so where both chunks have such an end the text can be cut.  The pieces are encoded by themselves and their
ids joined.  Two chunks that have no boundary in common (inside one huge pre-token) stay one piece.  The chunks of a text up
to ``SPREAD`` characters are stitched in the task that reads it; those of a longer one are spread over the cluster.
Decoding concatenates the raw bytes of the tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandemtext.session import written

#: Characters of a chunk and of its overlap with the next one, in texts of one task and in longer ones.
CHUNK, OVERLAP = 1024, 128
LONG_CHUNK, LONG_OVERLAP = 1 << 17, 1 << 12
SPREAD = 1 << 20
#: Where the vocabulary files lie; a parameter of every function here.
TOKENIZER_DIR = "/opt/tokenizers"
#: Pre-token pattern of the byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def _bytes(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in _ranks(path).items()}


def vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> str:
    return f"{folder}/{name}.tiktoken"


def _boundaries(text: str, whole: bool) -> np.ndarray:
    """Ends of pre-tokens that end a run of letters or digits: these are boundaries wherever a tokenisation begins.

    In a cut chunk the last pre-tokens may end elsewhere once the text goes on: a run that touches the end, or an apostrophe
    whose contraction (three characters at most) is cut.
    """
    import unicodedata

    import regex

    last, kind = len(text) - (0 if whole else 3), lambda c: unicodedata.category(c)[0]
    got = []
    for m in regex.finditer(PATTERN, text):
        e = m.end()
        if e > last:
            break
        if (own := kind(text[e - 1])) in "LN" and (e == len(text) or kind(text[e]) != own):
            got.append(e)
    return np.array(got, dtype=np.int64)


def pieces_of(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """The pieces of a text that can be encoded by themselves."""
    if len(text) <= chunk:
        return [text]
    cuts, right = [0], np.empty(0, dtype=np.int64)
    for low in range(0, len(text), chunk):
        high = low + chunk + overlap
        at = _boundaries(text[low:high], high >= len(text)) + low
        common = np.intersect1d(right, at[at < low + overlap])
        if len(common):
            cuts.append(int(common[0]))
        right = at[at >= low + chunk]
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


def _encoder(path: str, chunk: int | None, overlap: int = 0):
    """Encode the last column; it is one piece if there is no chunk size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path).encode_ordinary
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            ids = [[] if not t else encode(t) if chunk is None else [i for piece in pieces_of(t, chunk, overlap) for i in encode(piece)] for t in texts]
            offsets = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [*batch.schema.names[:-1], "ids"])

    return run


def _windows(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key"), batch.column("text").to_pylist()):
                lows = range(0, len(text), chunk)
                keys = pa.array([key.as_py()] * len(lows), batch.schema.field("key").type)
                yield pa.RecordBatch.from_arrays([keys, pa.array(range(len(lows)), pa.int32()), pa.array([low + chunk + overlap >= len(text) for low in lows]), pa.array([text[low : low + chunk + overlap] for low in lows])], ["key", "k", "last", "window"])

    return run


def _seams(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int32())
        for batch in batches:
            left, right = [], []
            for text, last in zip(batch.column("window").to_pylist(), batch.column("last").to_pylist()):
                at = _boundaries(text, last).astype(np.int32)
                left.append(at[at < overlap])
                right.append(at[at >= chunk] - chunk)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), pa.array(left, kind), pa.array(right, kind)], ["key", "k", "left", "right"])

    return run


def encode(df: DataFrame, key: str, text: str, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD, long_chunk: int = LONG_CHUNK, long_overlap: int = LONG_OVERLAP) -> DataFrame:
    """(key, ids array<int>) of every row; null and empty texts give an empty list, blank ones are encoded as they are.

    Strings of special tokens are ordinary text.  Keys should be unique; rows of long texts with a null key are not told
    apart.  An empty table gives an empty result; other columns are ignored.
    """
    path = path or vocabulary()
    kind = df.schema[key].dataType.simpleString()
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    size = F.coalesce(F.char_length("text"), F.lit(0))
    short = docs.where(size <= spread).mapInArrow(_encoder(path, chunk, overlap), f"key {kind}, ids array<int>")
    # One long text is one row of its file; its windows are written and spread before they are worked on.
    windows = docs.where(size > spread).mapInArrow(_windows(long_chunk, long_overlap), f"key {kind}, k int, last boolean, window string")
    windows = written(windows.repartition("key", "k"), "windows")
    seams = written(windows.mapInArrow(_seams(long_chunk, long_overlap), f"key {kind}, k int, left array<int>, right array<int>"), "seams")
    here, after = seams.select("key", (F.col("k") + 1).alias("k"), F.col("right").alias("before")), seams.select("key", "k", "left")
    start = F.when(F.col("k") == 0, 0).otherwise(F.array_min(F.array_intersect("left", "before")))
    starts = after.join(here, ["key", "k"], "left").select("key", "k", start.alias("start"))
    # One row of two numbers per chunk: where its piece begins (null if it goes on from the chunk before), and where the next does.
    order = Window.partitionBy("key").orderBy("k")
    starts = starts.select("key", "k", F.coalesce("start", F.lit(0)).alias("start"), F.count("start").over(order).alias("piece"), (F.coalesce(F.lead("start").over(order), F.lit(0)) + long_chunk).alias("end"))
    parts = windows.join(starts, ["key", "k"])
    until = F.when(F.col("last") & (F.char_length("window") <= F.col("end")), F.char_length("window")).otherwise(F.col("end"))
    parts = parts.select("key", "piece", "k", F.col("window").substr(F.col("start") + 1, until - F.col("start")).alias("part"))
    pieces = parts.groupBy("key", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x["part"]), "").alias("text"))
    done = pieces.mapInArrow(_encoder(path, None), f"key {kind}, piece long, ids array<int>")
    joined = done.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"])).alias("ids"))
    return short.unionByName(joined).withColumnRenamed("key", key)


def decode(df: DataFrame, key: str, ids: str, path: str | None = None) -> DataFrame:
    """(key, text) of (key, ids): the bytes of the tokens, joined and read as UTF-8; no ids (or null) give an empty text.

    Bytes that are no UTF-8, as where a list was cut inside a character, become U+FFFD.  An id the vocabulary lacks is an error.
    """
    path = path or vocabulary()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _bytes(path)
        for batch in batches:
            texts = [b"".join([known[i] for i in x or ()]).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], ["key", "text"])

    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
