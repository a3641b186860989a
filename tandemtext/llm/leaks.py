"""Passages of held-out items inside a large corpus.

The items are an inverted index over word trigrams.  Every trigram that a document shares with an item is a seed, however
common it is: the run of words around it is followed in both directions over single edits, all runs of an Arrow batch at once
in numpy.  There is no score and no threshold besides the length of the run, so a run counts if three of its words in a row
are unedited.  (A BM25 threshold low enough to lose no edited run leaves nearly all of the texts that share a trigram, at
four times the cost; see README.)  Equal texts of several items stand in the index once.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A leak has at least so many words of the item in a row, apart from single changed, added or missing ones.
LEAST_WORDS = 25
#: Seeds that are followed at once.
SEEDS = 1 << 19
#: Words of items in one index (about 100 bytes each on every worker); more items are searched in several indexes.
INDEX_WORDS = 2_000_000

_TAG = re.compile(r"<[^<>\n]{1,80}>")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Words without case, punctuation, markup and line layout."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = text.replace("’", "").replace("­", "").replace("​", "")
    return _WORD.findall(text.lower().replace("'", ""))


@dataclass
class Index:
    vocabulary: dict[str, int]
    codes: np.ndarray  # sorted trigram codes
    start: np.ndarray  # by code: the places in ``words`` where it begins
    place: np.ndarray
    words: np.ndarray  # words of all units, -2 before and after each
    unit: np.ndarray  # unit of each of these
    items: list[list[tuple]]  # (item, field) of each unit


def _codes(ids: np.ndarray, size: int) -> np.ndarray:
    """Trigram code at each position, -1 where one of the words is unknown or none."""
    if len(ids) < 3:
        return np.empty(0, dtype=np.int64)
    a, b, c = ids[:-2], ids[1:-1], ids[2:]
    return np.where((a >= 0) & (b >= 0) & (c >= 0), (a * size + b) * size + c, -1)


def _joined(texts: list[list[int]], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, text of each) of texts one after another, ``gap`` three times before, between and after them."""
    flat, owner = [gap] * 3, [0] * 3
    for k, t in enumerate(texts):
        flat += t
        flat += [gap] * 3
        owner += [k] * (len(t) + 3)
    return np.array(flat, dtype=np.int64), np.array(owner, dtype=np.int64)


def distinct(units: list[tuple]) -> dict[tuple[str, ...], list[tuple]]:
    """The (item, field) of each distinct text of (item, field, words)."""
    texts: dict[tuple[str, ...], list[tuple]] = {}
    for item, field, words in units:
        owners = texts.setdefault(tuple(words), [])
        if (item, field) not in owners:
            owners.append((item, field))
    return texts


def build(texts: dict[tuple[str, ...], list[tuple]]) -> Index:
    """Index of distinct texts with their owners."""
    vocabulary: dict[str, int] = {}
    words, unit = _joined([[vocabulary.setdefault(w, len(vocabulary)) for w in t] for t in texts], -2)
    code = _codes(words, len(vocabulary) + 1)
    place = np.argsort(code, kind="stable")
    place = place[code[place] >= 0]
    codes, first = np.unique(code[place], return_index=True)
    return Index(vocabulary, codes, np.append(first, len(place)), place, words, unit, list(texts.values()))


def _follow(d: np.ndarray, u: np.ndarray, i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
    """Follow matches at (i, j) in one direction over single edits: the last matched place in u of each.

    Texts are parted by three words that match nothing.
    """
    last = j.copy()
    live = np.arange(len(i))
    while len(live):
        same = d[i] == u[j]
        last[live[same]] = j[same]
        # Two words in a row must match after a word that is changed, that d adds or that d lacks.
        off = np.flatnonzero(~same)
        x, y = i[off], j[off]
        d1, d2, u1, u2 = d[x + step], d[np.clip(x + 2 * step, 0, len(d) - 1)], u[y + step], u[np.clip(y + 2 * step, 0, len(u) - 1)]
        changed = (d1 == u1) & (d2 == u2)
        added = ~changed & (d1 == u[y]) & (d2 == u1)
        lacking = ~changed & ~added & (d[x] == u1) & (d1 == u2)
        i, j = i + np.where(same, step, 0), j + np.where(same, step, 0)
        i[off] += np.where(changed | added, step, 0)
        j[off] += np.where(changed | lacking, step, 0)
        go = same.copy()
        go[off] = changed | added | lacking
        live, i, j = live[go], i[go], j[go]
    return last


def runs(index: Index, ids: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, unit, words) of runs of LEAST_WORDS words or more of a unit that a document holds in order, apart from
    single changed, added or missing words; ``ids`` and ``doc`` as from _joined.
    """
    code = _codes(ids, len(index.vocabulary) + 1)
    if not len(code) or not len(index.codes):
        return
    term = np.minimum(np.searchsorted(index.codes, code), len(index.codes) - 1)
    hit = np.flatnonzero(index.codes[term] == code)
    term = term[hit]
    many = index.start[term + 1] - index.start[term]
    edges = np.searchsorted(np.cumsum(many), np.arange(0, int(many.sum()) + SEEDS, SEEDS))
    for low, high in zip(edges[:-1], np.append(edges[1:-1], len(hit))):
        n = many[low:high]
        i = np.repeat(hit[low:high], n)
        j = index.place[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(index.start[term[low:high]], n)]
        # The seeds after the first of an unedited stretch lie in the same run.
        first = ids[i - 1] != index.words[j - 1]
        i, j = i[first], j[first]
        length = _follow(ids, index.words, i, j, 1) - _follow(ids, index.words, i, j, -1) + 1
        kept = np.flatnonzero(length >= LEAST_WORDS)
        yield doc[i[kept]], index.unit[j[kept]], length[kept]


def _search(index: Index, kind: pa.DataType):
    lookup = index.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for low in range(0, batch.num_rows, 2000):
                part = batch.slice(low, 2000)
                ids, doc = _joined([[lookup.get(w, -1) for w in words_of(t)] for t in part.column("text").to_pylist()], -1)
                best: dict[tuple, int] = {}
                for found in runs(index, ids, doc):
                    for d, unit, n in zip(*(c.tolist() for c in found)):
                        for owner in index.items[unit]:
                            if n > best.get((d, *owner), 0):
                                best[(d, *owner)] = n
                keys = part.column("key").to_pylist()
                out += [(keys[d], item, field, n) for (d, item, field), n in best.items()]
            columns = zip(*out) if out else ([], [], [], [])
            types = (batch.schema.field("key").type, kind, pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["key", "item", "field", "words"])

    return run


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, item_texts: list[str]) -> DataFrame:
    """(key, item, words, fields): every document that holds a passage of LEAST_WORDS words or more of an item, its length, and
    the names of the item's texts (question, answer) that have such passages there.

    Words are compared without case, punctuation, markup and line layout.  Null, empty and short texts hold none, and an item
    text below LEAST_WORDS words has no such passage; copies of a document are each reported; an item met twice counts once.
    Items are a small set; all of their words are held by every worker.  An empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL")
    got = items.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), *[F.col(c).alias(f"t{n}") for n, c in enumerate(item_texts)]).orderBy("item").toArrow()
    texts = [got.column(f"t{n}").to_pylist() for n in range(len(item_texts))]
    ids = got.column("item").to_pylist()
    all_texts = distinct([(ids[r], n, w) for r in range(len(ids)) for n in range(len(item_texts)) if len(w := words_of(texts[n][r])) >= LEAST_WORDS])
    parts: list[dict] = [{}]
    held = 0
    for words, owners in all_texts.items():
        if held + len(words) > INDEX_WORDS and parts[-1]:
            parts.append({})
            held = 0
        parts[-1][words] = owners
        held += len(words)
    out = spark.createDataFrame([], f"key {kind}, item {item_kind}, field int, words int")
    for part in parts:
        if part:
            found = rows.mapInArrow(_search(build(part), got.schema.field("item").type), f"key {kind}, item {item_kind}, field int, words int")
            out = found if part is parts[0] else out.unionByName(found)
    name = F.element_at(F.array(*[F.lit(c) for c in item_texts]), F.col("field") + 1)
    return out.groupBy("key", "item").agg(F.max("words").alias("words"), F.array_sort(F.collect_set(name)).alias("fields")).withColumnRenamed("key", key)
