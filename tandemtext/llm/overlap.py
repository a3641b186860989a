"""Records of one side that occur again, exactly or almost, on the other side.

Normalised texts are cut by content: a rolling hash over two words decides where a chunk ends, so an edit changes the chunks
around it and no others.  Chunk digests are joined across the sides, frequent ones too.  As in a prefix filter, a text leaves
out its most frequent chunks, but never so many that a text with a share of ``KEPT`` of its chunks would not be met any more,
and only frequent ones.  Chunks are joined in blocks whose pairs are never written but held against each other as bitmaps of
their words.  The bitmaps tell at least how many words differ, so no pair that counts is left out; what remains is compared
word by word.  All of it works on one representative per distinct normalised text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandemtext.session import written

#: Texts below so many words don't count; texts differing in this share of their words or more are not the same.
LEAST_WORDS, DIFFERING = 20, 0.2
#: Mean words in a chunk for texts above so many words and up to so many; texts near a limit are cut both ways, so that two
#: texts that count are always cut alike.
SIZES = (("tiny", 2, 0, 60), ("short", 4, 60, 80), ("long", 6, 80, float("inf")))
#: A chunk is frequent from so many pairs of representatives on.  Texts that share this part of their chunks meet in a chunk
#: that neither leaves out; with a fifth of the words changed at random a quarter and more is still shared on average.
FREQUENT, KEPT = 100, 1 / 10
#: Texts of either side in one block of a chunk's join, and pairs of bitmaps compared at once.
SIDE, TILE = 20_000, 1 << 18
#: Bits in a bitmap of words (a power of 2 that 64 divides).
BITS = 512
#: Mean words in a chunk whose lengths are summed up.
FRACTION_CHUNK = 6
#: Texts that are cut at once.
ROWS = 1000
#: Shared chunks (16 bytes each) up to which they are broadcast; beyond it they are joined by a shuffle.
BROADCAST_CHUNKS = 2_000_000
#: Texts to be compared word by word (8 bytes each) up to which their ids are broadcast to the table of texts.
BROADCAST_DOCS = 1_000_000

_TYPOGRAPHY = str.maketrans({"’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-", " ": " ", "­": None, "​": None, "﻿": None, "…": " "})
_LISTS = tuple(name for name, *_ in SIZES)
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Words without case, spacing and typography."""
    if not text:
        return []
    if not text.isascii():
        import unicodedata

        text = unicodedata.normalize("NFKC", text.translate(_TYPOGRAPHY))
    return _WORD.findall(text.lower().replace("'", ""))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _hashes(texts: list[list[str]], cache: dict[str, int]) -> np.ndarray:
    import xxhash

    flat = [w for t in texts for w in t]
    for w in set(flat).difference(cache):
        cache[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(cache.__getitem__, flat), dtype=np.uint64, count=len(flat))


def _rolled(h: np.ndarray) -> np.ndarray:
    return _mix(h * np.uint64(3) + np.concatenate([h[:1], h[:-1]]))


def _chunks(h: np.ndarray, rolled: np.ndarray, starts: np.ndarray, mean: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut a batch of texts (word hashes, first word of each): (first word of each chunk, digests)."""
    begins = np.zeros(len(h), dtype=bool)
    begins[1:] = rolled[:-1] % np.uint64(mean) == 0
    begins[starts] = True
    first = np.flatnonzero(begins)
    size = np.diff(np.append(first, len(h)))
    place = np.arange(len(h)) - np.repeat(first, size)
    digest = _mix(np.add.reduceat(_mix(h + (place.astype(np.uint64) + np.uint64(seed)) * _MIX), first))
    return first, digest


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict[str, int] = {}
    for batch in (b.slice(low, ROWS) for b in batches for low in range(0, b.num_rows, ROWS)):
        if len(cache) > 200_000:
            cache.clear()
        got = [words_of(t) for t in batch.column("text").to_pylist()]
        keep = [i for i, w in enumerate(got) if len(w) >= LEAST_WORDS]
        if not keep:
            continue
        side, key, field = (batch.column(c).take(pa.array(keep, pa.int64())) for c in ("side", "key", "field"))
        texts = [got[i] for i in keep]
        n = np.array([len(w) for w in texts])
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        h = _hashes(texts, cache)
        rolled = _rolled(h)
        place = np.arange(len(h)) - np.repeat(starts, n)
        # Equal texts and chunks of different fields are different ones.
        apart = _mix(np.asarray(field.to_numpy(), dtype=np.uint64) * _MIX)
        doc = _mix(np.add.reduceat(_mix(h + place.astype(np.uint64) * _MIX), starts) + n.astype(np.uint64) + apart)
        owner = np.repeat(np.arange(len(keep)), n)
        # A word's second occurrence is another word to the bitmap, its third one again.
        order = np.lexsort((h, owner))
        new = np.concatenate([[True], (owner[order][1:] != owner[order][:-1]) | (h[order][1:] != h[order][:-1])])
        nth = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        bit = (_mix(h[order] + nth.astype(np.uint64) * _MIX) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
        odd = np.bincount(owner[order] * BITS + bit, minlength=len(keep) * BITS) % 2
        bits = np.packbits(odd.astype(bool)).reshape(len(keep), -1)
        lists = []
        for _, mean, above, upto in SIZES:
            wanted = (n > above) & (n <= upto / (1 - DIFFERING))
            first, digest = _chunks(h, rolled, starts, mean, mean)
            owner = np.searchsorted(starts, first, side="right") - 1
            use = wanted[owner]
            owner, digest = owner[use], _mix(digest[use] + apart[owner[use]]).astype(np.int64)
            # Distinct chunks of each text.
            order = np.lexsort((digest, owner))
            owner, digest = owner[order], digest[order]
            new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (digest[1:] != digest[:-1])]) if len(owner) else np.empty(0, dtype=bool)
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(keep)))]), pa.int32())
            lists.append(pa.ListArray.from_arrays(offsets, pa.array(digest[new])))
        columns = [side, key, field, pa.array(doc.astype(np.int64)), pa.array(n.astype(np.int32)), *lists, pa.array([b.tobytes() for b in bits], pa.binary()), pa.array([" ".join(w) for w in texts])]
        yield pa.RecordBatch.from_arrays(columns, ["side", "key", "field", "doc", "n", *_LISTS, "bits", "words"])


def cut(rows: DataFrame) -> DataFrame:
    """(side, key, field, text) to (side, key, field, doc, n, tiny, short, long, bits, words) of the texts with enough words.

    ``tiny``, ``short`` and ``long`` have the digests of the chunks of that size, ``bits`` for each hash of a word and
    its number among equal ones whether the text holds an odd number of such, ``words`` the normalised text.
    """
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(_cut, f"side int, key {kind}, field int, doc long, n int, {', '.join(f'{c} array<long>' for c in _LISTS)}, bits binary, words string")


def _cut_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict[str, int] = {}
    for batch in (b.slice(low, ROWS) for b in batches for low in range(0, b.num_rows, ROWS)):
        if len(cache) > 200_000:
            cache.clear()
        got = [words_of(t) for t in batch.column("text").to_pylist()]
        keep = [i for i, w in enumerate(got) if len(w) >= LEAST_WORDS]
        if not keep:
            continue
        n = np.array([len(got[i]) for i in keep])
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        h = _hashes([got[i] for i in keep], cache)
        first, digest = _chunks(h, _rolled(h), starts, FRACTION_CHUNK, FRACTION_CHUNK)
        owner = np.searchsorted(starts, first, side="right") - 1
        # A chunk that a text has several times is one row, with the words of all.
        order = np.lexsort((digest, owner))
        owner, digest, size = owner[order], digest[order], np.diff(np.append(first, len(h)))[order]
        new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (digest[1:] != digest[:-1])]))
        owner, digest, size = owner[new], digest[new], np.add.reduceat(size, new).astype(np.int32)
        key, field = (batch.column(c).take(pa.array(np.array(keep)[owner])) for c in ("key", "field"))
        apart = _mix(field.to_numpy().astype(np.uint64) * _MIX)
        yield pa.RecordBatch.from_arrays([key, field, pa.array(n[owner].astype(np.int32)), pa.array(_mix(digest + apart).astype(np.int64)), pa.array(size)], ["key", "field", "n", "d", "size"])


def same_words(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, exact while it can reach the words that must agree; else -1."""
    most = max(len(a), len(b))
    allowed = int(np.ceil(DIFFERING * most - 1e-9)) - 1  # words of the longer text that may lack a partner
    if min(len(a), len(b)) < most - allowed or sum((Counter(a) & Counter(b)).values()) < most - allowed:
        return -1
    # Words at either end that agree are part of a longest subsequence.
    short = min(len(a), len(b))
    lead = next((i for i in range(short) if a[i] != b[i]), short)
    tail = next((i for i in range(short - lead) if a[-1 - i] != b[-1 - i]), short - lead)
    a, b = a[lead : len(a) - tail], b[lead : len(b) - tail]
    # Bit-parallel: a bit of ``open_`` per word of a that ends no longer common subsequence yet.
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    every = open_ = (1 << len(a)) - 1
    for w in b:
        if (at := where.get(w)) is not None:
            met = open_ & at
            open_ = (open_ + met | open_ - met) & every
    same = lead + tail + len(a) - open_.bit_count()
    return same if same >= most - allowed else -1


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, share = [], []
        for i, (x, y) in enumerate(zip(batch.column("words_a").to_pylist(), batch.column("words_b").to_pylist())):
            a, b = x.split(" "), y.split(" ")
            same = same_words(a, b)
            if same >= 0 and max(len(a), len(b)) - same < DIFFERING * max(len(a), len(b)) - 1e-9:
                keep.append(i)
                share.append(same / max(len(a), len(b)))
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("doc_a", "doc_b")), pa.array(share, pa.float64())], ["doc_a", "doc_b", "same"])


def _bitmaps(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(-1, BITS // 64)


def _most_odd(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Bits in which texts of so many words can differ that still count: a word without partner turns one bit."""
    return n_a + n_b - 2 * (1 - DIFFERING) * np.maximum(n_a, n_b) + 1e-6


def _left_out(m: np.ndarray, kept: float) -> np.ndarray:
    """Chunks that a text of m chunks may leave out."""
    return np.maximum(np.ceil(m * kept - 1e-9) - 1, 0).astype(np.int64)


def _units(shared, frequent: int, kept: float):
    """Rows of the blocks from representatives: their chunks that both sides have, less the most frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pairs = shared.value
        for batch in batches:
            out = []
            for name in _LISTS:
                lists = batch.column(name)
                m = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                owner, digest = np.repeat(np.arange(len(m)), m), lists.flatten().to_numpy()
                if not len(known) or not len(digest):
                    continue
                at = np.minimum(np.searchsorted(known, digest), len(known) - 1)
                met = known[at] == digest
                owner, digest, times = owner[met], digest[met], pairs[at[met]]
                order = np.lexsort((digest, -times, owner))
                owner, digest, times = owner[order], digest[order], times[order]
                place = np.arange(len(owner)) - np.searchsorted(owner, owner)
                use = (place >= _left_out(m, kept)[owner]) | (times <= frequent)
                out.append((owner[use], digest[use]))
            if out:
                owner, digest = (np.concatenate(c) for c in zip(*out))
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays([pa.array(digest), *(batch.column(c).take(at) for c in ("doc", "n", "on_a", "on_b", "bits"))], ["d", "doc", "n", "on_a", "on_b", "bits"])

    return run


def _met(on_b: np.ndarray, doc: np.ndarray, n: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of texts of either side in one block whose lengths and bitmaps let them count."""
    order = np.argsort(n, kind="stable")
    a, b = order[~on_b[order]], order[on_b[order]]
    n_b, columns = n[b], np.ascontiguousarray(bits[b].T)
    low = 0
    while low < len(a):
        # Texts of b as long as the first of a allows, then as many of a as fit.
        start = np.searchsorted(n_b, n[a[low]] * (1 - DIFFERING) - 1e-6)
        some = a[low : low + max(1, min(64, TILE // max(1, len(b) - start)))]
        stop = np.searchsorted(n_b, n[some[-1]] / (1 - DIFFERING) + 1e-6, side="right")
        low += len(some)
        if start == stop:
            continue
        odd = np.zeros((len(some), stop - start), dtype=np.uint16)
        for k, column in enumerate(columns):
            odd += np.bitwise_count(bits[some, k][:, None] ^ column[None, start:stop])
        x, y = np.nonzero(odd < _most_odd(n[some][:, None], n_b[None, start:stop]))
        x, y = doc[some[x]], doc[b[start + y]]
        yield x[x != y], y[x != y]


def _small(first: np.ndarray, end: np.ndarray, on_b: np.ndarray, doc: np.ndarray, n: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for many small blocks at once; a block is from ``first`` to ``end``, texts of a before texts of b."""
    of_b = np.concatenate([[0], np.cumsum(on_b)])
    middle = end - (of_b[end] - of_b[first])
    size = middle - first
    a = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
    low, many = np.repeat(middle, size), np.repeat(end - middle, size)
    edges = np.searchsorted(np.cumsum(many), np.arange(0, int(many.sum()) + TILE, TILE))
    for u, v in zip(edges[:-1], np.append(edges[1:-1], len(a))):
        k = many[u:v]
        x = np.repeat(a[u:v], k)
        y = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(low[u:v], k)
        most = _most_odd(n[x], n[y])
        near = (most > 0) & (doc[x] != doc[y])
        x, y, most = x[near], y[near], most[near]
        near = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) < most
        yield doc[x[near]], doc[y[near]]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of every block; rows of a block follow one another, those of side a first."""
    kept: list[tuple] = []

    def pairs(keys, on_b, doc, n, bits) -> Iterator[pa.RecordBatch]:
        edges = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
        first, end = edges[:-1], edges[1:]
        large = end - first > 128
        found = list(_small(first[~large], end[~large], on_b, doc, n, bits)) if not large.all() else []
        for low, high in zip(first[large], end[large]):
            found += _met(on_b[low:high], doc[low:high], n[low:high], bits[low:high])
        if found:
            # A pair that shares several chunks is one pair.
            both = np.unique(np.stack([np.concatenate(c) for c in zip(*found)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["doc_a", "doc_b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("d", "i", "j")], axis=1)
        rows = (keys, batch.column("side").to_numpy() == 1, batch.column("doc").to_numpy(), batch.column("n").to_numpy().astype(np.int64), _bitmaps(batch.column("bits")))
        # The last block may go on in the next batch.
        last = len(keys) if (keys == keys[-1]).all() else int(np.flatnonzero((keys != keys[-1]).any(axis=1))[-1]) + 1
        if last < len(keys) or (kept and (kept[-1][0][-1] != keys[0]).any()):
            whole = last if last < len(keys) else 0
            parts = [*kept, tuple(c[:whole] for c in rows)]
            yield from pairs(*(np.concatenate(c) for c in zip(*parts)))
            kept = [tuple(c[whole:] for c in rows)]
        else:
            kept.append(rows)
    if kept:
        yield from pairs(*(np.concatenate(c) for c in zip(*kept)))


def _shared_units(reps: DataFrame) -> DataFrame:
    """(d, doc, n, on_a, on_b, bits, over_a, over_b): the chunks by which representatives are joined, and parts of either side."""
    spark = reps.sparkSession
    either = lambda r: r.select(F.explode(F.concat(*_LISTS)).alias("d"), "on_a", "on_b")
    often = either(reps).groupBy("d").agg(F.sum(F.col("on_a").cast("long")).alias("as"), F.sum(F.col("on_b").cast("long")).alias("bs")).where("as > 0 AND bs > 0")
    shared = written(often, "shared")
    parts = shared.select("d", F.ceil(F.col("as") / SIDE).alias("over_a"), F.ceil(F.col("bs") / SIDE).alias("over_b"))
    if shared.count() <= BROADCAST_CHUNKS:
        got = shared.select("d", (F.col("as") * F.col("bs")).alias("pairs")).orderBy("d").toArrow()
        known = spark.sparkContext.broadcast((got.column("d").to_numpy(), got.column("pairs").to_numpy()))
        units = reps.mapInArrow(_units(known, FREQUENT, KEPT), "d long, doc long, n int, on_a boolean, on_b boolean, bits binary")
        split = F.broadcast(parts.where("over_a > 1 OR over_b > 1"))
        one = F.lit(1).cast("long")
        return units.join(split, "d", "left").withColumn("over_a", F.coalesce("over_a", one)).withColumn("over_b", F.coalesce("over_b", one))
    lists = F.array(*[F.struct(F.lit(c).alias("scheme"), F.col(c).alias("c")) for c in _LISTS])
    units = reps.select("doc", "n", "on_a", "on_b", "bits", F.inline(lists)).withColumn("m", F.size("c")).withColumn("d", F.explode("c")).drop("c")
    units = units.join(shared.withColumn("pairs", F.col("as") * F.col("bs")).drop("as", "bs"), "d")
    nth = F.row_number().over(Window.partitionBy("doc", "scheme").orderBy(F.col("pairs").desc(), "d"))
    out = F.greatest(F.ceil(F.col("m") * F.lit(KEPT) - 1e-9) - 1, F.lit(0))
    units = units.withColumn("nth", nth).where((F.col("nth") > out) | (F.col("pairs") <= FREQUENT))
    return units.join(parts, "d").select("d", "doc", "n", "on_a", "on_b", "bits", "over_a", "over_b")


def candidates(reps: DataFrame) -> DataFrame:
    """(doc_a, doc_b): representatives of either side with a chunk in common whose bitmaps let them count.

    ``reps`` has (doc, n, tiny, short, long, bits, on_a, on_b).
    """
    units = _shared_units(reps)
    # A block has a part of the texts of either side; each text goes to the blocks with every part of the other side.
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    own = lambda n: F.array(F.pmod("doc", F.col(n)))
    side = lambda s, i, j: F.when(F.col(f"on_{'ab'[s]}"), F.array(F.struct(F.lit(s).alias("side"), i.alias("i"), j.alias("j"))))
    sides = F.flatten(F.array_compact(F.array(side(0, own("over_a"), every("over_b")), side(1, every("over_a"), own("over_b")))))
    rows = units.select("d", "doc", "n", "bits", F.inline(sides)).withColumn("i", F.explode("i")).withColumn("j", F.explode("j"))
    rows = rows.repartition("d", "i", "j").sortWithinPartitions("d", "i", "j", "side")
    return rows.mapInArrow(_blocks, "doc_a long, doc_b long").distinct()


def _rows(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    texts = F.array(*[F.struct(F.lit(i).alias("field"), F.col(f"`{f}`").alias("text")) for i, f in enumerate(fields)])
    return df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.inline(texts)).where("text IS NOT NULL")


def fractions(side_a: DataFrame, side_b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, words, shared, fraction) of the texts of side a: words in chunks that stand in some text of side b too.

    Null texts and texts under LEAST_WORDS words are left out; a key met twice with the same texts counts once.  An empty
    side a gives an empty result, an empty side b fractions of 0.
    """

    def chunks(df: DataFrame) -> DataFrame:
        rows = _rows(df, key, fields)
        return rows.mapInArrow(_cut_lengths, f"key {rows.schema['key'].dataType.simpleString()}, field int, n int, d long, size int")

    # One row per digest on side b, so that the join gives no more rows than side a has chunks.
    known = chunks(side_b).select("d").distinct().withColumn("met", F.lit(True))
    own = chunks(side_a).groupBy("key", "field", "n", "d").agg(F.max("size").alias("size"))
    met = own.join(known, "d", "left").groupBy("key", "field").agg(F.max("n").alias("words"), F.sum(F.when(F.col("met"), F.col("size")).otherwise(0)).alias("shared"))
    shared = F.least("shared", "words").cast("int")
    names = F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("field") + 1)
    return met.select(F.col("key").alias(key), names.alias("field"), "words", shared.alias("shared"), F.round(shared / F.col("words"), 6).alias("fraction"))


def overlaps(side_a: DataFrame, side_b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key_a, key_b, field, same): records of side a and of side b whose texts in a field are the same or nearly so.

    Both inputs have ``key`` and the ``fields``.  ``same`` is the share of the longer text's words that agree in order (1.0 for
    equal texts).  Null texts and texts under LEAST_WORDS words don't count; a key met twice counts once; a record is never
    paired with itself.  Every overlapping pair comes out, copies of a copy included.  Empty sides give an empty result.
    """

    rows = lambda df, side: _rows(df, key, fields).withColumn("side", F.lit(side))
    docs = written(cut(rows(side_a, 0).unionByName(rows(side_b, 1))), "docs")
    members = docs.select("side", "key", "field", "doc").distinct()
    reps = docs.groupBy("doc").agg(F.max("n").alias("n"), F.bool_or(F.col("side") == 0).alias("on_a"), F.bool_or(F.col("side") == 1).alias("on_b"), F.max_by(F.struct(*_LISTS, "bits"), "n").alias("c"))
    reps = written(reps.select("doc", "n", "on_a", "on_b", "c.*"), "reps")
    met = written(candidates(reps), "candidates")
    # The words of the candidates, one record for each.
    asked = met.select(F.col("doc_a").alias("doc")).union(met.select(F.col("doc_b").alias("doc"))).distinct()
    asked = written(asked, "asked")
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_DOCS else asked
    words = written(docs.select("doc", "words").join(asked, "doc", "left_semi").dropDuplicates(["doc"]), "words")
    pairs = met.join(words.toDF("doc_a", "words_a"), "doc_a").join(words.toDF("doc_b", "words_b"), "doc_b")
    near = pairs.mapInArrow(_verify, "doc_a long, doc_b long, same double")
    equal = reps.where("on_a AND on_b").select(F.col("doc").alias("doc_a"), F.col("doc").alias("doc_b"), F.lit(1.0).alias("same"))
    linked = near.unionByName(equal)
    on_a = members.where("side = 0").select("field", F.col("doc").alias("doc_a"), F.col("key").alias("key_a"))
    on_b = members.where("side = 1").select(F.col("doc").alias("doc_b"), F.col("key").alias("key_b"))
    out = linked.join(on_a, "doc_a").join(on_b, "doc_b").where("key_a != key_b")
    names = F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("field") + 1)
    return out.select("key_a", "key_b", names.alias("field"), "same")
