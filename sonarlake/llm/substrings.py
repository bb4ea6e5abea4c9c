"""Substring dedup: MinHash banding of paragraphs.

A text's words are cut at line ends and where a word's hash is the least of its
surroundings, so that a passage pasted anywhere falls into the same paragraphs,
but for its two ends. Paragraphs of at least ``LEAST`` words count, and a
repeat is reported if it and the repeats that adjoin it (but for less than a
paragraph between) have ``RUN`` words. Equal
ones become one node. The others meet by MinHash: bands and rows are tuned so
that a pair at the threshold collides with the wanted chance and others seldom,
and a join stands if the exact Jaccard similarity of the five-word shingles is
high enough, or, for paragraphs with few shingles, if the words' edit distance is
small. Each node of a bucket is first held against the bucket's least one; then
all pairs of a bucket whose classes are still unlike, in blocks, so that neither
a crowd of copies is paired with itself nor a pair of a crowd left out; of a bucket
of more than ``CROWD`` nodes the pairs aren't written, but compared where its
paragraphs are brought together. Pairs of
short paragraphs one word apart are found exactly, by what is left of them without
one word; only those are looked at of which half the words begin or end another. Nodes joined directly or through others are one class; all but its
first paragraph (by doc_id, then text and place; null ids last) are removals.

Defined results: a null or empty text has no paragraphs; a document repeating
itself is a repeat; rows that share an id and a text are one document, and so are
rows without an id that share a text; documents without a repeated paragraph give
no row; equal least hashes are equal shingles, so ties change nothing; texts of
any length are cut as a whole; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import words as w
from .graph import components
from .store import Bits, discard, fold_bits, materialise

REACH = 5
LEAST = 6
RUN = 16
SHINGLE = 5
SIMILARITY = 0.8
COLLIDE = 0.98
FEW = 12
EDITS = 0.1
BLOCK = 64
CROWD = 64


def tuned(similarity: float = SIMILARITY, collide: float = COLLIDE, most: int = 4) -> tuple[int, int]:
    """(bands, rows): of at most ``most`` bands the strictest that make a pair at the threshold collide so often."""
    for rows in range(8, 0, -1):
        for bands in range(1, most + 1):
            if 1 - (1 - similarity**rows) ** bands >= collide:
                return bands, rows
    raise ValueError("no banding reaches that recall")


def cuts(h: np.ndarray, at: np.ndarray, lines: np.ndarray, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """(first word, end word) of every paragraph of at least LEAST words; ``at`` and ``lines`` begin texts and lines."""
    n = len(h)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z
    pair = w.mix(h * np.uint64(0x9FB21C651E98DF25))
    edge = np.zeros(n + 1, bool)
    edge[at] = edge[lines] = True
    # a gap before each line, so that a word's surroundings end with its line, whatever text comes next
    place = np.arange(n) + reach * np.cumsum(edge[:n])
    padded = np.full(int(place[-1]) + 1 + reach, np.uint64(2**64 - 1))
    padded[place] = pair
    before, after = padded[place - 1], padded[place + 1]
    for k in range(2, reach + 1):
        np.minimum(before, padded[place - k], out=before)
        np.minimum(after, padded[place + k], out=after)
    edge[:n] |= (pair < before) & (pair <= after)
    starts = np.flatnonzero(edge)
    a, b = starts[:-1], starts[1:]
    keep = b - a >= LEAST
    return a[keep], b[keep]


class Paragraphs:
    """Paragraphs of a block of texts, with keys, shingles and MinHashes."""

    def __init__(self, texts: pa.Array) -> None:
        self.t = t = w.words(texts)
        self.a, self.b = cuts(t.h, t.at, np.searchsorted(t.start, np.flatnonzero(t.data == 10)))
        self.row = np.searchsorted(t.at, self.a, "right") - 1
        n = len(t.h)
        self.sums = sums = np.zeros(n + 1, np.uint64)
        np.cumsum(w.mix(t.h) * w._powers("p", w._P, n), out=sums[1:])
        self.key = w.mix((sums[self.b] - sums[self.a]) * w._powers("q", w._PINV, n)[self.a]) if n else np.zeros(0, np.uint64)
        self.inverse = w._powers("q", w._PINV, n)
        g = np.zeros(n, np.uint64)
        for j in range(SHINGLE):
            g[: n - j] += t.h[j:] * np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)) if n > j else 0
        self.g = w.mix(g)
        self.last = self.b - SHINGLE + 1  # end of the shingles that lie inside

    def minhash(self, seed: int) -> np.ndarray:
        """The least seeded shingle hash of each paragraph."""
        if not len(self.a):
            return np.zeros(0, np.uint64)
        x = w.mix(self.g ^ np.uint64(seed))
        bounds = np.stack([self.a, self.last], axis=1).ravel()
        return np.minimum.reduceat(np.append(x, np.uint64(2**64 - 1)), bounds)[::2]

    def hashed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the words from a to b."""
        return (self.sums[b] - self.sums[a]) * self.inverse[a]

    def halves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, length, is it the end) of three parts of each paragraph; hash 0 if it isn't short.

        Of two paragraphs one word apart (another word, or one more) either the
        first half of the shorter begins the other, or its second half ends it;
        the third part is the shorter's, if this is the longer one.
        """
        n = self.b - self.a
        half = n // 2
        size = np.stack([half, n - half, np.where(n % 2, half, half - 1)], axis=1)
        end = np.stack([np.zeros(len(n), bool), np.ones(len(n), bool), n % 2 > 0], axis=1)
        lo = np.where(end, self.b[:, None] - size, self.a[:, None])
        h = w.mix(self.hashed(lo, lo + size) + end.astype(np.uint64)) | np.uint64(1)
        h[n > FEW + SHINGLE] = 0
        return h, size, end

    def without_one(self, halves: Bits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(paragraph, place, hash) of distinct short paragraphs with a known half: whole (place -1) and without each word beside that half."""
        h, size, end = self.halves()
        known = (h != 0) & halves.has(h.ravel().view(np.int64)).reshape(h.shape)
        short = np.flatnonzero(known.any(1))
        short = short[np.unique(self.key[short], return_index=True)[1]]
        n = self.b[short] - self.a[short]
        known, size, end = known[short], size[short], end[short]
        lo = np.where(known & ~end, size, 1 << 30).min(1, initial=1 << 30)  # beyond a known beginning
        hi = n - np.where(known & end, size, 1 << 30).min(1, initial=1 << 30)  # before a known end
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        open_ = (place >= np.repeat(lo, n)) | (place < np.repeat(hi, n))
        row, place = np.repeat(short, n)[open_], place[open_]
        a, b, at = self.a[row], self.b[row], self.a[row] + place
        left = self.hashed(a, at) + (self.sums[b] - self.sums[at + 1]) * self.inverse[a + 1]
        return np.concatenate([short, row]), np.concatenate([np.full(len(short), -1), place]), np.concatenate([self.key[short], w.mix(left)])


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _source(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text); ``row`` stands for an id and a text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return cols.select("doc_id", F.xxhash64("doc_id", F.xxhash64("text")).alias("row"), "text")


def paragraphs(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, row, start, stop, key, m0.., h0..): places in words, digest, bands, three parts of short ones (else 0)."""

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            for at, texts in w.blocks(b.column(2)):
                p = Paragraphs(texts)
                if not len(p.a):
                    continue
                base = p.t.at[p.row]
                band = []
                for k in range(bands):
                    v = np.full(len(p.a), np.uint64(k + 1))
                    for r in range(rows):
                        v = w.mix(v * np.uint64(0x9E3779B97F4A7C15) + p.minhash(7919 * (k * rows + r + 1)))
                    band.append(v)
                ids = [b.column(k).slice(at, len(texts)).take(pa.array(p.row)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array((p.a - base).astype(np.int32)), pa.array((p.b - base).astype(np.int32)), _long(p.key), *map(_long, (*band, *p.halves()[0].T))], names)

    names = ["doc_id", "row", "start", "stop", "key", *(f"m{k}" for k in range(bands)), "h0", "h1", "h2"]
    return _source(docs).mapInArrow(run, "doc_id long, row long, start int, stop int, " + ", ".join(f"{x} long" for x in names[4:]))


def shared_halves(paras: DataFrame) -> Bits:
    """The parts (h0..) that unlike paragraphs have in common, as a bitmap."""
    h = paras.select(F.explode(F.array("h0", "h1", "h2")).alias("h"), F.col("key").bitwiseAND(0x7FFFFFFF).cast("int").alias("k")).where("h <> 0")
    twice = materialise(h.groupBy("h").agg(F.min("k").alias("x"), F.max("k").alias("y")).where("x <> y").select("h"), "para-halves")
    bits = fold_bits(twice)
    discard(twice)
    return bits


def one_apart(docs: DataFrame, halves: Bits) -> DataFrame:
    """(a, b) with a < b: every short paragraph one word away from others is joined to them.

    Paragraphs that are equal without the word at one place are each within one
    edit of the least of them, so a star joins them, however many they are; a
    paragraph that equals a longer one without a word is joined to it.
    """

    shared = docs.sparkSession.sparkContext.broadcast(halves)

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            for _, texts in w.blocks(b.column(0)):
                p = Paragraphs(texts)
                if len(p.a):
                    row, place, v = p.without_one(shared.value)
                    yield pa.RecordBatch.from_arrays([_long(p.key[row]), pa.array(place.astype(np.int32)), _long(v)], ["key", "place", "v"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "key long, place int, v long").repartition("v")
    whole = F.max(F.when(F.col("place") < 0, F.col("key"))).over(Window.partitionBy("v"))
    least = F.min("key").over(Window.partitionBy("v", "place"))
    near = rows.select("key", whole.alias("whole"), least.alias("least")).select("key", F.explode(F.array("whole", "least")).alias("other")).where("key <> other")
    return near.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()


def met_twice(paras: DataFrame, bands: int, keys: DataFrame) -> DataFrame:
    """Paragraphs whose value in some band may occur twice, or that ``keys`` (h) may name; never without one that does.

    Values are counted over all paragraphs; those met twice are set in a bitmap of
    bounded size. It only spares later steps the lone paragraphs: where it fills up,
    more of them pass.
    """
    values = paras.select(F.explode(F.array(*(F.col(f"m{k}") for k in range(bands)))).alias("h"))
    twice = materialise(values.groupBy("h").count().where("count > 1").select("h"), "para-twice")
    shared = paras.sparkSession.sparkContext.broadcast(fold_bits(twice))
    discard(twice)
    named = paras.sparkSession.sparkContext.broadcast(fold_bits(keys))
    first, last = paras.columns.index("m0"), paras.columns.index("h0")

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            some = named.value.has(b.column(first - 1).to_numpy())
            for k in range(bands):
                some |= shared.value.has(b.column(first + k).to_numpy())
            yield b.select(range(last)).filter(pa.array(some))

    return paras.mapInArrow(run, paras.drop("h0", "h1", "h2").schema)


def buckets(nodes: DataFrame, bands: int) -> DataFrame:
    """(key, v, head, c) of nodes (key, m0..) that share a band: the bucket, its least node and its size."""
    entries = nodes.select("key", F.posexplode(F.array(*(F.col(f"m{k}") for k in range(bands)))).alias("band", "m")).select("key", F.xxhash64("band", "m").alias("v"))
    sizes = entries.groupBy("v").agg(F.count("*").alias("c"), F.min("key").alias("head")).where("c > 1")
    return entries.join(sizes, "v").select("key", "v", "head", "c")


def to_heads(members: DataFrame) -> DataFrame:
    """(a, b): each node and the least one of each of its buckets."""
    return members.where("key <> head").select(F.col("head").alias("a"), F.col("key").alias("b")).distinct()


def unlike(members: DataFrame, label: DataFrame) -> DataFrame:
    """(key, v, head, c, l) of the buckets in which there are several classes (l), without their least nodes."""
    named = members.where("c > 2").join(label.select(F.col("node").alias("key"), "class"), "key", "left").withColumn("l", F.coalesce("class", "key"))
    open_ = named.groupBy("v").agg(F.min("l").alias("x"), F.max("l").alias("y")).where("x <> y").select("v")
    return named.where("key <> head").join(open_, "v", "left_semi")


def across(members: DataFrame, label: DataFrame) -> DataFrame:
    """(a, b) with a < b: pairs of one bucket whose classes are unlike, but for those with the least node.

    A bucket is cut into blocks of about ``BLOCK`` nodes; each pair of blocks is a row,
    so that no task holds a crowd. A bucket of one class gives nothing.
    """
    named = unlike(members, label).withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int"))
    block = named.withColumn("i", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).groupBy("v", "blocks", "i").agg(F.collect_list(F.struct("l", "key")).alias("x"))
    block = materialise(block, "para-blocks")
    left = block.select("v", F.col("x").alias("p"), F.col("i"), F.explode(F.sequence(F.col("i"), F.col("blocks") - 1)).alias("j"))
    both = left.join(block.select("v", F.col("i").alias("j"), F.col("x").alias("q")), ["v", "j"])
    pairs = both.select(F.explode("p").alias("s"), "q").select("s", F.explode(F.filter("q", lambda z: z["l"] != F.col("s.l"))).alias("t"))
    return pairs.select(F.least("s.key", "t.key").alias("a"), F.greatest("s.key", "t.key").alias("b")).distinct()


def alike(label: np.ndarray, part: np.ndarray | None, s: pa.ListArray, h: pa.ListArray, similarity: float = SIMILARITY) -> Iterable[tuple[int, int]]:
    """(i, j) with i < j that :func:`joined` would keep, of unlike labels (which must be in order) and, if given, unlike parts.

    A word that the other lacks, or has less often, costs an edit, so counts of words in common spare most edit distances.
    """
    ns, nh = (pc.list_value_length(x).to_numpy().astype(np.int64) for x in (s, h))
    word, row = np.unique(pc.list_flatten(h).to_numpy(), return_inverse=True)[1], np.repeat(np.arange(len(nh)), nh)
    order = np.lexsort((word, row))
    word, row = word[order], row[order]
    new = np.append(True, (word[1:] != word[:-1]) | (row[1:] != row[:-1]))
    again = np.arange(len(word)) - np.flatnonzero(new)[np.cumsum(new) - 1]  # how often the text had the word before
    sides = []
    for flat, n in ((pc.list_flatten(s).to_numpy(), ns), (word * (nh.max() + 1) + again, nh)):
        kinds, ids = np.unique(flat, return_inverse=True)
        sides.append((ids, np.concatenate([[0], np.cumsum(n)]), np.zeros(len(kinds), np.int32)))

    def common(i: int, first: int, ids: np.ndarray, off: np.ndarray, mark: np.ndarray) -> np.ndarray:
        own = ids[off[i] : off[i + 1]]
        mark[own] = 1
        out = np.add.reduceat(mark[ids[off[first] :]], off[first:-1] - off[first])
        mark[own] = 0
        return out

    for i in range(len(label)):
        first = int(np.searchsorted(label, label[i], "right"))
        if first == len(label):
            break
        j = np.arange(first, len(label))
        shared = common(i, first, *sides[0])
        ok = shared >= similarity * (ns[i] + ns[j] - shared)
        most = np.maximum(1, (EDITS * np.maximum(nh[i], nh[j])).astype(np.int64))
        few = ~ok & (np.minimum(ns[i], ns[j]) <= FEW) & (np.abs(nh[i] - nh[j]) <= most)
        if few.any():
            few &= common(i, first, *sides[1]) >= np.maximum(nh[i], nh[j]) - most
        if part is not None:
            ok &= part[j] != part[i]
            few &= part[j] != part[i]
        for k in np.flatnonzero(few):
            ok[k] = _edits(h[i].as_py(), h[int(j[k])].as_py(), int(most[k]))
        yield from ((i, int(k)) for k in j[ok])


def across_crowds(members: DataFrame, label: DataFrame, parts: DataFrame, similarity: float = SIMILARITY, block: int = 16 * BLOCK) -> DataFrame:
    """(a, b) with a < b: the pairs of :func:`across` that :func:`joined` would keep, in each task one for each two classes.

    A bucket is cut into blocks of about ``block`` nodes; each pair of blocks is a
    task and gets their contents, so what is shuffled grows with a bucket's blocks and not with its pairs.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("l", "ascending"), ("key", "ascending")]).combine_chunks()
        node, label = t["key"].to_numpy(), t["l"].to_numpy()
        part = t["part"].to_numpy() if t["i"][0] != t["j"][0] else None
        links: dict[tuple, tuple] = {}
        for i, j in alike(label, part, t["s"].combine_chunks(), t["h"].combine_chunks(), similarity):
            links.setdefault((label[i], label[j]), (min(node[i], node[j]), max(node[i], node[j])))
        a, b = np.array(list(links.values()), np.int64).reshape(-1, 2).T
        return pa.table({"a": a.copy(), "b": b.copy()})

    cut = F.ceil(F.col("c") / block).cast("int")
    named = unlike(members, label).withColumn("part", F.pmod(F.xxhash64("key"), cut).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), cut - 1)))
    named = named.select("v", "key", "l", "part", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"))
    return named.join(parts, "key").groupBy("v", "i", "j").applyInArrow(run, "a long, b long").distinct()


def contents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, s, h): shingle and word hashes of the paragraphs in ``wanted`` (row, key), each from one holder.

    Texts are not shuffled: documents are picked by a bitmap of ``row``, their
    paragraphs by one of both; a few others pass and are met by no pair.
    """
    rows = docs.sparkSession.sparkContext.broadcast(fold_bits(wanted.select(F.col("row").alias("h")).distinct()))
    pairs = docs.sparkSession.sparkContext.broadcast(fold_bits(wanted.select(F.col("row").bitwiseXOR(F.col("key")).alias("h"))))

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            b = b.filter(pa.array(rows.value.has(b.column(0).to_numpy())))
            row = b.column(0).to_numpy()
            for at, texts in w.blocks(b.column(1)):
                p = Paragraphs(texts)
                hit = np.flatnonzero(pairs.value.has((row[at + p.row].view(np.uint64) ^ p.key).view(np.int64)))
                hit = hit[np.unique(p.key[hit], return_index=True)[1]]
                s = [np.unique(p.g[p.a[k] : p.last[k]]).view(np.int64) for k in hit]
                h = [p.t.h[p.a[k] : p.b[k]].view(np.int64) for k in hit]
                yield pa.RecordBatch.from_arrays([_long(p.key[hit]), pa.array(s, pa.list_(pa.int64())), pa.array(h, pa.list_(pa.int64()))], ["key", "s", "h"])

    return _source(docs).select("row", "text").mapInArrow(run, "key long, s array<long>, h array<long>")


def _edits(a: list[int], b: list[int], most: int) -> bool:
    """Is the edit distance of two word sequences at most ``most``?"""
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most


def joined(pairs: DataFrame, parts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs that are similar enough, by shingles or, if few, by words; only these few go to Python."""

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            keep = [ok or (p is not None and _edits(p, q, max(1, int(EDITS * max(len(p), len(q)))))) for ok, p, q in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)))]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = parts.select(F.col("key").alias("a"), F.col("s").alias("sa"), F.col("h").alias("ha"))
    right = parts.select(F.col("key").alias("b"), F.col("s").alias("sb"), F.col("h").alias("hb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("ok", shared >= similarity * (F.size("sa") + F.size("sb") - shared))
    most = F.greatest(F.lit(1), F.floor(EDITS * F.greatest(F.size("ha"), F.size("hb"))))
    few = ~F.col("ok") & (F.least(F.size("sa"), F.size("sb")) <= FEW) & (F.abs(F.size("ha") - F.size("hb")) <= most)
    near = both.select("a", "b", "ok", F.when(few, F.col("ha")).alias("p"), F.when(few, F.col("hb")).alias("q")).where("ok or p is not null")
    return near.mapInArrow(run, "a long, b long")


def repeated_paragraphs(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, first_doc_id, class_id, start_word, end_word, removed, run_words) of repeated paragraphs."""
    bands, rows = tuned(similarity)
    every = materialise(paragraphs(docs, bands, rows), "para-all")
    apart = materialise(one_apart(docs, shared_halves(every)), "para-apart")
    paras = materialise(met_twice(every, bands, apart.select(F.explode(F.array("a", "b")).alias("h")).distinct()), "para-some")
    discard(every)
    here = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "start", "stop")
    nodes = materialise(paras.groupBy("key").agg(F.min(here).alias("first"), F.max(here).alias("last"), *(F.first(c).alias(c) for c in (f"m{k}" for k in range(bands)))), "para-nodes")
    members = materialise(buckets(nodes.drop("first", "last"), bands), "para-members")
    wanted = nodes.join(members.select("key").distinct(), "key", "left_semi").select(F.col("first.row").alias("row"), "key")
    parts = materialise(contents(docs, wanted), "para-contents")
    # against the least node of each bucket first, then what is left open
    links = materialise(joined(to_heads(members), parts, similarity).unionByName(apart).distinct(), "para-links")
    label = components(links)
    rest = materialise(across(members.where(F.col("c") <= CROWD), label), "para-rest")
    crowds = across_crowds(members.where(F.col("c") > CROWD), label, parts, similarity)
    links = materialise(links.unionByName(joined(rest, parts, similarity)).unionByName(crowds).distinct(), "para-links")
    discard(members, parts, rest)
    label = components(links).select(F.col("node").alias("key"), F.col("class").alias("c"))
    known = nodes.join(label, "key", "left").where(F.col("c").isNotNull() | ~F.col("first").eqNullSafe(F.col("last"))).select("key", F.coalesce("c", "key").alias("class_id"), "first")
    heads = known.groupBy("class_id").agg(F.min("first").alias("head"))
    known = materialise(known.join(heads, "class_id").select("key", "class_id", "head"), "para-classes")
    out = paras.select("key", "doc_id", "row", "start", "stop").join(known, "key")
    out = out.select("doc_id", "row", F.col("head.doc_id").alias("first_doc_id"), "class_id", F.col("start").cast("long").alias("start_word"), F.col("stop").cast("long").alias("end_word"), (~here.eqNullSafe(F.col("head"))).alias("removed")).distinct()
    # runs of adjoining repeats, within one document
    by_doc = Window.partitionBy("row").orderBy("start_word", "end_word", "class_id")
    out = out.withColumn("new", (F.col("start_word") > F.coalesce(F.lag("end_word").over(by_doc), F.lit(-LEAST)) + LEAST).cast("int"))
    out = out.withColumn("run", F.sum("new").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    length = Window.partitionBy("row", "run")
    out = out.withColumn("run_words", F.max("end_word").over(length) - F.min("start_word").over(length))
    return out.where(F.col("run_words") >= RUN).drop("new", "run", "row")


def op10_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph of ``documents`` that occurs more than once, and which to remove."""
    return repeated_paragraphs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
