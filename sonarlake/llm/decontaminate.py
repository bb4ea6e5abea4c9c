"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into overlapping passages. Every word that occurs in the
benchmark is a column; its inverse passage frequency is counted over all
passages. A distributed randomised SVD (a sketch, then one subspace iteration,
both summed over executors) of the TF-IDF passages and the benchmark items gives
a latent space, in which passages near an item by cosine are candidates. A
candidate stands if the longest common subsequence of words covers most of the
item, or a good share of it and the item's answer (the content words of its last
sentence) is there as well.

All passages with as many words of the benchmark as an item needs are held against
all items of the block by a product of their latent vectors: those near enough are
the candidates. The check of these begins with the words that both share: ``SHARED``
content words, or all an item has.
An item of which less than ``PART`` of the words are content words (it is of
common words, or was copied so often that its words became common) is searched
by all its words instead: a copy that stands has at least ``needed`` of them in
one passage, every such passage is a candidate whatever its cosine, and the
common subsequence decides.

Defined results: null and empty texts and items have no words and match nothing;
an item is found in itself; repeated rows give one result; rows are told apart by
id and text, so one without an id is judged like any other; of equally good places
in a document the last is given; a text of any length is cut into passages as a
whole; documents that match nothing give no row; an empty benchmark gives an empty
result; extra columns are ignored. Items are taken in blocks of ``ITEMS``, so what
is broadcast is bounded.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as w
from .store import materialise

PASSAGE, STRIDE = 48, 24
CONTENT = 0.01  # a content word occurs in at most this share of passages
SHARED = 4
PART = 0.25  # of an item's words; with fewer content words all are searched
RANK, OVER = 256, 16
COSINE = 0.3
COPY, PARAPHRASE, ANSWER = 0.8, 0.55, 0.6
ITEMS = 5000
FAN_IN = 8
SLOTS = 20
FOUND = "doc_id long, row long, item_id long, lcs_share double, answer_share double, start_word long, cosine double"


class Items:
    """A block of benchmark items: words, vocabulary, answers."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        t = w.words(w.strings(pa.array(texts, pa.string())))
        self.ids = ids
        self.words = [t.h[a:b] for a, b in zip(t.at, t.at[1:])]
        self.vocab = np.unique(t.h)
        last = [([s for s in re.split(r"(?<=[.!?])\s+|\n", x.strip()) if re.search(r"\w", s)] or [""])[-1] for x in texts]
        t = w.words(w.strings(pa.array(last, pa.string())))
        self.answers = [np.unique(t.h[a:b]) for a, b in zip(t.at, t.at[1:])]
        self.slot = np.full(1 << SLOTS, -1, np.int32)
        self.more = []
        for k, h in enumerate(self.vocab):
            i = int(h >> np.uint64(64 - SLOTS))
            if self.slot[i] < 0:
                self.slot[i] = k
            else:
                self.more.append(k)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Vocabulary numbers of word hashes, or -1."""
        at = self.slot[h >> np.uint64(64 - SLOTS)]
        at[self.vocab[at] != h] = -1
        for k in self.more:
            at[h == self.vocab[k]] = k
        return at


def known_words(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id, row, n, pos, ids) per document, and rows with ``df``: passages by word, summed per batch."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterable[pa.RecordBatch]):
        x = shared.value
        size = len(x.vocab)
        names = ["doc_id", "row", "n", "pos", "ids", "df", "passages"]
        for b in batches:
            df, passages = np.zeros(size, np.int64), 0
            for at, texts in w.blocks(b.column(2)):
                t = w.words(texts)
                ids = x.lookup(t.h)
                hit = np.flatnonzero(ids >= 0)
                row = np.searchsorted(t.at, hit, "right") - 1
                pos = (hit - t.at[row]).astype(np.uint32)
                ids = ids[hit].astype(np.uint32)
                count = np.diff(t.at)
                lots = np.where(count > 0, np.maximum(1, -(-(count - PASSAGE) // STRIDE) + 1), 0)
                base = np.concatenate([[0], np.cumsum(lots)])
                passages += int(base[-1])
                hi = np.minimum(pos // STRIDE, lots[row] - 1)
                lo = np.maximum(0, pos.astype(np.int64) - PASSAGE + STRIDE) // STRIDE
                for k in range(PASSAGE // STRIDE):
                    p = lo + k
                    ok = p <= hi
                    pair = np.unique((base[row] + p)[ok] * size + ids[ok])
                    df += np.bincount(pair % size, minlength=size)
                cut = np.searchsorted(row, np.arange(len(texts) + 1))
                raw = (pos.tobytes(), ids.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(texts)), b.column(1).slice(at, len(texts)), pa.array(count, pa.int64()), *(pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((4 * cut).astype(np.int32).tobytes()), pa.py_buffer(r)]) for r in raw), pa.nulls(len(texts), pa.binary()), pa.nulls(len(texts), pa.int64())], names
                )
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([df.tobytes()], pa.binary()), pa.array([passages], pa.int64())], names)

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cols = cols.select("doc_id", F.xxhash64("doc_id", F.xxhash64("text")).alias("row"), "text")
    return cols.mapInArrow(w.lean(run), "doc_id long, row long, n long, pos binary, ids binary, df binary, passages long")


def summed(rows: DataFrame, column: str, kind: type) -> np.ndarray | None:
    """The sum of packed vectors (column), by a tree in which a task reads about ``FAN_IN`` of them."""

    def run(batches: Iterable[pa.RecordBatch]):
        total = None
        for b in batches:
            for x in b.column(0):
                v = np.frombuffer(x.as_buffer(), kind)
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], [column])

    left = rows.rdd.getNumPartitions()
    rows = rows.select(column).mapInArrow(w.lean(run), f"{column} binary")
    while left > 1:
        left = -(-left // FAN_IN)
        rows = rows.repartition(left).mapInArrow(w.lean(run), f"{column} binary")
    got = rows.collect()
    return np.frombuffer(bytes(got[0][0]), kind) if got else None


def passages(known: DataFrame, weight: np.ndarray, least: int) -> DataFrame:
    """(row, start, ids): passages with ``least`` distinct content words, those with a weight."""
    shared = known.sparkSession.sparkContext.broadcast(weight)

    def run(batches: Iterable[pa.RecordBatch]):
        used = shared.value > 0
        size = len(used)
        for b in batches:
            off_p, raw_p = np.frombuffer(b.column(2).buffers()[1], np.int32)[b.column(2).offset :][: b.num_rows + 1], b.column(2).buffers()[2]
            off_i, raw_i = np.frombuffer(b.column(3).buffers()[1], np.int32)[b.column(3).offset :][: b.num_rows + 1], b.column(3).buffers()[2]
            if raw_p is None or off_p[-1] == off_p[0]:
                continue
            pos = np.frombuffer(raw_p, np.uint32, (off_p[-1] - off_p[0]) // 4, off_p[0]).astype(np.int64)
            ids = np.frombuffer(raw_i, np.uint32, (off_i[-1] - off_i[0]) // 4, off_i[0])
            row = np.repeat(np.arange(b.num_rows), np.diff(off_p) // 4)
            keep = used[ids]
            pos, ids, row = pos[keep], ids[keep], row[keep]
            count = b.column(1).to_numpy(zero_copy_only=False)
            lots = np.where(count > 0, np.maximum(1, -(-(count - PASSAGE) // STRIDE) + 1), 0)
            base = np.concatenate([[0], np.cumsum(lots)])
            hi = np.minimum(pos // STRIDE, lots[row] - 1)
            lo = np.maximum(0, pos - PASSAGE + STRIDE) // STRIDE
            pairs = [((base[row] + lo + k) * size + ids)[lo + k <= hi] for k in range(PASSAGE // STRIDE)]
            pair = np.unique(np.concatenate(pairs))
            at, first, n = np.unique(pair // size, return_index=True, return_counts=True)
            good = n >= least
            if not good.any():
                continue
            member = np.repeat(good, n)
            owner = np.searchsorted(base, at[good], "right") - 1
            cut = np.concatenate([[0], np.cumsum(n[good])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), pa.array((at[good] - base[owner]) * STRIDE, pa.int64()), pa.ListArray.from_arrays(pa.array(cut), pa.array((pair % size)[member].astype(np.int32)))], ["row", "start", "ids"])

    return known.where("df is null").select("row", "n", "pos", "ids").mapInArrow(w.lean(run), "row long, start long, ids array<int>")


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    ids = column.flatten().to_numpy()
    off = column.offsets.to_numpy().astype(np.int64)
    return off - off[0], ids


def gathered(table: np.ndarray, index: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Per row r the sum of table[index[off[r]:off[r + 1]]]; rows of like length at once."""
    n = np.diff(off)
    out = np.zeros((len(n), table.shape[1]), table.dtype)
    for c in np.unique(n[n > 0]).tolist():
        r = np.flatnonzero(n == c)
        if c > 32:
            for q in r:
                out[q] = table[index[off[q] : off[q + 1]]].sum(0)
            continue
        acc = table[index[off[r]]]
        for j in range(1, c):
            acc += table[index[off[r] + j]]
        out[r] = acc
    return out


def project(off: np.ndarray, ids: np.ndarray, weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Unit TF-IDF rows times a basis; ``off`` bounds each row's (non-empty) ids."""
    scale = 1 / np.sqrt(np.add.reduceat(weight[ids] ** 2, off[:-1]))
    return gathered(basis * weight[:, None], ids, off) * scale[:, None]


def latent_space(rows: DataFrame, weight: np.ndarray, items: list[np.ndarray], rank: int = RANK) -> np.ndarray:
    """(vocabulary, rank) leading right singular vectors of passages and items.

    The items together weigh as much as the passages, so that what sets an item
    apart is kept even where no passage repeats it.
    """
    size = len(weight)
    k = min(size, rank + OVER)
    sc = rows.sparkSession.sparkContext
    some = [x for x in items if len(x)]
    off, ids = np.concatenate([[0], np.cumsum([len(x) for x in some])]), np.concatenate(some)

    heavy = max(1.0, rows.count() / len(some))

    def product(basis: np.ndarray) -> np.ndarray:
        """A'(A basis) over all rows; weights are taken in before and after, not per entry."""
        shared = sc.broadcast(((basis * weight[:, None]).astype(np.float32), (weight * weight).astype(np.float32)))

        def block(off: np.ndarray, ids: np.ndarray, total: np.ndarray) -> None:
            scaled, square = shared.value
            y = gathered(scaled, ids, off) / np.add.reduceat(square[ids], off[:-1])[:, None]
            order = np.argsort(ids, kind="stable")
            word = ids[order]
            heads = np.flatnonzero(np.diff(word, prepend=-1))
            row = np.repeat(np.arange(len(off) - 1), np.diff(off))[order]
            total[word[heads]] += gathered(y, row, np.append(heads, len(row)))

        def run(batches: Iterable[pa.RecordBatch]):
            total = np.zeros((size, k))
            for b in batches:
                for s in range(0, b.num_rows, 2000):
                    block(*_rows(b.column(0).slice(s, 2000)), total)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

        got = summed(rows.select("ids").mapInArrow(w.lean(run), "v binary"), "v", float)
        total = np.zeros((size, k))
        for s in range(0, len(off) - 1, 500):
            o = off[s : s + 501]
            block(o - o[0], ids[o[0] : o[-1]], total)
        return (heavy * total + (0 if got is None else got.reshape(-1, k))) * weight[:, None]

    q = np.linalg.qr(product(np.random.default_rng(3).standard_normal((size, k))))[0]
    again = product(q)
    value, vector = np.linalg.eigh(q.T @ again)  # Rayleigh-Ritz: the second product serves for it too
    return (q @ vector[:, ::-1][:, :rank]).astype(np.float32)


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, with bits of a whole row at once."""
    where: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        if m := where.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def needed(item: np.ndarray) -> int:
    """Distinct words of an item that a copy that stands has in one passage at least.

    It lacks no more than ``1 - PARAPHRASE`` of the item, and its stretch touches so
    many runs of ``PASSAGE`` words, each of which lies in one passage.
    """
    n = len(item)
    has = len(np.unique(item)) - (n - math.ceil(PARAPHRASE * n))
    runs = (n + max(8, n // 3) - 2) // PASSAGE + 2
    return max(1, -(-has // runs))


def judged(item: np.ndarray, answer: np.ndarray, content: np.ndarray, must: np.ndarray, pos: np.ndarray, ids: np.ndarray, start: int) -> tuple[float, float] | None:
    """(share of the item in order, share of its answer) around a passage, if it stands.

    All words are vocabulary numbers, the document's with their places: a word that
    is in no item cannot be part of a common subsequence.
    """
    n = len(item)
    lo, hi = max(0, start - n), start + PASSAGE + n
    a, b = np.searchsorted(pos, (lo, hi))
    pos, ids = pos[a:b], ids[a:b]
    if not len(pos) or len(np.intersect1d(ids, must)) < min(SHARED, len(must)):
        return None
    best, reach = 0.0, n + max(8, n // 3)
    step = max(4, n // 6)
    for s in range(lo, max(lo + 1, int(pos[-1]) + 1 - reach + step), step):
        c, d = np.searchsorted(pos, (s, s + reach))
        best = max(best, lcs(item, ids[c:d]) / n)
    key = np.intersect1d(answer, content)
    key = key if len(key) else answer
    found = float(np.isin(key, ids).mean()) if len(key) else 0.0
    return (best, found) if best >= COPY or (best >= PARAPHRASE and found >= ANSWER) else None


def _one_block(docs: DataFrame, items: Items) -> DataFrame | None:
    sc = docs.sparkSession.sparkContext
    known = materialise(known_words(docs, items), "leak-words")
    counts = known.where("df is not null")
    df = summed(counts, "df", np.int64)
    total = int(counts.agg(F.sum("passages")).first()[0] or 0)
    if not total or df is None:
        return None
    most = max(CONTENT * total, 25.0)  # of a few passages, a word in 25 is still rare
    number = [items.lookup(x) for x in items.words]
    known_own = [np.unique(x[df[x] > 0]) if len(x) else x for x in number]
    own = [x[df[x] <= most] for x in known_own]
    scarce = [len(x) > 0 and np.sum(df[np.unique(x)] <= most) < max(SHARED, PART * len(np.unique(x))) for x in number]
    own = [a if s else o for a, o, s in zip(known_own, own, scarce)]
    if not any(map(len, own)):
        return None
    need = np.array([needed(x) if s else min(SHARED, len(o)) for x, o, s in zip(number, own, scarce)])
    content = np.flatnonzero((df > 0) & (df <= most))
    used = np.union1d(content, np.concatenate(own))
    weight = np.zeros(len(df))
    weight[used] = np.log(1 + total / df[used])
    least = max(1, min(n for n, o in zip(need.tolist(), own) if len(o)))
    rows = materialise(passages(known, weight, least), "leak-passages")
    basis = latent_space(rows, weight, own)
    live = [k for k, x in enumerate(own) if len(x)]
    off = np.concatenate([[0], np.cumsum([len(own[k]) for k in live])])
    latent = project(off, np.concatenate([own[k] for k in live]), weight.astype(np.float32), basis)
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    shared = sc.broadcast((weight.astype(np.float32), basis, latent.astype(np.float32), live, own, need, np.array(scarce), items, content))

    def search(batches: Iterable[pa.RecordBatch]):
        wt, bs, lt, live, own, need, scarce, *_ = shared.value
        need, scarce = need[live], scarce[live]
        few = np.flatnonzero(scarce)
        flat = np.concatenate([own[live[k]] for k in few]) if len(few) else np.zeros(0, np.int64)
        by_word = np.argsort(flat, kind="stable")
        holder = np.repeat(few, [len(own[live[k]]) for k in few])[by_word]
        ptr = np.searchsorted(flat[by_word], np.arange(len(wt) + 1))
        words_of = np.sort(np.concatenate([at * len(wt) + own[k] for at, k in enumerate(live)]))
        step = max(1, 10_000_000 // max(1, len(live)))
        for b in batches:
            for s in range(0, b.num_rows, min(5000, step)):
                part = b.slice(s, min(5000, step))
                off, ids = _rows(part.column(2))
                y = project(off, ids, wt, bs)
                y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)
                near = y @ lt.T
                r, c = np.nonzero(near >= COSINE)
                # the check begins here, so that what can't stand isn't stored: words that passage and item share
                n = np.diff(off)[r]
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(off[:-1][r], n)
                asked = np.repeat(c, n) * len(wt) + ids[at]
                found = words_of[np.minimum(np.searchsorted(words_of, asked), len(words_of) - 1)] == asked
                good = np.bincount(np.repeat(np.arange(len(r)), n)[found], minlength=len(r)) >= need[c]
                r, c = r[good], c[good]
                if len(few):
                    # items of common words: all passages with as many of their words as a copy has
                    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
                    n = ptr[ids + 1] - ptr[ids]
                    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ptr[ids], n)
                    pair, shares = np.unique(np.repeat(row, n) * len(live) + holder[at], return_counts=True)
                    pair = np.union1d(pair[shares >= need[pair % len(live)]], r * len(live) + c)
                    r, c = pair // len(live), pair % len(live)
                if len(r):
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(r)), part.column(1).take(pa.array(r)), pa.array(np.array(live)[c].astype(np.int32)), pa.array(near[r, c].astype(float))], ["row", "start", "item", "cosine"])

    near = materialise(rows.mapInArrow(w.lean(search), "row long, start long, item int, cosine double"), "leak-candidates")
    per = near.groupBy("row").agg(F.collect_list(F.struct("item", "start", "cosine")).alias("c"))  # of one document each

    def decide(batches: Iterable[pa.RecordBatch]):
        *_, own, _, scarce, x, content = shared.value
        item_words, answers = [x.lookup(v) for v in x.words], [x.lookup(v) for v in x.answers]
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            for doc_id, row, raw_pos, raw_ids, ask in zip(*(b.column(k).to_pylist() for k in range(5))):
                pos, ids, best = np.frombuffer(raw_pos, np.uint32).astype(np.int64), np.frombuffer(raw_ids, np.uint32).astype(np.int32), {}
                for c in ask:
                    i = c["item"]
                    got = judged(item_words[i], answers[i], content, own[i][:0] if scarce[i] else own[i], pos, ids, c["start"])
                    if got and (i not in best or got > best[i][:2]):
                        best[i] = (*got, c["start"], c["cosine"])
                for i, (share, answer, start, cosine) in sorted(best.items()):
                    for col, v in zip(out, (doc_id, row, x.ids[i], share, answer, start, cosine)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64()])], ["doc_id", "row", "item_id", "lcs_share", "answer_share", "start_word", "cosine"])

    # hashed at every size: the candidates grow with the input, so they aren't broadcast
    asked = known.where("df is null").select("doc_id", "row", "pos", "ids").join(per.hint("shuffle_hash"), "row").select("doc_id", "row", "pos", "ids", "c")
    return asked.mapInArrow(w.lean(decide), FOUND)


def found_leaks(docs: DataFrame, benchmark: DataFrame, block: int = ITEMS) -> DataFrame:
    """:func:`leaks` with ``row``, the hash of a document's id and text's hash."""
    source = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).where("t is not null")
    blocks = max(1, -(-source.count() // block))
    found = docs.sparkSession.createDataFrame([], FOUND)
    for k in range(blocks):  # each of about `block` items, one at a time
        part = source.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).orderBy("i", "t").collect()
        if part and (one := _one_block(docs, Items([r.i for r in part], [r.t for r in part]))) is not None:
            found = found.unionByName(one)
    return found.groupBy("doc_id", "row", "item_id").agg(*(F.max_by(c, F.struct("lcs_share", "answer_share", "start_word")).alias(c) for c in ("lcs_share", "answer_share", "start_word", "cosine")))


def leaks(docs: DataFrame, benchmark: DataFrame, block: int = ITEMS) -> DataFrame:
    """(doc_id, item_id, lcs_share, answer_share, start_word, cosine) of documents that hold an item."""
    return found_leaks(docs, benchmark, block).drop("row")


def op1_lsa_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item or a paraphrase of one."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
