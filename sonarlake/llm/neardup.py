"""SimHash near-dedup: May-Ozerov recursion finds pairs, exact sets decide.

Texts that are equal become one node. A node's 128-bit SimHash is taken over its
distinct five-word shingles. A list keeps the fingerprints whose distance from a
random mask on a random strip of coordinates is small; near pairs survive this
together far more often than chance. A round filters all nodes into lists, each
list again into shorter ones, and so on, as deep as the number of nodes asks for;
the last lists are searched by brute force. Rounds are repeated until the target
recall at similarity 0.8 is reached over all distances that such pairs have. The
first levels are shuffled, the last is worked off inside a list's task; a list of
more than ``SPLIT`` rows is cut into blocks, each pair of which is a task.

Pairs are sought twice. A few lists first give each node's nearest partners;
those whose exact Jaccard similarity is high enough make draft classes. Then
every list gives all its close pairs of unlike classes, none left out, so a
crowd of near copies is not paired with itself but no link between classes is
lost. They are compared by the least ``SKETCH`` shingle hashes, then exactly.
Of a row with more than ``CROWD`` such partners in a list no pair is written:
rows so joined, directly or through others, are one crowd, whose shingle sets
are brought together and compared there, in blocks. An edited copy whose shingles
mostly occur nowhere else in its crowd is near nothing in it, which its count of
shared ones tells exactly.
Texts of at most ``SHORT`` shingles, whose fingerprints vary most, are also found
exactly, by equality of their sets but for one shingle. Classes are components.

Defined results: a null text counts as empty; equal texts (empty ones too) are
of one class; a text of fewer than five words is one shingle of all its words; a
text without words is near nothing but its equals; of a class the row of least
(doc_id, text hash) is kept, null ids last; rows that repeat an id and its text
are one document; rows of one id with other texts are classed by their texts;
``class_id`` is the least id of the class (a negative hash if none has one);
extra columns are ignored. Texts are told apart by a 64-bit hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as w
from .graph import components
from .store import discard, fold_bits, materialise

SHINGLE = 5
SIMILARITY = 0.8
BITS = 128
STRIP = 32
WEIGHT = 9
RADIUS = 36
SKETCH = 64
LIKELY = 0.55
RECALL = 0.9995
LEAF = 4096
SPLIT = 400_000
NEAREST = 3
CROWD = 8
ROOM = 2_000_000  # shingles of a block of a crowd
SHORT = 9

_SPREAD = np.zeros(256, np.uint64)  # bit k of a byte in byte k
for _k in range(8):
    _SPREAD |= ((np.arange(256, dtype=np.uint64) >> np.uint64(_k)) & np.uint64(1)) << np.uint64(8 * _k)


def shingles(texts: pa.Array) -> Iterator[np.ndarray]:
    """Distinct shingle hashes of each text of a block, sorted as signed numbers."""
    t = w.words(texts)
    g, at = w.grams(t.h, t.at, SHINGLE)
    for k in range(len(at) - 1):
        yield np.unique(g[at[k] : at[k + 1]].view(np.int64)).view(np.uint64)


def simhash(sets: list[np.ndarray]) -> np.ndarray:
    """(n, 2) words of 128 bits: the majority of each bit over a set; ties are 0."""
    n = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), 2), np.uint64)
    if not n.sum():
        return out
    h = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    cuts = np.unique(np.concatenate([starts[n > 0], np.arange(0, len(h), 255)]))  # a byte holds sums to 255
    owner = np.searchsorted(starts[n > 0], cuts, "right") - 1
    live = np.flatnonzero(n)
    for word, seed in enumerate((0x9E6C63D0876A9A47, 0xE7037ED1A0B428DB)):
        raw = w.mix(h ^ np.uint64(seed)).view(np.uint8).reshape(-1, 8)
        total = np.zeros((len(live), 64), np.int64)
        for byte in range(8):
            part = np.add.reduceat(_SPREAD[raw[:, byte]], cuts).view(np.uint8).reshape(-1, 8)
            np.add.at(total, (owner[:, None], np.arange(8)[None, :] + 8 * byte), part)
        bits = (2 * total > n[live][:, None]).astype(np.uint8)
        out[live, word] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, node, n, f0, f1, k, x) of every row.

    The text's hash, its number of shingles, SimHash, the high halves of its least
    shingle hashes, and of a short text the hashes of its set, whole and without
    each of its shingles.
    """

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            n, f = np.zeros(b.num_rows, np.int32), np.zeros((b.num_rows, 2), np.uint64)
            least: list[np.ndarray] = []
            short: list[np.ndarray] = []
            for at, texts in w.blocks(b.column(2)):
                sets = list(shingles(texts))
                n[at : at + len(texts)] = [len(s) for s in sets]
                f[at : at + len(texts)] = simhash(sets)
                least += [(s[:SKETCH].view(np.int64) >> 32).astype(np.int32) for s in sets]
                short += [without_one(s) for s in sets]
            f = f.view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, (n, f[:, 0].copy(), f[:, 1].copy())), _lists(least, np.int32), _lists(short, np.int64)], ["doc_id", "node", "n", "f0", "f1", "k", "x"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("node"), text.alias("text"))
    return cols.mapInArrow(run, "doc_id long, node long, n int, f0 long, f1 long, k array<int>, x array<long>")


def without_one(s: np.ndarray) -> np.ndarray:
    """Hashes of a set of at most SHORT shingles: whole, then without each one; none of a larger set."""
    if not 0 < len(s) <= SHORT:
        return np.zeros(0, np.int64)
    each = w.mix(s)
    return w.mix(np.append(np.uint64(0), each) * np.uint64(2**64 - 1) + each.sum(dtype=np.uint64)).view(np.int64)


def _lists(parts: list[np.ndarray], kind: type) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(parts) if parts else np.zeros(0, kind)))


def short_links(nodes: DataFrame) -> DataFrame:
    """(a, b) with a < b that join all short texts whose similarity is at least 0.8.

    Two sets whose union has at most ten shingles differ in one (each of them: if
    both have nine) at that similarity. Those that are another without one shingle
    are joined to the least that is it, and sets of nine with eight in common to
    the least of them, so work is by texts and never by pairs.
    """
    every = nodes.where(F.size("x") > 0).select("node", "n", F.posexplode("x").alias("i", "v")).where("i = 0 or n >= 5")
    whole, nine = F.col("i") == 0, (F.col("i") > 0) & (F.col("n") == SHORT)
    heads = every.groupBy("v").agg(F.min(F.when(whole, F.col("node"))).alias("whole"), F.min(F.when(nine, F.col("node"))).alias("nine"), F.count("*").alias("c")).where("c > 1").drop("c")
    near = every.join(heads, "v").select("node", F.explode(F.array("whole", F.when(nine, F.col("nine")))).alias("other")).where("node <> other")
    return near.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))


def survival(p: float, strip: int = STRIP, weight: int = WEIGHT) -> tuple[float, float]:
    """Chances that one fingerprint, and that a pair of bit difference p, pass a filter."""
    one = sum(math.comb(strip, k) for k in range(weight + 1)) / 2**strip
    both = 0.0
    for x in range(weight + 1):
        for i in range(x + 1):
            for j in range(strip - x + 1):
                if x - i + j <= weight:
                    both += math.comb(strip, x) / 2**strip * math.comb(x, i) * math.comb(strip - x, j) * p ** (i + j) * (1 - p) ** (strip - i - j)
    return one, both


def bit_difference(similarity: float) -> float:
    """Expected share of differing SimHash bits of two equally large sets of this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


@lru_cache(maxsize=256)
def met(distance: int) -> float:
    """Chance that a pair whose fingerprints differ in so many bits passes a filter."""
    total = 0.0
    for m in range(max(0, STRIP - BITS + distance), min(distance, STRIP) + 1):
        on_strip = math.comb(distance, m) * math.comb(BITS - distance, STRIP - m) / math.comb(BITS, STRIP)
        both = sum(math.comb(m, i) * math.comb(STRIP - m, x) for i in range(m + 1) for x in range(STRIP - m + 1) if x + max(i, m - i) <= WEIGHT)
        total += on_strip * both / 2**STRIP
    return total


class Plan(NamedTuple):
    """``rounds`` of ``depth`` levels of ``count`` filters, of which ``spread`` are shuffled."""

    depth: int
    spread: int
    count: int
    rounds: int


def missed(p: float, count: int, depth: int, rounds: int) -> float:
    """Share of pairs of bit difference p that are beyond RADIUS or meet in no list of the last level.

    Every list is filtered by masks of its own.
    """
    share = 0.0
    for d in range(BITS + 1):
        lost = 1.0
        if d <= RADIUS:
            one, lost = met(d), 0.0
            for _ in range(depth):
                lost = (1 - one * (1 - lost)) ** count
            lost **= rounds
        share += math.comb(BITS, d) * p**d * (1 - p) ** (BITS - d) * lost
    return share


def _least(good, hi: int) -> int:
    lo = 0
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if good(mid) else (mid, hi)
    return hi


@lru_cache(maxsize=64)
def depth_for(total: int, one: float) -> int:
    """Levels after which a list of ``total`` nodes is expected to have LEAF members at most."""
    return max(1, math.ceil(math.log(max(total, 1) / LEAF) / math.log(1 / one)))


@lru_cache(maxsize=64)
def planned(p: float, recall: float, depth: int) -> Plan:
    """The plan of that depth with fewest shuffled rows that misses no more than ``1 - recall``.

    One level is one round of as many lists as are needed. With more, many rounds
    of few filters a level cost far less than one round of many.
    """
    if missed(p, 1 << 20, 1, 1) > 1 - recall:
        raise ValueError("no number of lists reaches that recall within RADIUS")
    one, both = survival(p)
    if depth == 1:
        return Plan(1, 1, _least(lambda c: missed(p, c, 1, 1) <= 1 - recall, 1 << 20), 1)
    best = None
    for share in (0.75, 1.0, 1.25, 1.5, 2.0, 3.0):
        count = max(2, round(share / both))
        rounds = _least(lambda r: missed(p, count, depth, r) <= 1 - recall, 1 << 16)  # noqa: B023
        rows = rounds * (count * one) ** (depth - 1)
        if best is None or rows < best[0]:
            best = (rows, Plan(depth, depth - 1, count, rounds))
    return best[1]


@lru_cache(maxsize=512)
def filters(turn: int, level: int, count: int) -> np.ndarray:
    """(count, 4): strip and mask words of a round's level, the same everywhere."""
    rng = np.random.default_rng(1000 + level + 64 * turn)
    out = np.zeros((count, 4), np.uint64)
    for k in range(count):
        for bit in rng.choice(BITS, STRIP, replace=False):
            out[k, bit // 64] |= np.uint64(1) << np.uint64(bit % 64)
        out[k, 2:] = rng.integers(0, 2**64, 2, dtype=np.uint64) & out[k, :2]
    return out


def shifts(at: int) -> np.ndarray:
    """What the masks are changed by in a list, so that one list's luck isn't another's."""
    return w.mix(np.array([2 * at + 1, 2 * at + 2], np.uint64))


def passing(f: np.ndarray, rule: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Rows of f whose weight on the rule's strip, from its mask, is small."""
    mask = rule[2:] ^ (shift & rule[:2])
    near = np.bitwise_count((f[:, 0] & rule[0]) ^ mask[0]) + np.bitwise_count((f[:, 1] & rule[1]) ^ mask[1])
    return np.flatnonzero(near <= WEIGHT)


def close_pairs(f: np.ndarray, n: np.ndarray, label: np.ndarray | None, part: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (i, j, distance) with i < j, within RADIUS and of like size.

    With labels, which must be in order, all pairs of unlike labels: a stretch of
    one label is not compared with itself. Without, each row's NEAREST later
    partners. With parts, only pairs of unlike parts.
    """
    step = min(64, max(16, len(f) // 8))  # small blocks stay in the processor's cache
    for s in range(0, len(f), step):
        e = min(s + step, len(f))
        lo, hi, dist = [], [], []
        first = s
        if label is not None and label[s] == label[e - 1]:
            first = int(np.searchsorted(label, label[s], "right"))  # nothing before it is of another label and later
        for c in range(first, len(f), 1024):
            d = np.bitwise_count(f[s:e, None, 0] ^ f[None, c : c + 1024, 0])
            d += np.bitwise_count(f[s:e, None, 1] ^ f[None, c : c + 1024, 1])
            i, j = np.divmod(np.flatnonzero(d <= RADIUS), d.shape[1])
            v = d[i, j]
            i, j = i + s, j + c
            keep = (j > i) & (np.minimum(n[i], n[j]) >= SIMILARITY * np.maximum(n[i], n[j]))
            if label is not None:
                keep &= label[i] != label[j]
            if part is not None:
                keep &= part[i] != part[j]
            i, j, v = i[keep], j[keep], v[keep]
            if label is None and len(i):
                order = np.lexsort((j, v, i))
                i, j, v = i[order], j[order], v[order]
                near = np.arange(len(i)) - np.searchsorted(i, i) < NEAREST
                i, j, v = i[near], j[near], v[near]
            lo.append(i)
            hi.append(j)
            dist.append(v)
        if lo and sum(map(len, lo)):
            i, j, v = map(np.concatenate, (lo, hi, dist))
            if label is None:
                order = np.lexsort((j, v, i))
                i, j, v = i[order], j[order], v[order]
                near = np.arange(len(i)) - np.searchsorted(i, i) < NEAREST
                i, j, v = i[near], j[near], v[near]
            yield i, j, v


def search(f: np.ndarray, n: np.ndarray, at: int, turn: int, level: int, plan: Plan, label: np.ndarray | None, part: np.ndarray | None):
    """Close pairs of list ``at``: filtered by the levels that are left, then by brute force."""
    if level >= plan.depth:
        yield from close_pairs(f, n, label, part)
        return
    shift = shifts(at)
    for k, rule in enumerate(filters(turn, level, plan.count)):
        rows = passing(f, rule, shift)
        if len(rows) > 1:
            for i, j, v in search(f[rows], n[rows], at * plan.count + k, turn, level + 1, plan, None if label is None else label[rows], None if part is None else part[rows]):
                yield rows[i], rows[j], v


def lists(nodes: DataFrame, plan: Plan) -> DataFrame:
    """(list, node, n, f0, f1, label): each node in the lists of the shuffled levels that it passes, in all rounds."""
    names = ["list", "node", "n", "f0", "f1", "label"]

    def run(batches: Iterable[pa.RecordBatch]):
        for b in (whole.slice(k, 10_000) for whole in batches for k in range(0, whole.num_rows, 10_000)):
            f = np.stack([b.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (2, 3)], axis=1)
            for turn in range(plan.rounds):
                parts = [(turn, np.arange(len(f)))]
                for level in range(plan.spread):
                    rules = filters(turn, level, plan.count)
                    parts = [(at * plan.count + k, rows[hit]) for at, rows in parts for k, rule in enumerate(rules) if len(hit := passing(f[rows], rule, shifts(at)))]
                if parts:
                    rows = pa.array(np.concatenate([r for _, r in parts]))
                    at = np.repeat([p for p, _ in parts], [len(r) for _, r in parts])
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(pc.take(b.column(k), rows) for k in range(5))], names)

    return nodes.select("node", "n", "f0", "f1", "label").mapInArrow(run, "list long, node long, n int, f0 long, f1 long, label long")


def crowded(nodes: DataFrame, plan: Plan, split: int = SPLIT) -> dict[int, int]:
    """Blocks by list, of the lists of more than ``split`` rows; there are no more than rows / ``split`` of these."""
    sizes = lists(nodes, plan).groupBy("list").count().where(F.col("count") > split)
    return {r["list"]: -(-r["count"] // split) for r in sizes.toLocalIterator()}


def candidates(nodes: DataFrame, plan: Plan, labelled: bool, split: int = SPLIT, most: int | None = None) -> DataFrame:
    """(a, b, d): close pairs with a < b; of unlike labels, or each node's nearest ones in every list.

    Where a node has more than ``most`` later partners in a list, it and they are
    joined by a tree of rows with d = -1 in place of these pairs, for :func:`crowd_links`.
    """

    def run(key: tuple, t: pa.Table) -> pa.Table:
        at, i, j = (x.as_py() for x in key)
        node, n, label = (t[c].to_numpy() for c in ("node", "n", "label"))
        order = np.lexsort((node, label))
        node, n, label = node[order], n[order], label[order]
        f = np.stack([t[c].to_numpy()[order].view(np.uint64) for c in ("f0", "f1")], axis=1)
        part = t["part"].to_numpy()[order] if i != j else None
        a, b, d = [], [], []
        up = np.arange(len(node))
        for x, y, v in search(f, n, at, at // plan.count**plan.spread, plan.spread, plan, label if labelled else None, part):
            if most is not None and len(x) > most:
                _, where, count = np.unique(x, return_inverse=True, return_counts=True)
                over = count[where] > most
                for hub in np.unique(x[over]):
                    gather(up, np.append(y[x == hub], hub))
                x, y, v = x[~over], y[~over], v[~over]
            a.append(x)
            b.append(y)
            d.append(v)
        while (up[up] != up).any():
            up = up[up]
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
        alone = (up[a] != up[b]) | (most is None)  # pairs of one crowd are compared with it
        low = np.flatnonzero(up != np.arange(len(up)))
        a, b = node[np.concatenate([a[alone], low])], node[np.concatenate([b[alone], up[low]])]
        d = np.concatenate([np.concatenate([np.zeros(0, np.int32), *d])[alone], np.full(len(low), -1)]).astype(np.int32)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "d": d})

    many = crowded(nodes, plan, split) if nodes.count() > split else {}  # no list is longer than the table
    return in_blocks(lists(nodes, plan), many).groupBy("list", "i", "j").applyInArrow(run, "a long, b long, d int").distinct()


def gather(up: np.ndarray, rows: np.ndarray) -> None:
    """Make the trees of these rows one; ``up`` leads from a row to its root in the end."""
    top = up[rows]
    while (up[top] != top).any():
        top = up[top]
    up[top] = up[rows] = top.min()


def in_blocks(members: DataFrame, many: dict[int, int]) -> DataFrame:
    """``members`` with their ``part`` of a list that ``many`` cuts, once for each pair (i, j) of parts that it is in."""
    if not many:
        return members.withColumn("part", F.lit(0)).withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    cut = F.coalesce(F.create_map(*(F.lit(x) for kv in many.items() for x in kv))[F.col("list")], F.lit(1))
    members = members.withColumn("part", F.pmod(F.xxhash64("node"), cut).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), (cut - 1).cast("int"))))
    return members.withColumn("i", F.least("part", "o")).withColumn("j", F.greatest("part", "o")).drop("o")


def similar_pairs(f: np.ndarray, n: np.ndarray, label: np.ndarray, part: np.ndarray | None, ids: np.ndarray, similarity: float = SIMILARITY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (i, j): of all close pairs of unlike labels those of that exact Jaccard similarity.

    ``ids`` are the rows' sets of hashes one after the other. Two sets have no more
    in common than either has in common with all the others, so most pairs
    of edited copies are told unlike by two counts.
    """
    ids, count = np.unique(ids, return_inverse=True, return_counts=True)[1:]
    off = np.concatenate([[0], np.cumsum(n)])
    known = np.concatenate([[0], np.cumsum(count[ids] > 1)])
    known = known[off[1:]] - known[off[:-1]]
    mark = np.zeros(len(count), bool)
    for x, y, _ in close_pairs(f, n, label, part):
        # o in J = o / (n + n' - o), a hair less for rounding
        need = similarity / (1 + similarity) * (n[x] + n[y]) - 1e-6
        keep = np.minimum(known[x], known[y]) >= need
        x, y, need = x[keep], y[keep], need[keep]
        found = np.zeros(len(x), bool)
        for i in np.unique(x):
            at = np.flatnonzero(x == i)
            mark[ids[off[i] : off[i + 1]]] = True
            shared = np.array([np.count_nonzero(mark[ids[off[j] : off[j + 1]]]) for j in y[at]])
            mark[ids[off[i] : off[i + 1]]] = False
            found[at] = shared >= need[at]
        if found.any():
            yield x[found], y[found]


def crowd_links(nodes: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, room: int = ROOM) -> DataFrame:
    """(a, b) with a < b: similar pairs of unlike labels in one crowd (``list``), in each task one for each two labels.

    ``sets`` (node, s) are the shingle sets; a crowd of more than ``room`` shingles
    is cut into blocks, each pair of which is a task.
    """

    def run(key: tuple, t: pa.Table) -> pa.Table:
        node, n, label = (t[c].to_numpy() for c in ("node", "n", "label"))
        order = np.lexsort((node, label))
        node, n, label = node[order], n[order].astype(np.int64), label[order]
        f = np.stack([t[c].to_numpy()[order].view(np.uint64) for c in ("f0", "f1")], axis=1)
        part = t["part"].to_numpy()[order] if key[1].as_py() != key[2].as_py() else None
        ids = pc.list_flatten(t["s"].combine_chunks().take(pa.array(order))).to_numpy()
        links: dict[tuple, tuple] = {}
        for x, y in similar_pairs(f, n, label, part, ids, similarity):
            for i, j in zip(x.tolist(), y.tolist()):
                links.setdefault((label[i], label[j]), (min(node[i], node[j]), max(node[i], node[j])))
        a, b = np.array(list(links.values()), np.int64).reshape(-1, 2).T
        return pa.table({"a": a.copy(), "b": b.copy()})

    sizes = nodes.groupBy("list").agg(F.sum("n").alias("c")).where(F.col("c") > room)
    many = {r["list"]: -(-r["c"] // room) for r in sizes.toLocalIterator()}
    members = in_blocks(nodes.select("list", "node", "n", "f0", "f1", "label"), many).join(sets, "node")
    return members.groupBy("list", "i", "j").applyInArrow(run, "a long, b long").distinct()


def shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, s): the shingle sets of the nodes named in ``ids`` (node, least), each from its row of least id.

    Texts are not shuffled: rows are picked by a bitmap of the wanted ones of
    bounded size. The few others that it lets pass are of no node that is asked for.
    """
    bits = fold_bits(ids.select(F.xxhash64("least", "node").alias("h")))
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            hit = shared.value.has(b.column(0).to_numpy())
            if not hit.any():
                continue
            b = b.filter(pa.array(hit))
            new = np.unique(b.column(1).to_numpy(), return_index=True)[1]
            b = b.take(pa.array(new))
            for at, texts in w.blocks(b.column(2)):
                yield pa.RecordBatch.from_arrays([b.column(1).slice(at, len(texts)), _lists([s.view(np.int64) for s in shingles(texts)], np.int64)], ["node", "s"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("node"), text.alias("text"))
    return cols.select(F.xxhash64("doc_id", "node").alias("h"), "node", "text").mapInArrow(run, "node long, s array<long>")


def likely(pairs: DataFrame, sketches: DataFrame, at_least: float = LIKELY) -> DataFrame:
    """The pairs whose similarity, by the least shingle hashes, is not far below the threshold."""
    both = pairs.join(sketches.select(F.col("node").alias("a"), F.col("k").alias("ka")), "a").join(sketches.select(F.col("node").alias("b"), F.col("k").alias("kb")), "b")
    least = F.slice(F.array_sort(F.array_union("ka", "kb")), 1, SKETCH)
    shared = F.size(F.array_intersect(least, F.array_intersect("ka", "kb")))
    return both.where(shared >= at_least * F.size(least)).select(*pairs.columns)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose exact Jaccard similarity is at least ``similarity``."""
    both = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared >= similarity * (F.size("sa") + F.size("sb") - shared)).select("a", "b").distinct()


def classes(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, leaf: int | None = None) -> DataFrame:
    """(doc_id, node, class_id, n_shingles, is_kept): one row per document; ``node`` is the text's hash."""
    sig = materialise(signatures(docs), "near-signatures")
    nodes = materialise(sig.groupBy("node").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("n", "f0", "f1", "k", "x"))), "near-nodes")
    some = nodes.where("n > 0")
    p = bit_difference(similarity)
    depth = depth_for(some.count(), survival(p)[0]) if leaf is None else leaf
    plan = planned(p, recall, depth)

    def sets_of(ids: DataFrame) -> DataFrame:
        return materialise(shingle_sets(docs, nodes.select("node", "least").join(ids, "node", "left_semi")), "near-sets")

    def checked(pairs: DataFrame) -> DataFrame:
        sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        found = materialise(verified(pairs, sets, similarity), "near-true")
        discard(sets, pairs)
        return found

    # a few lists, each node's nearest partners: draft classes
    few = plan._replace(rounds=1) if plan.rounds > 1 else plan._replace(count=-(-plan.count // 8))
    draft = materialise(candidates(some.withColumn("label", F.col("node")), few, False), "near-draft")
    links = checked(materialise(likely(draft, some), "near-likely"))
    if similarity <= 0.8:
        links = links.unionByName(short_links(some))
    links = materialise(links.distinct(), "near-links")
    label = components(links)
    # all lists, all pairs of unlike classes
    named = some.join(label.select("node", F.col("class").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = materialise(named.select("node", "n", "f0", "f1", "label"), "near-named")
    close = materialise(candidates(named, plan, True, most=CROWD), "near-candidates")
    rest = close.where("d >= 0").join(draft.select("a", "b"), ["a", "b"], "left_anti")
    found = checked(materialise(likely(rest, some), "near-likely"))
    trees = close.where("d < 0")
    if not trees.isEmpty():
        crowd = materialise(named.join(components(trees).withColumnRenamed("class", "list"), "node"), "near-crowd")
        sets = sets_of(crowd.select("node"))
        found = found.unionByName(materialise(crowd_links(crowd, sets, similarity), "near-true"))
        discard(sets, crowd)
    links = materialise(links.unionByName(found).distinct(), "near-links")
    label = components(links)
    last = F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("doc_id"), F.col("node").alias("node"))
    known = nodes.select("node", "least").join(label, "node", "left")
    heads = known.where("class is not null").groupBy("class").agg(F.min(last).alias("head"))
    known = known.join(heads, "class", "left").select("node", F.coalesce("head", last).alias("head"))
    out = sig.select("doc_id", "node", "n").join(known, "node")
    name = F.coalesce("head.doc_id", -F.abs(F.shiftrightunsigned("head.node", 1)) - 1)
    kept = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("node") == F.col("head.node"))
    return out.select("doc_id", "node", name.alias("class_id"), F.col("n").cast("long").alias("n_shingles"), kept.alias("is_kept"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_shingles, is_kept): one row per document."""
    return classes(docs, similarity, recall).drop("node")


def op9_may_ozerov_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every row of ``documents``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
