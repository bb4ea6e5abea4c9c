"""Best-fit packing by a grouping genetic algorithm on islands.

Pieces are spread at random (by row, so no hot key matters) over groups of about
``GROUP`` pieces. Two pieces that fill a sequence are set together beforehand,
which costs none. The rest of a group is packed by several islands: a population of
best-fit packings evolves by crossover that injects whole well-filled bins,
removes the duplicates and best-fits what was displaced; then every island takes
its neighbour's elite and evolves again, and the best island's packing is taken.
A group that reaches the lower bound of its sum stops at once; any other, of
whatever size, gets all ``GENERATIONS`` on each island before and after migration.

Defined results: a null or empty text is the single closing id; repeated rows
are packed as often as they come; an empty table gives an empty table; a text of
any length is encoded whole and cut into full pieces, each a sequence of its own,
but for the first. Of packings with equally many bins the better filled one is
taken, then the one of the lower island. The marker of the vocabulary's special
token in a text is that token, as its ``tokenizers`` form has it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as w
from .store import materialise

CAPACITY = 1024
END = 2
GROUP = 8192
ISLANDS = 2
POPULATION = 6
GENERATIONS = 400
BLOCK = 1 << 20  # bytes of texts that are encoded together, or one text
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def markers(vocabulary: str | None = None) -> tuple[str, ...]:
    """The special tokens of a ``tokenizers`` file."""
    import json

    import public_tokenizers

    with open(vocabulary or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f)["added_tokens"])


@lru_cache(maxsize=2)
def _whole(path: str):
    """The ``tokenizers`` form; read only where a text has a marker, as it takes much memory."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# after these bytes a space or line feed may belong to a longer run of white space: all ASCII controls, and what begins such characters beyond ASCII
_BLANK = np.zeros(256, bool)
_BLANK[[*range(33), 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True


class IdBytes:
    """Token ids of texts.

    All ids are those of the ``tokenizers`` file of the vocabulary; ordinary text
    gets them faster from the same ranks (tests hold both equal), text with a
    special token's marker from that file. The pre-tokenizer begins a new piece at
    every space or line feed that a non-space follows, so a block of texts is the
    sum of the stretches between these: each is encoded once, all in one call,
    whose ids are told apart by the bytes they stand for. Nothing is kept.
    """

    def __init__(self, vocabulary: str | None = None, marked: tuple[str, ...] | None = None) -> None:
        import base64

        import public_tokenizers
        import tiktoken

        self.path = path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
        self.markers = markers(path) if marked is None else marked
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size[list(ranks.values())] = list(map(len, ranks))
        self.encoding = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special=set(), disallowed_special=())

    def __call__(self, text: str) -> bytes:
        return self.many(w.strings(pa.array([text], pa.string())))[0].tobytes()

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (a null-free string array) in a row, and the bounds of each text's."""
        offsets, raw = w.buffers(texts)
        edge = (offsets - offsets[0]).astype(np.int64)
        data = raw[int(offsets[0]) : int(offsets[-1])]
        cut = np.zeros(len(data) + 1, bool)
        cut[: len(data) - 1] = ((data[:-1] == 32) | (data[:-1] == 10)) & ~_BLANK[data[1:]] if len(data) else False
        cut[edge[1:-1] - 1] &= False  # a blank at a text's end, whatever the next begins with
        head = np.zeros(len(data) + 1, bool)
        head[edge[:-1][np.diff(edge) > 0]] = True
        at = np.flatnonzero(cut | head)
        units = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data))
        first = head[at]
        known = units.filter(pa.array(~first)).dictionary_encode()
        off, flat = w.buffers(known.dictionary)
        ids = self.whole(flat[int(off[0]) : int(off[-1])].tobytes().decode())
        starts = [self.whole(t) for t in units.filter(pa.array(first)).to_pylist()]
        bound = np.append(np.searchsorted(np.cumsum(self.size[ids]), (off[:-1] - off[0]), "right"), len(ids))
        source, n = np.zeros((2, len(at)), np.int64)
        code = known.indices.to_numpy()
        source[~first], n[~first] = bound[code], np.diff(bound)[code]
        n[first] = list(map(len, starts))
        source[first] = len(ids) + np.cumsum(n[first]) - n[first]
        pool = np.concatenate([ids, *starts])
        ends = np.cumsum(n)
        out = pool[np.arange(n.sum()) + np.repeat(source - ends + n, n)]
        bounds = np.append(0, ends)[np.searchsorted(at, edge)]
        odd = np.zeros(len(texts), bool)
        for m in self.markers:
            odd |= pc.match_substring(texts, m).to_numpy(zero_copy_only=False)
        if not odd.any():
            return out, bounds
        parts = [out[a:b] for a, b in zip(bounds, bounds[1:])]
        for k in np.flatnonzero(odd):
            parts[k] = np.array(_whole(self.path).encode(texts[int(k)].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])


_ids: dict[str | None, IdBytes] = {}


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Tokenised documents, cut so that only the first piece may be shorter."""
    marked = markers(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]):
        if vocabulary not in _ids:
            _ids[vocabulary] = IdBytes(vocabulary, marked)
        ids = _ids[vocabulary]
        end = np.array([END], np.uint32).tobytes()
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            keys = b.column(0).to_pylist()
            for at, texts in w.blocks(b.column(1), BLOCK):
                found, bounds = ids.many(texts)
                for k, x, y in zip(keys[at : at + len(texts)], bounds, bounds[1:]):
                    raw = memoryview(found[x:y].tobytes() + end)
                    n = len(raw) // 4
                    lo, piece = 0, 0
                    while lo < n:
                        hi = lo + (n % capacity or capacity) if not lo else lo + capacity
                        for c, v in zip(out, (k, piece, lo, hi - lo, zlib.crc32(raw[4 * lo : 4 * hi]))):
                            c.append(v)
                        lo, piece = hi, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(w.lean(run), PIECE)


def placed(items: Iterable[int], sizes: list[int], room: list[int], capacity: int) -> list[int]:
    """The bin of each item, put where it leaves least room; opens bins as needed."""
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, out = 0, []
    for b, r in enumerate(room):
        if r:
            open_[r].append(b)
            mask |= 1 << r
    for i in items:
        s = sizes[i]
        fits = mask >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = open_[r].pop()
            if not open_[r]:
                mask ^= 1 << r
        else:
            b, r = len(room), capacity
            room.append(capacity)
        out.append(b)
        room[b] = r = r - s
        if r:
            open_[r].append(b)
            mask |= 1 << r
    return out


def best_fit(items: Iterable[int], sizes: list[int], bins: list[list[int]], room: list[int], capacity: int) -> None:
    """Put each item where it leaves least room, opening bins as needed."""
    items = list(items)
    for i, b in zip(items, placed(items, sizes, room, capacity)):
        if b == len(bins):
            bins.append([])
        bins[b].append(i)


class Packing(NamedTuple):
    """The bin of each item, the room left in each bin, and what makes one packing better: fewer bins, then unevenly filled ones."""

    bins: np.ndarray
    room: np.ndarray
    score: tuple[int, float]


def scored(bins: np.ndarray, room: np.ndarray, capacity: int) -> Packing:
    return Packing(bins, room, (len(room), -float(np.mean((1 - room / capacity) ** 2)) if len(room) else -1.0))


def cross(one: Packing, two: Packing, sizes: list[int], capacity: int, rng: np.random.Generator) -> Packing:
    """Inject a share of the best-filled bins of ``one`` into ``two``; items come largest first."""
    order = np.lexsort((rng.random(len(one.room)), one.room))
    take = np.full(len(one.room), -1)
    share = order[: max(1, int(len(order) * rng.uniform(0.2, 0.6)))]
    take[share] = np.arange(len(share))
    bins = take[one.bins]
    # bins without a piece that is inside already stay whole if they are well filled
    stay = capacity - two.room >= rng.uniform(0.9, 0.995) * capacity
    stay[two.bins[bins >= 0]] = False
    keep = np.where(stay, np.cumsum(stay) - 1 + len(share), -1)
    bins = np.maximum(bins, keep[two.bins])
    room = np.concatenate([one.room[share], two.room[stay]]).tolist()
    loose = np.flatnonzero(bins < 0)
    bins[loose] = placed(loose.tolist(), sizes, room, capacity)
    return scored(bins, np.array(room), capacity)


def twins(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """For each item the number of the pair it fills a bin with, or -1; as many pairs as there can be.

    No packing is lost: what else lies with one of a pair is no larger than the
    other, so the two can change places.
    """
    order = np.argsort(sizes, kind="stable")
    count = np.bincount(sizes, minlength=capacity + 1)
    rank = np.empty(len(sizes), np.int64)
    rank[order] = np.arange(len(sizes)) - np.repeat(np.cumsum(count) - count, count)
    pairs = np.minimum(count, count[::-1])
    middle = capacity // 2
    if capacity % 2 == 0:
        pairs[middle] = count[middle] // 2
    half = 2 * sizes == capacity
    low = np.minimum(sizes, capacity - sizes)
    first = np.cumsum(pairs[: middle + 1]) - pairs[: middle + 1]
    return np.where(rank < np.where(half, 2 * pairs[low], pairs[low]), first[low] + np.where(half, rank // 2, rank), -1)


def evolve(sizes: list[int], capacity: int, seed: int, immigrant: list[int] | None = None, population: int = POPULATION, generations: int = GENERATIONS) -> list[int]:
    """The bin of each item after some generations on one island.

    Pairs that fill a bin are set at once (see :func:`twins`); the rest evolves,
    in all ``generations`` unless it reaches the bound of its sum.
    """
    every, rng = np.asarray(sizes, np.int64), np.random.default_rng(seed)
    pair = twins(every, capacity)
    left = np.flatnonzero(pair < 0)
    left = left[np.argsort(-every[left], kind="stable")]
    size = every[left]
    listed, n, bound = size.tolist(), len(left), -(-int(size.sum()) // capacity)

    def start(noise: float) -> Packing:
        order, room = np.argsort(-size * (1 + noise * rng.random(n)), kind="stable"), []
        bins = np.empty(n, np.int64)
        bins[order] = placed(order.tolist(), listed, room, capacity)
        return scored(bins, np.array(room, np.int64), capacity)

    people = []
    if immigrant is not None:
        bins = np.unique(np.asarray(immigrant, np.int64)[left], return_inverse=True)[1]
        people.append(scored(bins, capacity - np.bincount(bins, size).astype(np.int64), capacity))
    people.append(start(0.0))
    if min(len(p.room) for p in people) > bound:
        people += [start(0.1 * k) for k in range(1, population + 1 - len(people))]  # ever worse packed, and ever more unlike
        for _ in range(generations):
            people.sort(key=lambda p: p.score)
            if len(people[0].room) <= bound:
                break
            a, b = rng.choice(len(people), 2, replace=False)
            child = cross(people[a], people[b], listed, capacity, rng)
            if child.score < people[-1].score and all(child.score != p.score for p in people):
                people[-1] = child
    best = min(people, key=lambda p: p.score)
    out = pair + len(best.room)
    out[left] = best.bins
    if immigrant is not None and max(immigrant, default=-1) < out.max(initial=-1):
        return np.asarray(immigrant).tolist()
    return out.tolist()


def pack(parts: DataFrame, capacity: int = CAPACITY, group: int = GROUP, islands: int = ISLANDS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a stored table of pieces."""
    ids = parts.withColumn("_row", F.monotonically_increasing_id())
    full = ids.where(F.col("length") >= capacity).select(*parts.columns, (F.lit(1 << 62) + F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = ids.where(F.col("length") < capacity)
    groups = max(1, math.ceil(rest.count() / group))
    island = (
        rest.groupBy(F.pmod(F.xxhash64("_row"), F.lit(groups)).alias("g"))
        .agg(F.sort_array(F.collect_list(F.struct("_row", *parts.columns))).alias("items"))  # about `group` rows, whatever the data
        .withColumn("island", F.explode(F.array(*(F.lit(i) for i in range(islands)))))
    )

    def run(batches, migrated: bool):
        for b in batches:
            out = []
            for k in range(b.num_rows):
                row = {c: b.column(c)[k] for c in b.schema.names}
                sizes = row["items"].values.field("length").to_numpy()
                elite = row["elite"].values.to_numpy() if migrated else None
                out.append(evolve(sizes, capacity, row["g"].as_py() * islands + row["island"].as_py() + (1 << 40) * migrated, elite))
            cols = [b.column(i) for i in range(b.num_columns) if b.schema.names[i] != "elite"]
            names = [x for x in b.schema.names if x != "elite"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.list_(pa.int32()))], [*names, "bins"])

    item = "items array<struct<_row: bigint, doc_id: bigint, piece: int, start: bigint, length: bigint, ids_crc32: bigint>>"
    schema = f"g bigint, {item}, island int, bins array<int>"
    first = materialise(island.repartition("g", "island").mapInArrow(w.lean(lambda it: run(it, False)), schema), "pack-islands")
    elite = first.select("g", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("bins").alias("elite"))
    second = first.drop("bins").join(elite, ["g", "island"]).select("g", "items", "island", "elite").mapInArrow(w.lean(lambda it: run(it, True)), schema)
    best = second.groupBy("g").agg(F.min_by(F.struct("items", "bins"), F.struct(F.array_max("bins"), "island")).alias("b"))
    seq = best.select("g", F.explode(F.arrays_zip("b.items", "b.bins")).alias("x")).select("x.items.*", (F.col("g") * (1 << 24) + F.col("x.bins")).alias("sequence_id"))
    whole = seq.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("_row", *parts.columns))).alias("items"))
    # a bin holds at most `capacity` pieces; offsets are the running sum of lengths
    runs = whole.withColumn("at", F.expr("aggregate(items, array(0L), (a, x) -> concat(a, array(element_at(a, -1) + x.length)))"))
    packed = runs.select("sequence_id", F.posexplode("items").alias("i", "x"), "at").select(*(F.col(f"x.{c}") for c in parts.columns), "sequence_id", F.expr("get(at, i)").alias("offset"))
    return full.unionByName(packed)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Tokenise, cut and pack all documents."""
    return pack(materialise(pieces(docs, capacity, vocabulary), "pack-pieces"), capacity)


def op6_gga_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 1024 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
