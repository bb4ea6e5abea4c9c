"""Each method against brute force, an exact round trip or held-out accuracy."""

from __future__ import annotations

import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sonarlake.llm import decontaminate, graph, html, langid, lines, media, neardup, packing, pii, substrings, toxicity
from sonarlake.llm import words as w

SF = "/root/testdata/sf0.001"


def words_of(rng, n):
    return [rng.choice("ra te lo mi en sh or an di qu".split()) + rng.choice("kan tol bis mer dun fal".split()) + rng.choice("a e i o u".split()) + str(rng.randint(0, 99)) for _ in range(n)]


@given(st.lists(st.text(alphabet="ab9_ .\né漢", max_size=30), max_size=6))
@settings(max_examples=150, deadline=None)
def test_word_hashes(texts):
    t = w.words(w.strings(pa.array(texts, pa.string())))
    plain = [re.findall(r"[0-9a-z_\x80-\U0010ffff]+", x.lower()) for x in texts]
    assert np.diff(t.at).tolist() == [len(p) for p in plain]
    seen = {}
    for h, x in zip(t.h.tolist(), [y for p in plain for y in p]):
        assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


def test_a_worker_waits_without_the_memory_of_its_task():
    def held():
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"Pss_Anon:\s+(\d+)", f.read())[1]) // 1024

    def run(batches):
        for _ in batches:
            many = [np.ones(2000) for _ in range(6000)]  # 96 MB in small blocks, and one after them that stays
            pins.append(np.ones(2000))
            del many
            yield held()

    pins: list = []
    assert list(w.lean(lambda batches: iter(batches))([1, 2])) == [1, 2]
    before = held()
    list(w.lean(run)([1]))
    assert held() < before + 40


def test_ftrl_separates_held_out():
    rng = random.Random(1)
    rows = [(" ".join(words_of(rng, 30) + (["vekrum" + rng.choice("abcdef")] if k % 4 == 0 else [])), int(k % 4 == 0)) for k in range(600)]
    model, feats = toxicity.Ftrl(), []
    row, f = toxicity.features(w.strings(pa.array([t for t, _ in rows])))
    feats = [np.unique(f[row == k]) for k in range(len(rows))]
    for _ in range(3):
        for x, (_, y) in list(zip(feats, rows))[:400]:
            model.learn(x, y)
    weights = np.append(model.weights(slice(0, -1)), model.weights(np.array([len(model.z) - 1])))
    table = weights
    got = toxicity.scores(pa.array([t for t, _ in rows[400:]]), table) >= 0.5
    assert np.mean(got == [y == 1 for _, y in rows[400:]]) > 0.97
    assert (weights != 0).sum() < 500


def plain_base(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) < 256 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]


@given(st.text(alphabet="a1@.+- (9%é\n", max_size=40))
@settings(max_examples=400, deadline=None)
def test_base_spans(text):
    assert pii.base_spans(text) == plain_base(text)


def test_semi_markov_finds_written_entities():
    field, rows = pii.trained(), pii.written_sentences(80, 99)
    assert sum(field.decode(x) == gold for x, gold in rows) >= 0.95 * len(rows)


def best_by_hand(field, words):
    """All segmentations of a short sentence."""
    moves, k = field.moves(words), len(pii.KINDS) + 1
    best = {(0, 0): (0.0, [])}
    for e in range(1, len(words) + 1):
        for s, t, v, _ in moves[e]:
            for p in range(k):
                if (s, p) in best:
                    x = best[s, p][0] + v + field.x.get((p, t), 0.0)
                    if (e, t) not in best or x > best[e, t][0]:
                        best[e, t] = (x, best[s, p][1] + ([(t, s, e)] if t else []))
    return max((best[len(words), t] for t in range(k) if (len(words), t) in best), key=lambda b: b[0])[1]


def test_semi_markov_decoding():
    field = pii.trained()
    for words, _ in pii.written_sentences(30, 5):
        assert field.decode(words) == best_by_hand(field, words)


def labellings(field, words):
    """(score, entities, features used) of every way to cut and label a sentence, one by one."""
    moves = field.moves(words)

    def from_(at, last):
        if at == len(words):
            yield 0.0, [], []
        for e in range(at + 1, len(words) + 1):
            for s, t, v, f in moves[e]:
                if s == at:
                    for x, found, used in from_(e, t):
                        yield v + field.x.get((last, t), 0.0) + x, ([(t, s, e)] if t else []) + found, [(last, t), *((name, t) for name in f), *used]

    return list(from_(0, 0))


@pytest.mark.parametrize("seed", range(4))
def test_semi_markov_against_every_labelling(seed):
    """Decoding and the gradient of the likelihood, by enumeration."""
    rng = random.Random(seed)
    words = ["call", *rng.choice([["+1", "(555)", "123-4567"], ["a@b.com"], ["x", "at", "y", "dot", "com"], ["4111", "1111"]]), rng.choice(["now", "77", "k=5"])]
    field = pii.SemiMarkov()
    every = labellings(field, words)
    field.x = {key: rng.uniform(-1, 1) for key in {key for _, _, used in every for key in used}}
    every = labellings(field, words)
    best = max(every, key=lambda x: x[0])
    assert field.decode(words) == best[1]
    gold = rng.choice(every)
    weight = np.exp([x - best[0] for x, _, _ in every])
    want = dict.fromkeys(field.x, 0.0)
    for p, (_, _, used) in zip(weight / weight.sum(), every):
        for key in used:
            want[key] -= p
    for key in gold[2]:
        want[key] += 1
    before = dict(field.x)
    field.learn(words, gold[1], 1.0)
    for key, g in want.items():
        assert field.x[key] == pytest.approx(0.999 * before[key] + g, abs=2e-5) or field.x[key] == pytest.approx(before[key] + g, abs=2e-5)


def test_entities_are_found_anywhere_in_a_long_row_of_hot_words():
    """Nothing is cut: an entity after hundreds of words with digits, and one beside many base spans."""
    field = pii.trained()
    text = " ".join(["7"] * 395 + ["bob", "at", "mail", "dot", "example", "dot", "com"] + ["7"] * 300)
    spans = [text[s:e] for t, s, e in pii.added_spans(text, [], field) if t == 0]
    assert any("bob at mail dot example" in x for x in spans)
    text = " ".join(f"a{k}@b.co" for k in range(30)) + " password=0123456789abcdef0"
    base = pii.base_spans(text)
    added = pii.added_spans(text, base, field)
    assert all(e <= a or s >= b for _, s, e in added for _, a, b in base)


def test_chain_gradient_against_every_labelling():
    rng = np.random.default_rng(2)
    feats = [["bias", "a"], ["bias"], ["bias", "b", "a"], ["bias", "c"]]
    chain = html.Chain()
    chain.x = {f: rng.normal(size=2) for f in "abc"} | {"bias": rng.normal(size=2)}
    chain.tr = rng.normal(size=(2, 2))
    score = lambda ys, x, tr: sum(x[f][y] for fs, y in zip(feats, ys) for f in fs) + sum(tr[a, b] for a, b in zip(ys, ys[1:]))
    every = [[(m >> k) & 1 for k in range(4)] for m in range(16)]
    gold = [0, 1, 1, 0]
    like = lambda x, tr: score(gold, x, tr) - np.log(sum(np.exp(score(ys, x, tr)) for ys in every))
    old, tr, tiny = {f: v.copy() for f, v in chain.x.items()}, chain.tr.copy(), 1e-5
    want = np.zeros((2, 2))
    for i in range(2):
        for j in range(2):
            up, down = tr.copy(), tr.copy()
            up[i, j] += tiny
            down[i, j] -= tiny
            want[i, j] = (like(old, up) - like(old, down)) / (2 * tiny)
    rate = 1e-3
    chain.learn(feats, gold, rate)
    np.testing.assert_allclose((chain.tr - 0.999 * tr) / rate, want, atol=1e-6)
    for f in old:
        g = [(like(old | {f: old[f] + tiny * np.eye(2)[y]}, tr) - like(old | {f: old[f] - tiny * np.eye(2)[y]}, tr)) / (2 * tiny) for y in range(2)]
        n = sum(fs.count(f) for fs in feats)
        np.testing.assert_allclose((chain.x[f] - 0.9995**n * old[f]) / rate, g, atol=5e-3)


def test_ftrl_against_a_plain_version():
    """The same weights as the published per-coordinate rule, one coordinate at a time."""
    rng = random.Random(1)
    model = toxicity.Ftrl(31)
    z, n = [0.0] * 31, [0.0] * 31

    def weight(i):
        l1 = 0.0 if i == 30 else toxicity.L1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(600):
        f = sorted(rng.sample(range(30), rng.randint(1, 8)))
        y = int(f[0] < 4)
        model.learn(np.array(f), y)
        p = 1 / (1 + math.exp(-sum(map(weight, [*f, 30]))))
        for i in [*f, 30]:
            g, x = p - y, weight(i)
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
            z[i] += g - sigma * x
            n[i] += g * g
    np.testing.assert_allclose(model.weights(np.arange(31)), [weight(i) for i in range(31)], atol=1e-9)
    assert any(weight(i) for i in range(30)) and any(not weight(i) for i in range(30))


def test_media_query_against_plain_digests(spark):
    """Every column recomputed from the text with hashlib, zlib and numpy."""
    import hashlib

    got = {r.doc_id: r for r in media.op5_media_tiles(spark, SF).collect()}
    forms = set()
    for doc_id, text in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall():
        raw, r = (text or "").encode(), got[doc_id]
        payload = raw + bytes(-len(raw) % 64 or 64 * (not raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        a = np.frombuffer(payload, np.uint8).reshape(-1, 64)
        stored = {"pgm": media.encode_pgm, "bmp": media.encode_bmp}[r.format](a)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest()) and stored[:2] == (b"P5" if r.format == "pgm" else b"BM")
        # each cell of the tile by whole fine pixels: every source pixel repeated eight times down
        fine = np.repeat(a.astype(float), 8, axis=0).reshape(8, len(a), 8, 8).mean(axis=(1, 3))
        tile = media.npy(np.rint(fine).astype(np.uint8))
        near = np.abs(fine - np.rint(fine))
        assert r.tile_sha256 == hashlib.sha256(tile).hexdigest() or (near > 0.499).any()
        forms.add(r.format)
    assert forms == {"pgm", "bmp"}


def test_pages_held_out():
    x, tr = html.trained()
    right = total = 0
    for page, gold in html.written_pages(60, 77):
        blocks = html.leaf_blocks(page)
        for b, y in zip(blocks, html.viterbi([html.block_features(b) for b in blocks], x, tr)):
            right += y == (b.text in gold)
            total += 1
    assert right >= 0.98 * total


def test_viterbi_is_best():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 7))
        x = {f"f{k}": float(v) for k, v in enumerate(rng.normal(size=n))}
        tr = rng.normal(size=(2, 2)).tolist()
        score = lambda ys: sum(x[f"f{k}"] for k, y in enumerate(ys) if y) + sum(tr[a][b] for a, b in zip(ys, ys[1:]))  # noqa: B023, E731
        every = [[(m >> k) & 1 for k in range(n)] for m in range(1 << n)]
        assert score(html.viterbi([[f"f{k}"] for k in range(n)], x, tr)) == pytest.approx(max(map(score, every)))


@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 2**32 - 1))
@settings(max_examples=60, deadline=None)
def test_images(h, width, seed):
    a = np.random.default_rng(seed).integers(0, 256, (h, width)).astype(np.uint8)
    assert (media.decode(media.encode_pgm(a)) == a).all() and (media.decode(media.encode_bmp(a)) == a).all()
    plain = b"P2 # c\n%d %d 255\n" % (width, h) + b" ".join(b"%d" % v for v in a.ravel())
    assert (media.decode(plain) == a).all()
    big = np.kron(a, np.ones((6, 4)))
    np.testing.assert_allclose(media.resize(big, h, width), a, atol=1e-6)
    np.testing.assert_allclose(media.resize(a, 3, 5).mean(), a.mean())


def test_colour_and_bits():
    rgb = bytes(range(12))
    assert media.decode(b"P6 2 2 255\n" + rgb).tolist() == np.arange(12).reshape(2, 2, 3).tolist()
    assert media.decode(b"P4 3 1\n" + bytes([0b01000000])).tolist() == [[1, 0, 1]]
    assert media.decode(b"P1 3 1\n0 1 0").tolist() == [[1, 0, 1]]
    assert media.tile(b"nothing", 4)[2]


def test_tiles(spark):
    a = np.arange(64, dtype=np.uint8).reshape(8, 8)
    df = spark.createDataFrame([(1, bytearray(media.encode_bmp(a))), (2, None)], "id long, image binary")
    got = {r.id: r for r in media.media_tiles(df, side=4).collect()}
    import io

    assert np.load(io.BytesIO(got[1].npy)).shape == (4, 4) and got[1].dhash == media.difference_hash(a) and got[2].error


def test_token_ids_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = packing.IdBytes()
    rng = random.Random(4)
    texts = [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet'").fetchall()]
    texts += ["".join(rng.choice("ab é  \n\t'sx1,.漢 ") for _ in range(rng.randint(0, 25))) for _ in range(800)]
    texts += ["<|endoftext|> a", "x <|endoftext|><|endoftext|>  y", "<|endoftext", " lead", "trail ", "a\n b", "a \nb", "don't we'll"]
    for t in texts:
        assert np.frombuffer(ids(t), np.uint32).tolist() == ref.encode(t, add_special_tokens=False).ids, repr(t)


def test_token_ids_of_a_block_of_texts():
    """A block's texts get the ids that each has alone, and a stretch that repeats is encoded once."""
    import public_tokenizers
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids, asked = packing.IdBytes(), []
    whole = ids.whole
    ids.whole = lambda text: asked.append(len(text)) or whole(text)
    rng = random.Random(14)
    texts = ["", " ", "\n", "<|endoftext|>", *("".join(rng.choice("ab é\n\t\r\x1c\x85\xa0\u2003\u3000 'll漢7.") for _ in range(rng.randint(0, 25))) for _ in range(3000))]
    rng.shuffle(texts)
    got, at = ids.many(w.strings(pa.array(texts)))
    for t, a, b in zip(texts, at, at[1:]):
        assert got[a:b].tolist() == ref.encode(t, add_special_tokens=False).ids, repr(t)
    asked.clear()
    many = words_of(rng, 120_000)
    got, at = ids.many(w.strings(pa.array(["x " + " ".join(many), "y " + " ".join(many[::-1])])))
    assert len(at) == 3 and at[1] == at[2] - at[1] == len(got) // 2 and sum(asked) == 2 + sum(len(x) + 1 for x in set(many))


def test_packing_is_tight_and_true(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    out = packing.op6_gga_packing(spark, SF).toPandas()
    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for doc_id, text in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall():
        ids = [*ref.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want += [(doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], np.uint32).tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(map(tuple, out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == sorted(want)
    assert out.sequence_id.nunique() <= 1.02 * -(-out.length.sum() // 1024) + 1


def test_evolution_never_loses_a_piece():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 1024, 300).tolist()
    first = packing.evolve(sizes, 1024, 1, generations=1)
    second = packing.evolve(sizes, 1024, 2, immigrant=first, generations=20)
    for bins in (first, second):
        fill = np.bincount(bins, sizes)
        assert len(bins) == 300 and fill.max() <= 1024
    assert max(second) <= max(first)


def test_evolution_beats_its_seed_on_hard_lists():
    """Lists of two to six pieces a bin, where best-fit decreasing leaves bins to save."""
    better, saved = 0, 0
    for k in range(30):
        sizes = np.random.default_rng(k).integers(150, 500, 120).tolist()
        seed: list[list[int]] = []
        packing.best_fit(np.argsort(-np.asarray(sizes), kind="stable").tolist(), sizes, seed, [], 1000)
        first = packing.evolve(sizes, 1000, k)
        last = packing.evolve(sizes, 1000, k + 99, first)
        assert max(last) <= max(first) < len(seed) + 1
        better += max(last) + 1 < len(seed)
        saved += len(seed) - max(last) - 1
    assert better >= 15 and saved >= 15


def test_large_groups_evolve_as_long_as_small_ones(monkeypatch):
    """A whole group out of the bound's reach gets every generation."""
    born, cross = [], packing.cross
    monkeypatch.setattr(packing, "cross", lambda *a: born.append(1) or cross(*a))
    sizes = np.random.default_rng(1).integers(260, 490, packing.GROUP).tolist()
    seed: list[list[int]] = []
    packing.best_fit(np.argsort(-np.asarray(sizes), kind="stable").tolist(), sizes, seed, [], 1000)
    out = packing.evolve(sizes, 1000, 1)
    assert len(born) == packing.GENERATIONS == 400
    fill = np.bincount(out, sizes)
    assert fill.max() <= 1000 and fill.min() > 0 and len(fill) < len(seed)


def test_pairs_that_fill_a_bin_cost_no_bin():
    """Against the fewest bins there can be, by trying all; pairs are as many as there can be."""

    def fewest(sizes, capacity):
        best = [len(sizes)]

        def place(k, room):
            if len(room) >= best[0]:
                return
            if k == len(sizes):
                best[0] = len(room)
                return
            for b, r in enumerate(room):
                if r >= sizes[k]:
                    place(k + 1, [*room[:b], r - sizes[k], *room[b + 1 :]])
            place(k + 1, [*room, capacity - sizes[k]])

        place(0, [])
        return best[0]

    rng = np.random.default_rng(2)
    for k in range(150):
        capacity = int(rng.integers(7, 13))
        sizes = rng.integers(1, capacity, rng.integers(0, 9))
        pair = packing.twins(sizes, capacity)
        n, left = np.unique(pair[pair >= 0], return_counts=True)[1], sizes[pair < 0].tolist()
        assert (n == 2).all() and (np.bincount(pair[pair >= 0], sizes[pair >= 0]) == capacity).all()
        assert not any(a + b == capacity for i, a in enumerate(left) for b in left[:i])
        assert len(n) + fewest(left, capacity) == fewest(sizes.tolist(), capacity) <= max(packing.evolve(sizes.tolist(), capacity, k), default=-1) + 1


def test_line_dedup_against_sql(spark):
    from oracle import compare

    ours, theirs = compare(lines.op7_winnow_lines(spark, SF), lines.ORACLE_SQL, SF)
    assert ours == theirs


def test_line_dedup_by_hand(spark):
    rng = random.Random(6)
    pool = ["a", "b", "c", " ".join(["w"] * 45), "d e"]
    docs = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))) for k in range(60)]
    seen, gone = set(), {}
    for k, t in docs:
        s = t.split("\n")
        for p in range(len(s)):
            for q in range(p, min(p + 3, len(s))):
                if q - p == 2 or sum(x.count(" ") + 1 for x in s[p : q + 1]) >= 40:
                    if tuple(s[p : q + 1]) in seen:
                        gone.setdefault(k, set()).update(range(p, q + 1))
                    seen.add(tuple(s[p : q + 1]))
                    break
    want = {k: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(k, ())) for k, t in docs}
    got = lines.line_dedup(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == want


def test_winnowing_selects_few_places_and_loses_no_repeat(spark):
    """Each window selects the last of its least line hashes; windows that are equal select equal places; the rest of the lines is not looked at."""
    rng = random.Random(16)
    docs = [(k, "\n".join(" ".join(words_of(rng, 4)) for _ in range(60))) for k in range(12)]
    part = docs[3][1].split("\n")[20:29]
    docs.append((50, "\n".join(["one more line here", *part, "and a last one"])))
    wins = lines.windows(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    hashes = {r.doc_id: r.h for r in spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "transform(split(text, '\\n', -1), x -> xxhash64(x)) as h").collect()}
    for r in wins:
        h = hashes[r.doc_id][r.p : r.q + 1]
        assert r.f == min(h) and r.i == r.p + max(k for k, x in enumerate(h) if x == min(h))
    chosen = {(r.doc_id, r.i) for r in wins}
    assert sum(r["head"] for r in wins) == len(chosen) < 0.6 * sum(t.count("\n") + 1 for _, t in docs)
    where = {}
    for r in wins:
        where.setdefault(r.w, set()).add((r.f, r.i - r.p))
    assert all(len(x) == 1 for x in where.values())
    gone = lines.repeated(spark.createDataFrame(wins, "doc_id long, th long, p int, q int, i int, f long, w binary, head boolean")).collect()
    assert [(r.doc_id, sorted(r.gone)) for r in gone] == [(50, list(range(1, 10)))]


def test_langid_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.predict(docs, langid.train(langid.sample(docs))).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.95


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 20])
def test_codewords(n):
    m = langid.code_matrix(n)
    assert len({tuple(r) for r in m}) == n
    far = [(m[i] != m[j]).sum() for i in range(n) for j in range(i)]
    assert min(far) >= (1 if n == 2 else 2 if n == 3 else 4)


def copies(seed=7, groups=12):
    rng = random.Random(seed)
    docs, k = [], 0
    for g in range(groups):
        base = words_of(rng, rng.randint(30, 200))
        for c in range(rng.randint(1, 5)):
            x = list(base)
            for _ in range(c and rng.randint(0, max(1, len(x) // 60))):
                x[rng.randrange(len(x))] = words_of(rng, 1)[0]
            docs.append((k, " ".join(x)))
            k += 1
    return docs


def plain_classes(docs):
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for k, t in docs}
    cls = {k: k for k in sets}

    def root(x):
        while cls[x] != x:
            x = cls[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                cls[y] = x
    return {k: root(k) for k in sets}


def test_neardup_against_all_pairs(spark):
    docs = copies()
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == plain_classes(docs)


def near_fingerprints(seed, n, p):
    """n fingerprints, then n others of which each bit differs from the first ones with chance p."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, (n, 2), dtype=np.int64).view(np.uint64)
    return np.concatenate([base, base ^ np.packbits(rng.random((n, 128)) < p, axis=1).view(np.uint64)])


def as_nodes(spark, f, label=None):
    rows = [(k, 9, int(x[0]), int(x[1]), int(k if label is None else label[k])) for k, x in enumerate(f.view(np.int64))]
    return spark.createDataFrame(rows, "node long, n int, f0 long, f1 long, label long").repartition(4)


def exact_close(f, label=None):
    out = set()
    for s in range(0, len(f), 500):
        d = np.bitwise_count(f[s : s + 500, None, 0] ^ f[None, :, 0]).astype(int) + np.bitwise_count(f[s : s + 500, None, 1] ^ f[None, :, 1])
        out |= {(int(i) + s, int(j)) for i, j in zip(*np.nonzero(d <= neardup.RADIUS)) if i + s < j and (label is None or label[i + s] != label[j])}
    return out


def test_ten_thousand_nodes_through_two_levels(spark):
    """Lists shuffled at the first level and worked off at the second: the pairs of an exact search, but for the planned misses."""
    p, n = neardup.bit_difference(0.8), 5000
    f = near_fingerprints(17, n, p)
    plan = neardup.planned(p, 0.98, 2)
    assert plan.depth == 2 and plan.spread == 1 and plan.rounds > 1
    got = {(r.a, r.b) for r in neardup.candidates(as_nodes(spark, f), plan, True).collect()}
    want = exact_close(f)
    assert got <= want and len(want) >= n - 10
    assert sum((k, k + n) not in got for k in range(n)) <= 0.025 * n


def test_a_list_beyond_the_split_gives_the_same_pairs(spark):
    f = near_fingerprints(5, 300, 0.1)
    plan = neardup.planned(neardup.bit_difference(0.8), 0.9995, 1)
    nodes = as_nodes(spark, f, np.arange(600) % 300 // 2)
    whole = {(r.a, r.b) for r in neardup.candidates(nodes, plan, True).collect()}
    assert max(neardup.crowded(nodes, plan, 5).values()) > 1
    assert {(r.a, r.b) for r in neardup.candidates(nodes, plan, True, 5).collect()} == whole


def test_labels_leave_out_no_pair_of_unlike_ones():
    rng = np.random.default_rng(2)
    f = np.zeros((1500, 2), np.uint64)
    f[:, 0] = rng.integers(0, 4, 1500, dtype=np.uint64)
    label = np.sort(rng.integers(0, 3, 1500))
    got = {(int(i), int(j)) for x, y, _ in neardup.close_pairs(f, np.full(1500, 5), label) for i, j in zip(x, y)}
    assert got == exact_close(f, label)
    few = sum(len(x) for x, _, _ in neardup.close_pairs(f, np.full(1500, 5), None))
    assert few <= neardup.NEAREST * 1500


def test_a_crowd_of_edited_copies_is_compared_without_writing_its_pairs(spark):
    """Pairs of a crowd grow with its square, what is written for it by its rows; its classes stay those of all pairs."""
    p, n = neardup.bit_difference(0.8), 400
    rng = np.random.default_rng(4)
    f = rng.integers(0, 2**63, (1, 2), dtype=np.int64).view(np.uint64) ^ np.packbits(rng.random((n, 128)) < 0.08, axis=1).view(np.uint64)
    plan = neardup.planned(p, 0.9995, 1)
    every = {(r.a, r.b) for r in neardup.candidates(as_nodes(spark, f), plan, True).collect()}
    rows = neardup.candidates(as_nodes(spark, f), plan, True, most=neardup.CROWD).collect()
    assert len(every) > 0.9 * n * (n - 1) / 2 and len(rows) < len(every) / 4
    trees = [(r.a, r.b) for r in rows if r.d < 0]
    crowd = {r.node: r["class"] for r in graph.components(spark.createDataFrame(trees, "a long, b long")).collect()}
    alone = {(r.a, r.b) for r in rows if r.d >= 0}
    assert alone <= every and all((a, b) in alone or (a in crowd and crowd[a] == crowd.get(b)) for a, b in every)


def test_pairs_of_a_crowd_are_those_of_an_exact_search(spark):
    rng = random.Random(8)
    base = words_of(rng, 150)
    texts = {" ".join(base)}
    while len(texts) < 120:
        copy = list(base)
        for _ in range(rng.randint(1, 9)):
            copy[rng.randrange(len(copy))] = "x" + words_of(rng, 1)[0]
        texts.add(" ".join(copy))
    docs = list(enumerate(sorted(texts)))
    sig = neardup.signatures(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    sets = {r.node: next(neardup.shingles(pa.array([docs[r.doc_id][1]]))).view(np.int64).tolist() for r in sig}
    want = {(a, b) for a in sets for b in sets if a < b and len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]})}
    assert 0 < len(want) < len(sets) * (len(sets) - 1) / 2
    nodes = spark.createDataFrame([(0, r.node, r.n, r.f0, r.f1, r.node) for r in sig], "list long, node long, n int, f0 long, f1 long, label long")
    stored = spark.createDataFrame(list(sets.items()), "node long, s array<long>")
    for room in (neardup.ROOM, 2000):  # whole, and in blocks
        assert {(r.a, r.b) for r in neardup.crowd_links(nodes, stored, room=room).collect()} == want
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == plain_classes(docs)


def test_short_texts_one_shingle_apart_are_all_found(spark):
    rng = random.Random(6)
    docs = []
    for k in range(0, 400, 4):
        a = words_of(rng, rng.randint(9, 13))
        docs += [(k, " ".join(a)), (k + 1, " ".join(a[:-1])), (k + 2, " ".join(["neu", *a])), (k + 3, " ".join(words_of(rng, 9)))]
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == plain_classes(docs)


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    rng = random.Random(3)
    a, b = " ".join(words_of(rng, 40)), " ".join(words_of(rng, 40))
    rows = [(1, a), (2, a), (2, b), (None, b), (None, b), (None, a), (2, b)]
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 7 and {(r.doc_id, r.class_id, r.is_kept) for r in got} == {(1, 1, True), (2, 1, False), (2, 2, True), (None, 2, False), (None, 1, False)}


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(200 + k, 201 + k) for k in range(40)]
    got = {r.node: r["class"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    cls = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            cls[a] = cls[b] = min(cls[a], cls[b])
    assert got == {x: c for x, c in cls.items() if x in got} and all(c == x for x, c in cls.items() if x not in got)


def test_pasted_passages_are_found(spark):
    rng = random.Random(10)
    docs, planted = [], set()
    passages = [" ".join(words_of(rng, 60)) for _ in range(8)]
    for k in range(60):
        x = words_of(rng, 150)
        if k % 3 == 0:
            at = rng.randrange(150)
            x[at:at] = passages[k % 8].split()
            planted.add(k)
        docs.append((k, " ".join(x)))
    got = substrings.repeated_paragraphs(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == planted
    first = {min(k for k in planted if k % 8 == p) for p in {k % 8 for k in planted}}
    assert first <= {r.doc_id for r in got if not r.removed} and {r.doc_id for r in got if r.removed} == planted - first


def test_bands():
    bands, rows = substrings.tuned()
    assert 1 - (1 - 0.8**rows) ** bands >= substrings.COLLIDE


def test_crowded_bands_are_whole(spark):
    """Every pair of a bucket is looked at, but for those that are of one class already."""
    keys = [(k, 5, 100 + k) for k in range(300)]
    members = substrings.buckets(spark.createDataFrame(keys, "key long, m0 long, m1 long"), 2)
    heads = {(r.a, r.b) for r in substrings.to_heads(members).collect()}
    assert heads == {(0, k) for k in range(1, 300)}
    label = spark.createDataFrame([(k, 0) for k in range(100)], "node long, class long")
    rest = {(r.a, r.b) for r in substrings.across(members, label).collect()}
    every = {(a, b) for a in range(300) for b in range(a + 1, 300)}
    assert rest == {(a, b) for a, b in every - heads if b >= 100}
    one = spark.createDataFrame([(k, 0) for k in range(300)], "node long, class long")
    assert substrings.across(members, one).count() == 0


def test_a_crowd_of_paragraphs_is_compared_without_writing_its_pairs(spark):
    """The links of a bucket, whole and in blocks, join what those of all its pairs join."""
    rng = random.Random(31)
    texts = set()
    for n in (9, 16, 60):
        base = words_of(rng, n)
        for _ in range(40):
            copy = list(base)
            for _ in range(rng.randint(1, 2)):
                copy[rng.randrange(n)] = words_of(rng, 1)[0]
            texts.add(" ".join(copy))
    texts |= {" ".join(["ah"] * a + ["be"] * b) for a in (9, 14, 20) for b in (7, 8, 13)}
    rows = []
    for k, x in enumerate(sorted(texts)):
        t = w.words(w.strings(pa.array([x])))
        rows.append((k, np.unique(w.grams(t.h, t.at, 5)[0]).view(np.int64).tolist(), t.h.view(np.int64).tolist()))
    parts = spark.createDataFrame(rows, "key long, s array<long>, h array<long>")
    members = substrings.buckets(spark.createDataFrame([(k, 5, 100 + k) for k in range(len(rows))], "key long, m0 long, m1 long"), 2)
    label = spark.createDataFrame([(k, 0) for k in range(0, 30)], "node long, class long")
    pairs = substrings.across(members, label)
    want = {(r.a, r.b) for r in substrings.joined(pairs, parts).collect()}
    assert 50 < len(want) < pairs.count() / 2
    name = lambda k: 0 if k < 30 else k
    for block in (1024, 20):
        got = {(r.a, r.b) for r in substrings.across_crowds(members, label, parts, block=block).collect()}
        assert got <= want and {tuple(sorted((name(a), name(b)))) for a, b in got} == {tuple(sorted((name(a), name(b)))) for a, b in want}
        assert len(got) < len(want)


def test_similar_paragraphs_join(spark):
    rng = random.Random(11)
    a = words_of(rng, 30)
    b = list(a)
    b[29] = "other1x"
    parts = [(1, a), (2, b), (3, words_of(rng, 30))]
    rows = []
    for k, x in parts:
        t = w.words(w.strings(pa.array([" ".join(x)])))
        rows.append((k, np.unique(w.grams(t.h, t.at, 5)[0]).view(np.int64).tolist(), t.h.view(np.int64).tolist()))
    df = spark.createDataFrame(rows, "key long, s array<long>, h array<long>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a long, b long")
    assert [tuple(r) for r in substrings.joined(pairs, df).collect()] == [(1, 2)]


def test_lcs():
    rng = random.Random(12)
    for _ in range(100):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(1, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs(np.array(a), np.array(b)) == t[-1][-1]


def test_leaks_and_paraphrases(spark):
    rng = random.Random(13)
    items = [(k, " ".join(words_of(rng, 30)) + ". " + " ".join(words_of(rng, 6)) + ".") for k in range(40)]
    docs, want = [], set()
    for k in range(200):
        x = words_of(rng, 200)
        if k % 5 == 0:
            i = k % 40
            y = items[i][1].split()
            if k % 10 == 0:  # a paraphrase: a fifth of the words before the answer are others
                for p in rng.sample(range(28), 7):
                    y[p] = words_of(rng, 1)[0]
            x[50:50] = y
            want.add((k, i))
        docs.append((k, " ".join(x)))
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want


def test_decontamination_finds_items_whose_words_became_common(spark):
    rng = random.Random(31)
    items = [(k, " ".join(words_of(rng, 34)) + ".") for k in range(6)]
    docs = [(k, " ".join(words_of(rng, 60) + ([items[0][1]] if k % 3 == 0 else []) + words_of(rng, 40))) for k in range(120)]
    part = items[0][1].split()
    docs.append((120, " ".join(words_of(rng, 50) + part[3:] + words_of(rng, 50))))
    docs.append((121, items[4][1]))
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, 0) for k in range(0, 121, 3)} | {(120, 0), (121, 4)}


def test_leaks_against_an_exhaustive_search(spark):
    """Every item against every passage of every document by common subsequences, without a latent space: recall of the search, and nothing else found."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    rng = random.Random(4)
    texts = {r.item_id: r.text for r in bench.collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k, i in enumerate(sorted(texts)[:30]):  # paraphrases: every fifth word is another
        x = texts[i].split()
        rows.append((10_000 + k if k % 3 else None, " ".join(words_of(rng, 30) + [words_of(rng, 1)[0] if j % 5 == 1 and j < 0.8 * len(x) else y for j, y in enumerate(x)] + words_of(rng, 30))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.row, r.item_id) for r in decontaminate.found_leaks(df, bench).collect()}
    x = decontaminate.Items(list(texts), list(texts.values()))
    row_of = [r.h for r in df.selectExpr("xxhash64(doc_id, xxhash64(text)) as h").collect()]
    known = []
    count, total = np.zeros(len(x.vocab), int), 0
    for _, text in rows:
        h = w.words(w.strings(pa.array([text], pa.string()))).h
        ids = x.lookup(h)
        lots = max(1, -(-(len(h) - decontaminate.PASSAGE) // decontaminate.STRIDE) + 1) if len(h) else 0
        total += lots
        for k in range(lots):
            part = ids[k * decontaminate.STRIDE : k * decontaminate.STRIDE + decontaminate.PASSAGE]
            count[np.unique(part[part >= 0])] += 1
        known.append((np.flatnonzero(ids >= 0), ids[ids >= 0], lots))
    content = np.flatnonzero((count > 0) & (count <= max(decontaminate.CONTENT * total, 25)))
    want = set()
    for at, (pos, ids, lots) in enumerate(known):
        for k, i in enumerate(x.ids):
            item, answer = x.lookup(x.words[k]), x.lookup(x.answers[k])
            if np.isin(item, ids).mean() >= decontaminate.PARAPHRASE and any(decontaminate.judged(item, answer, content, item[:0], pos, ids, s * decontaminate.STRIDE) for s in range(lots)):
                want.add((row_of[at], i))
    assert got <= want and len(want) >= 30 and len(got) >= 0.98 * len(want)
    assert any(doc_id is None and row_of[at] in {r for r, _ in got} for at, (doc_id, _) in enumerate(rows))


def test_randomised_basis_is_near_the_exact_one(spark):
    """Cosines in the sketched space against those in numpy's own singular vectors."""
    rng = np.random.default_rng(9)
    lists_ = [np.sort(rng.choice(60, rng.integers(4, 9), replace=False)).tolist() for _ in range(400)]
    items = [np.sort(rng.choice(60, 10, replace=False)) for _ in range(12)]
    weight = rng.uniform(1, 4, 60)
    rows = spark.createDataFrame([(0, 0, x) for x in lists_], "row long, start long, ids array<int>").repartition(9)
    basis = decontaminate.latent_space(rows, weight, items, rank=40)
    unit = lambda x: (weight * np.isin(np.arange(60), x)) / np.linalg.norm(weight[x])
    a, b = np.array([unit(np.array(x)) for x in lists_]), np.array([unit(x) for x in items])
    exact = np.linalg.svd(np.concatenate([a, np.sqrt(400 / 12) * b]), full_matrices=False)[2][:40].T
    cos = lambda v: (lambda p, q: (p / np.linalg.norm(p, axis=1, keepdims=True)) @ (q / np.linalg.norm(q, axis=1, keepdims=True)).T)(a @ v, b @ v)
    assert np.abs(cos(basis) - cos(exact)).mean() < 0.03


def test_neardup_recall_counts_radius_and_all_distances():
    p = neardup.bit_difference(0.8)
    plan = neardup.planned(p, neardup.RECALL, 1)
    assert neardup.missed(p, plan.count, 1, 1) <= 1 - neardup.RECALL < neardup.missed(p, plan.count - 1, 1, 1)
    for depth in (2, 3):
        deep = neardup.planned(p, neardup.RECALL, depth)
        assert neardup.missed(p, deep.count, depth, deep.rounds) <= 1 - neardup.RECALL < neardup.missed(p, deep.count, depth, deep.rounds - 1)
    n = 3000
    f = near_fingerprints(41, n, p)
    found = set()
    for i, j, _ in neardup.search(f, np.full(len(f), 9), 0, 0, 0, plan, np.arange(len(f)), None):
        found |= set(zip(i.tolist(), j.tolist()))
    assert sum((k, k + n) not in found for k in range(n)) <= 6  # 1.5 expected; 19 at radius 30


def test_cuts_do_not_depend_on_the_text_that_comes_next():
    rng = random.Random(12)
    texts = [" ".join(words_of(rng, rng.randint(1, 60))) + rng.choice(["", "\n" + " ".join(words_of(rng, 20))]) for _ in range(40)]

    def cut(some):
        p = substrings.Paragraphs(w.strings(pa.array(some)))
        out = [[] for _ in some]
        for row, lo, hi in zip(p.row, p.a, p.b):
            out[row].append((int(lo - p.t.at[row]), int(hi - p.t.at[row])))
        return out

    assert cut(texts) == [cut([t])[0] for t in texts]


def test_paragraphs_against_all_pairs(spark):
    """Classes of repeated paragraphs against every pair of paragraphs, with ids that are null or shared."""
    rng = random.Random(77)
    base = [words_of(rng, rng.randint(18, 40)) for _ in range(25)]
    rows = []
    for k in range(120):
        lines_ = []
        for _ in range(3):
            x = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                x[rng.randrange(len(x))] = words_of(rng, 1)[0]
            lines_.append(" ".join(x))
        rows.append((None if k % 7 == 0 else k - k % 2, "\n".join(lines_)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    p = substrings.Paragraphs(w.strings(pa.array([t for _, t in rows])))
    sets = {int(key): set(p.g[lo:last].tolist()) for key, lo, last in zip(p.key.view(np.int64), p.a, p.last)}
    where = {}
    for key, row, lo, hi in zip(p.key.view(np.int64).tolist(), p.row, p.a, p.b):
        where.setdefault(key, set()).add((rows[row], int(lo - p.t.at[row]), int(hi - p.t.at[row])))
    words_in = {int(key): p.t.h[lo:hi].tolist() for key, lo, hi in zip(p.key.view(np.int64), p.a, p.b)}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    pairs = 0
    for x in sets:
        for y in sets:
            if x < y:
                shared = len(sets[x] & sets[y])
                near = shared >= 0.8 * len(sets[x] | sets[y])
                pairs += near
                if near or (min(len(words_in[x]), len(words_in[y])) <= 17 and substrings._edits(words_in[x], words_in[y], 1)):
                    root[max(find(x), find(y))] = min(find(x), find(y))
    groups = {}
    for k in sets:
        groups.setdefault(find(k), set()).update((r, lo, hi) for r, lo, hi in where[k])
    want = {(r[0], lo, hi) for g in groups.values() if len(g) > 1 for r, lo, hi in g}
    got = substrings.repeated_paragraphs(df).collect()
    found = {(r.doc_id, r.start_word, r.end_word) for r in got}
    assert pairs > 10 and found <= want
    long_enough = {x for x in want if x[2] - x[1] >= substrings.RUN}
    assert len(long_enough - found) <= 0.02 * len(long_enough)
    assert any(r.doc_id is None for r in got)


def test_a_first_holder_without_an_id_loses_no_link(spark):
    rng = random.Random(31)
    x = words_of(rng, 40)
    cuts = lambda t: [p := substrings.Paragraphs(w.strings(pa.array([" ".join(t)]))), list(zip(p.a.tolist(), p.b.tolist()))][1]
    spot = next(k for k in range(10, 30) if cuts([*x[:k], "neu", *x[k + 1 :]]) == cuts(x) and any(a <= k < b <= a + 17 for a, b in cuts(x)))
    edited = [*x[:spot], "neu", *x[spot + 1 :]]
    rows = [(0, " ".join(x))] * 8 + [(None, " ".join(x))] * 4 + [(5, " ".join(edited)), (None, " ".join(edited))]
    got = substrings.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {0, 5, None} and {r.first_doc_id for r in got} == {0}
    assert any(r.doc_id == 5 and r.start_word <= spot < r.end_word for r in got)
    assert {r.removed for r in got if r.doc_id == 0} == {False} and all(r.removed for r in got if r.doc_id is None)


def test_short_paragraphs_one_word_apart_are_all_found(spark):
    rng = random.Random(51)
    docs, n = [], 60
    for k in range(n):
        x = [words_of(rng, rng.randint(8, 14)) for _ in range(2)]
        docs.append((2 * k, "\n".join(" ".join(p) for p in x)))
        y = [p[:] for p in x]
        for p in y:
            at = rng.randrange(len(p))
            p[at : at + 1] = words_of(rng, rng.choice([0, 1, 1, 2]))
        docs.append((2 * k + 1, "\n".join(" ".join(p) for p in y)))
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)  # cuts look past the ends of a block's texts
    found = {(r.a, r.b) for r in substrings.one_apart(df, substrings.shared_halves(substrings.paragraphs(df, *substrings.tuned()))).collect()}
    keyed, want = {}, set()
    p = substrings.Paragraphs(w.strings(pa.array([text for _, text in docs])))
    for key, a, b in zip(p.key.view(np.int64).tolist(), p.a, p.b):
        keyed[key] = p.t.h[a:b].tolist()
    for a in keyed:
        want |= {(a, b) for b in keyed if a < b and min(len(keyed[a]), len(keyed[b])) <= 16 and substrings._edits(keyed[a], keyed[b], 1)}
    assert len(want) > 40 and found == want
    got = {(r.doc_id, r.start_word) for r in substrings.repeated_paragraphs(df).collect() if r.removed}
    assert got  # the pairs reach the result


def test_html_attributes_are_read_by_name_and_whole():
    shown = ['style="overflow:hidden"', 'class="overflow-hidden"', 'data-x="display:none"', "title='aria-hidden=\"true\"'", 'aria-hidden="false"', 'data-hidden="1"']
    away = ["hidden", "HIDDEN=''", 'style="color:red; display : none"', 'aria-hidden="true"', "aria-hidden=true", f'data-x="{"y" * 500}" hidden', f'style="{"a:b;" * 200}display:none"']
    for attrs in shown:
        assert [b.text for b in html.leaf_blocks(f"<div {attrs}><p>Words.</p></div>")] == ["Words."], attrs
    for attrs in away:
        assert not html.leaf_blocks(f"<div {attrs}><p>Words.</p></div>"), attrs
    (b,) = html.leaf_blocks(f'<div data-x="{"y" * 500}" class="comments"><p>Words.</p></div>')
    assert "cue:comment" in b.up


def test_pii_looks_at_texts_without_digits_and_at_long_words(spark):
    rng = random.Random(61)
    hexes = "".join(rng.choice("0123456789abcdef") for _ in range(300))
    part = lambda n: "".join(rng.choice("ABCDEFabcdefghijk0123456789_-") for _ in range(n))
    jwt = f"eyJ{part(40)}.eyJ{part(120)}.{part(42)}z"
    texts = ["lomi ana(at)mail.net tera", "lomi ana at\nmail\tdot\ncom tera", f"lomi api_key={hexes} tera", f"lomi token={jwt} tera", f'lomi token = "{hexes}" tera']
    want = ["ana(at)mail.net", "ana at\nmail\tdot\ncom", f"api_key={hexes}", f"token={jwt}", f'token = "{hexes}']
    got = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        text = texts[r.doc_id]
        spans = [text[int(s) : int(e)] for _, s, e in (x.split(":") for x in r.spans.split(",") if x)]
        assert spans == [want[r.doc_id]], r.doc_id
