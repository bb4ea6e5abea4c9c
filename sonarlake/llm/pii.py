"""Personal data: fixed patterns, and a semi-Markov CRF that adds to them.

Base spans come from four patterns, found in linear time. Around words that hold
a digit, an at sign, an equals sign or the like, a semi-Markov conditional random
field scores whole segments of up to ``LONGEST`` words by span features (digit
and letter counts, separators, checksums, the words before) and by the types of
neighbours; a bounded-entity dynamic programme picks boundaries and types
together. What it finds where no base span is, is added. The field is trained
by the gradient of its likelihood on labelled sentences that this module writes.

Defined results: a null or empty text has no spans; added spans never overlap
base ones, nor each other: of two that do the one that begins first stays; of
equally good labellings the one met first in the order outside, ``KINDS`` is
taken; a segment of several words may have ``WIDEST`` characters, in which a
longer word counts as one; texts of any length are decoded as a whole; repeated
rows give repeated results; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterable
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as w

KINDS = ("email", "ip", "card", "phone", "secret")
LONGEST = 7
WIDEST = 96
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]+@")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = np.zeros(256, bool)
_TRIGGER[[ord(c) for c in "0123456789@="]] = True


def luhn(digits: str) -> bool:
    """The check digit of a card number."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterable[tuple[int, int]]:
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            floor = m.end()
            at = text.find("@", floor)
        else:
            floor = at + 1
            at = text.find("@", floor)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the four patterns, by kind and start."""
    found = [(0, *s) for s in _emails(text)]
    if any(d in text for d in "0123456789"):
        found += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def _shape(s: str) -> tuple:
    digits = sum(c.isdigit() for c in s)
    alpha = sum(c.isalpha() for c in s)
    return digits, alpha, len(s)


def span_features(words: tuple[str, ...], before: str) -> tuple[str, ...]:
    """Features of a candidate segment as a whole."""
    return _cached(words, before) if max(map(len, (*words, before))) <= WIDEST else _features(words, before)  # long words would fill memory


def _features(words: tuple[str, ...], before: str) -> tuple[str, ...]:
    s = " ".join(words)
    core = s.strip(".,;:!?\"'()<>")
    digits, alpha, n = _shape(core)
    low = core.lower()
    f = ["bias", f"words{min(len(words), 4)}", f"digits{'0' if not digits else '1-3' if digits < 4 else '4-8' if digits < 9 else '9-12' if digits < 13 else '13-19' if digits < 20 else '20+'}"]
    if re.fullmatch(r"[\d.]+", core) and core.count(".") == 3:
        f.append("quad")
    if re.fullmatch(r"[\d \-]+", core) and digits >= 13:
        f.append("cardlike" + str(luhn(re.sub(r"\D", "", core))))
    if re.fullmatch(r"\(?\+?[\d ().\-/]+", core) and 7 <= digits <= 15:
        f.append("dial" + "+" * core.startswith("+"))
    if "@" in core or re.search(r"\(at\)|\[at\]", low):
        f.append("at" + str("." in core.split("@")[-1]))
    if len(words) > 2 and re.fullmatch(r"[\w.+-]+ at [\w-]+(?: dot [\w-]+)+", low):
        f += ["spelt", "spelt" + str(len(words))]
    if re.search(r"(?:passw(?:or)?d|token|secret|api_?key|pwd)\W*[=:]", low):
        f.append("assign")
        value = low[len(low) - len(re.match(r"\w*", low[::-1])[0]) :]
        marks = re.match(r"\W*", low[: len(low) - len(value)][::-1])[0]
        if len(value) >= 6 and ("=" in marks or ":" in marks):
            f.append("assigned")
    if re.fullmatch(r"[A-Z0-9]{16,}", core) and digits and alpha:
        f.append("keyid")
    if re.fullmatch(r"[0-9a-f]{16,}", core) and digits and alpha:
        f.append("hex")
    if alpha and not digits and "spelt" not in f:
        f.append("letters")
    if alpha and digits:
        f.append("mixed" + ("long" if n >= 16 else "short"))
    if not core:
        f.append("marks")
    b = re.sub(r"\W", "", before.lower())
    if b in ("password", "passwd", "token", "secret", "key", "pwd", "email", "mail", "phone", "call", "tel", "card", "ip", "contact"):
        f.append("after_" + b)
    return tuple(f)


_cached = lru_cache(maxsize=50_000)(_features)


def _eligible(words: tuple[str, ...]) -> bool:
    s = " ".join(words)
    size = len(s) - sum(len(x) - 1 for x in words if len(x) > WIDEST)  # a long word counts as one character
    return size <= WIDEST and ("@" in s or "=" in s or any(c.isdigit() for c in s) or " dot " in s or "(at)" in s)


class SemiMarkov:
    """Types 0 (outside, one word at a time) and 1.. (KINDS), with segment scores."""

    def __init__(self) -> None:
        self.x: dict[tuple, float] = {}

    def score(self, feats: tuple[str, ...], t: int) -> float:
        get = self.x.get
        return sum(get((f, t), 0.0) for f in feats)

    def moves_to(self, words: list[str], e: int) -> list[tuple[int, int, float, tuple[str, ...]]]:
        """(start, type, score, features) of the segments that may end at e."""
        out = []
        for s in range(e - 1, max(-1, e - 1 - LONGEST), -1):
            seg = tuple(words[s:e])
            may = _eligible(seg)
            if may or s == e - 1:
                f = span_features(seg, words[s - 1] if s else "")
                out += [(s, t, self.score(f, t), f) for t in (range(len(KINDS) + 1) if may else (0,)) if t or s == e - 1]
        return out

    def moves(self, words: list[str]) -> dict[int, list[tuple[int, int, float, tuple[str, ...]]]]:
        return {e: self.moves_to(words, e) for e in range(1, len(words) + 1)}

    def decode(self, words: list[str]) -> list[tuple[int, int, int]]:
        """The best (type, first word, end word), entities only; two numbers a word and type are kept."""
        n, k = len(words), len(KINDS) + 1
        start, kind = np.zeros((n + 1, k), np.int32), np.zeros((n + 1, k), np.int8)
        step = [[self.x.get((p, t), 0.0) for p in range(k)] for t in range(k)]
        best = {0: [0.0] + [-math.inf] * (k - 1)}
        for e in range(1, n + 1):
            here = [-math.inf] * k
            for s, t, v, _ in self.moves_to(words, e):
                for p, (b, tr) in enumerate(zip(best[s], step[t])):
                    x = b + v + tr
                    if x > here[t]:
                        here[t] = x
                        start[e, t], kind[e, t] = s, p
            best[e] = here
            best.pop(e - LONGEST - 1, None)
        out, e = [], n
        t = max(range(k), key=lambda q: best[n][q])
        while e > 0:
            s, p = int(start[e, t]), int(kind[e, t])
            if t:
                out.append((t, s, e))
            e, t = s, p
        return out[::-1]

    def learn(self, words: list[str], gold: list[tuple[int, int, int]], rate: float) -> None:
        """One step up the log-likelihood: gold features less expected ones."""
        n, k = len(words), len(KINDS) + 1
        moves = self.moves(words)
        a = np.full((n + 1, k), -np.inf)
        b = np.full((n + 1, k), -np.inf)
        a[0, 0] = 0
        b[n] = 0
        tr = np.array([[self.x.get((p, t), 0.0) for t in range(k)] for p in range(k)])
        for e in range(1, n + 1):
            for s, t, v, _ in moves[e]:
                a[e, t] = np.logaddexp(a[e, t], np.logaddexp.reduce(a[s] + tr[:, t]) + v)
        for e in range(n, 0, -1):
            for s, t, v, _ in moves[e]:
                b[s] = np.logaddexp(b[s], tr[:, t] + v + b[e, t])
        z = np.logaddexp.reduce(a[n])
        truth = {(s, e): t for t, s, e in gold}
        inside = {i for _, s, e in gold for i in range(s, e)}
        truth |= {(i, i + 1): 0 for i in range(n) if i not in inside}
        grad: dict[tuple, float] = {}
        for e in range(1, n + 1):
            for s, t, v, f in moves[e]:
                each = np.exp(a[s] + tr[:, t] + v + b[e, t] - z)
                d = float(truth.get((s, e)) == t) - each.sum()
                for name in f:
                    grad[name, t] = grad.get((name, t), 0.0) + d
                for p in np.flatnonzero(each > 1e-6):
                    grad[int(p), t] = grad.get((int(p), t), 0.0) - each[p]
        p = 0
        for (s, e), t in sorted(truth.items()):
            grad[p, t] = grad.get((p, t), 0.0) + 1
            p = t
        for key, g in grad.items():
            self.x[key] = 0.999 * self.x.get(key, 0.0) + rate * g


def written_sentences(n: int = 260, seed: int = 5) -> list[tuple[list[str], list[tuple[int, int, int]]]]:
    """Labelled sentences: made-up words with entities of every type and look-alikes."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ra", "te", "lo", "mi", "en", "sh", "or", "an", "di", "qu"]) for _ in range(rng.randint(1, 4)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card() -> str:
        body = rng.choice(["4", "51", "37"]) + num(13)
        body = body[:15]
        full = next(body + c for c in "0123456789" if luhn(body + c))
        sep = rng.choice(["", " ", "-"])
        return sep.join(full[i : i + 4] for i in range(0, 16, 4))

    def entity(t: int) -> str:
        if t == 1:
            return rng.choice([f"{word()}.{num(2)}@{word()}.com", f"{word()}@{word()}.org", f"{word()} at {word()} dot com", f"{word()} at {word()} dot {word()} dot net", f"{word()}(at){word()}.net"])
        if t == 2:
            return ".".join(str(rng.randint(0, 255)) for _ in range(4))
        if t == 3:
            return card()
        if t == 4:
            return rng.choice([f"+1 ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(3)} {num(3)}", f"{num(3)}-{num(3)}-{num(4)}"])
        key = "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(16, 40)))
        upper = "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(15)) + num(1)
        return rng.choice([f"password={key}", f'token = "{key}"', upper, f"secret: {key}1", f"api_key={upper}"])

    def unchecked() -> str:
        body = num(15)
        return next(body + c for c in "0123456789" if not luhn(body + c))

    def decoy() -> str:
        return rng.choice([num(4), num(rng.randint(1, 6)), f"{num(1)}.{num(1)}", f"v{num(1)}.{num(1)}.{num(2)}", f"20{num(2)}-{num(2)}-{num(2)}", f"{word()}={num(2)}", "@" + word(), f"{num(2)}%", f"{num(1)},{num(3)}", f"a = {num(1)}", f"{word()}{num(2)}", f"{num(20)}", f"{num(2)}:{num(2)}", unchecked(), unchecked()])

    out = []
    for _ in range(n):
        words: list[str] = []
        gold = []
        for _ in range(rng.randint(1, 3)):
            words += [word() for _ in range(rng.randint(1, 3))]
            if rng.random() < 0.62:
                t = rng.randint(1, 5)
                seg = (entity(t) + rng.choice(["", "", ".", ","])).split()
                gold.append((t, len(words), len(words) + len(seg)))
                words += seg
            else:
                words += decoy().split()
        words += [word()]
        out.append((words, gold))
    return out


@lru_cache(maxsize=1)
def trained() -> SemiMarkov:
    """The field, trained once a process; the same on every run."""
    field, rows = SemiMarkov(), written_sentences()
    for epoch in range(5):
        for words, gold in rows:
            field.learn(words, gold, 0.25 / (1 + 0.5 * epoch))
    return field


_WORD = re.compile(r"\S+")
_HOT = re.compile(r"[0-9@=]|\(at\)")


def added_spans(text: str, base: list[tuple[int, int, int]], field: SemiMarkov) -> list[tuple[int, int, int]]:
    """What the field finds apart from base spans."""
    toks = [m.span() for m in _WORD.finditer(text)]
    hot = [k for k, (s, e) in enumerate(toks) if _HOT.search(text, s, e) or text[s:e] == "dot"]
    out, i = [], 0
    taken = sorted((s, e) for _, s, e in base)
    starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    while i < len(hot):
        j = i
        while j + 1 < len(hot) and hot[j + 1] - hot[j] <= LONGEST:
            j += 1
        lo, hi = max(0, hot[i] - 4), min(len(toks), hot[j] + 5)
        part = toks[lo:hi]
        for t, a, b in field.decode([text[s:e] for s, e in part]):
            s, e = part[a][0], part[b - 1][1]
            while s < e and text[s] in "\"'(<[,;":
                s += 1
            while e > s and text[e - 1] in "\"').,;:!?>]":
                e -= 1
            if e > s:
                out.append((t - 1, s, e))
        i = j + 1
    free, last = [], -1
    for t, s, e in sorted(set(out), key=lambda x: x[1:]):
        before = bisect_left(starts, e)  # base spans that begin before this one ends
        if s >= last and not (before and reach[before - 1] > s):
            free.append((t, s, e))
            last = e
    return free


def find_pii(docs: DataFrame) -> DataFrame:
    """Base and added spans of every text, with counts and digests."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())  # a few hundred weights

    def run(batches: Iterable[pa.RecordBatch]):
        field = shared.value
        none = hashlib.sha256(b"").hexdigest()
        for b in batches:
            rows: list[tuple] = []
            column = w.strings(b.column(1))
            off, raw = w.buffers(column)
            hits = np.concatenate([[0], np.cumsum(_TRIGGER[raw[off[0] : off[-1]]])]) if len(off) > 1 else np.zeros(1)
            edge = off - off[0]
            for k in range(b.num_rows):
                text = ""
                if hits[edge[k + 1]] > hits[edge[k]]:
                    text = column[k].as_py()
                elif (s := column[k].as_py()) and ("(at)" in s or "dot" in s):  # all that may hold a hot word
                    text = s
                if not text:
                    rows.append((0, 0, 0, 0, none, "", 0))
                    continue
                base = base_spans(text)
                more = added_spans(text, base, field)
                listed = lambda x: ",".join(f"{KINDS[t]}:{s}:{e}" for t, s, e in sorted(x))
                n = [sum(t == q for t, _, _ in base) for q in range(4)]
                rows.append((*n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more), len(more)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            cols = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def op3_semicrf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``."""
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
