"""Main text of web pages: a linear-chain CRF over DOM leaf blocks.

A page is read into leaf blocks (runs of text between block-level tags), each
with the set of features of its ancestors: tags, and words of their classes and
ids. Text features are added, a two-label chain is decoded by Viterbi, and the
blocks labelled as content are joined. The chain is trained by the gradient of
its likelihood on labelled pages that this module writes in many layouts.

Defined results: a null or empty page has an empty text; markup that is never
closed ends with the page; scripts, styles, templates, comments and what is in
the head are no text; of equally likely labellings a block is aside rather than
content; repeated rows give repeated results; extra columns are left alone.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr svg path button picture source".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template title textarea iframe xmp noembed noframes".split())
CLOSES_P = frozenset("address article aside blockquote body center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table td th tr ul".split())
SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_PART = re.compile(r"[a-z]+")
CUES = ("comment", "reply", "respond", "disqus", "ad", "ads", "advert", "advertisement", "sponsor", "promo", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "widget", "footer", "foot", "header", "masthead", "cookie", "consent", "notice", "gdpr", "popup", "modal", "newsletter", "subscribe", "signup", "related", "recommended", "share", "social", "search", "login", "toolbar", "pagination", "pager", "tags", "legal", "copyright", "content", "article", "post", "entry", "story", "body", "main", "text")
_CUES = {c: c for c in CUES} | {c + "s": c for c in CUES if not c.endswith("s")}
TAGS = frozenset("nav header footer aside main article section form ul ol li table td th tr dl dd dt p h1 h2 h3 h4 h5 h6 blockquote pre div figure figcaption button select option label address details summary dialog menu center".split())


def _own(tag: str, attrs: str) -> frozenset[str]:
    """Features that an element gives to all blocks below it."""
    return _cached(tag, attrs) if len(attrs) <= 400 else _features(tag, attrs)  # long ones would fill the cache


def _features(tag: str, attrs: str) -> frozenset[str]:
    f = set()
    if tag in TAGS:
        f.add("in:" + tag)
    names = []
    seen = set()
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in seen:  # of attributes of one name the first counts
            continue
        seen.add(name)
        if "&" in value:
            value = entities.unescape(value)
        if name in ("class", "id", "role"):
            names.append(value)
        elif name == "hidden" or (name == "style" and _NONE.search(value)) or (name == "aria-hidden" and value.strip().lower() == "true"):
            f.add("hidden")
    for part in _PART.findall(" ".join(names).lower()):
        if part in _CUES:
            f.add("cue:" + _CUES[part])
    return frozenset(f)


_cached = lru_cache(maxsize=4096)(_features)


class Block:
    __slots__ = ("links", "nearest", "text", "up")

    def __init__(self, text: str, links: int, up: frozenset[str], nearest: str) -> None:
        self.text, self.links, self.up, self.nearest = text, links, up, nearest


def leaf_blocks(page: str) -> list[Block]:
    """The page's non-empty leaf blocks in order."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = [("", frozenset())]
    open_: dict[str, int] = {}
    parts: list[str] = []
    links = in_a = 0
    pos, size = 0, len(page)

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                near = next((t for t, _ in reversed(stack) if t and t not in INLINE), "")
                out.append(Block(text, links, stack[-1][1], near))
            parts.clear()
            links = 0

    def add(raw: str) -> None:
        nonlocal links
        if "&" in raw:
            raw = entities.unescape(raw)
        parts.append(raw)
        if in_a:
            links += len(raw)

    def pop_to(k: int) -> None:
        nonlocal in_a
        while len(stack) > k:
            t, _ = stack.pop()
            open_[t] -= 1
            in_a -= t == "a"

    def find(tags: tuple[str, ...], stop: tuple[str, ...]) -> int:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                return k
            if stack[k][0] in stop:
                return 0
        return 0

    for m in iter(lambda: _TAG.search(page, pos), None):
        if m.start() > pos:
            add(page[pos : m.start()])
        pos = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        elif tag == "br":
            add(" ")
        if m[1]:
            if open_.get(tag):
                k = find((tag,), ())
                pop_to(k)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, pos)
            pos = end.end() if end else size
            continue
        if tag == "body" and open_.get("head"):
            pop_to(find(("head",), ()))
        if tag in CLOSES_P and open_.get("p") and (k := find(("p",), ("table", "button"))):
            pop_to(k)
        if tag in SAME and open_.get(tag):
            like = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
            if k := find(like, SAME[tag]):
                pop_to(k)
        if tag in VOID or m[3].endswith("/"):
            continue
        own = _own(tag, m[3])
        top = stack[-1][1]
        stack.append((tag, top if own <= top else top | own))
        open_[tag] = open_.get(tag, 0) + 1
        in_a += tag == "a"
    if pos < size:
        add(page[pos:])
    flush()
    return [b for b in out if "hidden" not in b.up]


def block_features(b: Block) -> list[str]:
    """Ancestor features and those of the text."""
    n = b.text.count(" ") + 1
    f = ["bias", "own:" + b.nearest, "n" + ("1" if n == 1 else "2-4" if n < 5 else "5-9" if n < 10 else "10-24" if n < 25 else "25+")]
    share = b.links / len(b.text)
    f.append("links" + ("0" if not share else "<.3" if share < 0.3 else "<.8" if share < 0.8 else "1"))
    if b.text[-1] in ".!?\"'”’":
        f.append("stop")
    if "©" in b.text or "All rights" in b.text:
        f.append("rights")
    f += b.up
    return f


class Chain:
    """Two labels: 0 aside, 1 content."""

    def __init__(self) -> None:
        self.x: dict[str, np.ndarray] = {}
        self.tr = np.zeros((2, 2))

    def emit(self, feats: list[list[str]]) -> np.ndarray:
        zero = np.zeros(2)
        return np.array([sum((self.x.get(f, zero) for f in fs), zero) for fs in feats])

    def plain(self) -> tuple[dict[str, float], list[list[float]]]:
        """Content less aside by feature, and the transitions."""
        return {f: float(v[1] - v[0]) for f, v in self.x.items()}, self.tr.tolist()

    def learn(self, feats: list[list[str]], gold: list[int], rate: float) -> None:
        e = self.emit(feats)
        n = len(e)
        a, b = e.copy(), np.zeros_like(e)
        for i in range(1, n):
            a[i] += np.logaddexp.reduce(a[i - 1][:, None] + self.tr, axis=0)
        for i in range(n - 2, -1, -1):
            b[i] = np.logaddexp.reduce(self.tr + e[i + 1] + b[i + 1], axis=1)
        z = np.logaddexp.reduce(a[-1])
        p = np.exp(a + b - z)
        for i in range(n):
            g = -p[i]
            g[gold[i]] += 1
            for f in feats[i]:
                self.x[f] = 0.9995 * self.x.get(f, np.zeros(2)) + rate * g
        step = np.zeros((2, 2))
        for i in range(1, n):
            step -= np.exp(a[i - 1][:, None] + self.tr + e[i] + b[i] - z)
            step[gold[i - 1], gold[i]] += 1
        self.tr = 0.999 * self.tr + rate * step


def viterbi(feats: list[list[str]], x: dict[str, float], tr: list[list[float]]) -> list[int]:
    """The likeliest labels."""
    v0 = v1 = 0.0
    back = []
    get = x.get
    for i, fs in enumerate(feats):
        s = sum([get(f, 0.0) for f in fs])
        if i:
            a, b = v0 + tr[0][0], v1 + tr[1][0]
            c, d = v0 + tr[0][1], v1 + tr[1][1]
            back.append((int(b > a), int(d > c)))
            v0, v1 = max(a, b), max(c, d) + s
        else:
            v1 = s
    out = [int(v1 > v0)] if feats else []
    for choice in reversed(back):
        out.append(choice[out[-1]])
    return out[::-1]


def written_pages(n: int = 220, seed: int = 11) -> list[tuple[str, set[str]]]:
    """Pages in many layouts, and the texts of each that are content."""
    rng = random.Random(seed)
    serial = iter(range(10**9))

    def say(lo: int, hi: int, stop: bool = True) -> str:
        k = rng.randint(lo, hi)
        s = " ".join("".join(rng.choice(["ra", "te", "lo", "mi", "en", "sh", "or", "an", "di", "qu"]) for _ in range(rng.randint(1, 4))) for _ in range(k))
        return f"{s} w{next(serial)}" + ("." if stop else "")

    def links(k: int, tag: str) -> str:
        one = lambda: f'<a href="/x">{say(1, 2, False)}</a>'
        return "<ul>" + "".join(f"<li>{one()}</li>" for _ in range(k)) + "</ul>" if tag == "ul" else " | ".join(one() for _ in range(k))

    out = []
    for _ in range(n):
        gold: set[str] = set()

        def good(lo: int, hi: int, stop: bool = True) -> str:
            s = say(lo, hi, stop)
            gold.add(s)
            return s

        def box(tag: str, cue: str, inner: str) -> str:
            return f'<{tag} {rng.choice(["class", "id"])}="{cue}">{inner}</{tag}>' if cue else f"<{tag}>{inner}</{tag}>"

        def extra() -> str:
            k = rng.randrange(9)
            text = f"<p>{say(4, 30)}</p>" if rng.random() < 0.6 else say(3, 25)
            if k == 0:
                return box("div", rng.choice(["ad", "ads", "advert", "ad-box", "sponsor", "promo", "banner-ad"]), text)
            if k == 1:
                return box(rng.choice(["aside", "div"]), rng.choice(["sidebar", "widget", "related", "sidebar-right"]), f"<h3>{say(1, 3, False)}</h3>" + rng.choice([text, links(4, "ul")]))
            if k == 2:
                return f"<aside>{text}</aside>"
            if k == 3:
                return box("div", rng.choice(["cookie-notice", "notice", "consent", "gdpr-banner", "popup"]), text + f"<button>{say(1, 1, False)}</button>")
            if k == 4:
                return f"<form><label>{say(1, 3, False)}</label><p>{say(3, 9)}</p><button>{say(1, 1, False)}</button></form>"
            if k == 5:
                return box("div", rng.choice(["newsletter", "subscribe", "share", "social"]), text)
            if k == 6:
                return box("div", rng.choice(["breadcrumbs", "menu", "pagination", "tags"]), links(4, rng.choice(["ul", ""])))
            return box("nav", "", links(3, rng.choice(["ul", ""])))

        def comments() -> str:
            return box(rng.choice(["section", "div"]), rng.choice(["comments", "comment-list", "respond"]), "".join(box(rng.choice(["div", "article", "li"]), rng.choice(["comment", "reply", "comment-body"]), f"<p>{say(4, 30)}</p>") for _ in range(rng.randint(1, 4))))

        def paragraph() -> str:
            k = rng.random()
            if k < 0.7:
                return f"<p>{good(3, 60)}" + rng.choice(["</p>", "</p>", ""])
            if k < 0.76:
                return f"<h2>{good(1, 6, False)}</h2>"
            if k < 0.82:
                return "<ul>" + "".join(f"<li>{good(1, 20)}</li>" for _ in range(3)) + "</ul>"
            if k < 0.87:
                return f"<blockquote><p>{good(4, 30)}</p></blockquote>"
            if k < 0.9:
                return f"<pre>{good(3, 12, False)}</pre>"
            if k < 0.93:
                return f"<table><tr><td>{good(1, 5, False)}</td><td>{good(1, 5, False)}</td></tr></table>"
            return f"<p><b>{good(2, 30)}</b></p>"

        body = rng.choice([f"<h1>{good(2, 9, False)}</h1>", f"<header><h1>{good(2, 9, False)}</h1></header>", ""])
        for _ in range(rng.randint(1, 7)):
            body += paragraph()
            if rng.random() < 0.12:
                body += extra()
        if rng.random() < 0.2:
            body += comments()
        kind = rng.randrange(6)
        if kind < 2:
            body = f"<article>{body}</article>"
        elif kind == 2:
            body = f"<main>{body}</main>"
        elif kind == 3:
            body = f"<main><article>{body}</article></main>"
        else:
            body = box("div", rng.choice(["content", "post-content", "entry", "article-body", "story", "main-text", "post"]), body)
        before = rng.choice([f"<nav>{links(5, rng.choice(['ul', '']))}</nav>", f"<header><p>{say(1, 8, False)}</p><nav>{links(4, 'ul')}</nav></header>", box("div", rng.choice(["header", "masthead", "navbar"]), say(1, 6, False) + links(3, "ul")), ""])
        after = rng.choice([f"<footer>&copy; {say(1, 20)}</footer>", f"<footer><p>{say(2, 20)}</p>{links(3, '')}</footer>", box("div", rng.choice(["footer", "legal", "copyright"]), say(2, 20)), ""])
        more = [extra() for _ in range(rng.randrange(3))] + ([comments()] if rng.random() < 0.3 else [])
        rng.shuffle(more)
        cut = rng.randrange(len(more) + 1)
        out.append((f"<html><head><title>{say(2, 6)}</title></head><body>{before}{''.join(more[:cut])}{body}{''.join(more[cut:])}{after}</body></html>", gold))
    return out


@lru_cache(maxsize=1)
def trained() -> tuple[dict[str, float], list[list[float]]]:
    """The chain's weights, trained once a process; the same on every run."""
    chain, rows = Chain(), []
    for page, gold in written_pages():
        blocks = leaf_blocks(page)
        rows.append(([block_features(b) for b in blocks], [int(b.text in gold) for b in blocks]))
    for epoch in range(6):
        for feats, gold in rows:
            if feats:
                chain.learn(feats, gold, 0.15 / (1 + 0.4 * epoch))
    return chain.plain()


def main_text(page: str, x: dict[str, float], tr: list[list[float]]) -> str:
    """The page's content blocks, one to a line."""
    blocks = leaf_blocks(page)
    labels = viterbi([block_features(b) for b in blocks], x, tr)
    return "\n".join(b.text for b, y in zip(blocks, labels) if y)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(trained())  # about a hundred weights

    def run(batches: Iterable[pa.RecordBatch]):
        x, tr = shared.value
        for b in batches:
            texts = [main_text(p, x, tr) if p else "" for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    cols = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return cols.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_crf_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
