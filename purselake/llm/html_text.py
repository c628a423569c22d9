"""Main text of web pages by a maximum-scoring subsequence.

A page becomes a sequence of words and tags, each with a score; one linear scan finds
the contiguous region of the highest sum, whose words are the text. Weights are learned
from labelled pages, those that mark their article (``<article>`` or ``<main>``), at
most ``SAMPLE`` of them:

* A word stands in a chain of open elements. Each name, class, id and role of the chain
  (but for the marks themselves) has a weight, fitted by logistic regression on the
  labelled words; a word's score is their sum, which is positive for words like those of
  articles and negative for words like those of menus, links, adverts and footers.
  Regression shrinks towards ``prior_weight``, which stands in for names that labelled
  pages do not show.
* A tag's score is negative: ``TAG_COST``, and more the more often the labelled pages
  show the tag outside their articles.

Words of a negative score inside the region (an advert in an article) are left out; a
run of them between two tags scores once, ``RUN_COST`` of a word, so that a long advert
does not part an article.

Character references are decoded; white space inside a block becomes one space;
blocks are joined by one newline. Cases: null or empty html, and pages without words of
positive score, give the empty text; unclosed tags, comments and scripts end with the
page; a ``<`` that starts no tag is text; a page is read whole whatever its length, in
time linear in it, however deep its elements nest; repeated rows give repeated results;
an empty table gives an empty result; further columns are ignored. If no labelled page
exists, ``prior_weight`` gives all weights.
"""

from __future__ import annotations

import html
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purselake.llm.common import table

SAMPLE = 1000
FIT_CHAIN = 64
RIDGE, STEPS = 3e-3, 400
TAG_COST, OUTSIDE_COST = -0.02, -0.05
TOP = 3.0
RUN_COST = 0.25

# Element names.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
SELDOM_MAIN = frozenset("nav header footer aside form svg button select option label dialog menu head object canvas figcaption".split())
SELDOM_MAIN_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog status".split())
SELDOM_MAIN_NAMES = re.compile(
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar\w*|nav\w*|menu\w*|breadcrumb\w*|footer|masthead|header|notices?|cookie\w*|consent|popup|modal|"
    r"comments?|discussion|replies|respond|related|shar(?:e|ing)|social|subscribe|newsletter|widget\w*|toolbar|pagination|pager|hidden)"
)
MARKS = ("article", "main")


def prior_weight(key: str) -> float:
    """Weight of an element name, ``.class``, ``#id``, ``@role`` or ``?hidden`` before
    any page is seen; ``*`` is every word's."""
    if key == "*":
        return 1.0
    if key[0] in ".#":
        return -6.0 if any(SELDOM_MAIN_NAMES.fullmatch(part) for part in re.split(r"[\s_-]+", key[1:])) else 0.0
    if key[0] == "@":
        return -6.0 if key[1:] in SELDOM_MAIN_ROLES else 0.0
    if key == "?hidden" or key in SELDOM_MAIN:
        return -6.0
    return -0.7 if key == "a" else 0.0


_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"""(?is)\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")


def keys_of(name: str, attributes: str) -> list[str]:
    """What an element's opening tag says of it."""
    if name in MARKS:
        return []
    out = [name]
    for key, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "class":
            out += [f".{c}" for c in value.split()]
        elif key in ("id", "role") and value:
            out.append(("#" if key == "id" else "@") + value)
        elif key == "hidden" or value == "true":
            out.append("?hidden")
    return out


class Open:
    """An open element: the keys that it adds to those of the elements around it, and the
    running sum of the keys' weights once that is asked for."""

    __slots__ = ("outer", "keys", "total", "chain")

    def __init__(self, outer: Open | None, keys: tuple[str, ...]):
        self.outer, self.keys, self.total = outer, keys, None
        before = outer.chain if outer else ()
        #: All keys, outermost first, for the fit; None for more than ``FIT_CHAIN``.
        self.chain = None if before is None or len(before) + len(keys) > FIT_CHAIN else before + keys if keys else before


def tokens(page: str):
    """(kind, value, open element, in_article) of a page in order; kind is 'tag', 'break' (a
    block boundary) or 'text' (a decoded run of text). The keys of all open elements count,
    each once."""
    names: list[str] = []
    chains: list[Open] = [Open(None, ())]
    held: dict[str, int] = {}
    blocks: list[int] = []  # places of the open block elements
    count: dict[str, int] = {}
    at, end = 0, len(page)

    def close_to(depth: int) -> None:
        while len(names) > depth:
            count[names.pop()] -= 1
            for k in chains.pop().keys:
                held[k] -= 1
        while blocks and blocks[-1] >= depth:
            blocks.pop()

    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2] or m[5]
        inside = count.get("article", 0) + count.get("main", 0) > 0
        if name is None:
            run = m[0]
            if not run.startswith(("<!", "<?")):
                yield "text", html.unescape(run), chains[-1], inside
            continue
        name, closing = name.lower(), bool(m[1] or m[4])
        kind = "break" if name in BLOCKS else "tag"
        if closing:
            if count.get(name):
                depth = len(names) - 1
                while names[depth] != name:
                    depth -= 1
                close_to(depth)
            yield kind, name, chains[-1], inside
            continue
        if name in BLOCKS and name != "br" and blocks and names[blocks[-1]] == "p":
            close_to(blocks[-1])  # a new block ends an open paragraph and what is open in it
        attributes = m[3] if m[2] else m[6]
        yield kind, name, chains[-1], inside
        if name in VOID or attributes.rstrip().endswith("/"):
            continue
        if name in RAW:
            stop = re.compile(rf"(?i)</{name}\b[^>]*>").search(page, at)
            at = stop.end() if stop else end
            continue
        if name in BLOCKS:
            blocks.append(len(names))
        names.append(name)
        count[name] = count.get(name, 0) + 1
        fresh = tuple(k for k in dict.fromkeys(keys_of(name, attributes)) if not held.get(k))
        for k in fresh:
            held[k] = 1
        chains.append(Open(chains[-1], fresh))


class Weights:
    """Scores of words by chain and of tags by name."""

    def __init__(self, words: dict[str, float], tags: dict[str, float]):
        self.words, self.tags = words, tags

    def word(self, at: Open) -> float:
        """The weights of ``*`` and of all keys around a word, within bounds."""
        unknown = []
        while at is not None and at.total is None:
            unknown.append(at)
            at = at.outer
        total = at.total if at is not None else self.words.get("*", prior_weight("*"))
        for element in reversed(unknown):
            for k in element.keys:
                total += self.words.get(k, prior_weight(k))
            element.total = total
        return max(-TOP, min(TOP, total))

    def tag(self, name: str) -> float:
        return self.tags.get(name, TAG_COST)


def fitted_weights(words: list[tuple[tuple[str, ...], bool, int]], tags: list[tuple[str, bool, int]]) -> Weights:
    """Weights from (chain, in the article, number of words) and (tag, in the article, number)."""
    total = sum(n for *_, n in words)
    if not total or len({inside for _, inside, _ in words}) < 2:
        return Weights({}, {})
    keys = sorted({k for chain, _, _ in words for k in chain} | {"*"})
    place = {k: i for i, k in enumerate(keys)}
    rows = [np.array([place[k] for k in ("*", *chain)]) for chain, _, _ in words]
    owner, columns = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
    y, n = np.array([float(inside) for _, inside, _ in words]), np.array([m for *_, m in words]) / total
    prior = np.array([prior_weight(k) for k in keys])
    w, speed = prior.copy(), np.zeros(len(keys))
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[columns], minlength=len(rows)), -30, 30)))
        gradient = np.bincount(columns, (n * (p - y))[owner], minlength=len(keys)) + RIDGE * (w - prior)
        speed = 0.9 * speed - gradient
        w = w + speed
    shown: dict[str, list[int]] = {}
    for name, inside, m in tags:
        shown.setdefault(name, [0, 0])[inside] += m
    costs = {name: TAG_COST + OUTSIDE_COST * math.log1p(out / (own + 1)) for name, (out, own) in shown.items()}
    return Weights(dict(zip(keys, w.tolist())), costs)


def page_counts(page: str) -> list[tuple[str, list[str], bool, int]]:
    """('word' or tag name, chain, in the article, number) of one page. Words under more than
    ``FIT_CHAIN`` keys are left out of the fit (not out of extraction)."""
    found: dict[tuple, int] = {}
    for kind, value, at, inside in tokens(page):
        if kind == "text" and at.chain is None:
            continue
        key, n = (("word", at.chain, inside), len(value.split())) if kind == "text" else ((f"<{value}", (), inside), 1)
        if n and value not in MARKS:
            found[key] = found.get(key, 0) + n
    return [(kind, list(chain), inside, n) for (kind, chain, inside), n in found.items()]


def main_text(page: str | None, weights: Weights) -> str:
    if not page:
        return ""
    sequence: list[tuple[float, str | None]] = []
    for kind, value, at, _ in tokens(page):
        if kind == "text":
            score, n = weights.word(at), len(value.split())
            sequence.append((score * n, value) if score > 0 else (RUN_COST * score * min(n, 1), None))
        else:
            sequence.append((weights.tag(value), "\n" if kind == "break" else None))
    # The best contiguous region, by one scan over running sums.
    best, best_at, running, start = 0.0, (0, 0), 0.0, 0
    for i, (s, _) in enumerate(sequence):
        if running <= 0:
            running, start = 0.0, i
        running += s
        if running > best:
            best, best_at = running, (start, i + 1)
    parts, out = [], []
    for _, value in [*sequence[best_at[0] : best_at[1]], (0.0, "\n")]:
        if value == "\n":
            if parts:
                out.append(" ".join("".join(parts).split()))
                parts = []
        elif value is not None:
            parts.append(value)
    return "\n".join(b for b in out if b)


def learned_weights(pages: DataFrame, limit: int = SAMPLE) -> Weights:
    """Weights from at most ``limit`` labelled pages, taken by hash. Executors count; the
    driver sees sums by distinct chain."""
    marked = pages.filter(F.lower("html").rlike("<(article|main)[ >]")).select("html", F.xxhash64("html").alias("h"))
    total = marked.count()
    if total > 2 * limit:
        marked = marked.filter(F.pmod("h", F.lit(total)) < 2 * limit)

    def count(frames):
        for frame in frames:
            yield pd.DataFrame([c for page in frame["html"] for c in page_counts(page)], columns=["kind", "chain", "inside", "n"])

    counts = marked.orderBy("h", "html").limit(limit).select("html").mapInPandas(count, "kind string, chain array<string>, inside boolean, n long")
    rows = counts.groupBy("kind", "chain", "inside").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("pages")).orderBy(F.col("pages").desc(), "kind", "chain", "inside").limit(20_000).collect()
    words = [(tuple(r.chain), r.inside, r.n) for r in rows if r.kind == "word"]
    return fitted_weights(words, [(r.kind[1:], r.inside, r.n) for r in rows if r.kind != "word"])


def extract(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    @F.pandas_udf("string")
    def text_of(pages_: pd.Series) -> pd.Series:
        return pages_.map(lambda p: main_text(p, weights) if isinstance(p, str) else "")

    texts = pages.select("page_id", "url", text_of(F.coalesce(F.col("html"), F.lit(""))).alias("text"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, learned_weights(pages))
