"""Personal data by patterns and a skip-chain conditional random field.

Four patterns give the base spans (see ``base_spans``). The nodes of a field with labels
none, email, ip, card and phone are tokens that look like data (an @ sign, or four digits
or more, or a digit group with a plus, dot or bracket) and words that stand as the local
part of an address elsewhere in the document ("ann.b at home" beside ann.b@home.org).
Neighbouring nodes share chain potentials. Nodes that are alike, however far apart, share
skip potentials: equal digits, the same last seven digits, equal addresses or equal local
parts; so a number written once as a phone number is one everywhere in the document.
Loopy sum-product message passing runs ``ROUNDS`` rounds over the whole document. Nodes
in base spans are clamped to them; any other node whose belief in a kind reaches
``BELIEF`` adds a span. Added spans never touch a base span, and base spans always stay.

Weights come from maximum pseudo-likelihood on the base labels of at most ``SAMPLE``
documents. A node outside base spans that is like one inside is unlabelled, not a
negative. Node features are blanked at random, once with the known label of a twin, so
that chain and skip evidence is weighed as well as form. Executors turn documents into
nodes; the driver sees how often each kind of node occurs. Each node is linked with the
next one of the same key, so edges are linear in tokens, however often a value repeats.

Cases: null and empty texts have no spans; a text is read whole whatever its length;
repeated rows give repeated results; an empty table gives an empty result; without
labelled nodes in the sample only base spans are found. Columns other than doc_id and
text are ignored by ``find``; ``redacted`` carries them.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purselake.llm.common import documents_only, keep_nothing, table

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 4000
ROUNDS = 12
BELIEF = 0.9
KINDS_OF_NODES = 20_000
NONE_WEIGHT = 0.3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NODE = re.compile(r"[^\s,;|\"'<>=]*[@0-9][^\s,;|\"'<>=]*")
_SPACE = re.compile(r"\s")
_WORD = re.compile(r"[A-Za-z0-9._%+-]{4,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of all base matches, by start and then kind.

    Per kind, matches are leftmost and do not overlap; those that fail the kind's
    test (octets, length and Luhn sum, number of digits) are dropped.
    """
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            last = m.end()
            out.append((start, last, 0))
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = digits_of(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((*m.span(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(digits_of(m[0])) <= 15:
                out.append((*m.span(), 3))
    return sorted(out, key=lambda x: (x[0], x[2]))


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def lowered(text: str) -> str:
    """A-Z as a-z; no other character changes, so places stay the same."""
    return text.translate(_LOWER)


def local_part(token: str) -> str:
    return lowered(token.rpartition("@")[0])


def nodes_of(text: str) -> list[tuple[int, int]]:
    """Spans of tokens that look like data, without edge punctuation, and of words that
    are the local part of one of them."""
    out = []
    for m in _NODE.finditer(text):
        token = m[0]
        a = len(token) - len(token.lstrip(".:!?*%&$#"))
        b = len(token.rstrip(".:!?*%&$#"))
        if a >= b:
            continue
        inner = token[a:b]
        if "@" in inner or sum("0" <= c <= "9" for c in inner) >= 4 or inner[0] in "+(":
            out.append((m.start() + a, m.start() + b))
    locals_ = {local_part(text[a:b]) for a, b in out if "@" in text[a:b]}
    if any(len(x) >= 4 for x in locals_):
        low, taken, at = lowered(text), out, 0
        words = []
        for m in _WORD.finditer(low):
            if m[0].rstrip(".-") not in locals_ and m[0] not in locals_:
                continue
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            end = m.end() if m[0] in locals_ else m.start() + len(m[0].rstrip(".-"))
            if at == len(taken) or taken[at][0] >= end:
                words.append((m.start(), end))
        out = sorted(out + words)
    return out


FEATURES = 28


def features(text: str, span: tuple[int, int]) -> list[int]:
    """Indexes of the node's binary features."""
    token = text[span[0] : span[1]]
    d = digits_of(token)
    before = text[max(0, span[0] - 2) : span[0]]
    found = [0]
    if "@" in token:
        found.append(1)
        found.append(2 if "." in token.rpartition("@")[2] else 3)
    found.append(4 + min(len(d) // 2, 9))  # 4..13
    found.append(14 + min(token.count("."), 4))  # 14..18
    if token[0] == "+":
        found.append(19)
    if "(" in token or ")" in token:
        found.append(20)
    if "-" in token:
        found.append(21)
    if len(d) == len(token):
        found.append(22)
    if 14 <= len(d) <= 19:
        found.append(23 if luhn(d) else 24)
    if any(c.isalpha() for c in token):
        found.append(25)
    if before.endswith(")") or before.endswith(") "):
        found.append(26)
    if d and token.count(".") == 3 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in token.split(".") if p.isascii()):
        found.append(27)
    return found


def keys_of(token: str) -> list[str]:
    """What tokens have in common that are alike: digits or their last seven, an address
    or its local part."""
    if "@" in token:
        return [x for x in (lowered(token), local_part(token)) if len(x) >= 4]
    d = digits_of(token)
    out = [d[-7:]] if len(d) >= 4 else []
    return out + [lowered(token)] if any(c.isalpha() for c in token) else out


def edges_of(text: str, nodes: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(chain edges, skip edges)."""
    chain = [(i, i + 1) for i in range(len(nodes) - 1) if nodes[i + 1][0] - nodes[i][1] <= 3 and len(_SPACE.findall(text[nodes[i][1] : nodes[i + 1][0]])) <= 1]
    skip, seen = [], {}
    for i, (a, b) in enumerate(nodes):
        for key in keys_of(text[a:b]):
            if key in seen and (not skip or skip[-1] != (seen[key], i)):
                skip.append((seen[key], i))
            seen[key] = i
    return chain, skip


class Field:
    """Weights of the field: unary (feature, label), chain (label, label), skip (label, label)."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    def beliefs(self, found: list[list[int]], chain, skip, clamped: dict[int, int]) -> np.ndarray:
        """Marginals of every node after loopy message passing."""
        n, k = len(found), self.unary.shape[1]
        local = np.array([self.unary[f].sum(axis=0) for f in found])
        for i, label in clamped.items():
            local[i] = -30.0
            local[i, label] = 30.0
        edges = np.array([*chain, *skip], dtype=np.int64).reshape(-1, 2)
        if len(edges):
            pots = np.concatenate([np.broadcast_to(self.chain, (len(chain), k, k)), np.broadcast_to(self.skip, (len(skip), k, k))])
            source = np.concatenate([edges[:, 0], edges[:, 1]])
            target = np.concatenate([edges[:, 1], edges[:, 0]])
            pots = np.concatenate([pots, pots.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
            messages = np.zeros((len(source), k))
            for _ in range(ROUNDS):
                total = local.copy()
                np.add.at(total, target, messages)
                sent = (total[source] - messages[back])[:, :, None] + pots
                top = sent.max(axis=1, keepdims=True)
                new = (top + np.log(np.exp(sent - top).sum(axis=1, keepdims=True)))[:, 0]
                new -= new.max(axis=1, keepdims=True)
                if np.abs(new - messages).max() < 1e-4:
                    messages = new
                    break
                messages = 0.5 * messages + 0.5 * new
            np.add.at(local, target, messages)
        p = np.exp(local - local.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def clamped_labels(nodes, base) -> dict[int, int]:
    """Label of each node that touches a base span."""
    out, b = {}, 0
    for i, (start, end) in enumerate(nodes):
        while b < len(base) and base[b][1] <= start:
            b += 1
        for s, e, kind in base[b:]:
            if s >= end:
                break
            if e > start:
                out[i] = kind + 1
                break
    return out


def node_rows(text: str) -> list[tuple[list[int], list[int], int]]:
    """(features, labels around, label) of a document's nodes for training: labels around
    are the left neighbour's, the right neighbour's and the twins', -1 for none."""
    nodes = nodes_of(text)
    if not nodes:
        return []
    given = clamped_labels(nodes, base_spans(text))
    y = [given.get(i, 0) for i in range(len(nodes))]
    chain, skip = edges_of(text, nodes)
    around = [[-1, -1, -1] for _ in nodes]
    for a, b in chain:
        around[b][0], around[a][1] = y[a], y[b]
    for a, b in skip:
        around[b][2] = max(around[b][2], y[a])
        around[a][2] = max(around[a][2], y[b])
    out = [(features(text, span), around[i], y[i]) for i, span in enumerate(nodes) if y[i] or around[i][2] <= 0]
    # The first plain word stands for those that are no nodes: form alone makes no data of one.
    plain = next((m.span() for m in _WORD.finditer(text) if m[0].isalpha() and m.span() not in nodes), None)
    return [*out, (features(text, plain), [-1, -1, -1], 0)] if plain else out


def train(counted: list[tuple[list[int], list[int], int, int]], steps: int = 300, blanks: int = 3) -> Field | None:
    """Maximum pseudo-likelihood on (features, labels around, label, number of such nodes)."""
    k = len(KINDS) + 1
    rows, labels, numbers = [], [], []
    rng = np.random.default_rng(11)
    for found, around, label, n in counted:
        x, near, repeat = np.zeros(FEATURES), np.zeros(3 * k), np.zeros(3 * k)
        x[found] = 1
        for place, other in enumerate(around):
            if other >= 0:
                near[place * k + other] = 1
        repeat[2 * k + label] = 1  # a repeat of the node: its form is blurred, its twin's label known
        n = n * (1 if label else NONE_WEIGHT)
        blank = [x * np.concatenate([[1], rng.random(FEATURES - 1) < 0.5]) for _ in range(blanks)]
        for copy, given, share in ((x, near, 1), *((c, near, 1 / blanks) for c in blank), *((c, repeat, 1 / blanks) for c in blank), (x * 0, repeat, 1)):
            rows.append(np.concatenate([copy, given]))
            labels.append(label)
            numbers.append(n * share)
    if not rows or max(labels) == 0:
        return None
    x, y = np.array(rows), np.eye(k)[labels]
    numbers = np.array(numbers)
    row_weight = numbers * (y @ (1 / np.sqrt((y * numbers[:, None]).sum(axis=0) + 1)))
    row_weight = (row_weight / row_weight.sum())[:, None]
    w, speed = np.zeros((x.shape[1], k)), np.zeros((x.shape[1], k))
    for _ in range(steps):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        gradient = x.T @ (row_weight * (p - y)) + 2e-4 * w
        speed = 0.9 * speed - 2.0 * gradient
        w = w + speed
    chain = (w[FEATURES : FEATURES + k] + w[FEATURES + k : FEATURES + 2 * k].T) / 2
    skip = w[FEATURES + 2 * k :]
    return Field(w[:FEATURES], chain, (skip + skip.T) / 2)


def all_spans(text: str, field: Field | None) -> tuple[list, list]:
    """(base spans, base and added spans), each by start and then kind."""
    base = base_spans(text)
    if field is None:
        return base, base
    nodes = nodes_of(text)
    if not nodes:
        return base, base
    given = clamped_labels(nodes, base)
    if len(given) == len(nodes):
        return base, base
    chain, skip = edges_of(text, nodes)
    beliefs = field.beliefs([features(text, s) for s in nodes], chain, skip, given)
    added = [(*nodes[i], int(beliefs[i].argmax()) - 1) for i in range(len(nodes)) if i not in given and beliefs[i].argmax() and beliefs[i].max() >= BELIEF]
    return base, sorted(base + added, key=lambda x: (x[0], x[2])) if added else base


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def training_nodes(docs: DataFrame, limit: int = SAMPLE) -> list[tuple[list[int], list[int], int, int]]:
    """Nodes of at most ``limit`` documents that hold a digit or an @ sign, taken by hash:
    the ``KINDS_OF_NODES`` most frequent kinds and how often each occurs."""
    rows = documents_only(docs).filter(F.col("text").rlike("[0-9@]")).select("text", F.xxhash64("text", "doc_id").alias("h"))
    total = rows.count()
    if total > 2 * limit:
        rows = rows.filter(F.pmod("h", F.lit(total)) < 2 * limit)

    def nodes(frames):
        keep_nothing()
        for frame in frames:
            yield pd.DataFrame([r for text in frame["text"] for r in node_rows(text)], columns=["found", "around", "label"])

    columns = ["found", "around", "label"]
    found = rows.orderBy("h", "text").limit(limit).select("text").mapInPandas(nodes, "found array<int>, around array<int>, label int")
    counts = found.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), *columns).limit(KINDS_OF_NODES)
    return [(list(r.found), list(r.around), r.label, r.n) for r in counts.collect()]


def fitted(docs: DataFrame, limit: int = SAMPLE) -> Field | None:
    return train(training_nodes(docs, limit))


def find(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def scan(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            base, spans = all_spans(text, shared.value)
            counts = [0, 0, 0, 0]
            for x in base:
                counts[x[2]] += 1
            out.append((*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
        return pd.DataFrame(out, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return documents_only(docs).select("doc_id", scan("text").alias("f")).select("doc_id", "f.*")


def redacted(docs: DataFrame, field: Field | None) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans
    are replaced as one, by the first's kind. ``n_chars``, if present, follows the text."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def redact(text):
        if not text:
            return text
        out, at, last = [], 0, -1
        for a, b, kind in all_spans(text, shared.value)[1]:
            if a >= last:
                out += [text[at:a], f"<{KINDS[kind].upper()}>"]
            at = last = max(last, b)
        return "".join([*out, text[at:]])

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        keep_nothing()
        return texts.map(redact, na_action="ignore")

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op3_pii(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, fitted(docs))
