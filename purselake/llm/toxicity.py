"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

Kernel: a text is a bag of windows, stretches of at most ``WIDTH`` characters of its
words. Two windows share every subsequence of three characters; a shared one counts
``DECAY`` to the power of the stretch it spans in either window, over at most ``SPAN``
characters. The sum is divided by both windows' norms and raised to ``POWER``, and two
texts' kernel is the mean over their pairs of windows. Gaps and inserted characters
only lower a value; runs of single characters ("i d i o t", "i.d.i.o.t") also count
joined.

Training, on at most ``SAMPLE`` labelled documents (of near copies, one):

1. Landmarks are windows of the sample, ``PER_ROUND`` a round: those unlike the ones so
   far whose triples are most over-represented in toxic documents or, every other round,
   in those that the landmarks so far leave unexplained.
2. Labelled sentences (a document's label is its sentences') are mapped to the Nystroem
   space of the landmarks, where a linear SVM (squared hinge) is fitted.
3. A document's own SVM reads the kernel means of its whole text with the landmarks,
   the worst sentence's margin and the share of sentences of positive margin (margins of
   machines that did not see the document). A logistic curve turns its margins, again
   of machines that did not see the document, into scores.

Scoring: windows recur more than words, so workers keep each window's kernels with the
landmarks (of at most ``CACHE_WINDOWS``, and what one stretch adds) and each word's windows
(of ``CACHE_WORDS``); a document's means are sums over its distinct windows.

Cases: null or empty text has no windows and scores as such a text does; words of any
length are read in overlapping windows, so nothing is cut off; very long texts are read
in stretches of bounded memory; repeated rows get equal results; an empty table gives an
empty result; with no positive or no negative label every score is the share of toxic
labels. Only the text enters a score; further columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purselake.llm.common import crc_mod, documents_only, kept, table
from purselake.llm.wordbpe import batches, gather

SAMPLE = 3000
ROUNDS, PER_ROUND, DIVERSITY = 12, 8, 0.5
DECAY, SPAN, POWER = 0.8, 6, 4
WIDTH, STEP = 7, 2
SENTENCE_WORDS = 20
FOLDS = 5
CACHE_WORDS, CACHE_WINDOWS = 200_000, 200_000
STRETCH = 50_000
PART = 10_000
BATCH_CHARS = 500_000
CODES = 64
RATE = 300.0
DOCUMENT_COST, SENTENCE_COST = 0.02, 10.0
_RUNS = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")
_DOTTED = re.compile(r"\b(?:\w[^\w\s]){2,}\w\b")
_A_RUN = re.compile(r"\s\S\s+\S\s+\S(?!\S)")  # finds in " " + text what _RUNS finds, faster
_A_DOT = re.compile(r"[^\w\s]\w[^\w\s]\w")  # in every match of _DOTTED
_INSIDE = re.compile(r"[^\w]")
_SENTENCE = re.compile(r"[.!?]+\s+|\n+")
_EDGES = ".,;:!?\"'()[]{}|*%&$#"

_TRIPLES = [(i, j, k) for i in range(WIDTH) for k in range(i + 2, min(i + SPAN, WIDTH)) for j in range(i + 1, k)]
_I, _J, _K = (np.array(x) for x in zip(*_TRIPLES))
_WEIGHT = (DECAY ** (_K - _I + 1.0)).astype(np.float32)


def sentences_of(text: str) -> list[list[str]]:
    """Lower-case words of each sentence; sentences of over ``SENTENCE_WORDS`` words come
    in stretches of so many."""
    low = text.lower()
    odd = bool(_A_RUN.search(" " + low) or _A_DOT.search(low) and _DOTTED.search(low))
    out = []
    for sentence in _SENTENCE.split(low):
        words = sentence.split()
        if odd:
            words += ["".join(run.split()) for run in _RUNS.findall(sentence)]
            words += [_INSIDE.sub("", run) for run in _DOTTED.findall(sentence)]
        if len(words) <= SENTENCE_WORDS:
            if words:
                out.append(words)
        else:
            out += [words[i : i + SENTENCE_WORDS] for i in range(0, len(words), SENTENCE_WORDS)]
    return out


def windows_of(word: str) -> list[str]:
    """Windows of a word without its edge punctuation; none of punctuation alone."""
    word = word.strip(_EDGES)
    return [word[i : i + WIDTH] for i in range(0, max(len(word) - WIDTH + STEP, 1), STEP)] if word else []


def encode_windows(windows: list[str]) -> np.ndarray:
    """Codes of each window's characters, padded with 0."""
    points = np.array([w.ljust(WIDTH, "\0") for w in windows], dtype=f"<U{WIDTH}").view("<u4").reshape(len(windows), WIDTH)
    letter, digit = (points >= 97) & (points <= 122), (points >= 48) & (points <= 57)
    other = np.where(points < 128, CODES - 1, 37 + points % 26)
    return np.where(letter, points - 96, np.where(digit, points - 21, np.where(points == 0, 0, other))).astype(np.int32)


def norms(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Norm of each window by the triples of its places and their weights."""
    order = np.argsort(keys, axis=1, kind="stable")
    sorted_keys, running = np.take_along_axis(keys, order, 1), np.cumsum(np.take_along_axis(weights, order, 1), axis=1)
    last = np.ones(keys.shape, dtype=bool)
    last[:, :-1] = sorted_keys[:, 1:] != sorted_keys[:, :-1]
    row, place = np.nonzero(last)
    ends = running[row, place]
    before = np.concatenate([[0], ends[:-1]]) * np.concatenate([[False], row[1:] == row[:-1]])[: len(row)]
    norm = np.sqrt(np.bincount(row, (ends - before) ** 2, minlength=len(keys)))
    return np.maximum(norm, DECAY**3)


def triple_features(codes: np.ndarray, norm: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(triple of each place, its weight over the window's norm; 0 at padding)."""
    codes = codes.astype(np.int32, copy=False)
    keys = (codes[:, _I] * CODES + codes[:, _J]) * CODES + codes[:, _K]
    weights = np.where(codes[:, _K] > 0, _WEIGHT, np.float32(0))
    if norm is None:
        norm = norms(keys, weights)
    return keys, (weights / norm[:, None]).astype(np.float32)


class Sample:
    """The sentences of the training documents. Of a distinct window only codes and norm are
    kept and its triples made anew, and of a place its window: what is built on the way
    covers ``PART`` windows, or one document, at a time."""

    def __init__(self, texts: list[str]):
        vocabulary: dict[str, int] = {}
        windows, size, owner = array("i"), array("i"), array("i")
        for n, text in enumerate(texts):
            for words in sentences_of(text):
                known = len(windows)
                windows.extend(vocabulary.setdefault(u, len(vocabulary)) for w in words for u in windows_of(w))
                size.append(len(windows) - known)
                owner.append(n)
        self.n_docs = len(texts)
        self.windows, self.size, self.owner = (np.array(x, dtype=np.int32) for x in (windows, size, owner))
        self.names = list(vocabulary)
        self.codes, self.norm = np.empty((len(self.names), WIDTH), dtype=np.uint8), np.empty(len(self.names))
        for rows in self.slices():
            self.codes[rows] = encode_windows(self.names[rows])
            self.norm[rows] = norms(*triple_features(self.codes[rows], np.ones(1)))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.owner, minlength=self.n_docs))])
        self.start = np.concatenate([[0], np.cumsum(self.size, dtype=np.int64)])

    def slices(self) -> list[slice]:
        return [slice(at, at + PART) for at in range(0, len(self.names), PART)]

    def triples(self, rows) -> tuple[np.ndarray, np.ndarray]:
        return triple_features(self.codes[rows], self.norm[rows])

    def documents(self):
        """(documents, their sentences, windows of their places, sentence of each place and
        document of each place, both from 0) of each part."""
        before = self.start[self.first[:-1]] // PART
        edges = [*np.flatnonzero(np.diff(before, prepend=-1)), self.n_docs]
        for at, end in zip(edges, edges[1:]):
            own = slice(self.first[at], self.first[end])
            sentence = np.repeat(np.arange(own.stop - own.start), self.size[own])
            yield slice(at, end), own, self.windows[self.start[own.start] : self.start[own.stop]], sentence, self.owner[own][sentence] - at

    def length(self) -> np.ndarray:
        """Number of windows of each document."""
        return np.diff(self.start[self.first])

    def by_window(self, weight: np.ndarray) -> np.ndarray:
        """Sum of a weight of documents over each window's places."""
        out = np.zeros(len(self.names))
        for documents, _, windows, _, document in self.documents():
            np.add.at(out, windows.astype(np.intp), weight[documents][document])
        return out

    def by_triple(self, weight: np.ndarray) -> np.ndarray:
        """Sum of a weight of windows over each triple's places."""
        out = np.zeros(CODES**3)
        for rows in self.slices():
            keys, own = self.triples(rows)
            np.add.at(out, keys.ravel().astype(np.intp), (own * weight[rows, None]).ravel())
        return out

    def pulls(self, by_triple: np.ndarray) -> np.ndarray:
        """Sum of a weight of triples over each window's places."""
        out = np.empty(len(self.names), dtype=np.float32)
        for rows in self.slices():
            keys, own = self.triples(rows)
            out[rows] = (by_triple[keys] * own).sum(axis=1)
        return out

    def kernel_sums(self, landmarks: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the kernels with landmarks over each sentence's and each document's windows."""
        kernel = Kernel([self.names[i] for i in landmarks])
        values = np.empty((len(self.names), len(landmarks)), dtype=np.float32)
        for rows in self.slices():
            values[rows] = kernel.of(*self.triples(rows))
        sentences, documents = (np.empty((n, len(landmarks)), dtype=np.float32) for n in (len(self.owner), self.n_docs))
        for some, own, windows, sentence, document in self.documents():
            for z in range(len(landmarks)):
                value = values[windows, z]
                sentences[own, z] = np.bincount(sentence, value, minlength=own.stop - own.start)
                documents[some, z] = np.bincount(document, value, minlength=some.stop - some.start)
        return sentences, documents


class Kernel:
    """Kernels of windows with a list of landmark windows."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        keys, weights = triple_features(encode_windows(landmarks))
        used = np.unique(keys[weights > 0])
        self.column = np.zeros(CODES**3, dtype=np.int32)  # 0: no landmark has the triple
        self.column[used] = np.arange(1, len(used) + 1)
        self.table = np.zeros((len(used) + 1, len(landmarks)), dtype=np.float32)
        for z in range(len(landmarks)):
            np.add.at(self.table[:, z], self.column[keys[z]], weights[z])
        self.table[0] = 0

    def of(self, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        out = np.zeros((len(keys), len(self.landmarks)), dtype=np.float32)
        for at in range(0, len(keys), 2000):
            column, own, part = self.column[keys[at : at + 2000]], weights[at : at + 2000], out[at : at + 2000]
            for place in range(keys.shape[1]):
                rows = np.flatnonzero((column[:, place] > 0) & (own[:, place] > 0))
                part[rows] += self.table[column[rows, place]] * own[rows, place, None]
        return out**POWER


def linear_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, seen: np.ndarray | None = None, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Squared-hinge SVM (y is -1 or 1) on the ``seen`` rows, by Newton steps on those inside the margin."""
    n = x.shape[1]
    w, ridge = np.zeros(n + 1), np.r_[np.ones(n), 1e-6]
    rows = np.arange(len(x)) if seen is None else np.flatnonzero(seen)
    for _ in range(rounds):
        gram, pull = np.diag(ridge), np.zeros(n + 1)
        for at in range(0, len(rows), 8192):
            own = rows[at : at + 8192]
            some = np.c_[x[own].astype(float), np.ones(len(own))]
            inside = y[own] * (some @ w) < 1
            some, c = some[inside], cost[own][inside]
            gram += (some * c[:, None]).T @ some
            pull += some.T @ (c * y[own][inside])
        new = np.linalg.solve(gram, pull)
        if np.abs(new - w).max() < 1e-5:
            break
        w = new
    return w[:-1], float(w[-1])


def margins(x: np.ndarray, rows: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(x[rows[at : at + 8192]] @ w + bias for at in range(0, len(rows), 8192))])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: float, rounds: int = 40) -> np.ndarray:
    """Weights (the last is the constant) of a ridge logistic fit."""
    x = np.c_[x, np.ones(len(x))]
    w, ridge = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, weight), 1e-6]
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Machine:
    """``sentence`` maps a window's kernels to its part of a sentence's margin; a
    document's features are centred, scaled and weighed by ``weights``."""

    kernel: Kernel | None
    sentence: np.ndarray
    sentence_bias: float
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    prior: float

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.kernel is None:
            return np.full(len(features), self.prior)
        margin = (features - self.centre) / self.scale @ self.weights + self.bias
        return sigmoid(self.slope * margin + self.shift)


def nothing(prior: float) -> Machine:
    one = np.ones(0)
    return Machine(None, one, 0.0, one, one, one, 0.0, 0.0, 0.0, prior)


def document_features(means: np.ndarray, worst: np.ndarray, share: np.ndarray) -> np.ndarray:
    return np.c_[np.log1p(RATE * means), worst, share]


def sentence_statistics(margin: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(worst margin, share of positive margins) of each document's sentences."""
    worst = np.full(n, -2.0)
    np.maximum.at(worst, owner, np.clip(margin, -2, 5))
    share = np.bincount(owner, margin > 0, minlength=n) / np.maximum(np.bincount(owner, minlength=n), 1)
    return worst, share


def distinct_documents(texts: list[str], labels: list[int]) -> list[int]:
    """Places of the documents of which no earlier one is a near copy: two of the three
    least hashes of their word triples are equal."""
    odd = [np.uint64(x) for x in (2654435761, 2246822519, 3266489917)]
    seen: set[tuple] = set()
    out = []
    for n, (text, y) in enumerate(zip(texts, labels)):
        words = text.lower().split()
        grams = {" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))}
        hashes = np.array([zlib.crc32(g.encode()) for g in grams], dtype=np.uint64)
        a, b, c = (int(((hashes * o) & np.uint64(0xFFFFFFFF)).min()) for o in odd)
        pairs = {(y, 0, a, b), (y, 1, a, c), (y, 2, b, c)}
        if not pairs & seen:
            out.append(n)
        seen |= pairs
    return out


def train(texts: list[str], toxic: list[int]) -> Machine:
    """Fit the machine on documents and their labels (0/1)."""
    prior = float(np.mean(toxic)) if len(toxic) else 0.0
    kept = distinct_documents(texts, toxic)
    labels = np.array([toxic[n] for n in kept], dtype=int)
    n_docs = len(labels)
    sample = Sample([texts[at] for at in kept])
    if not sample.names or labels.min() == labels.max():
        return nothing(prior)
    owner = sample.owner
    length = np.maximum(sample.length(), 1)
    share = np.minimum(1 / length, 0.05)

    def over_represented(residual: np.ndarray) -> np.ndarray:
        """Each window's kernel with the difference of unexplained toxic and other documents."""
        pull = np.where(residual > 0, residual / max(residual[residual > 0].sum(), 1e-9), residual / -min(residual[residual < 0].sum(), -1e-9))
        difference, spread = (sample.by_triple(sample.by_window(p * share)) for p in (pull, np.abs(pull)))
        return sample.pulls((difference / np.sqrt(spread + 1e-4)).astype(np.float32))

    landmarks: list[int] = []
    residual = labels - labels.mean()
    mapped = np.zeros((len(owner), ROUNDS * PER_ROUND), dtype=np.float32)
    means = np.zeros((n_docs, 0))
    for turn in range(ROUNDS):
        pull = residual if turn % 2 else labels - labels.mean()
        candidates = np.argsort(-over_represented(pull), kind="stable")[: 40 * PER_ROUND]
        near = Kernel([sample.names[i] for i in [*candidates, *landmarks]]).of(*sample.triples(candidates)) ** (1 / POWER)
        nearest = near[:, len(candidates) :].max(axis=1) if landmarks else np.zeros(len(candidates))
        new = []
        for i in range(len(candidates)):
            if len(new) < PER_ROUND and nearest[i] < DIVERSITY:
                new.append(int(candidates[i]))
                nearest = np.maximum(nearest, near[:, i])
        if not new:
            break
        mapped[:, len(landmarks) : len(landmarks) + len(new)], by_document = sample.kernel_sums(new)
        landmarks += new
        means = np.hstack([means, by_document / length[:, None]])
        features = np.log1p(RATE * means)
        features = (features - features.mean(axis=0)) / (features.std(axis=0) + 1e-6)
        residual = labels - sigmoid(np.c_[features, np.ones(n_docs)] @ logistic(features, labels, 10.0))

    kernel = Kernel([sample.names[i] for i in landmarks])
    gram = kernel.of(*sample.triples(landmarks)).astype(float)
    eigen, vectors = np.linalg.eigh((gram + gram.T) / 2)
    good = eigen > 1e-4 * eigen.max()
    project = vectors[:, good] / np.sqrt(eigen[good])
    n_sentences = len(owner)
    size = np.maximum(sample.size, 1)
    del sample
    for at in range(0, n_sentences, 8192):
        mapped[at : at + 8192, : project.shape[1]] = mapped[at : at + 8192, : len(landmarks)] @ project / size[at : at + 8192, None]
    mapped = mapped[:, : project.shape[1]]
    y = np.where(labels == 1, 1.0, -1.0)
    # Each class weighs alike, and so does each of its documents.
    cost = (SENTENCE_COST * n_docs / 2 / np.where(labels == 1, labels.sum(), n_docs - labels.sum()))[owner] / np.bincount(owner, minlength=n_docs)[owner]
    fold = np.arange(n_docs) % FOLDS
    margin = np.zeros(n_sentences)
    for k in range(FOLDS):
        seen = fold[owner] != k
        if labels[fold != k].min() < labels[fold != k].max():
            w, b = linear_svm(mapped, y[owner], cost, seen)
            margin[~seen] = margins(mapped, np.flatnonzero(~seen), w, b)
    w, sentence_bias = linear_svm(mapped, y[owner], cost)
    features = document_features(means, *sentence_statistics(margin, owner, n_docs))
    centre, scale = features.mean(axis=0), features.std(axis=0) + 1e-6
    x = (features - centre) / scale
    even = np.full(n_docs, DOCUMENT_COST)
    unseen = np.zeros(n_docs)
    for k in range(FOLDS):
        others = fold != k
        if labels[others].min() < labels[others].max():
            v, b = linear_svm(x[others], y[others], even[others])
            unseen[~others] = x[~others] @ v + b
    v, bias = linear_svm(x, y, even)
    slope, shift = logistic(unseen[:, None], labels, 1e-2)
    return Machine(kernel, project @ w, sentence_bias, centre, scale, v, bias, float(slope), float(shift), prior)


def training_sample(labels: DataFrame, docs: DataFrame, limit: int = SAMPLE) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``limit`` labelled rows that are not held out, taken by hash."""
    rows = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), 5) != 0))
        .select("doc_id", "toxic")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic")
        .limit(limit)
    )
    found = documents_only(docs).join(F.broadcast(rows), "doc_id").select("text", "toxic", "doc_id").orderBy("doc_id", "toxic", "text").limit(limit).toPandas()
    return found["text"].tolist(), found["toxic"].astype(int).tolist()


class Reader:
    """A worker's cache: of each window its kernels with the landmarks and its part of a
    sentence's margin; of each word without edge punctuation the places of its windows,
    their number and the sum of their parts."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self._empty()

    def _empty(self) -> None:
        self.windows: dict[str, int] = {}
        self.kernels = np.zeros((CACHE_WINDOWS + STRETCH, len(self.machine.sentence)), dtype=np.float16)
        self.part = np.zeros(CACHE_WINDOWS + STRETCH)
        self.words: dict[str, int] = {}
        self.places = np.zeros(0, dtype=np.int32)
        self.start = self.count = np.zeros(0, dtype=np.int64)
        self.sum = np.zeros(0)

    def _learn_windows(self, new: list[str]) -> None:
        known = len(self.windows)
        more = known + len(new) - len(self.part)
        if more > 0:  # words of great length
            self.kernels, self.part = (np.concatenate([x, np.zeros((more, *x.shape[1:]), dtype=x.dtype)]) for x in (self.kernels, self.part))
        for i in range(0, len(new), 8000):
            some = new[i : i + 8000]
            values, at = self.machine.kernel.of(*triple_features(encode_windows(some))), slice(known + i, known + i + len(some))
            self.kernels[at], self.part[at] = values, values @ self.machine.sentence
        self.windows.update(zip(new, range(known, known + len(new))))

    def _learn(self, words: list[str]) -> None:
        split = [windows_of(w) for w in words]
        count = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        windows = list(chain.from_iterable(split))
        self._learn_windows([u for u in dict.fromkeys(windows) if u not in self.windows])
        places = np.fromiter(map(self.windows.__getitem__, windows), dtype=np.int32, count=len(windows))
        self.start = np.concatenate([self.start, len(self.places) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.sum = np.concatenate([self.sum, np.bincount(np.repeat(np.arange(len(words)), count), self.part[places], minlength=len(words))])
        self.places = np.concatenate([self.places, places])
        self.words.update(zip(words, range(len(self.words), len(self.words) + len(words))))

    def stretch(self, sentences: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of each word, place of each sentence's first word, its margin)."""
        words = pa.array(list(chain.from_iterable(sentences)), pa.large_string()).dictionary_encode()
        bare = pc.utf8_trim(words.dictionary, characters=_EDGES).dictionary_encode()
        names = bare.dictionary.to_pylist()
        if len(self.words) > CACHE_WORDS or len(self.windows) > CACHE_WINDOWS:
            self._empty()
        self._learn([w for w in names if w not in self.words])
        rows = np.fromiter(map(self.words.__getitem__, names), dtype=np.int64, count=len(names))
        ids = rows[bare.indices.to_numpy()][words.indices.to_numpy()]
        starts = np.cumsum([0, *map(len, sentences[:-1])])
        part, count = (np.add.reduceat(x[ids], starts) for x in (self.sum, self.count))
        return ids, starts, part / np.maximum(count, 1) + self.machine.sentence_bias

    def features(self, texts: list[str]) -> np.ndarray:
        """Document features of texts, read in stretches of about ``STRETCH`` words."""
        split = [sentences_of(t) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(s) for s in split])
        sentences = list(chain.from_iterable(split))
        before = np.cumsum([0, *map(len, sentences)])[:-1] // STRETCH
        edges = [*np.flatnonzero(np.diff(before, prepend=-1)), len(sentences)]
        total, windows, margins = np.zeros((len(texts), len(self.machine.sentence))), np.zeros(len(texts)), [np.zeros(0)]
        for at, end in zip(edges, edges[1:]):
            ids, starts, margin = self.stretch(sentences[at:end])
            margins.append(margin)
            document = owner[at:end]
            cuts = starts[np.flatnonzero(np.diff(document, prepend=-1))]
            places = gather(self.places, self.start[ids], self.count[ids])
            ends = np.cumsum(self.count[ids])[cuts[1:] - 1]
            met = np.zeros(len(self.part), dtype=bool)
            met[places] = True
            kernels, places = self.kernels[met].astype(np.float32), (np.cumsum(met) - 1)[places]
            for n, own in zip(np.unique(document), np.split(places, ends)):
                used, count = np.unique(own, return_counts=True)
                total[n] += count.astype(np.float32) @ kernels[used]
                windows[n] += len(own)
        worst, share = sentence_statistics(np.concatenate(margins), owner, len(texts))
        return document_features(total / np.maximum(windows, 1)[:, None], worst, share)


def score_texts(machine: Machine, key: str, texts: list[str]) -> np.ndarray:
    """Scores of texts; ``key`` names the machine in this worker's word cache."""
    if machine.kernel is None:
        return np.full(len(texts), machine.prior)
    return machine.score(kept(("toxicity", key), lambda: Reader(machine)).features(texts))


def score_documents(docs: DataFrame, machine: Machine) -> DataFrame:
    """``docs`` with all its columns plus ``score`` and ``predicted``."""
    shared, key = docs.sparkSession.sparkContext.broadcast(machine), uuid.uuid4().hex

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([float(x) for some in batches(texts.fillna("").tolist(), BATCH_CHARS) for x in score_texts(shared.value, key, some)], dtype="float64")

    columns = [F.col(c) for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*columns, score("text").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def fitted(spark, sf_dir: str, limit: int = SAMPLE) -> Machine:
    return train(*training_sample(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"), limit))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents_only(table(spark, sf_dir, "documents"))
    scored = score_documents(docs, fitted(spark, sf_dir))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
