"""Alignment of two tokenizers over the same documents.

Both tokenizers encode every text; their tokens have byte ranges. Per batch, two
``pandas.merge_asof`` calls keyed by document find, for the start of each token, the
token of the other side that covers it. The union of both directions is the set of
overlapping pairs. Overlapping pairs of equal ends are *links*; the links of a document
cut its tokens into the smallest groups that both sides share.

Tables over the corpus are counted from the links of each document, gathered to distinct
id pairs before anything is shuffled. Counts go back to the documents by
``hot_aware_join``: pairs above 1/65,536 of all links, at most that many, are broadcast,
all others are shuffled.

Encoding goes by *segments*: a text is cut before each space that follows no white space
and is not the last character, where neither tokenizer joins anything (their files are asked for that; otherwise whole
texts are encoded). Segments recur, so each worker keeps the ids of those it has met in
two bounded generations.

Cases: a null or empty text, and one whose tokens do not give back its bytes (U+2581 in
it), has no tokens: numbers of 0 and an empty ``groups``. Tokens' names inside a text are
plain text. Rows of equal or null doc_id are documents of their own. An empty table gives
an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purselake.llm.common import documents_only, hot_aware_join, staged, table
from purselake.llm.wordbpe import batches

MARK = "▁"
CACHE_SEGMENTS = 150_000
CACHED_CHARS = 40
BATCH_CHARS = 500_000
HOT_SHARE = 1 << 16
_ID = np.dtype("<i4")
#: Fixed value: the pattern by which the byte-level format splits a text.
BYTE_LEVEL_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CUT = re.compile(r"(?<!\s) (?!\Z)")
_SPACE_AFTER_SPACE = re.compile(r"\s ")
_ASCII_SPACES = [c + " " for c in " \t\n\v\f\r\x1c\x1d\x1e\x1f"]


def byte_of_sign() -> dict[str, int]:
    """The byte-level format writes a byte as a character: printable ones as themselves,
    the others, in order, as the characters from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level file of the ``tokenizers`` library."""

    SHORT = 200

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        settings = json.loads(self.model.to_str())
        own_names = {t["id"] for t in settings["added_tokens"]}
        sign, vocabulary = byte_of_sign(), self.model.get_vocab()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for name, i in vocabulary.items():
            self.bytes[i] = name.encode() if i in own_names else bytes(map(sign.__getitem__, name))
        step = settings["pre_tokenizer"] or {}
        plain = not settings["normalizer"] and step.get("type") == "ByteLevel" and step.get("use_regex") and not step.get("add_prefix_space")
        self.cuts_at_spaces = bool(plain)
        self.quick = self._ranked(settings["model"], vocabulary, own_names) if plain else None

    def _ranked(self, model: dict, vocabulary: dict[str, int], own_names: set[int]):
        """The same merges in the library for rank files, which is faster on short texts;
        None unless every merge makes the next id, so that ids are ranks."""
        import tiktoken

        pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        if model.get("ignore_merges") or model.get("dropout") or [vocabulary.get(a + b) for a, b in pairs] != list(range(256, 256 + len(pairs))):
            return None
        ranks = {b: i for i, b in enumerate(self.bytes) if i not in own_names}
        return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of space + text."""
        texts = [" " + t for t in texts]
        if self.quick is None:
            return [x.ids for x in self.model.encode_batch(texts, add_special_tokens=False)]
        one = self.quick.encode_ordinary
        return [one(t) if len(t) < self.SHORT else self.model.encode(t, add_special_tokens=False).ids for t in texts]


class Pieces:
    """A SentencePiece model, which adds the space itself."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.model.serialized_model_proto())
        normal = proto.normalizer_spec
        self.cuts_at_spaces = normal.add_dummy_prefix and not normal.remove_extra_whitespaces and not normal.precompiled_charsmap and not any(MARK in p.lstrip(MARK) for p in names)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.by_segments = self.a.cuts_at_spaces and self.b.cuts_at_spaces
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}
        self.lengths = [np.array([len(x) for x in side.bytes], dtype=np.int64) for side in (self.a, self.b)]
        number = lambda sign, side: np.array([f"{sign}{i}" for i in range(len(side.bytes))], dtype=object)
        self.a_first, self.a_next = number(";", self.a), number(",", self.a)
        self.b_first, self.b_next = number("|", self.b), number(",", self.b)

    def segments(self, text: str) -> list[str]:
        """Parts of space + text, each without the space before it."""
        full = " " + text
        if not self.by_segments:
            return [text]
        spaced = any(map(full.__contains__, _ASCII_SPACES)) if full.isascii() else _SPACE_AFTER_SPACE.search(full)
        if spaced or full.endswith(" "):
            return _CUT.split(full)[1:]
        return text.split(" ")

    def _learn(self, parts: list[str]) -> dict[str, tuple[bytes, bytes] | None]:
        """Ids of both sides of new segments; None where they do not give back its bytes."""
        out = {}
        for part, a, b in zip(parts, self.a.encode(parts), self.b.encode(parts)):
            whole = (" " + part).encode()
            same = b"".join(map(self.a.bytes.__getitem__, a)) == whole == b"".join(map(self.b.bytes.__getitem__, b))
            out[part] = (np.array(a, dtype=_ID).tobytes(), np.array(b, dtype=_ID).tobytes()) if same else None
        return out

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of both sides of each text, as bytes; empty for texts without tokens."""
        if len(self.known) > CACHE_SEGMENTS:
            self.older, self.known = self.known, {}
        split = [self.segments(t) if t else [] for t in texts]
        need = set().union(*split).difference(self.known)
        again = need.intersection(self.older)
        self.known.update((s, self.older[s]) for s in again)
        fresh = self._learn(sorted(need - again))
        lost = {s for s, v in fresh.items() if v is None}
        self.known.update((s, v) for s, v in fresh.items() if v is not None)
        get = self.known.__getitem__
        out = []
        for parts in split:
            if lost and not lost.isdisjoint(parts):
                parts = []
            pairs = list(map(get, parts))
            out.append((b"".join([p[0] for p in pairs]), b"".join([p[1] for p in pairs])))
        for s in fresh:
            if len(s) > CACHED_CHARS:
                self.known.pop(s, None)
        return out

    def align(self, texts: list[str]) -> dict[str, list | np.ndarray]:
        """Columns of the alignment of each text."""
        encoded = self.encode(texts)
        sides, starts, ends, docs, numbers = [], [], [], [], []
        for k in (0, 1):
            ids = np.frombuffer(b"".join([e[k] for e in encoded]), dtype=_ID)
            end = np.cumsum(self.lengths[k][ids])
            numbers.append(np.array([len(e[k]) // _ID.itemsize for e in encoded], dtype=np.int64))
            sides.append(ids)
            ends.append(end)
            starts.append(end - self.lengths[k][ids])
            docs.append(np.repeat(np.arange(len(texts)), numbers[k]))
        (a, b), (a_end, b_end), (n_a, n_b) = sides, ends, numbers
        a_tokens = pd.DataFrame({"at": starts[0], "doc": docs[0], "a": np.arange(len(a))})
        b_tokens = pd.DataFrame({"at": starts[1], "doc": docs[1], "b": np.arange(len(b))})
        over_a = pd.merge_asof(a_tokens, b_tokens, on="at", by="doc")["b"].to_numpy()
        over_b = pd.merge_asof(b_tokens, a_tokens, on="at", by="doc")["a"].to_numpy()
        # The union of both directions; pairs that start together are in both.
        late = starts[0][over_b] != starts[1]
        pair_a = np.concatenate([a_tokens["a"].to_numpy(), over_b[late]])
        pair_b = np.concatenate([over_a, b_tokens["b"].to_numpy()[late]])
        linked = a_end[pair_a] == b_end[pair_b]
        partner = np.full(len(a), -1, dtype=np.int64)
        partner[pair_a[linked]] = pair_b[linked]
        a_last = np.flatnonzero(partner >= 0)
        b_last = partner[a_last]
        group_docs = docs[0][a_last]
        key = (group_docs * len(self.a.bytes) + a[a_last]) * len(self.b.bytes) + b[b_last]
        key, times = np.unique(key, return_counts=True)
        key, b_ids = np.divmod(key, len(self.b.bytes))
        key, a_ids = np.divmod(key, len(self.a.bytes))
        return {
            "n_a": n_a,
            "n_b": n_b,
            "n_groups": np.bincount(group_docs, minlength=len(texts)),
            "n_overlaps": np.bincount(docs[0][pair_a], minlength=len(texts)),
            "groups": self._groups_text(a, b, a_last, b_last, n_a + n_b),
            "pair_ends": np.searchsorted(key, np.arange(len(texts) + 1)),
            "a_ids": a_ids,
            "b_ids": b_ids,
            "times": times,
        }

    def _groups_text(self, a, b, a_last, b_last, sizes) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text: tokens are put in order of group and side."""
        a_ends, b_ends = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
        a_ends[a_last], b_ends[b_last] = True, True
        a_group, b_group = np.cumsum(a_ends) - a_ends, np.cumsum(b_ends) - b_ends
        a_begins, b_begins = np.roll(a_ends, 1), np.roll(b_ends, 1)
        b_before = np.concatenate([[0], b_last + 1])
        signs = np.empty(len(a) + len(b), dtype=object)
        signs[np.arange(len(a)) + b_before[a_group]] = np.where(a_begins, self.a_first[a], self.a_next[a])
        signs[np.arange(len(b)) + (a_last + 1)[b_group]] = np.where(b_begins, self.b_first[b], self.b_next[b])
        stops = np.cumsum(sizes)
        return ["".join(signs[s:e].tolist())[1:] for s, e in zip(stops - sizes, stops)]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner a worker process and pair of files."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


PAIR = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())])
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_overlaps long, groups string, pairs array<struct<a:int,b:int,n:int>>"


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document: numbers of tokens, groups and overlapping pairs; ``groups`` as text
    (``a1,a2|b1;a3|b2,b3``); ``pairs``, the distinct linked id pairs with how often."""

    def run(frames):
        worker = aligner(a_path, b_path)
        for frame in frames:
            at = 0
            for texts in batches(frame.column(1).to_pylist(), BATCH_CHARS):
                yield as_batch(frame.column(0).slice(at, len(texts)), worker.align(texts))
                at += len(texts)

    def as_batch(ids, found):
        structs = pa.StructArray.from_arrays([pa.array(found[c], type=pa.int32()) for c in ("a_ids", "b_ids", "times")], fields=list(PAIR))
        pairs = pa.ListArray.from_arrays(pa.array(found["pair_ends"], type=pa.int32()), structs)
        longs = [pa.array(found[c], type=pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_overlaps")]
        return pa.RecordBatch.from_arrays([ids, *longs, pa.array(found["groups"], type=pa.string()), pairs], names=names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_overlaps", "groups", "pairs"]
    return documents_only(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def pair_links(aligned: DataFrame) -> DataFrame:
    """(row, pair, b, n): how often a document links an id pair; ``pair`` holds both ids."""
    links = aligned.select("row", F.explode("pairs").alias("p"))
    pair = F.shiftleft(F.col("p.a").cast("long"), 32) + F.col("p.b")
    return links.select("row", pair.alias("pair"), F.col("p.b").alias("b"), F.col("p.n").cast("long").alias("n"))


def pair_table(aligned: DataFrame) -> DataFrame:
    """(pair, b, count, best): links of each id pair in the corpus, and whether no pair of
    its B id has more. One row a B id is broadcast: at most the vocabulary."""
    counts = staged(pair_links(aligned).groupBy("pair", "b").agg(F.sum("n").alias("count")), "pair-counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def aligned_with_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps."""
    digest = F.when(F.col("n_a") + F.col("n_b") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    aligned = alignments(docs, a_path, b_path).withColumn("groups_sha256", digest).drop("groups")
    aligned = staged(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned")
    total = aligned.agg(F.sum("n_groups")).first()[0] or 0
    rated = hot_aware_join(pair_links(aligned).drop("b"), pair_table(aligned), "pair", "count", total, HOT_SHARE)
    sums = rated.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = aligned.drop("pairs").join(sums, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256", "n_overlaps")


def op12_cross_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return aligned_with_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
