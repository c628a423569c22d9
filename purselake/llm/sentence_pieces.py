"""SentencePiece encoding and decoding by a max-plus scan over chunks.

Every document is cut into chunks of ``CHUNK`` characters, wherever that falls. A
boundary's states are the pieces that may lie over it. A chunk yields the max-plus matrix
(0 or minus infinity) of which state at its left boundary leads to which at its right
one. Products of matrices are associative; taken from both ends of a document they leave
one state at each boundary, and every chunk is then backtraced by itself between its two.

No piece crosses the place before a word-boundary sign that follows another character,
nor one beside a newline (the vocabulary is asked). Between the first and the last such
place of a chunk, its *middle*, the library's ids hold whatever the states are, so a
matrix needs only walks over the parts of words at the chunk's ends, its *head* and
*tail*. A chunk without such a place is all head and is walked through.

The model at hand is a byte-pair vocabulary, not a unigram one, so its segmentation is
no best-scoring path; but a sequence of pieces is the model's encoding exactly if each
two neighbours are, and that makes matrices of zeros and minus infinities exact.

Plan: chunks are summarised where their document is read; only those of documents of
over ``SPREAD`` characters are dealt to other tasks first. Written summaries hold heads,
tails and matrices, so texts are not shuffled again. States come from one pass over the
matrices of each document, which are some hundred bytes a chunk.

Cases: a null or empty text has no ids and decodes to the empty text; characters
outside the vocabulary become byte pieces; repeated rows give repeated results; an
empty table gives an empty result; further columns are ignored. Decoding turns the
word-boundary sign U+2581 into a space, as the library does.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purselake.llm.common import staged, table, with_long_ids, with_text_ids

CHUNK = 4096
SPREAD = 1 << 20
BATCH = 400_000
MARK = "▁"
NO = -np.inf


class Pieces:
    """A model file and the questions that chunks ask of it."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        odd = lambda i: self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i)
        self.ids = {self.model.id_to_piece(i): i for i in range(n) if not odd(i)}
        self.longest = max(map(len, self.ids))
        cuts = []
        if not any(MARK in p.lstrip(MARK) for p in self.ids):
            cuts.append(f"(?<=[^{MARK}])(?={MARK})")
        if not any("\n" in p for p in self.ids):
            cuts.append(r"(?<=\n)|(?=\n)")
        self.cut = re.compile("|".join(cuts) or r"(?!)")
        self.bytes = [bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        self.neighbours = functools.lru_cache(100_000)(self._neighbours)
        self.whole = functools.lru_cache(50_000)(lambda s: len(self.encode_inner(s)) == 1)

    def encode_inner(self, text: str) -> list[int]:
        """Ids of a text inside a document, that is without the leading word mark: a
        newline, which no piece contains, goes before it and its ids are taken off."""
        return self.model.encode("\n" + text)[2:]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return [ids[2:] for ids in self.model.encode(["\n" + t for t in texts], num_threads=1)]

    def text_of(self, ids: list[int]) -> str:
        """Decoding of ids inside a document."""
        try:
            return b"".join(map(self.bytes.__getitem__, ids)).decode()
        except UnicodeDecodeError:  # byte pieces that are no character
            return self.model.decode([self.model.piece_to_id(MARK), *ids])

    def _neighbours(self, a: str, b: str) -> bool:
        """Whether pieces a and b stay as they are side by side."""
        return self.encode_inner(a + b) == self.encode_inner(a) + self.encode_inner(b)

    def is_piece(self, s: str) -> bool:
        return len(s) == 1 or (s in self.ids and self.whole(s))

    def over(self, text: str, at: int) -> list[tuple[int, int]]:
        """States of boundary ``at``: pieces (start, end) with start < at <= end."""
        out = []
        for start in range(max(0, at - self.longest), at):
            for end in range(at, min(len(text), start + self.longest) + 1):
                if self.is_piece(text[start:end]):
                    out.append((start, end))
        return out

    def walk(self, text: str, sources: list[tuple[int, int]], stop: int) -> dict[int, dict[int, int]]:
        """end -> {start: set of sources (bits)} of all pieces reached, up to those that
        lie over ``stop``. A source (0, 0) is the beginning of a stretch."""
        reached: dict[int, dict[int, int]] = {}
        for bit, (start, end) in enumerate(sources):
            own = reached.setdefault(end, {})
            own[start] = own.get(start, 0) | 1 << bit
        for at in range(min(e for _, e in sources), stop):
            for start, bits in reached.get(at, {}).items():
                before = text[start:at]
                for end in range(at + 1, min(len(text), at + self.longest) + 1):
                    piece = text[at:end]
                    if self.is_piece(piece) and (not before or self.neighbours(before, piece)):
                        own = reached.setdefault(end, {})
                        own[at] = own.get(at, 0) | bits
        return reached


@functools.lru_cache(4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def marked(text: str) -> str:
    """The text as the model reads it: a sign for each space, and one before the text."""
    return MARK + text.replace(" ", MARK) if text else ""


def split_document(text: str, size: int = CHUNK) -> list[tuple[int, int, str, int, int]]:
    """Chunks (number, count, text with context, from, to) of a document. A chunk's own
    text is ``text[from:to]``; it carries 16 characters of context on both sides."""
    text = marked(text)
    count = max(1, -(-len(text) // size))
    out = []
    for n in range(count):
        a, b = n * size, min((n + 1) * size, len(text))
        left = max(0, a - 16)
        out.append((n, count, text[left : b + 16], a - left, b - left))
    return out


def middle_of(p: Pieces, text: str, a: int, b: int, first: bool, last: bool) -> tuple[int, int] | None:
    """(start, end) of a chunk's middle: from the first to the last place in [a, b) that
    no piece crosses, a document's ends among them; None without one."""
    if first:
        start = a
    else:
        found = p.cut.search(text, a, b)
        if not found or found.start() >= b:
            return None
        start = found.start()
    if last:
        return start, b
    width = 64
    while b - width > start:
        places = [m.start() for m in p.cut.finditer(text, b - width, b) if m.start() < b]
        if places:
            return start, places[-1]
        width *= 4
    return start, max([start, *(m.start() for m in p.cut.finditer(text, start, b) if m.start() < b)])


def boundary(p: Pieces, text: str, a: int, b: int, first: bool, last: bool) -> tuple[list, list]:
    """(left states, right states) of a chunk; a document's ends have one state each."""
    return [(0, 0)] if first else p.over(text, a), [(b, b)] if last else p.over(text, b)


def any_source(reached: dict, end: int) -> int:
    return functools.reduce(int.__or__, reached.get(end, {}).values(), 0)


def transfer(p: Pieces, text: str, a: int, b: int, first: bool, last: bool) -> tuple[list, list, np.ndarray]:
    """(left states, right states, matrix) of a chunk; states by distance from the
    boundary, so that neighbours name them alike."""
    left, right = boundary(p, text, a, b, first, last)
    middle = middle_of(p, text, a, b, first, last)
    if middle is None:
        sources, into = left, None
    else:
        bits = 1 if first else any_source(p.walk(text[: middle[0]], left, middle[0]), middle[0]) if left else 0
        sources, into = [(middle[1], middle[1])], np.array([bits >> n & 1 for n in range(len(left))], dtype=bool)
    reached = p.walk(text[: b if last else len(text)], sources, b) if sources else {}
    matrix = np.full((len(left), len(right)), NO)
    for k, (start, end) in enumerate(right):
        bits = any_source(reached, b) if last else reached.get(end, {}).get(start, 0)
        if into is None:
            matrix[[n for n in range(len(left)) if bits >> n & 1], k] = 0.0
        elif bits:
            matrix[into, k] = 0.0
    return [(s - a, e - a) for s, e in left], [(s - b, e - b) for s, e in right], matrix


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product, which is associative."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def boundary_states(chunks: list[tuple[list, list, np.ndarray]]) -> list[tuple]:
    """(left state, right state) of each chunk of a document, from the products of
    matrices before and after each boundary."""
    aligned = []
    for k, (left, right, matrix) in enumerate(chunks):
        if k + 1 < len(chunks):
            place = {s: n for n, s in enumerate(right)}
            full = np.concatenate([matrix, np.full((len(left), 1), NO)], axis=1)
            matrix = full[:, [place.get(s, -1) for s in chunks[k + 1][0]]]
        aligned.append(matrix)
    after = [np.zeros((aligned[-1].shape[1], 1))]
    for matrix in reversed(aligned):
        after.append(combine(matrix, after[-1]))
    after.reverse()
    out, before = [], np.zeros((1, 1))
    state = chunks[0][0][0]
    for k, matrix in enumerate(aligned):
        before = combine(before, matrix)
        at = int(np.argmax(before[0] + after[k + 1][:, 0]))
        right = (chunks[k + 1][0] if k + 1 < len(chunks) else chunks[k][1])[at]
        out.append((state, right))
        state, before = right, np.where(np.arange(len(before[0])) == at, 0.0, NO)[None, :]
    return out


def path(p: Pieces, text: str, source: tuple[int, int], stop: int, goal: tuple[int, int] | None) -> list[str]:
    """Pieces after ``source`` up to ``goal``, or to any piece that ends at ``stop``."""
    reached = p.walk(text, [source], stop)
    end = stop if goal is None else goal[1]
    start = next(iter(reached[end])) if goal is None else goal[0]
    parts = []
    while (start, end) != source:
        parts.append(text[start:end])
        before = [s for s in reached[start] if s == start or p.neighbours(text[s:start], text[start:end])]
        start, end = before[0], start
    return parts[::-1]


def ends_of(text: str, b: int, middle: tuple[int, int] | None) -> tuple[str | None, str, int]:
    """(head, tail, the right boundary's place in the tail); without a middle the tail is
    the whole chunk and there is no head."""
    return (None, text, b) if middle is None else (text[: middle[0]], text[middle[1] :], b - middle[1])


def backtrace(p: Pieces, head: str | None, tail: str, a: int, b: int, first: bool, last: bool, left: tuple, right: tuple) -> tuple[list[int], list[int]]:
    """Ids before and after the middle's: of the pieces after the left state's and up to
    the right state's."""
    source, goal = (left[0] + a, left[1] + a), None if last else (right[0] + b, right[1] + b)
    ids = lambda parts: [i for part in parts for i in p.encode_inner(part)]
    tail = tail[: b if last else len(tail)]
    if head is None:
        return [], ids(path(p, tail, source, b, goal))
    before = [] if first else path(p, head, source, len(head), None)
    return ids(before), [] if last else ids(path(p, tail, (0, 0), b, goal))


@functools.lru_cache(64)
def _zeros(bits: int) -> int:
    """x to the power of 8 * 2**bits, modulo the polynomial of crc32."""
    return 1 << 23 if bits == 0 else _times(_zeros(bits - 1), _zeros(bits - 1))


def _times(a: int, b: int) -> int:
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, n_bytes: int) -> int:
    """crc32 of two byte strings one after the other, the second of ``n_bytes``."""
    bits = 0
    while n_bytes:
        if n_bytes & 1:
            first = _times(_zeros(bits), first)
        n_bytes, bits = n_bytes >> 1, bits + 1
    return first ^ second


class Ids:
    """What a chunk keeps of its ids: themselves."""

    schema = "ids array<int>"

    @staticmethod
    def of(p: Pieces, parts: list[list[int]], first: bool) -> tuple:
        return (np.array([i for part in parts for i in part], dtype=np.int32),)

    @staticmethod
    def joined(parts: list[tuple]) -> tuple:
        return (np.concatenate([np.asarray(ids, dtype=np.int32) for (ids,) in parts]),)


class Digest:
    """What a chunk keeps of its ids: their number and checksum, and the same of the text
    they decode to."""

    schema = "n_pieces long, ids_crc32 long, n_chars long, n_bytes long, text_crc32 long"

    @staticmethod
    def of(p: Pieces, parts: list[list[int]], first: bool) -> tuple:
        ids = [i for part in parts for i in part]
        text = p.text_of(ids)[1 if first and ids else 0 :]
        data = text.encode()
        return len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()), len(text), len(data), zlib.crc32(data)

    @staticmethod
    def joined(parts: list[tuple]) -> tuple:
        n, crc, chars, size, text = 0, 0, 0, 0, 0
        for n2, crc2, chars2, size2, text2 in parts:
            crc, text = joined_crc(crc, int(crc2), 4 * int(n2)), joined_crc(text, int(text2), int(size2))
            n, chars, size = n + int(n2), chars + int(chars2), size + int(size2)
        return n, crc, chars, size, text


CHUNKS = "doc_id string, row long, number int, count int, head string, tail string, a int, b int, left_states binary, right_states binary, matrix binary"


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def summaries(p: Pieces, keep, rows: list[tuple]) -> pd.DataFrame:
    """Chunks (doc_id, row, number, count, text, a, b) with what is kept of their middle's
    ids and, in documents of several chunks, their matrices, heads and tails."""
    middles = [middle_of(p, t, a, b, n == 0, n + 1 == count) for _, _, n, count, t, a, b in rows]
    encoded = iter(p.encode_all([t[m[0] : m[1]] for (_, _, _, _, t, _, _), m in zip(rows, middles) if m]))
    out = []
    for (doc_id, row, n, count, t, a, b), m in zip(rows, middles):
        kept = keep.of(p, [next(encoded) if m else []], n == 0)
        if count == 1:
            out.append((doc_id, row, n, count, "", "", 0, 0, b"", b"", b"", *kept))
            continue
        left, right, matrix = transfer(p, t, a, b, n == 0, n + 1 == count)
        states = [np.array(x, dtype=np.int32).tobytes() for x in (left, right)]
        head, tail, place = ends_of(t, b, m)
        out.append((doc_id, row, n, count, head, tail, a, place, *states, (matrix == 0).tobytes(), *kept))
    return pd.DataFrame(out, columns=names(f"{CHUNKS}, {keep.schema}"))


def chunk_rows(docs: DataFrame, model_path: str, keep) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, number and what is kept of its ids) of every chunk: those that are a
    whole document, and those of documents of several."""
    schema, size = f"{CHUNKS}, {keep.schema}", CHUNK

    def split(frames):
        for frame in frames:
            for doc_id, row, text in zip(frame["doc_id"], frame["row"], frame["text"]):
                for chunk in split_document(text, size):
                    yield doc_id, row, *chunk

    def bounded(rows):
        held, size = [], 0
        for r in rows:
            if held and size + len(r[4]) > BATCH:
                yield held
                held, size = [], 0
            held.append(r)
            size += len(r[4])
        if held:
            yield held

    def split_only(frames):
        for some in bounded(split(frames)):
            yield pd.DataFrame(some, columns=["doc_id", "row", "number", "count", "text", "a", "b"])

    def summarise(frames):
        for some in bounded(r for frame in frames for r in frame.itertuples(index=False, name=None)):
            yield summaries(pieces(model_path), keep, some)

    def split_and_summarise(frames):
        for some in bounded(split(frames)):
            yield summaries(pieces(model_path), keep, some)

    rows = with_text_ids(docs).select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    far = F.length("text") > SPREAD
    here = rows.filter(~far).withColumn("row", F.col("row") * 2).mapInPandas(split_and_summarise, schema)
    dealt = rows.filter(far).withColumn("row", F.col("row") * 2 + 1).mapInPandas(split_only, "doc_id string, row long, number int, count int, text string, a int, b int")
    chunks = staged(here.unionByName(dealt.repartition("row", "number").mapInPandas(summarise, schema)), "piece-chunks")

    def scan(frames):
        """States of each chunk; a document's rows follow one another."""
        held: list = []

        def done():
            row = held[0].row
            parts = []
            for c in held:
                left, right = ([tuple(x) for x in np.frombuffer(s, dtype=np.int32).reshape(-1, 2).tolist()] for s in (c.left_states, c.right_states))
                parts.append((left, right, np.where(np.frombuffer(c.matrix, dtype=bool).reshape(len(left), len(right)), 0.0, NO)))
            return [(row, c.number, [*a, *b]) for c, (a, b) in zip(held, boundary_states(parts))]

        for frame in frames:
            out = []
            for c in frame.itertuples(index=False):
                if held and held[0].row != c.row:
                    out += done()
                    held = []
                held.append(c)
            yield pd.DataFrame(out, columns=["row", "number", "states"])
        if held:
            yield pd.DataFrame(done(), columns=["row", "number", "states"])

    def trace(frames):
        n_kept = len(names(keep.schema))
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False, name=None):
                doc_id, row, n, count, head, tail, a, b, states = r[:9]
                p, s = pieces(model_path), [int(x) for x in states]
                before, after = backtrace(p, head, tail, a, b, n == 0, n + 1 == count, tuple(s[:2]), tuple(s[2:]))
                middle = r[9 : 9 + n_kept]
                opens = n == 0 and not keep_size(middle)  # the document's first piece is in the tail
                out.append((doc_id, row, n, *keep.joined([keep.of(p, [before], False), middle, keep.of(p, [after], opens)])))
            yield pd.DataFrame(out, columns=["doc_id", "row", "number", *names(keep.schema)])

    several = chunks.filter("count > 1")
    states = several.select("row", "number", "left_states", "right_states", "matrix").repartition("row").sortWithinPartitions("row", "number").mapInPandas(scan, "row long, number int, states array<int>")
    wanted = several.join(states, ["row", "number"]).select("doc_id", "row", "number", "count", "head", "tail", "a", "b", "states", *names(keep.schema))
    traced = wanted.mapInPandas(trace, f"doc_id string, row long, number int, {keep.schema}")
    return chunks.filter("count = 1").select(*traced.columns), traced


def keep_size(kept: tuple) -> int:
    """Ids that a chunk's middle has, of either kind of what is kept."""
    return int(kept[0]) if np.isscalar(kept[0]) else len(kept[0])


def encoded_chunks(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, row, number, ids: every document's ids by chunk, each row of bounded size;
    ``row`` tells rows of equal doc_id apart."""
    alone, several = chunk_rows(docs, model_path, Ids)
    return with_long_ids(alone.unionByName(several))


def encoded(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids of every document, as one array each."""
    parts = encoded_chunks(docs, model_path).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("number", "ids"))).alias("parts"))
    return parts.select("doc_id", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"))


def decoded(rows: DataFrame, model_path: str) -> DataFrame:
    """``rows`` (with ids) plus ``text``, the library's decoding."""

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        model = pieces(model_path).model
        return pd.Series([model.decode(np.asarray(x).tolist()) for x in ids], dtype=object)

    return rows.withColumn("text", decode("ids"))


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 and, of the text decoded from them, n_chars, text_crc32."""
    fields = names(Digest.schema)
    alone, several = chunk_rows(docs, model_path, Digest)

    @F.pandas_udf(Digest.schema)
    def joined(parts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([Digest.joined([tuple(x[f] for f in fields) for x in own]) for own in parts], columns=fields)

    parts = several.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("number", *fields))).alias("parts"))
    whole = parts.select("doc_id", joined("parts").alias("d")).select("doc_id", "d.*")
    return with_long_ids(alone.select(*whole.columns).unionByName(whole)).select("doc_id", "n_pieces", "ids_crc32", "n_chars", "text_crc32")


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
