"""Whole-text encoding with a ``tokenizers`` file, by cached words.

A file that lower-cases, drops white space and ends words with a sign never merges
across white space, so a text's ids are those of its white-space-separated words in
order. The file's settings are read when it is loaded; with any others, whole texts go
to the library. Arrow splits a batch of texts and numbers its distinct words. Of a word
that is plain letters and then plain punctuation, the parts are looked up apart, as the
file splits there too; other words are looked up whole. Parts recur; each worker keeps
the ids of those it has met (bounded; a full cache is emptied) and asks the library only
for new ones. A text's ids are gathered from them.
Only the ASCII white-space characters separate words here; any other white space
stays inside a word and is left to the library.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from purselake.llm.common import kept

CACHE_WORDS = 600_000
_SIMPLE = r"\A(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<signs>[!-&(-/:-@\[-`{-~]*)\z"


def splits_at_white_space(settings: dict) -> bool:
    """Whether a file's settings are those that encoding by words relies on."""
    steps = lambda part, key: (part or {}).get(key, [part] if part else [])
    normal = steps(settings["normalizer"], "normalizers")
    split = next((s for s in steps(settings["pre_tokenizer"], "pretokenizers") if s["type"] == "Split"), None)
    return (
        {s["type"] for s in normal} == {"NFC", "Replace", "Lowercase"}
        and [(s["pattern"], s["content"]) for s in normal if s["type"] == "Replace"] == [({"Regex": r"\s+"}, " ")]
        and split is not None
        and (split["behavior"], split["invert"]) == ("Removed", True)
        and split["pattern"].get("Regex", "").endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        and settings["model"].get("end_of_word_suffix") == "</w>"
        and not settings.get("post_processor")
    )


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = splits_at_white_space(json.loads(self.tokenizer.to_str()))
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.ends_word = np.zeros(1 << 8 * self.width if self.width == 2 else self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends_word[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True
        self._empty()

    def _empty(self) -> None:
        """Forget all parts but the empty one. Part ``k`` has ``length[k]`` ids from ``start[k]`` on."""
        self.rows: dict[str, int] = {"": 0}
        self.ids = np.zeros(0, dtype=self.dtype)
        self.start = self.length = np.zeros(1, dtype=np.int64)

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=self.dtype).tobytes() for x in found]

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of parts that are one pre-token each: many are encoded as one text,
        which is cut after each token that ends a word."""
        out: list[bytes] = []
        for i in range(0, len(parts), 500):
            some = parts[i : i + 500]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, dtype=self.dtype)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(some):
                out += self._encode(some)
                continue
            raw, cuts = ids.tobytes(), (ends * self.width).tolist()
            out += [raw[a:b] for a, b in zip([0, *cuts], cuts)]
        return out

    def _rows(self, parts: pa.Array, encode) -> np.ndarray:
        """Rows of parts; ``encode`` gives the ids of new ones."""
        numbered = parts.dictionary_encode()
        names, rows = numbered.dictionary.to_pylist(), self.rows
        new = [x for x in names if x not in rows]
        if new:
            found = encode(new)
            length = np.fromiter(map(len, found), dtype=np.int64, count=len(new)) // self.width
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(length) - length])
            self.length = np.concatenate([self.length, length])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), dtype=self.dtype)])
            rows.update(zip(new, range(len(rows), len(rows) + len(new))))
        return np.fromiter(map(rows.__getitem__, names), dtype=np.int64, count=len(names))[numbered.indices.to_numpy()]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all words, one after another, each word's first place, its number of ids)."""
        split = pc.extract_regex(words, _SIMPLE)
        simple = split.is_valid()
        letters, signs = split.filter(simple).flatten()
        at, rows = simple.to_numpy(zero_copy_only=False), np.zeros((len(words), 2), dtype=np.int64)
        rows[at, 0] = self._rows(pc.utf8_lower(letters), self._encode_parts)
        rows[at, 1] = self._rows(signs, self._encode_parts)
        rows[~at, 0] = self._rows(words.filter(pc.invert(simple)), self._encode)
        length = self.length[rows].sum(axis=1)
        return gather(self.ids, self.start[rows].ravel(), self.length[rows].ravel()), np.cumsum(length) - length, length

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        return [np.frombuffer(x, dtype=self.dtype) for x in self.encode_bytes(texts)]

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as the bytes of an array of ``dtype``."""
        if not self.by_words:
            return self._encode(texts)
        if len(self.rows) > CACHE_WORDS:
            self._empty()
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        words = split.values.dictionary_encode()
        ids, start, length = self._words(words.dictionary)
        at = words.indices.to_numpy()
        raw = gather(ids, start[at], length[at]).tobytes()
        ends = np.concatenate([[0], np.cumsum(length[at])]) * self.width
        cuts = ends[split.offsets.to_numpy()].tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def gather(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Stretches of ``values``, one after another."""
    ends = np.cumsum(length)
    return values[np.arange(length.sum()) + np.repeat(start - ends + length, length)]


def encoder(path: str) -> WordEncoder:
    """One encoder a worker process and file."""
    return kept(("words", path), lambda: WordEncoder(path))


def batches(texts, max_chars: int = 2_000_000):
    """Consecutive slices of ``texts`` of about ``max_chars`` characters."""
    batch, size = [], 0
    for t in texts:
        if batch and size + len(t) > max_chars:
            yield batch
            batch, size = [], 0
        batch.append(t)
        size += len(t)
    if batch:
        yield batch
