"""Token ids of whole texts with a vocabulary file of the `tokenizers` library.

Blanks and line ends never lie inside a token of these vocabularies, so the ids of a text are those of its words put
together. Every distinct word of a chunk is encoded once; a worker remembers a bounded number of words. Plain words
(letters, then at most one full stop or comma) share the ids of their letters in lower case. Any other word goes to
the tokenizer as it is.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
REMEMBERED = 400_000
CHUNK_BYTES = 4 << 20  # larger than elsewhere: the more text at a time, the fewer words are distinct
PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$"

_encoders: dict[str, WordEncoder] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str | None = None, remembered: int = REMEMBERED) -> WordEncoder:
    """The worker's encoder for a vocabulary file; without a path, the one installed with `public_tokenizers`."""
    path = path or vocabulary_path()
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    _encoders[path].remembered = remembered
    return _encoders[path]


def ranges(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All places first, first + 1, ... of every (first, length), one range after the other."""
    ends = np.cumsum(length)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - length), length)


class WordEncoder:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.remembered = remembered
        self.marks = {mark: np.array(self._whole(mark), dtype=np.uint32) for mark in ".,"}
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0
        self.first = np.zeros(1 << 14, dtype=np.int64)
        self.size = np.zeros(1 << 14, dtype=np.int64)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while len(self.place) + len(words) > len(self.first):
            self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size))
        self.pool[self.used : self.used + len(ids)] = ids
        a, b = len(self.place), len(self.place) + len(words)
        self.first[a:b] = self.used + np.cumsum(size) - size
        self.size[a:b] = size
        self.used += len(ids)
        self.place.update(zip(words, range(a, b)))

    def _places(self, words: list[str], plain: bool) -> np.ndarray:
        """Where each word's ids are remembered; new words are encoded."""
        new = [w for w in words if w not in self.place]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            if plain:  # each is one run of letters, so its last token is the only one that ends a word
                ids = np.array(self._whole(" ".join(part)), dtype=np.uint32)
                ends = np.flatnonzero(self.ends_word[ids]) + 1
                size = np.diff(ends, prepend=0)
            if not plain or len(size) != len(part) or ends[-1] != len(ids):
                found = [e.ids for e in self.tokenizer.encode_batch(part, add_special_tokens=False)]
                size = np.array([len(x) for x in found], dtype=np.int64)
                ids = np.array([i for x in found for i in x], dtype=np.uint32)
            self._learn(part, ids, size)
        return np.fromiter((self.place[w] for w in words), dtype=np.int64, count=len(words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row (uint32), and where each text's begin. A null text has none."""
        if len(self.place) > self.remembered:
            self._forget()
        lists = pc.split_pattern(pc.replace_substring(texts.fill_null("").cast(pa.large_string()), "\n", " "), " ")
        word_at = lists.offsets.to_numpy()
        coded = lists.values.slice(word_at[0], word_at[-1] - word_at[0]).dictionary_encode()
        which, distinct = coded.indices.to_numpy(), coded.dictionary
        if len(distinct) == 0:
            return np.zeros(0, dtype=np.uint32), np.zeros(len(texts) + 1, dtype=np.int64)
        first, size, pool = self._distinct(distinct)
        per_word = size[which]
        ids = pool[ranges(first[which], per_word)]
        total = np.concatenate(([0], np.cumsum(per_word)))
        return ids, total[word_at - word_at[0]]

    def _distinct(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First place, number and pool of the ids of distinct words."""
        plain = pc.match_substring_regex(distinct, PLAIN).to_numpy(zero_copy_only=False)
        letters = pc.utf8_lower(pc.utf8_rtrim(distinct, ".,")).dictionary_encode()
        stem = letters.indices.to_numpy()
        wanted = np.unique(stem[plain])
        place = np.zeros(len(letters.dictionary), dtype=np.int64)
        place[wanted] = self._places(letters.dictionary.take(pa.array(wanted)).to_pylist(), plain=True)
        other = np.flatnonzero(~plain)
        at = place[stem]
        at[other] = self._places(distinct.take(pa.array(other)).to_pylist(), plain=False)
        marked = {m: plain & pc.ends_with(distinct, m).to_numpy(zero_copy_only=False) for m in self.marks}
        size = self.size[at] + sum(m.astype(np.int64) * len(self.marks[k]) for k, m in marked.items())
        first = np.cumsum(size) - size
        pool = np.empty(int(size.sum()), dtype=np.uint32)
        pool[ranges(first, self.size[at])] = self.pool[ranges(self.first[at], self.size[at])]
        for mark, there in marked.items():
            end = (first + size)[there]
            for k, i in enumerate(self.marks[mark]):
                pool[end - len(self.marks[mark]) + k] = i
        return first, size, pool

    def encode_documents(self, texts: pa.Array, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """As `encode`, with `end_id` behind every text."""
        ids, at = self.encode(texts)
        n = len(texts)
        out = np.empty(len(ids) + n, dtype=np.uint32)
        new_at = at + np.arange(n + 1)
        ends = np.zeros(len(out), dtype=bool)
        ends[new_at[1:] - 1] = True
        out[ends] = end_id
        out[~ends] = ids
        return out, new_at
