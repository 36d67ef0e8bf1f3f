"""Cross-tokenizer alignment: which tokens of a byte-level BPE (A) and of a sentencepiece model (B) cover the same bytes.

Both see a space and the text. Spans come from the tokenizers: character offsets from A, byte spans of the immutable
proto from B. A token whose span begins where the one before has ended is a coarse cut. Tokens that share characters
(parts of a multibyte character, byte-fallback tokens) lie between two cuts, and their ends follow from the bytes they
decode to. Byte offsets where tokens of both end cut the text into groups; all pairs of an A and a B token in one group
are links.

Texts are cut into words where both always begin a token, whatever stands around: before a blank or a line end behind a
visible ASCII character, behind such a line end, and between ASCII letters, digits and other marks. A's pattern does not
cross these places (but for marks that begin with an apostrophe, which are left whole), and B merges two characters only
if some piece has them side by side; which pairs those are is read from its vocabulary. So a chunk of texts needs spans,
groups and links for its distinct words only. B puts a blank before every text; a word that has none is encoded behind a
line end, which no piece holds, and the two first tokens are left out. A worker remembers a bounded number of words.

The number of documents that hold an id pair linked is counted per chunk and then summed up; the chunks' pairs meet
these counts again in a shuffle of distinct pairs, so no table of pairs is broadcast or collected. A chunk has about
CHUNK_BYTES of text, or one longer text.

A null or empty text has no tokens, nor has one whose joined A or B bytes differ from space and text: its counts are 0
and its digest ''. Rows with equal ids each get a row and count as documents each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.llm.tokens import ranges, vocabulary_path
from trapline.llm.words import chunks, text_bytes
from trapline.session import cut

FIRST_VOCABULARY = "byte_bpe_50k.json"
SECOND_VOCABULARY = "piece_bpe_32k.model"
CHUNK_BYTES = 2 << 20
REMEMBERED = 700_000  # of 80,000 words of a late chunk 18,000 are new, with 300,000 remembered 28,000
AT_ONCE = 10_000  # words that go to a tokenizer in one call
BLANK = "▁"

_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(first: str | None = None, second: str | None = None) -> Aligner:
    paths = (first or vocabulary_path(FIRST_VOCABULARY), second or vocabulary_path(SECOND_VOCABULARY))
    if paths not in _aligners:
        _aligners[paths] = Aligner(*paths)
    return _aligners[paths]


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 stands for itself, and the other
    bytes, in order, for the characters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in shown}
    letters.update({chr(0x100 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))})
    return letters


def token_ends(begins: list[int], ends: list[int], decoded: list[bytes], low: int = 0) -> list[int]:
    """Byte ends of tokens with byte spans (begin, end) that may share characters. Where a span begins at the end of
    all before, the cut is the span's; between two cuts ends follow from the decoded bytes. A span without width is that
    of a byte whose character ends with a later token."""
    out, reach, at, inside = [], low, low, False
    for a, b, piece in zip(begins, ends, decoded):
        if a >= reach and not inside:
            at = reach  # nothing of the tokens before is open: a coarse cut
        at += len(piece)
        out.append(at)
        inside = b <= a
        if b > reach:
            reach = b
    return out


#: (A tokens, B tokens, groups, links, their text, linked id pairs, how often each is linked) of a distinct word. Plain
#: tuples of plain values, as the garbage collector leaves them alone.
Word = tuple[int, int, int, int, bytes, tuple[int, ...], tuple[int, ...]]
GROUPS, PAIRS, TIMES = 4, 5, 6


LETTER, DIGIT, MARK = 1, 2, 3
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[0x21:0x7F] = MARK
_KIND[[*range(ord("0"), ord("9") + 1)]] = DIGIT
_KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = LETTER


class Aligner:
    def __init__(self, first: str, second: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        letters = byte_letters()
        self.a_bytes = {i: bytes(letters[c] for c in t) if set(t) <= letters.keys() else t.encode() for t, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.cuts = self.places_to_cut(pieces)
        self.whole_words = not any(BLANK in p.lstrip(BLANK) or "\n" in p for k, p in enumerate(pieces) if not self.b.is_byte(k))
        self.remembered = remembered
        self.young: dict[bytes, Word | None] = {}  # words of late chunks, and before them
        self.old: dict[bytes, Word | None] = {}
        self.shared: dict = {}  # pairs and times that many words have

    def places_to_cut(self, pieces: list[str]) -> np.ndarray:
        """Whether a word can begin at the second of two bytes."""
        kind = _KIND.astype(np.int64)
        change = (kind[:, None] > 0) & (kind[None, :] > 0) & (kind[:, None] != kind[None, :])
        change[ord("'"), :] = False
        cuts = change
        cuts[kind > 0, ord(" ")] = cuts[kind > 0, ord("\n")] = cuts[ord("\n"), kind > 0] = True
        for k, piece in enumerate(pieces):
            if not self.b.is_byte(k) and not self.b.is_control(k):
                text = piece.replace(BLANK, " ")
                for x, y in zip(text, text[1:]):
                    if x < "\x80" and y < "\x80":
                        cuts[ord(x), ord(y)] = False
        return cuts

    def words(self, texts: list[bytes]) -> list[list[bytes]]:
        """Every text, behind a space, cut into words."""
        data = np.frombuffer(b"".join(b" " + t for t in texts), dtype=np.uint8)
        size = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        stop = np.cumsum(size)
        begins = np.zeros(len(data), dtype=bool)
        begins[1:] = self.cuts[data[:-1], data[1:]]
        if self.whole_words:  # a blank or line end behind a character of two bytes from U+00C0 on, none of which is space
            ends = np.zeros(len(data), dtype=bool)
            ends[2:] = (data[:-2] >= 0xC3) & (data[:-2] <= 0xDF) & (data[1:-1] >= 0x80)
            begins |= ends & ((data == 0x20) | (data == 0x0A))
        # Behind a line end only if that is all of the space there, as A treats longer space by what follows.
        line = data == 0x0A
        alone = np.append(False, _KIND[data[:-1]] > 0) & line
        begins[1:] &= ~line[:-1] | alone[:-1]
        begins[stop - 1] &= data[stop - 1] != 0x20  # B gives a lone blank no token
        begins[stop - size] = True
        first = np.flatnonzero(begins)
        last = np.append(first[1:], len(data))
        body = data.tobytes()
        spelled = [body[x:y] for x, y in zip(first.tolist(), last.tolist())]
        at = np.append(np.searchsorted(first, stop - size), len(first)).tolist()
        return [spelled[x:y] for x, y in zip(at[:-1], at[1:])]

    def look_up(self, words: set[bytes]) -> dict[bytes, Word | None]:
        """The alignment of each word, None where the joined bytes of A or B differ from it."""
        if len(self.young) > self.remembered // 2:
            self.young, self.old = {}, self.young
        if len(self.shared) > self.remembered:
            self.shared = {}
        new = []
        for w in words:
            if w not in self.young:
                if w in self.old:
                    self.young[w] = self.old[w]
                else:
                    new.append(w)
        for at in range(0, len(new), AT_ONCE):
            part = new[at : at + AT_ONCE]
            text = [w.decode() for w in part]
            a = self.a.encode_batch(text, add_special_tokens=False)
            b = self.b.encode([t[1:] if t[0] == " " else "\n" + t for t in text], return_type="proto", num_threads=1)
            self.young.update(zip(part, self.align(part, text, a, b)))
        return {w: self.young[w] for w in words}

    def align(self, words: list[bytes], texts: list[str], a: list, b: list) -> list[Word | None]:
        a_ids, a_ends, a_n, b_ids, b_ends, b_n = [], [], [], [], [], []
        for word, text, x, y in zip(words, texts, a, b):
            ids, spans = x.ids, x.offsets
            pieces = [(p.id, p.begin, p.end) for p in y.pieces]
            # B's spans are of the text behind the space, which its first piece holds too, or of a line end and the text.
            shift = 1
            if text[0] != " ":
                pieces, shift = pieces[2:], -1
            others = [p[0] for p in pieces]
            if len(text) == len(word):  # every character is a byte, so spans are the tokens' own
                a_ends += [s[1] for s in spans]
                b_ends += [p[2] + shift for p in pieces]
            else:
                byte_at = [0, *accumulate(len(c.encode()) for c in text)]
                a_ends += token_ends([byte_at[s] for s, _ in spans], [byte_at[s] for _, s in spans], [self.a_bytes[i] for i in ids])
                begins = [p[1] + shift for p in pieces]
                if shift == 1 and begins:
                    begins[0] = 0
                b_ends += token_ends(begins, [p[2] + shift for p in pieces], [self.b_bytes[i] for i in others])
            a_ids += ids
            b_ids += others
            a_n.append(len(ids))
            b_n.append(len(others))
        size = np.array([len(w) for w in words], dtype=np.int64)
        fine = self._spells(a_ids, a_n, words, self.a_bytes) & self._spells(b_ids, b_n, words, self.b_bytes)
        groups, pairs, times = self._groups(fine, size, *(np.array(x, dtype=np.int64) for x in (a_ids, a_ends, a_n, b_ids, b_ends, b_n)))
        n_groups, n_links = groups[0], [sum(t) for t in times]
        return [
            (a_n[k], b_n[k], n_groups[k], n_links[k], groups[1][k], pairs[k], times[k]) if good else None for k, good in enumerate(fine.tolist())
        ]

    @staticmethod
    def _spells(ids: list[int], counts: list[int], words: list[bytes], decoded) -> np.ndarray:
        """Whether the joined bytes of each word's tokens are the word."""
        pieces = [decoded[i] for i in ids]
        at = np.append(0, np.cumsum([len(p) for p in pieces]))[np.append(0, np.cumsum(counts))].tolist()
        body = b"".join(pieces)
        return np.array([body[x:y] == w for x, y, w in zip(at[:-1], at[1:], words)], dtype=bool)

    def _groups(self, fine, size, a_ids, a_ends, a_n, b_ids, b_ends, b_n):
        """Per word: its number of groups and their text, its distinct linked pairs and their times."""
        base = np.cumsum(size) - size
        a_word, b_word = np.repeat(np.arange(len(size)), a_n), np.repeat(np.arange(len(size)), b_n)
        a_ok, b_ok = fine[a_word], fine[b_word]
        a_ids, a_word, a_at = a_ids[a_ok], a_word[a_ok], (a_ends + base[a_word])[a_ok]
        b_ids, b_word, b_at = b_ids[b_ok], b_word[b_ok], (b_ends + base[b_word])[b_ok]
        cuts = np.intersect1d(a_at, b_at)
        a_group, b_group = np.searchsorted(cuts, a_at), np.searchsorted(cuts, b_at)
        per_a, per_b = np.bincount(a_group, minlength=len(cuts)), np.bincount(b_group, minlength=len(cuts))
        group_word = np.zeros(len(cuts), dtype=np.int64)
        group_word[a_group] = a_word
        n_groups = np.bincount(group_word, minlength=len(size)).tolist()
        # All pairs: every A token of a group with each of its B tokens.
        repeat = per_b[a_group]
        one = np.repeat(a_ids, repeat)
        two = b_ids[ranges((np.cumsum(per_b) - per_b)[a_group], repeat)]
        word, pair = np.repeat(a_word, repeat), one << 32 | two
        order = np.lexsort((pair, word))
        word, pair = word[order], pair[order]
        new = np.append(True, (word[1:] != word[:-1]) | (pair[1:] != pair[:-1]))[: len(word)]
        first = np.flatnonzero(new)
        often = np.diff(np.append(first, len(word))).tolist()
        stop = np.searchsorted(word[first], np.arange(len(size) + 1)).tolist()
        keep, distinct = self.shared.setdefault, pair[first].tolist()
        distinct = [keep(p, p) for p in distinct]
        pairs = [tuple(distinct[x:y]) for x, y in zip(stop[:-1], stop[1:])]
        times = [keep(t, t) for t in (tuple(often[x:y]) for x, y in zip(stop[:-1], stop[1:]))]
        # The text: every id with the sign behind it, in the order of groups, A before B; words end with a line end.
        a_last = np.append(a_group[1:] != a_group[:-1], True)[: len(a_group)]
        b_last = np.append(b_group[1:] != b_group[:-1], True)[: len(b_group)]
        word_last = np.append(b_word[1:] != b_word[:-1], True)[: len(b_word)]
        signs = np.concatenate([np.where(a_last, 1, 0), np.where(word_last, 3, np.where(b_last, 2, 0))])
        place = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        ids = np.concatenate([a_ids, b_ids])[place].tolist()
        whole = "".join([f"{i}{sign}" for i, sign in zip(ids, [",|;\n"[s] for s in signs[place].tolist()])])
        lines = iter(whole.encode().split(b"\n"))
        texts = [next(lines) if good else b"" for good in fine.tolist()]
        return (n_groups, texts), pairs, times


def align_chunks(docs: DataFrame, key: str, text: str, first: str | None, second: str | None, chunk_bytes: int) -> DataFrame:
    """Two kinds of rows, told apart by `times`. A document: its counts and digest, and its distinct pairs, as numbers
    inside its chunk, with the times it links each. A chunk (`times` is null): its distinct pairs, and in how many of its
    documents each is. Both as packed numbers, compressed."""
    import zstandard

    kind = docs.schema[key].dataType.simpleString()
    numbers = ["n_a", "n_b", "n_groups", "n_links"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligned = aligner(first, second)
        part_number, count = TaskContext.get().partitionId(), 0
        for rows in batches:
            for part in chunks(rows, text, chunk_bytes):
                chunk = (part_number << 32) + count
                count += 1
                yield from one_chunk(aligned, part, chunk)

    def one_chunk(aligned: Aligner, part: pa.RecordBatch, chunk: int) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        body, at = text_bytes(part.column(1))
        body = body.tobytes()
        texts = [body[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        full = [k for k, t in enumerate(texts) if t]
        spelled = dict(zip(full, aligned.words([texts[k] for k in full]))) if full else {}
        known = aligned.look_up({w for own in spelled.values() for w in own})
        order = {w: k for k, w in enumerate(known)}
        entries = list(known.values())
        fine = np.array([e is not None for e in entries], dtype=bool)
        figures = np.array([e[:4] if e else [0] * 4 for e in entries], dtype=np.int64).reshape(-1, 4)
        groups = [e[GROUPS] if e else b"" for e in entries]
        flat = np.fromiter(chain.from_iterable([e[PAIRS] for e in entries if e]), dtype=np.int64)
        word_times = np.fromiter(chain.from_iterable([e[TIMES] for e in entries if e]), dtype=np.int64)
        pairs, word_pair = np.unique(flat, return_inverse=True)
        size = np.array([len(e[PAIRS]) if e else 0 for e in entries], dtype=np.int64)
        word_at = np.cumsum(size) - size
        in_docs = np.zeros(len(pairs), dtype=np.int64)
        totals, digest = np.zeros((part.num_rows, 4), dtype=np.int64), [""] * part.num_rows
        nothing = squeeze.compress(b"")
        held, times = [nothing] * part.num_rows, [nothing] * part.num_rows
        codes = np.fromiter(map(order.__getitem__, chain.from_iterable(spelled.values())), dtype=np.int64)
        stop = np.cumsum([len(own) for own in spelled.values()]).tolist()
        for k, at, end in zip(spelled, [0, *stop], stop):
            which = codes[at:end]
            distinct, often = np.unique(which, return_counts=True)
            if not fine[distinct].all():
                continue
            totals[k] = often @ figures[distinct]
            digest[k] = hashlib.sha256(b";".join([groups[w] for w in which.tolist()])).hexdigest()
            link = ranges(word_at[distinct], size[distinct])
            linked, place = np.unique(word_pair[link], return_inverse=True)
            total = np.bincount(place, weights=np.repeat(often, size[distinct]) * word_times[link], minlength=len(linked))
            held[k], times[k] = squeeze.compress(linked.astype("<u4").tobytes()), squeeze.compress(total.astype("<u4").tobytes())
            in_docs[linked] += 1
        there = np.flatnonzero(in_docs)
        yield batch(part.column(0), np.full(part.num_rows, chunk), totals, digest, held, times)
        index = [squeeze.compress(np.stack([there, pairs[there], in_docs[there]]).astype("<i8").tobytes())]
        yield batch(pa.nulls(1, part.column(0).type), np.array([chunk]), np.zeros((1, 4), dtype=np.int64), [None], index, [None])

    def batch(keys: pa.Array, chunk: np.ndarray, totals: np.ndarray, digest: list, held: list, times: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [keys, pa.array(chunk, pa.int64()), *[pa.array(totals[:, c]) for c in range(4)], pa.array(digest, pa.string()),
             pa.array(held, pa.binary()), pa.array(times, pa.binary())],
            [key, "chunk", *numbers, "groups_sha256", "pairs", "times"],
        )

    schema = f"`{key}` {kind}, chunk bigint, " + "".join(f"{c} bigint, " for c in numbers) + "groups_sha256 string, pairs binary, times binary"
    return docs.select(F.col(key), F.col(text)).mapInArrow(work, schema)


def chunk_pairs(aligned: DataFrame) -> DataFrame:
    """(chunk, place, pair, n): the pairs of each chunk's documents, their numbers there, and how many have them."""
    import zstandard

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for rows in batches:
            for chunk, packed in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                place, pair, n = np.frombuffer(expand.decompress(packed), dtype="<i8").reshape(3, -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(pair), chunk)), pa.array(place), pa.array(pair), pa.array(n)], ["chunk", "place", "pair", "n"]
                )

    chunk_rows = aligned.where(F.col("times").isNull()).select("chunk", "pairs")
    return chunk_rows.mapInArrow(unpack, "chunk bigint, place bigint, pair bigint, n bigint")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents each id pair is linked, and whether no pair of its A id is in more."""

    total = cut(chunk_pairs(aligned).groupBy("pair").agg(F.sum("n").alias("n")))
    own = F.shiftright("pair", 32)
    top = total.groupBy(own.alias("a")).agg(F.max("n").alias("most"))
    return total.join(top, own == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align_tokens(
    docs: DataFrame, key: str = "doc_id", text: str = "text", first: str | None = None, second: str | None = None,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row. `first` and `second` are paths
    of a byte-level BPE and of a sentencepiece model.

    n_best counts the links whose id pair is in as many documents as any pair with its A id, and count_sum adds up these
    numbers of documents over the links. The digest is of `a1,a2|b1;a3|b2,b3`: the ids of each group.
    """
    import zstandard

    aligned = cut(align_chunks(docs, key, text, first, second, chunk_bytes))
    answers = chunk_pairs(aligned).drop("n").join(pair_counts(aligned), "pair").select("chunk", "place", "n", "best")
    rows = aligned.where(F.col("times").isNotNull())
    columns = [key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        expand = zstandard.ZstdDecompressor()
        place = right.column("place").to_numpy()
        n = np.zeros(int(place.max(initial=-1)) + 1, dtype=np.int64)
        best = np.zeros(len(n), dtype=np.int64)
        n[place] = right.column("n").to_numpy()
        best[place] = right.column("best").to_numpy() if right.num_rows else 0
        sums = np.zeros((left.num_rows, 2), dtype=np.int64)
        for k, (pairs, times) in enumerate(zip(left.column("pairs").to_pylist(), left.column("times").to_pylist())):
            own, often = (np.frombuffer(expand.decompress(x), dtype="<u4").astype(np.int64) for x in (pairs, times))
            sums[k] = often @ best[own], often @ n[own]
        found = left.append_column("n_best", pa.array(sums[:, 0])).append_column("count_sum", pa.array(sums[:, 1]))
        return found.select(columns)

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, " + "".join(f"{c} bigint, " for c in columns[1:-1]) + "groups_sha256 string"
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, schema)
