"""Token alignment against a version that encodes whole texts and compares every pair of tokens."""

import hashlib
import random

import pytest

from trapline.llm import token_alignment as ta
from trapline.llm.tokens import vocabulary_path

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary_path(ta.FIRST_VOCABULARY))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(ta.SECOND_VOCABULARY))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in shown}
    hidden = [x for x in range(256) if x not in shown]
    byte.update({chr(256 + k): x for k, x in enumerate(hidden)})
    entry = {i: bytes(byte[c] for c in t) for t, i in a.get_vocab().items() if all(c in byte for c in t)}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    return (lambda t: [(i, entry[i]) for i in a.encode(" " + t, add_special_tokens=False).ids]), lambda t: [(i, piece(i)) for i in b.encode(t)]


def brute(texts, encoders):
    rows, counts = [], {}
    for t in texts:
        a, b = (encode(t) if t else [] for encode in encoders)
        whole = (" " + (t or "")).encode()
        if not t or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            rows.append(None)
            continue
        ends = []
        for tokens in (a, b):
            at, own = 0, []
            for _, x in tokens:
                at += len(x)
                own.append(at)
            ends.append(own)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        group = [[next(g for g, c in enumerate(cuts) if e <= c) for e in own] for own in ends]
        links = []
        by_b = {}
        for (j, _), g in zip(b, group[1]):
            by_b.setdefault(g, []).append(j)
        by_a = {}
        for (i, _), g in zip(a, group[0]):
            by_a.setdefault(g, []).append(i)
            links += [(i, j) for j in by_b[g]]
        for p in set(links):
            counts[p] = counts.get(p, 0) + 1
        text = ";".join(",".join(map(str, by_a[g])) + "|" + ",".join(map(str, by_b[g])) for g in range(len(cuts)))
        rows.append((len(a), len(b), len(cuts), links, hashlib.sha256(text.encode()).hexdigest()))
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(best.get(i, 0), n)
    out = {}
    for k, r in enumerate(rows):
        if r is None:
            out[k] = (0, 0, 0, 0, 0, 0, "")
        else:
            n_best = sum(counts[p] == best[p[0]] for p in r[3])
            out[k] = (*r[:3], len(r[3]), n_best, sum(counts[p] for p in r[3]), r[4])
    return out


ODD = [
    None, "", " ", "  a", "a  b ", "end ", "\n", "x\ny", " \t\n  z", "a\n  b", "a \n b", "a  b", "a　 b  c", "日本語 é 😀ok 👩‍👩‍👧 ｆｕｌｌ",
    "a▁b c", "plain", "<|endoftext|> <s> </s> <unk> <0x41> <pad>", "it's we'll DON'T  I'm", "0123456789 1,234.56", "\x00a \x7f b\x01 c",
    "é ́x ﬁ ½ ™", "x" * 3_000, "ab" * 500 + " " + "日" * 300, "tab\there  two\r\nlines \r x", " line  par", "a\x1c b\x85 c", "!?... -- __ @@ ##", "a.b, (c) d1 2e 3.4% f\n\ng\nh. \ni \n", "x'y 'z ''s 's' e.\n", "a\n", "(a) ", "é à ñ\nü ×\n ß÷ Ж д\n\nж ", "العربية текст ελληνικά",
]


def frame(spark, texts):
    rows = [(i, t, "c", 1, "p", 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, chunk string, n int, pairs string, word_at int")


def got(spark, texts, **options):
    rows = ta.align_tokens(frame(spark, texts).repartition(3), **options).collect()
    assert len(rows) == len(texts)
    return {r.doc_id: tuple(r[c] for c in COLUMNS) for r in rows}


@pytest.mark.parametrize("seed,chunk", [(1, 1 << 22), (2, 300)])
def test_as_whole_texts_encode(spark, encoders, seed, chunk):
    draw = random.Random(seed)
    pool = [w for t in ODD if t for w in t.replace("x" * 3_000, "y").split(" ")] + ["the", "of", "token", "Straße", "naïve", "\n", "\n\n", "", ""]
    texts = list(ODD) + [" ".join(draw.choice(pool) for _ in range(draw.randrange(1, 40))) for _ in range(150)]
    texts += texts[-5:]
    found, want = got(spark, texts, chunk_bytes=chunk), brute(texts, encoders)
    assert {k: texts[k] for k in want if found[k] != want[k]} == {}
    assert sum(r[0] > 0 for r in found.values()) > 100 and found[0] == found[1] == (0, 0, 0, 0, 0, 0, "")


def test_given_texts(spark, sf_dir, encoders):
    """Every 5th text of the smallest table."""
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()][::5]
    assert got(spark, texts) == brute(texts, encoders)


def test_words_are_where_whole_texts_are_cut(encoders):
    """Tokens of the words in a row are those of the whole text."""
    aligned = ta.aligner()
    assert aligned.cuts[ord("d"), ord(" ")] and aligned.cuts[ord("d"), ord("\n")] and not aligned.cuts[ord("'"), ord("s")]
    for text in ODD[3:]:
        words = aligned.words([text.encode()])[0]
        assert b"".join(words) == b" " + text.encode()
        known = aligned.look_up(set(words))
        if all(known[w] for w in words):
            groups = b";".join(known[w][ta.GROUPS] for w in words).decode()
            a = [int(x) for g in groups.split(";") for x in g.split("|")[0].split(",")]
            assert a == [i for i, _ in encoders[0](text)]


def test_empty_table_and_equal_ids(spark):
    assert ta.align_tokens(frame(spark, ["a"]).limit(0)).count() == 0
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a")], "doc_id long, text string")
    found = sorted((r.doc_id is None, r.n_links, r.n_best, r.count_sum) for r in ta.align_tokens(rows).collect())
    assert found == [(False, 2, 2, 5), (False, 2, 2, 5), (True, 1, 1, 3)]


def test_words_of_a_task_are_remembered(monkeypatch):
    """A task meets some 600,000 words, most of them again and again: 300,000 are each aligned once."""
    known = ta.Aligner(vocabulary_path(ta.FIRST_VOCABULARY), vocabulary_path(ta.SECOND_VOCABULARY))
    aligned = []
    monkeypatch.setattr(known, "a", type("A", (), {"encode_batch": lambda self, text, **_: text})())
    monkeypatch.setattr(known, "b", type("B", (), {"encode": lambda self, text, **_: text})())
    monkeypatch.setattr(known, "align", lambda words, *_: aligned.extend(words) or [None] * len(words))
    for _ in range(2):
        for at in range(0, 300_000, 50_000):
            known.look_up({b"w%d" % k for k in range(at, at + 50_000)})
    assert len(aligned) == 300_000
