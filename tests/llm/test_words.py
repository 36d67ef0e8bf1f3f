"""Numbers of words: equal words only have equal numbers."""

import random

import pyarrow as pa
import pytest
from brute import words as plain_words

from trapline.llm.words import Words, chunks


def swapped(n):
    """Words of two letters by the parity of the ones in 0..n-1, and with the letters changed over: for any base, a
    polynomial of their letters modulo 2**64 is the same."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [8, 16, 1024, 2048, 4096])
def test_swapped_letters_have_other_numbers(n):
    numbers = Words(pa.array(list(swapped(n)))).numbers
    assert len(set(numbers.tolist())) == 2


def test_equal_words_have_equal_numbers():
    draw = random.Random(1)
    pool = ["".join(draw.choice("abé日") for _ in range(draw.randrange(1, 30))) for _ in range(300)]
    pool += ["a" * n for n in range(1, 40)] + ["a" * n + "\0" for n in range(1, 20)]
    texts = [" ".join(draw.choice(pool) for _ in range(draw.randrange(30))) for _ in range(200)] + [None, ""]
    by_word, batch = {}, pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
    for part in chunks(batch, "t", 500):
        found = Words(part.column(0))
        spelled = [w for t in part.column(0).to_pylist() for w in plain_words(t)]
        assert len(spelled) == len(found.numbers)
        for word, number in zip(spelled, found.numbers.tolist()):
            assert by_word.setdefault(word, number) == number
    assert len(set(by_word.values())) == len(by_word)


def test_long_swapped_words_are_not_linked(spark):
    from trapline.llm.jaccard_join import jaccard_components

    rows = [(i + 1, f"{x}{w}{y}") for n in (1024, 2048) for x, y in (("", ""), ("a b ", " c d")) for i, w in enumerate(swapped(n))]
    for at in range(0, len(rows), 2):
        docs = spark.createDataFrame(rows[at : at + 2], "doc_id long, text string")
        assert {r.doc_id: r.component_id for r in jaccard_components(docs).collect()} == {1: 1, 2: 2}
