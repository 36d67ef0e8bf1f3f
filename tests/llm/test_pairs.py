"""Operators on pairs and runs: Jaccard join, decontamination, line dedup, suffix dedup, against brute force."""

import hashlib
import random
from pathlib import Path

import brute
import numpy as np
import pytest
from compare import connect, difference

from trapline.llm import components, containment, jaccard_join, line_runs, signature_tree, suffixes
from trapline.llm.registry import CHECKS

ODD = [None, "", " \n\t ", "one", "One", "two words", "a b c d", "A b C d", "a b c d e", "x " * 5_000, "y", "y"]


@pytest.mark.parametrize("name", [n for n, (_, sql) in CHECKS.items() if sql])
def test_same_rows_as_sql(name, spark, sf_dir):
    query, sql = CHECKS[name]
    assert difference(query(spark, sf_dir), connect(sf_dir), sql) is None


def frame(spark, texts, first=0):
    rows = [(first + i, t, "c", 1, "d", "n", "l", "s") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, cls string, n int, z string, root string, line string, row string")


def families(seed, n_families=5, members=30, words=60):
    """Near copies at all distances around the threshold, passages that families share, odd texts and exact copies."""
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(4000)}"
    passage = [word() for _ in range(20)]
    out = list(ODD)
    for f in range(n_families):
        base = [word() for _ in range(words)] + (passage if f % 2 else [])
        for _ in range(members):
            own = list(base)
            for _ in range(draw.randrange(5)):
                own[draw.randrange(len(own))] = word()
            out.append(" ".join(own))
        out += out[-3:]
    return out


def brute_components(texts, width, percent):
    sets = [brute.shingle_set(t, width) for t in texts]
    links = signature_tree.Links(len(texts))
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and 100 * common >= percent * (len(a) + len(sets[j]) - common) and sets[j]:
                links.join(i, j)
    return {i: (len(s), links.root(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("seed,width,percent,block", [(1, 4, 85, 256), (2, 4, 85, 8), (3, 5, 80, 5)])
def test_components_as_by_hand(spark, seed, width, percent, block):
    texts = families(seed)
    found = jaccard_join.jaccard_components(frame(spark, texts).repartition(4), width=width, percent=percent, block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(texts, width, percent)


def test_components_with_common_elements_put_last(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "COMMON_COUNT", 10)
    texts = families(4, members=60)
    found = jaccard_join.jaccard_components(frame(spark, texts).coalesce(1), width=4, percent=85, block=16).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(texts, 4, 85)


@pytest.mark.parametrize("few", [1, 8, 32])
def test_pairs_of_short_lists_meet_signatures_once(spark, monkeypatch, few):
    """Few members as pairs, more of them in trees: the same pairs, each once, whatever the number of lists they share."""
    monkeypatch.setattr(jaccard_join, "FEW", few)
    draw = np.random.default_rng(few)
    base = [draw.integers(0, 1 << 62, 90, dtype=np.uint64) for _ in range(4)]
    sets = [np.unique(np.concatenate([base[k % 4][: 90 - k // 4], draw.integers(0, 1 << 62, k // 2, dtype=np.uint64)])) for k in range(60)]
    texts = spark.createDataFrame(
        [(k, len(s), bytearray(signature_tree.signature(s).tobytes())) for k, s in enumerate(sets)], "cls long, n long, signature binary"
    )
    members = [(100 * t + f, k, 0) for f in range(4) for t in range(6) for k in range(60) if k % 4 == f and (k // 4 + t) % 5 != 0]
    members += [(1000 + k, c, 0) for k in range(59) for c in (k, k + 1)]
    sizes = {name: sum(m[0] == name for m in members) for name, *_ in members}
    lists = spark.createDataFrame([(name, k, sizes[name]) for name, k, _ in members], "list long, cls long, size long")
    comps = spark.createDataFrame([(k, 0) for k in (0, 4, 8)], "node long, root long")
    got = [tuple(r) for r in jaccard_join.pairs_across(lists, comps, texts, 80, 256).collect()]
    alike = {(i, j) for i in range(60) for j in range(i + 1, 60) if signature_tree.linked(sets[i], sets[j], 80)}
    met = {(i, j) for name in sizes for i in [m[1] for m in members if m[0] == name] for j in [m[1] for m in members if m[0] == name] if i < j}
    wanted = {(i, j) for i, j in alike & met if not {i, j} <= {0, 4, 8}}
    assert len(got) == len(set(got)) and wanted and wanted <= set(got) <= met
    assert not any({i, j} <= {0, 4, 8} for i, j in got)


def test_prefix_elements_do_not_stay_on_disk(spark):
    with jaccard_join.tables_of() as paths:
        frame_ = frame(spark, families(9))
        assert jaccard_join.jaccard_components(frame_).count() == frame_.count()
    left = [spark.read.parquet(p).columns for p in paths if Path(p.removeprefix("file:")).exists()]
    assert left and ["slot", "keys", "classes"] not in left
    texts = next(c for c in left if "z" in c)
    assert texts == ["cls", "n", "signature", "z", "list", "size"]  # a text goes to its list without a join


def test_repeated_ids_and_no_rows(spark):
    twice = frame(spark, ["a b c d e f", "a b c d e f"]).union(frame(spark, ["a b c d e f", None]))
    rows = jaccard_join.jaccard_components(twice).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == [(0, 2, 0), (0, 2, 0), (1, 0, 1), (1, 2, 0)]
    assert jaccard_join.jaccard_components(twice.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d e"), (None, None), (4, "a b c d e")], "doc_id long, text string")
    rows = jaccard_join.jaccard_components(nulls).collect()
    assert sorted((r.n_shingles, r.doc_id is None, r.component_id) for r in rows if r.n_shingles) == [(1, False, 4), (1, True, 4)]
    assert jaccard_join.one_of_each(nulls).count() == 3  # rows are told apart by id: null stays, for its row without words


def test_one_of_each_group_stays(spark):
    texts = families(6)
    kept = {r.doc_id for r in jaccard_join.one_of_each(frame(spark, texts)).collect()}
    assert kept == {i for i, (_, c) in brute_components(texts, 5, 80).items() if c == i}


def test_stars(spark):
    draw = random.Random(1)
    edges = [(k, k + 1) for k in range(40)] + [(draw.randrange(50, 300), draw.randrange(50, 300)) for _ in range(150)] + [(7, 7)]
    links = signature_tree.Links(300)
    for a, b in edges:
        links.join(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: links.root(x) for a, b in edges if a != b for x in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_contained_items(spark):
    draw = random.Random(3)
    word = lambda: f"w{draw.randrange(900)}"
    items = [" ".join(word() for _ in range(n)) for n in (5, 6, 9, 17, 33, 60, 60)] + [None, "", "three words only", "A b C d e F"]
    docs = list(ODD) + ["three words only", "a B c D E f g", "x a b c d e f y"]
    for k in range(60):
        own = items[k % 7].split()
        for _ in range(k % 5):
            own[draw.randrange(len(own))] = word()
        docs.append(" ".join([word() for _ in range(draw.randrange(40))] + own + [word() for _ in range(draw.randrange(400))]))
    expected = set()
    for i, d in enumerate(docs):
        for j, item in enumerate(items):
            a, b = brute.shingle_set(d, 5), brute.shingle_set(item, 5)
            if b and 100 * len(a & b) >= 80 * len(b):
                expected.add((i, j, len(a & b), len(b)))
    bench = spark.createDataFrame([(j, t, "x", 3) for j, t in enumerate(items)], "item_id long, text string, shingles string, n int")
    for block in (1 << 24, 200):
        got = containment.find_contained(frame(spark, docs).repartition(3), bench, block_bytes=block).collect()
        assert {tuple(r) for r in got} == expected and len(got) == len(expected)
    kept = {r.doc_id for r in containment.decontaminate(frame(spark, docs), bench).collect()}
    assert kept == set(range(len(docs))) - {i for i, *_ in expected}
    assert containment.find_contained(frame(spark, docs), bench.limit(0)).count() == 0
    assert containment.decontaminate(frame(spark, docs).limit(0), bench).count() == 0


def brute_lines(texts, min_lines, min_words):
    seen, gone = set(), {}
    for i, t in enumerate(texts):
        lines = [(k, x) for k, x in enumerate((t or "").split("\n")) if brute.words(x)]
        for p in range(len(lines) - min_lines + 1):
            run = lines[p : p + min_lines]
            name = tuple(x for _, x in run)
            if name in seen and sum(len(brute.words(x)) for x in name) >= min_words:
                gone.setdefault(i, set()).update(k for k, _ in run)
            seen.add(name)
    out = {}
    for i, t in enumerate(texts):
        g = gone.get(i, set())
        out[i] = (t if not g else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in g), len(g))
    return out


@pytest.mark.parametrize("min_lines,min_words", [(2, 10), (1, 3), (3, 0), (5, 0)])
def test_repeated_lines_go(spark, min_lines, min_words):
    draw = random.Random(min_lines)
    pool = [" ".join(f"w{draw.randrange(50)}" for _ in range(draw.randrange(1, 9))) for _ in range(25)] + ["", "  ", "\t"]
    texts = ["\n".join(draw.choice(pool) for _ in range(draw.randrange(0, 14))) for _ in range(60)]
    texts += [texts[3], texts[3], None, "\n\n", "l\n" * 300, "l\n" * 300, "é ü\r\nö " * 9]
    rows = line_runs.drop_repeated_lines(frame(spark, texts).repartition(3), min_lines=min_lines, min_words=min_words).collect()
    assert {r.doc_id: (r.text, r.n_removed) for r in rows} == brute_lines(texts, min_lines, min_words)
    assert rows[0].line == "l" and rows[0].row == "s"


def brute_runs(texts, min_words):
    """Lines of maximal runs that also stand at an earlier place, from all pairs of places."""
    lines = [[(k, x) for k, x in enumerate((t or "").split("\n")) if brute.words(x)] for t in texts]
    places = [(i, p) for i, own in enumerate(lines) for p in range(len(own))]
    gone = [set() for _ in texts]
    for at, (i, p) in enumerate(places):
        for j, q in places[:at]:
            n = 0
            while p + n < len(lines[i]) and q + n < len(lines[j]) and lines[i][p + n][1] == lines[j][q + n][1]:
                n += 1
            if n and sum(len(brute.words(x)) for _, x in lines[i][p : p + n]) >= min_words:
                gone[i].update(k for k, _ in lines[i][p : p + n])
    return {
        i: (t if not g else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in g), len(g))
        for i, (t, g) in enumerate(zip(texts, gone))
    }


LONG_LINE = " ".join(f"w{i}" for i in range(60))


def dropped(spark, texts, **options):
    rows = line_runs.drop_later_runs(frame(spark, texts).repartition(3), **options).collect()
    assert len(rows) == len(texts)
    return {r.doc_id: (r.text, r.n_removed) for r in rows}


def test_one_repeated_line_goes(spark):
    texts = [f"a\n{LONG_LINE}\nb", f"c\n\n{LONG_LINE}\nd", LONG_LINE, f"short line\n{LONG_LINE} x", "e\nshort line\nf"]
    found = dropped(spark, texts)
    assert found == brute_runs(texts, 10)
    assert found[1] == ("c\n\nd", 1) and found[2] == ("", 1) and found[4] == (texts[4], 0)


@pytest.mark.parametrize("min_words", [1, 3, 10, 16])
def test_later_copies_of_whole_runs_go(spark, min_words):
    draw = random.Random(min_words)
    pool = [" ".join(f"w{draw.randrange(50)}" for _ in range(draw.randrange(1, 9))) for _ in range(12)] + ["", "  ", "\t", LONG_LINE]
    texts = ["\n".join(draw.choice(pool) for _ in range(draw.randrange(0, 14))) for _ in range(40)]
    run = "\n".join(f"{x} {x}" for x in "abcdefgh")
    texts += [texts[3], texts[3], None, "\n\n", f"{run}\nx", f"y\n{run}\nz", "l\n" * 60, "k l\n" * 4, "é ü\r\nö " * 9]
    found = dropped(spark, texts, min_words=min_words)
    assert found == brute_runs(texts, min_words)
    assert found[45] == ("y\nz", 8)
    assert found[46] == ("l\n", 59)
    assert line_runs.drop_later_runs(frame(spark, texts).limit(0)).count() == 0


def test_line_dedup_of_its_own_output_and_odd_names(spark):
    """Columns that are named like helpers or like the result are no hindrance."""
    texts = [f"a\n{LONG_LINE}", f"b\n{LONG_LINE}\nc", None]
    docs = frame(spark, texts).withColumnsRenamed({"cls": "_doc", "z": "_gone", "n": "n_removed", "line": "c0", "row": "_removed", "root": "id"})
    for drop in (line_runs.drop_later_runs, line_runs.drop_repeated_lines):
        once = drop(docs)
        assert once.columns == [*[c for c in docs.columns if c != "n_removed"], "n_removed"]
        again = drop(once).collect()
        assert [r.n_removed for r in again] == [0, 0, 0] and {r["_doc"] for r in again} == {"c"} and {r.c0 for r in again} == {"l"}
    rows = {r.doc_id: r for r in line_runs.drop_later_runs(docs, removed="_gone").collect()}
    assert rows[1].text == "b\nc" and rows[1]["_gone"] == 1 and rows[1].n_removed == 1


def test_suffix_array_and_common_prefixes(spark):
    draw = random.Random(9)
    docs = [[draw.randrange(4) for _ in range(draw.randrange(1, 30))] for _ in range(20)]
    docs += [docs[0], docs[1][2:]]
    rows = [(d, i, x) for d, line in enumerate(docs) for i, x in enumerate(line)]
    lines = spark.createDataFrame(rows, "doc long, idx int, line long")
    array = line_runs.suffix_array(lines)
    placed = {(r.doc, r.idx): r.rank for r in array.collect()}
    order = sorted(placed, key=placed.get)
    assert sorted(placed.values()) == list(range(len(rows)))
    suffix = [docs[d][i:] for d, i in order]
    assert suffix == sorted(suffix)

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    found = {(r.doc, r.idx): r.lcp for r in line_runs.common_prefixes(array).collect()}
    assert [found[k] for k in order] == [0] + [common(a, b) for a, b in zip(suffix, suffix[1:])]


def test_no_repeated_lines_and_no_rows(spark):
    docs = frame(spark, ["a b\nc d", "e f", None])
    assert [r.n_removed for r in line_runs.drop_repeated_lines(docs).collect()] == [0, 0, 0]
    assert line_runs.drop_repeated_lines(docs.limit(0)).count() == 0


def brute_bytes(texts, length):
    bodies = [(t or "").encode() for t in texts]
    times = {}
    for b in bodies:
        for i in range(len(b) - length + 1):
            times[b[i : i + length]] = times.get(b[i : i + length], 0) + 1
    out = []
    for k, b in enumerate(bodies):
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - length + 1):
            if times[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(b) else 0
        out.append((k, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length,token,hot,segment", [(16, 8, 10_000, 1 << 20), (16, 5, 3, 1 << 20), (24, 10, 10_000, 100), (40, 20, 5, 64)])
def test_repeated_bytes_go(spark, monkeypatch, length, token, hot, segment):
    draw = random.Random(length + hot)
    monkeypatch.setattr(suffixes, "SEGMENT_BYTES", segment)
    make = lambda n, letters="abcdé": "".join(draw.choice(letters) for _ in range(n))
    passages = [make(n) for n in (length - 1, length, length + 1, 3 * length)]
    texts = [None, "", "z" * (3 * length), "xy" * length, "xyz" * length, "z" * (length - 1)]
    for _ in range(60):
        texts.append("".join(make(draw.randrange(30)) + draw.choice(passages) for _ in range(draw.randrange(4))) + make(draw.randrange(40)))
    texts += [texts[10], texts[11][3:], make(50, "ab") * 3]
    # closures run in other processes, so the segment size travels with the data only in local tests of one text
    got = suffixes.remove_repeated_bytes(frame(spark, texts).repartition(4), length=length, token=token, hot=hot).collect()
    rows = sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got)
    assert rows == brute_bytes(texts, length)


def test_segments_cover_every_string_once(monkeypatch):
    import pyarrow as pa
    import zstandard

    monkeypatch.setattr(suffixes, "SEGMENT_BYTES", 32)
    body = bytes(np.random.default_rng(0).integers(97, 100, 500, dtype=np.uint8))
    pack = zstandard.ZstdCompressor()
    batch = pa.RecordBatch.from_arrays([pa.array([5, 6]), pa.array([pack.compress(body), pack.compress(b"")])], ["row", "z"])
    starts = []
    for data, at, rows, begins in suffixes._segments(iter([batch]), 16):
        text, low, left, span, _, _ = suffixes.regions(data, at, 16, 8)
        for t, a, s in zip(text, low, span):
            starts += [a - at[t] + begins[t] + k for k in range(s + 1)]
    assert sorted(starts) == list(range(500 - 16 + 1))


def test_no_bytes_go(spark):
    docs = frame(spark, [None, "short", "other"])
    assert [r.n_removed for r in suffixes.remove_repeated_bytes(docs).collect()] == [0, 0, 0]
    assert suffixes.remove_repeated_bytes(docs.limit(0)).count() == 0
