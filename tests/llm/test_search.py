"""Top-k search, near copies and benchmark passages, against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ledgerlake.llm import decontamination, ngram_join, topk
from ledgerlake.llm.components import components
from ledgerlake.llm.signature_tree import Tree, bitmap, dual_traversal, fold
from ledgerlake.llm.words import blocks, shingles
from tests.llm.frames import collected, documents, odd_texts, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


@pytest.mark.parametrize("parts", [{}, {"block_queries": 3, "shard_rows": 7, "fan_in": 2}])
def test_topk(spark, parts):
    rng = random.Random(3)
    vectors = [(i, [rng.choice([-0.5, 0.1, 0.3, 1e3]) for _ in range(3)]) for i in range(60)]
    vectors += [(60, [float("nan"), 1.0, 1.0]), (61, [None, 1.0, 1.0]), (62, None), (63, [1.0]), (64, [2.0])]
    vectors += [(40, [0.1, 0.1, 0.1]), (None, [0.1, 0.1, 0.1])]
    df = spark.createDataFrame(
        [(i, v, 1, 0) for i, v in vectors], "vec_id long, embedding array<float>, row int, shard int"
    )
    found = sorted(collected(topk.exact_topk(df, k=5, every=20, **parts), "query_id", "rank", "vec_id", "score"))
    ok = [
        (k, i, np.floor(64 * np.float32(v).astype(np.float64)).astype(np.int64))
        for k, (i, v) in enumerate(vectors)
        if i is not None and v is not None and None not in v and np.isfinite(v).all()
    ]
    want = []
    for k, i, q in ok:
        if i % 20 == 0:
            best = sorted((-int(q @ v), j) for m, j, v in ok if m != k and len(v) == len(q))[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert found == sorted(want)
    assert topk.exact_topk(df.limit(0)).count() == 0


def test_products_beyond_doubles():
    a = np.array([[1 << 30, 1]], np.int64)
    b = np.array([[1 << 31, 1], [1, 1]], np.int64)
    assert topk._products(a, b).tolist() == [[(1 << 61) + 1, (1 << 30) + 1]]


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 90), (90, 80), (7, 7), (200, 201), (201, 200)]
    found = dict(collected(components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    assert found == {**{k: 1 for k in range(1, 41)}, 100: 80, 90: 80, 80: 80, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tree_leaves_out_no_similar_pair():
    draw = np.random.default_rng(0)
    base = [draw.integers(0, 1 << 63, 200, dtype=np.uint64) for _ in range(12)]
    sets = []
    for k in range(150):
        some = base[k % 12]
        keep = draw.random(len(some)) > draw.random() * 0.2
        sets.append(np.unique(np.concatenate([some[keep], draw.integers(0, 1 << 63, 5, dtype=np.uint64)])))
    for wide in (16, 64):
        maps = np.stack([fold(bitmap(s, 64), wide) for s in sets])
        assert (maps == np.stack([bitmap(s, wide) for s in sets])).all()
        tree = Tree(maps, np.array([len(s) for s in sets]), np.arange(len(sets)))
        found = set(zip(*(x.tolist() for x in dual_traversal(tree, tree, 85)), strict=True))
        for i in range(len(sets)):
            for j in range(i + 1, len(sets)):
                common = len(np.intersect1d(sets[i], sets[j]))
                if 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                    assert (i, j) in found
        assert len(found) < 150 * 149 / 4


def shingle_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3)))


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    of = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                both = len(sets[i] & sets[j])
                if both and 100 * both >= 85 * len(sets[i] | sets[j]) and of[i] != of[j]:
                    of[i] = of[j] = min(of[i], of[j])
                    changed = True
    return {i: (len(sets[i]), of[i]) for i in sets}


def family(rng, start, members, words, edits):
    base = prose(rng, words).split()
    rows = []
    for k in range(members):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
        rows.append((start + k, " ".join(copy)))
    return rows


@pytest.mark.parametrize("block", [1024, 4])
def test_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "FIRST", (1, 1))
    rng = random.Random(8)
    passage = prose(rng, 60)
    rows = family(rng, 0, 14, 90, 4) + family(rng, 20, 12, 130, 5) + family(rng, 40, 8, 20, 1)
    rows += [(60 + k, prose(rng, 40) + " " + passage + " " + prose(rng, 40)) for k in range(12)]
    rows += [(80, "a b c"), (81, "A  b\nc"), (82, "a b"), (83, "a b c d"), (84, "a b c d e")]
    rows += [r for r in odd_texts() if r[0] is not None]
    found = ngram_join.jaccard_components(documents(spark, rows))
    got = {i: (n, c) for i, n, c in collected(found, "doc_id", "n_shingles", "component_id")}
    assert got == brute_components(rows)
    assert found.count() == len(rows)


def test_near_copies_of_odd_rows(spark):
    found = collected(ngram_join.jaccard_components(documents(spark, odd_texts())), "doc_id", "component_id")
    assert (None, None) in found and (904, 904) in found and (905, 904) in found and (901, 901) in found
    assert ngram_join.jaccard_components(documents(spark, odd_texts()).limit(0)).count() == 0
    kept = sorted(collected(ngram_join.one_of_each(documents(spark, odd_texts())), "doc_id"), key=str)
    assert kept == [(i,) for i in (901, 902, 903, 904, 906, 907)] + [(None,)]


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 4}, {"BLOCK_TOKENS": 600, "COLUMNS": 50}])
def test_links_within_components(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(6)
    rows = family(rng, 0, 24, 90, 3) + family(rng, 40, 12, 130, 5) + [(60 + k, prose(rng, 40)) for k in range(5)]
    text = rows[0][1]
    for k in range(14):  # a chain of growing texts
        text += " " + prose(rng, 8)
        rows.append((100 + k, text))
    rows += [(80, rows[3][1].upper()), (81, rows[3][1]), (82, ""), (83, None), (84, " ")]
    sets = {i: shingle_set(t) for i, t in rows}
    want = {
        (i, j)
        for i in sets
        for j in sets
        if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])
    }
    df = documents(spark, [*rows, rows[3], (None, rows[3][1]), (None, "x y")])
    found = collected(ngram_join.jaccard_components(df), "doc_id", "n_links")
    count = {i: sum(i in pair for pair in want) for i in sets}
    assert {(i, n) for i, n in found if i is not None} == set(count.items())
    assert sorted(n for i, n in found if i is None) == [0, count[3] + 1]
    members, links = ngram_join.jaccard_links(df)
    of = dict(collected(members.where("doc_id IS NOT NULL"), "doc_id", "class_id"))
    pairs = collected(links, "a", "b", "common")
    assert len(set(pairs)) == len(pairs) and all(len(sets[a] & sets[b]) == n for a, b, n in pairs)
    linked = {(a, b) for a, b, _ in pairs}
    got = {
        (i, j)
        for i in of
        for j in of
        if i < j and (of[i] == of[j] or (min(of[i], of[j]), max(of[i], of[j])) in linked)
    }
    assert got == want


def test_words_of_blocks():
    texts = ["One two", None, "", " ONE\ttwo three ", "é É x"]
    seen = {}
    for limit in (1, 8, 1 << 20):
        sets = [s.tolist() for b in blocks(pa.array(texts), limit) for s in shingles(b.word_hashes(), b.word_ptr, 2)]
        seen[limit] = sets
        assert [len(s) for s in sets] == [1, 0, 0, 2, 2]
    assert seen[1] == seen[8] == seen[1 << 20]
    assert set(seen[1][0]) <= set(seen[1][3])


def edit_distance(line, text):
    row = [0] * (len(text) + 1)
    for k, w in enumerate(line):
        now = [k + 1]
        for j, x in enumerate(text):
            now.append(min(row[j] + (w != x), row[j + 1] + 1, now[j] + 1))
        row = now
    return min(row)


def test_nearest_run():
    draw = np.random.default_rng(2)
    for _ in range(40):
        line, text = draw.integers(0, 4, 9).astype(np.uint64), draw.integers(0, 4, 30).astype(np.uint64)
        edits, start, end = decontamination.nearest(line, text, np.array([0]), np.array([30]), 36)
        assert edits[0] == edit_distance(line.tolist(), text.tolist())
        a, b = int(start[0]), int(end[0])
        assert edit_distance(line.tolist(), text[a:b].tolist()) == edits[0]


def test_passages(spark):
    rng = random.Random(4)
    items = [(k, prose(rng, 25 + k)) for k in range(12)] + [(50, None), (51, "too short"), (None, "x " * 20)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows, want = odd_texts(), {}
    for k in range(120):
        item, text = items[k % 12]
        words = text.split()
        edits = k % 4
        for at in rng.sample(range(len(words)), edits):
            words[at] = rng.choice(["other", words[at] + " more", ""])
        passage = " ".join(words).upper() if k % 5 == 0 else ", ".join(words)
        rows.append((k, prose(rng, rng.randrange(60)) + " " + passage + "\n" + prose(rng, rng.randrange(60))))
        want[k, item] = edits
    rows += [(500 + k, prose(rng, 200)) for k in range(20)]
    found = collected(decontamination.passages(documents(spark, rows), benchmark), "doc_id", "item_id", "edits")
    got = {(i, j): e for i, j, e in found}
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want)
    assert all(e <= want[k] for k, e in got.items())
    clean = decontamination.clean(documents(spark, rows), benchmark)
    assert {i for (i,) in collected(clean, "doc_id")} == {r[0] for r in rows} - {i for i, _ in got}
    none = benchmark.limit(0)
    assert decontamination.passages(documents(spark, rows), none).count() == 0
    assert decontamination.passages(documents(spark, rows).limit(0), benchmark).count() == 0
    assert decontamination.clean(documents(spark, rows), none).count() == len(rows)


@pytest.mark.parametrize("size", [1, 3, 4, 5, 7, 8, 9, 10, 11, 14, 15, 19, 20, 30, 39, 40, 44, 50, 80])
def test_passages_at_the_most_edits(size):
    rng = random.Random(size)
    count = 100
    texts = [[f"i{item}x{k}" for k in range(size)] for item in range(count)]
    items = decontamination.Items(list(range(count)), [" ".join(w) for w in texts])
    docs = []
    for words in texts:
        edited = list(words)
        for at in rng.sample(range(size), size // 5):
            edited[at] = rng.choice(["other", "", words[at] + " more"])
        docs.append(prose(rng, rng.randrange(50)) + " " + " ".join(edited) + " " + prose(rng, rng.randrange(50)))
    found = {(row, item) for row, item, *_ in items.search(pa.array(docs))}
    wanted = {(k, k) for k in range(count)}
    assert found <= wanted
    assert len(found) >= (decontamination.RECALL if size >= decontamination.LONG else 1) * count


def test_passages_without_spaces():
    items = decontamination.Items([1, 2], ["\u6771\u4eac\u306e\u5929\u6c17\u306f\u6674\u308c", "\u0e2a\u0e27\u0e31\u0e2a\u0e14\u0e35"])
    docs = ["abc\u4eca\u65e5\u306e\u6771\u4eac\u306e\u5929\u6c17\u304c\u6674\u308c\u3067\u3059", "x\u0e01\u0e2a\u0e27\u0e31\u0e2a\u0e14\u0e35\u0e01", "\u6771\u4eac"]
    assert [(row, item) for row, item, *_ in items.search(pa.array(docs))] == [(0, 1), (1, 2)]


def test_hashes_do_not_depend_on_spans(monkeypatch):
    from ledgerlake.llm import words as words_module

    rng = random.Random(8)
    texts = [prose(rng, 400), "x" * 5000, "Ä" * 700 + " end", "", None, prose(rng, 30)]
    whole = [np.concatenate([b.word_hashes() for b in blocks(pa.array(texts), 1 << 30)])]
    monkeypatch.setattr(words_module, "SPAN", 64)
    words_module._powers.cache_clear()
    try:
        spans = np.concatenate([b.word_hashes() for b in blocks(pa.array(texts), 1 << 30)])
        starts = np.array([900, 3, 3, 500, 0])
        ends = np.array([1000, 9, 300, 501, 4000])
        block = next(iter(blocks(pa.array(texts), 1 << 30)))
        mixed = block.hashes(starts, ends)
    finally:
        monkeypatch.undo()
        words_module._powers.cache_clear()
    assert (spans == whole[0]).all()
    assert (mixed == block.hashes(starts, ends)).all()


def test_runs_span_batches():
    rows = [(k // 5, k, np.arange(k, dtype=np.uint64).tobytes()) for k in range(23)]
    table = pa.table(
        {c: pa.array(v) for c, v in zip(("key", "x", "bits"), map(list, zip(*rows, strict=True)), strict=True)}
    )
    for size in (1, 3, 7, 100):
        found = list(ngram_join._runs(table.to_batches(size), ["key"], ["x", "bits"], "bits"))
        assert [r["x"].tolist() for r in found] == [list(range(a, min(a + 5, 23))) for a in range(0, 23, 5)]
        assert [len(b) for r in found for b in r["bits"]] == list(range(23))


def test_roots_are_components():
    rng = np.random.default_rng(1)
    for n, m in ((1, 0), (50, 20), (300, 250), (40, 400)):
        i, j = rng.integers(0, n, m), rng.integers(0, n, m)
        root = ngram_join._roots(n, i, j)
        want = list(range(n))
        for _ in range(n):
            for a, b in zip(i, j, strict=True):
                want[a] = want[b] = min(want[a], want[b])
        assert root.tolist() == want


def test_vectors_of_no_length_and_scores_beyond_64_bits(spark):
    ddl = "vec_id long, embedding array<double>"
    none = spark.createDataFrame([(20, []), (1, []), (2, [1.0]), (40, [])], ddl)
    found = sorted(collected(topk.exact_topk(none, k=5, every=20), "query_id", "rank", "vec_id", "score"))
    assert found == [(20, 1, 1, 0), (20, 2, 40, 0), (40, 1, 1, 0), (40, 2, 20, 0)]
    large = spark.createDataFrame([(20, [1e9, 1.0]), (1, [1e9, -1.0]), (2, [1.0, 1.0])], ddl)
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.exact_topk(large).collect()
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.exact_topk(spark.createDataFrame([(20, [1e30]), (1, [1.0])], ddl)).collect()
    a, b = np.array([[1 << 40, -(1 << 40)]], np.int64), np.array([[1 << 30, 1 << 30], [1 << 20, 0]], np.int64)
    assert topk._products(a, b).tolist() == [[0, 1 << 60]]
