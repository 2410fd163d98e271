"""Filter audit, Merkle manifest and URL filter, against plain Python."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import filter_audit, merkle_manifest, url_filter
from tests.llm.frames import DDL, collected, documents, odd_texts, prose

# --- filter audit -------------------------------------------------------------------------------


def letters_failed(text, doc_id, ids_of_text) -> str:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    failing = {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
        "E": doc_id is not None and any(i is not None and i < doc_id for i in ids_of_text),
    }
    return "".join(k for k, v in failing.items() if v)


def audited(rows, labels):
    """The audit by running every order over every document."""
    ids = {}
    for i, text, *_ in rows:
        ids.setdefault(text or "", []).append(i)
    docs = [
        (i, rest[1] if len(rest) > 1 and rest[1] else "" if len(rest) > 1 else "web", letters_failed(t or "", i, ids[t or ""]))
        for i, t, *rest in rows
    ]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = {}
    for part in {p for _, p, _ in docs}:
        own = [(i, f) for i, p, f in docs if p == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[1]]
                left = [d for d in left if letter not in d[1]]
                fails = sum(letter in f for _, f in own)
                removed_by[letter] += len(gone)
                out[part, order, step] = [
                    len(left),
                    len(gone),
                    fails - len(gone),
                    sum(f == letter for _, f in own),
                    sum(i in good for i, _ in gone),
                    sum(i in toxic for i, _ in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return out


def test_audit_of_odd_documents(spark):
    rng = random.Random(3)
    rows = [*odd_texts(), (920, "X" * 200), (921, "a $ b " * 40), (5, prose(rng, 60)), (6, None, "de", None)]
    rows += [(930 + k, prose(rng, 70, vocabulary=40 + 10 * k), "en", f"s{k % 2}") for k in range(6)]
    rows += [(940 + k, "The same text " * 20, "en", f"s{k % 2}") for k in range(5)]
    rows += [(940, "The same text " * 20, "en", "s1"), (None, "The same text " * 20, "en", "s0")]
    labels = [(904, 1, 0), (904, 0, 1), (940, 1, None), (942, 1, 1), (None, 1, 1), (5, None, 1), (77, 1, 1)]
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("n", F.lit(3))
    found = filter_audit.audit(documents(spark, rows), given).collect()
    told = {(r[0], r[1], r[2]): list(r[3:]) for r in found}
    assert len(told) == len(found) and told == audited(rows, labels)


def test_audit_of_nothing_and_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(documents(spark, odd_texts()).limit(0), labels).count() == 0
    found = filter_audit.audit(documents(spark, [(1, "x")]), labels)
    assert found.count() == 600 and not found.where("good_lost + toxic_lost > 0").count()


def test_wide_counters_do_not_run_over():
    counts = {0: 1 << 61, 5: 1 << 60, 31: (1 << 60) + 7}
    steps, only = filter_audit.unpack(sum(filter_audit.wide_counter(m) * n for m, n in counts.items()))
    assert steps.shape == (120, 5, 3) and not only.any()
    at = filter_audit.orders().index("CABDE")
    assert steps[at, 0].tolist() == [1 << 61, (1 << 61) + 7, 0]
    assert steps[at, 1].tolist() == [1 << 61, 0, (1 << 61) + 7]
    assert steps[at, 4].tolist() == [1 << 61, 0, (1 << 60) + 7]


# --- Merkle manifest ----------------------------------------------------------------------------


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def told(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes):
    """All levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[k : k + 8])) for k in range(0, len(below), 8)])
    return levels


def way(levels, at):
    for level in levels[:-1]:
        first = at // 8 * 8
        yield level[first:at], level[at + 1 : first + 8]
        at //= 8


def folded(leaf, siblings):
    for left, right in siblings:
        leaf = sha("".join([*left, leaf, *right]))
    return leaf


def expected_manifest(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    trees = {}
    for i, text, lang, source, n in rows:
        leaf = sha("".join(map(told, (i, source, lang, n, text))))
        lower = None if text is None else re.sub("[A-Z]+", lambda m: m[0].lower(), text)
        changed = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        other = sha("".join(map(told, (i, source, lang, n, lower)))) if changed else leaf
        trees.setdefault(lang, []).append((i is not None, i or 0, leaf, other))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    levels = {lang: climb([d[2] for d in sorted(trees[lang])]) for lang in langs}
    top = climb([levels[lang][-1][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for at, (known, i, leaf, other) in enumerate(sorted(trees[lang])):
            siblings = [*way(levels[lang], at), *way(top, k)]
            proof = sha("".join("".join([*a, *b]) for a, b in siblings))
            end = folded(other, siblings)
            root = top[-1][0]
            out.append((i if known else None, leaf, levels[lang][-1][0], root, proof, end, end == root))
    return sorted(out, key=str)


MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def manifest_rows():
    rng = random.Random(4)
    rows = [(rng.randrange(10**6), f"Text {k} {'é' * (k % 3)}", "en", "a", k) for k in range(1100)]
    rows += [(k, f"deutsch {k}", "de", None, None) for k in range(9)]
    rows += [(k, None if k % 2 else "", None, "b", k) for k in range(20)]
    rows += [(7, "Alone", "zz", "a", 5), (7, "EQUAL", "", "a", 5), (7, "EQUAL", "", "a", 5), (7, "Ties", "", "a", 4)]
    rows += [(None, "No Id", "de", "a", 5), (None, "No Id either", "de", "a", 5), (12, "L" * 100_000, "de", "a", 1)]
    return rows


def test_manifest_agrees_with_whole_trees(spark):
    rows = manifest_rows()
    given = spark.createDataFrame(rows, DDL).withColumns({c: F.lit("x") for c in ("tree", "at", "hash", "total")})
    found = collected(merkle_manifest.manifest(given), *MANIFEST)
    assert sorted(found, key=str) == expected_manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 65])
def test_manifest_of_few_rows(spark, n):
    rows = [(k, f"T{k}", "en", "a", 2) for k in range(n)]
    given = spark.createDataFrame(rows, DDL)
    assert sorted(collected(merkle_manifest.manifest(given), *MANIFEST), key=str) == expected_manifest(rows)


def test_a_version_shares_all_but_its_ancestors():
    hexes = [sha(str(k)).encode() for k in range(512)]
    nodes = merkle_manifest.block_nodes(hexes, 3)
    lefts, rights = merkle_manifest.way_up(nodes, 77)
    own = merkle_manifest.new_version(b"other", lefts, rights)
    whole = merkle_manifest.block_nodes([*hexes[:77], b"other", *hexes[78:]], 3)
    for k, level in enumerate(whole):
        assert [i for i, (a, b) in enumerate(zip(level, nodes[k], strict=True)) if a != b] == [77 // 8**k]
        assert level[77 // 8**k] == own[k]


# --- URL filter -----------------------------------------------------------------------------------

URLS = [
    ("http://net/x", "net", "/x", "net/", "block"),
    ("http://a.NET?x", "a.net", "", None, "allow"),
    ("http://a.net", "a.net", "", None, "allow"),
    ("http://notnet/", "notnet", "/", None, "allow"),
    ("https://m.Example.net/en/25#top", "m.example.net", "/en/25", "example.net/en/", "allow"),
    ("https://example.net/EN/25", "example.net", "/EN/25", "net/", "block"),
    ("ftp://example.com/de/?q=/fr/", "example.com", "/de/", "example.com/de/", "block"),
    ("http://x.org/fr/1", "x.org", "/fr/1", "org/fr/", "allow"),
    ("http://www.spam-farm.org/fr/1", "www.spam-farm.org", "/fr/1", "org/fr/", "allow"),
    ("http://Spam-farm.org/2.html?utm_source=x&b=2&a=1#t", "spam-farm.org", "/2.html", None, "block"),
    ("https://www.spam-farm.org:443/2/?a=1&b=2", "www.spam-farm.org:443", "/2/", None, "block"),
    ("https://spam-farm.org/2/?a=1", "spam-farm.org", "/2/", None, "allow"),
    ("mailto:someone", "", "", None, "allow"),
    (":///path", "", "/path", None, "allow"),
    ("http://h?q=a://b/c", "h", "", None, "allow"),
    ("http://ÄB.com/Ä", "Äb.com", "/Ä", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
]


def test_verdicts(spark):
    rows = [(k, url) for k, (url, *_) in enumerate(URLS)]
    rows += [(k, url) for k, url in rows[:3]] + [(None, URLS[0][0])]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    pages = pages.withColumns({c: F.lit("clash") for c in ("html", "hash", "maybe", "hot", "found", "listed")})
    unwanted = spark.createDataFrame([(URLS[9][0],), (URLS[9][0],), (URLS[8][0],), (None,), ("x",)], "url string")
    found = collected(url_filter.judge(pages, unwanted), "page_id", "host", "path", "rule", "verdict")
    want = [(k, *rest) for k, (_, *rest) in enumerate(URLS)]
    want += [*want[:3], (None, *URLS[0][1:])]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert url_filter.judge(pages.limit(0), unwanted).count() == 0
    nothing = url_filter.judge(pages, unwanted.limit(0))
    assert nothing.count() == len(rows) and not nothing.where("listed").count()


def test_listed_urls_that_many_pages_share(spark):
    pages = spark.range(6000).select(
        F.col("id").alias("page_id"),
        F.expr("'http://h.com/' || if(id % 3 = 0, 0, id)").alias("url"),
    )
    unwanted = spark.range(0, 6000, 4).select(F.expr("'https://www.h.com/' || id || '.html'").alias("url"))
    found = dict(collected(url_filter.judge(pages, unwanted), "page_id", "listed"))
    assert found == {k: k % 3 == 0 or k % 4 == 0 for k in range(6000)}


@pytest.mark.parametrize("n", [0, 1, 40, 5000])
def test_filter_holds_all_it_was_given_and_few_others(spark, n):
    listed = spark.range(n).select(F.xxhash64("id").alias("hash"))
    told = url_filter.bloom_filter(listed)
    assert len(told) == url_filter.WORDS * url_filter.blocks_for(n)
    own = np.array([r[0] for r in listed.collect()], np.int64)
    assert url_filter.may_hold(told, own).all()
    others = np.array([r[0] for r in spark.range(10**6, 10**6 + 20_000).select(F.xxhash64("id")).collect()])
    assert url_filter.may_hold(told, others).mean() < 0.02


def test_filter_size_is_bounded():
    assert url_filter.blocks_for(10**12) == url_filter.MOST_BLOCKS
    assert [url_filter.blocks_for(n) for n in (0, 1, 32, 33, 10_000)] == [1, 1, 1, 2, 512]
