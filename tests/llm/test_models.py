"""Trained operators: held-out accuracy, brute force for their parts, and odd input."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import language, pages, pieces, quality, toxicity
from ledgerlake.llm.labelled import remainder
from ledgerlake.llm.tables import table
from ledgerlake.llm.words import blocks
from tests.llm.frames import collected, documents, odd_texts

SF = "/root/testdata/sf0.01"


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    ones = y.sum()
    return (rank[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))


def held_out(spark, found, label):
    rows = found.join(table(spark, SF, "labels"), "doc_id").where("held_out").select("score", label).toPandas()
    return auc(rows["score"].to_numpy(), rows[label].to_numpy())


def test_folds(spark):
    import zlib

    df = spark.createDataFrame([(7,), (123456,), (None,)], "doc_id long")
    found = collected(df.select(remainder(F.col("doc_id"), 5).alias("r")), "r")
    assert [r for (r,) in found] == [zlib.crc32(x) % 5 for x in (b"7", b"123456", b"")]


def test_quality_of_held_out_rows(spark):
    found = quality.score(table(spark, SF, "documents"), table(spark, SF, "labels"))
    assert found.count() == 1000
    assert held_out(spark, found, "quality") > 0.95


def test_toxicity_of_held_out_rows(spark):
    found = toxicity.score(table(spark, SF, "documents"), table(spark, SF, "labels"))
    assert found.count() == 1000
    assert held_out(spark, found, "toxic") > 0.8


@pytest.mark.parametrize(("score", "label"), [(quality.score, "quality"), (toxicity.score, "toxic")])
def test_scores_of_odd_rows(spark, score, label):
    df = documents(spark, odd_texts())
    labels = spark.createDataFrame(
        [(901, 1), (902, 0), (903, 1), (904, 1), (904, 1), (905, 0), (906, None), (None, 1)],
        f"doc_id long, {label} int",
    )
    for some in (labels, labels.limit(0)):
        found = score(df, some).collect()
        assert len(found) == len(odd_texts())
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    assert score(df.limit(0), labels).count() == 0


def test_accepted_rows_keep_their_columns(spark):
    df = table(spark, SF, "documents").withColumn("score", F.lit("clash"))
    found = quality.accepted(df, table(spark, SF, "labels"))
    assert found.columns == df.columns and 700 < found.count() < 1000


def maximal(scores):
    """Maximal segments by their definition: best of all, then the same left and right of it."""
    best = max(
        ((sum(scores[a:b]), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)),
        default=(0,),
    )
    if best[0] <= 0:
        return []
    a, b = -best[2], -best[2] - best[1]
    right = [(x + b, y + b, s) for x, y, s in maximal(scores[b:])]
    return [*maximal(scores[:a]), (a, b, best[0]), *right]


def test_segments_by_definition():
    rng = random.Random(6)
    for _ in range(150):
        # no partial sums are equal, so there are no ties to settle
        scores = [rng.choice([-3, -1, -2, 1, 2, 4]) + rng.random() / 100 for _ in range(rng.randrange(25))]
        found = toxicity.segments(np.array(scores))
        want = maximal(scores)
        assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in found], [s for *_, s in want])


def plain_words(text):
    out = []
    for word in re.findall(r"[^ \t-\r]+", text or ""):
        word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)
        bare = re.sub(r"^[\x00-/:-`{-\x7f]+|[\x00-/:-`{-\x7f]+$", "", word)
        out.append(bare or word)
    return out


def test_odds_from_plain_counts(spark):
    rng = random.Random(8)
    clean = ["zwölf", "walking", "walked", "walk", "**walker**", "of", "***", "日本語", "x" * 30]
    bad = ["vileness", "vilest", "(((((vile)))))", "of", "walk", "Vilest!"]
    rows = [(i, " ".join(rng.choices(bad if i % 4 == 0 else clean, k=rng.randrange(1, 9)))) for i in range(200)]
    rows += [(300 + i, "unlabelled walk words vilely") for i in range(5)]
    rows += [(r[0], r[1]) for r in odd_texts() if r[0] != 907]
    labels = {i: int(i % 4 == 0) for i in range(150)} | {902: 0}
    df = documents(spark, rows)
    ids = np.array(sorted(labels))
    odds = toxicity.Odds(*toxicity._of_classes(df, ids, np.array([labels[i] for i in ids.tolist()])))
    odds.frequencies(df)

    stems = lambda w: [*(w[:k] for k in toxicity.STEMS), w]
    seen = [Counter(), Counter()]
    every = Counter(w for _, text in rows for w in plain_words(text))
    for i, text in rows:
        if i in labels:
            seen[labels[i]].update({(k, s) for w in plain_words(text) for k, s in enumerate(stems(w))})
    of = [sum(n for (k, _), n in c.items() if k == len(toxicity.STEMS)) for c in seen]
    share = of[1] / sum(of)

    def score(word):
        odd = share
        for k, s in enumerate(stems(word)[:-1]):
            a, b = seen[0][k, s], seen[1][k, s]
            odd = (b + toxicity.LEAST * odd) / (a + b + toxicity.LEAST)
        a, b = (c[len(toxicity.STEMS), word] for c in seen)
        weight = toxicity.LEAST + (toxicity.PRIOR * every[word] / every.total() if a + b else 0)
        a, b = a + weight * (1 - odd), b + weight * odd
        error = np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        return np.log(b / a) - np.log(share / (1 - share)) - toxicity.CAUTION * error - toxicity.OFFSET

    for _, text in [*rows, (0, "unknown vilegone wörter ******vile******")]:
        (block,) = blocks(pa.array([text], pa.string()))
        assert np.allclose(odds.scores(toxicity._tokens(block)), [score(w) for w in plain_words(text)])


def test_chance_of_all_segments():
    rng = random.Random(3)
    texts = [[rng.expovariate(0.5) for _ in range(k)] for k in (0, 1, 2, 30, 0, 200)]
    n, lam, k = np.array([5, 9, 40, 900, 0, 7000]), 0.7, 0.02

    def plain(scores, n):
        best = 0.0
        for r in range(1, len(scores) + 1):
            total = sum(lam * s - math.log(k * max(n, 1)) for s in sorted(scores, reverse=True)[:r])
            if r == 1:
                chance = math.log(1 - math.exp(-math.exp(-total)) + 1e-300)
            elif total > r:
                chance = -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r)
            else:
                continue
            best = max(best, -chance - math.log(r))
        return best

    flat, ptr = np.array([s for x in texts for s in x]), np.cumsum([0, *map(len, texts)])
    found = toxicity.unlikely(flat, ptr, n, lam, k)
    assert np.allclose(found, [plain(x, m) for x, m in zip(texts, n.tolist(), strict=True)])


def test_rising_curve():
    x = np.array([0, 0, 1, 2, 3, 4, 5.0])
    knots, share = toxicity.rising(x, np.array([0, 0, 1, 0, 1, 1, 1.0]))
    assert (np.diff(knots) > 0).all() and (np.diff(share) >= 0).all()


def test_languages(spark):
    docs = table(spark, SF, "documents")
    found = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    right = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


def test_language_of_odd_rows(spark):
    rows = [(*r, "en" if k % 2 else None, "web") for k, r in enumerate(odd_texts())]
    rows += [(k, "the cat sat on the mat", "en", "x") for k in range(20)]
    rows += [(20 + k, "die katze saß auf der matte", "de", "x") for k in range(20)]
    rows += [(50, "12 34 !?", "de", "x"), (51, "matten katzen", None, "x")]
    found = {r.doc_id: r for r in language.identify(documents(spark, rows)).collect()}
    assert {i for i, r in found.items() if r.lang_pred == "und"} == {901, 902, 903, 50}
    assert found[51].lang_pred == "de" and all(0 <= r.score <= 1 for r in found.values())
    assert found[50].score == 0
    nothing = documents(spark, [(1, "some text", None, "x")])
    assert collected(language.identify(nothing), "lang_pred") == [("und",)]
    assert language.identify(documents(spark, rows).limit(0)).count() == 0


def test_a_language_of_one_short_row_takes_no_others(spark):
    docs = table(spark, SF, "documents")
    few = documents(spark, [(10**9 + 1, "vuos bierggu guolli", "xa", "x"), (10**9 + 2, "bierggu", None, "x")])
    found = language.identify(docs.unionByName(few.select(docs.columns))).cache()
    right = found.join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert right.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    of = dict(collected(found.where("lang_pred = 'xa'"), "doc_id", "lang_pred"))
    assert set(of) >= {10**9 + 1, 10**9 + 2} and len(of) < 10


def test_words_seen_once_count(spark):
    rows = [(k, "the cat sat on the mat", "en", "x") for k in range(1, 20)]
    rows += [(101, "zq xj", "de", "x"), (102, "zq", None, "x")]
    learned = language._learned(documents(spark, rows)).where("lang = 'de' and n = 0")
    assert sorted(collected(learned, "seen")) == [(1,), (1,)]
    found = dict(collected(language.identify(documents(spark, rows)), "doc_id", "lang_pred"))
    assert found[102] == "de" and all(found[k] == "en" for k in range(1, 20))


def best_score(text, pieces_of, unknown):
    best = [0.0] + [-np.inf] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(j):
            if text[i:j] in pieces_of:
                best[j] = max(best[j], best[i] + pieces_of[text[i:j]])
        if text[j - 1] not in pieces_of:
            best[j] = max(best[j], best[j - 1] + unknown)
    return best[-1]


def test_best_paths_by_brute_force():
    rng = random.Random(9)
    made = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(25)} | {" ab", " ", " c"}
    made -= {"b"}
    known = [(text, k, -rng.random() * 10) for k, text in enumerate(sorted(made))]
    automaton = pieces.Automaton(known, list(range(1000, 1256)))
    scores = {text: s for text, _, s in known}
    of = {k: s for _, k, s in known}
    texts = ["".join(rng.choice("abc dé") for _ in range(rng.randrange(1, 70))) for _ in range(200)]
    for text, ids in zip(texts, pieces.encode_batch(pa.array(texts), automaton).to_pylist(), strict=True):
        led = " " + text
        got, k = 0.0, 0
        while k < len(ids):
            if ids[k] >= 1000:
                lead = ids[k] - 1000
                k += 1 if lead < 128 else 2
                got += automaton.unknown
            else:
                got += of[ids[k]]
                k += 1
        assert got == pytest.approx(best_score(led, scores, automaton.unknown)), text


def test_round_trip(spark):
    texts = [*odd_texts(), (1, "  two  spaces "), (2, "▁ literal ▁▁"), (3, "\n\n\ttabs\x00"), (4, "x" * 3000)]
    found = pieces.encoded(documents(spark, texts))
    assert found.count() == len(texts) and not found.where("NOT round_trip").count()
    back = pieces.decoded(found.drop("text"))
    assert sorted(collected(back, "doc_id", "text"), key=str) == sorted(
        ((i, t or "") for i, t in texts), key=str
    )
    # the library reads the same text out of the ids
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for text, ids in collected(found.where("text IS NOT NULL"), "text", "ids"):
        if "▁" not in text and "\x00" not in text:
            assert lib.decode(list(ids)) == text
    assert pieces.encoded(documents(spark, texts).limit(0)).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<div class="site-header"><ul class="menu"><li><a href="/">Home</a></li><li><a>About us</a></li></ul></div>
<div class="cookie-notice">We use cookies to improve your visit. Accept all of them now please.</div>
<main id="content"><h1>A title&nbsp;of the
 story</h1><p>First <b>para</b>graph of the story &amp; with quite a few words in it, to be read.
<p>Second paragraph goes on.<br>More</p><div class="advert">Buy now the best thing made by anyone</div>
<ul><li>One point<li>Other point</ul></main>
<aside><p>Related stories you may like</p></aside>
<section class="comments"><h3>Comments</h3><p>I really liked this very much, thanks for writing it down.</p></section>
<form><label>Email</label><input></form><footer>Copyright 2020</footer></body></html>"""


def test_pages(spark):
    stored = table(spark, SF, "pages").withColumn("text", F.lit("clash"))
    odd = stored.limit(1).select(
        F.explode(F.array(F.lit(None), F.lit(""), F.lit(PAGE), F.lit(PAGE), F.lit("<p>" * 50))).alias("html"),
        F.lit(-1).cast("long").alias("page_id"),
        F.lit(None).cast("string").alias("url"),
        "text",
    )
    found = pages.extract(stored.unionByName(odd)).collect()
    assert len(found) == stored.count() + 5
    mine = sorted(r.text for r in found if r.page_id == -1)
    story = "A title of the story\nFirst paragraph of the story & with quite a few words in it, to be read.\n"
    story += "Second paragraph goes on. More\nOne point\nOther point"
    assert mine == ["", "", "", story, story]
    assert all(r.n_chars == len(r.text) for r in found)
    htmls = dict(collected(stored, "page_id", "html"))
    right = sum(
        r.text == "\n".join(t for t, path, _ in pages.leaves(htmls[r.page_id]) if "article" in path)
        for r in found
        if r.page_id >= 0
    )
    assert right >= 0.99 * len(htmls)
    assert pages.extract(stored.limit(0)).count() == 0


def laid_out(html, telling):
    """The page without class, id and role, and without elements that tell what they are for."""
    html = re.sub(r"\s(class|id|role)=(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", html)
    return html if telling else re.sub(r"<(/?)(article|main|nav|header|footer|aside|section|form|dialog)\b", r"<\1div", html)


def test_pages_that_name_nothing(spark):
    htmls = [h for (h,) in collected(table(spark, SF, "pages").orderBy("page_id"), "html")]
    net = pages.trained(htmls[:120])
    rest = htmls[120:]
    article = ["\n".join(t for t, path, _ in pages.leaves(h) if "article" in path) for h in rest]
    for telling in (True, False):
        got = pages.extract_batch([laid_out(h, telling) for h in rest], net)
        same = wrong = 0
        for text, want in zip(got, article, strict=True):
            a, b = Counter(text.split("\n")), Counter(want.split("\n"))
            same += 2 * (a & b).total()
            wrong += (a - b).total() + (b - a).total()
        assert same / (same + wrong) > 0.9
    # a reply stays a reply, however deep its thread
    prose = "<p>Long prose of an article that goes on for a while, as they do, line after line.</p>"
    reply = "<p>I liked this a lot, and would say so to anyone who asks me in the years to come.</p>"
    for deep in (1, 14, 40):
        thread = "<div class=comments>" + "<div>" * deep + reply + "</div>" * deep + "</div>"
        for page in (prose * 3 + "</article>" + thread, prose * 3 + thread + "</article>"):
            (text,) = pages.extract_batch(["<html><body><article><h1>T</h1>" + page + "</body></html>"], net)
            assert "prose" in text and "liked" not in text


def test_paths_hold_each_word_once():
    page = "<div class='a b'><div class=b><ul class=c><li>x<ul><li>y</ul></ul></div></div><p>z"
    assert [(t, path) for t, path, _ in pages.leaves(page)] == [
        ("x", ("div", ".a", ".b", "ul", ".c", "li")),
        ("y", ("div", ".a", ".b", "ul", ".c", "li")),
        ("z", ("p",)),
    ]
    draw = np.random.default_rng(1)
    bare = [("t", ("html", "main", ".a", "div", "p"), 0)]
    assert pages.hidden(bare, 1.0, draw) == [("t", ("html", "div", "p"), 0)]
    assert pages.hidden(bare, 0.0, draw) == bare


def test_long_pages_are_fitted_in_runs(monkeypatch):
    monkeypatch.setattr(pages, "RUN", 3)
    page = "<nav>menu</nav><article>" + "<p>some words of an article</p>" * 10 + "</article><footer>end</footer>"
    net = pages.trained([page] * 20)
    assert pages.extract_batch([page], net) == ["\n".join(["some words of an article"] * 10)]


def test_gradients_are_those_of_the_loss():
    page = [("some words here", ("html", "article", "p"), 0), ("x", ("html", ".ad"), 1), ("two words", ("nav",), 0)]
    sequences, labels = [pages._Sequence(page), pages._Sequence(page[:2])], [[1, 0, 0], [1, 0]]
    net = pages.Labeller(3)

    def loss():
        p = net.probability(sequences)
        flat, y = np.concatenate(p), np.concatenate(labels)
        return -np.mean(np.where(y == 1, np.log(flat), np.log(1 - flat)))

    found = net.gradients(sequences, labels)
    draw = np.random.default_rng(0)
    for name, value in net.p.items():
        for _ in range(4):
            at = tuple(draw.integers(n) for n in value.shape)
            before = value[at]
            value[at] = before + 1e-5
            up = loss()
            value[at] = before - 1e-5
            down = loss()
            value[at] = before
            assert found[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_no_page_stops_the_parser():
    rng = random.Random(9)
    page = "<html><body><nav><a href=x>menu</a></nav><article><p>Some text &amp; more</p></article></body></html>"
    odd = ["<![foo[bar]]>", "<![", "<![ ]>", "<!", "<!-", "<!-->", "<![CDATA[x]]>", "<!DOCTYPE [", "<?", "</", "<a b='", "&#", "&#xffffffff;", "<!ELEMENT"]
    assert [t for t, _, _ in pages.leaves(page.replace("<p>", "<![foo[bar]]><p>"))] == ["menu", "Some text & more"]
    for _ in range(3000):
        text = page
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(odd) + text[at + rng.randrange(4) :]
        pages.leaves(text[: rng.randrange(len(text) + 1)])
