"""Operators that look at one row at a time, and the search."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from knotwork.llm import bpe, html_extract, language_id, license_scan, quality, toxicity
from knotwork.llm._labels import Sample, labelled_sample
from knotwork.llm.topk_search import BitSlicedIndex, top_k


def docs(spark, rows):
    return spark.createDataFrame([(d, t, g, "s", 0.5, "und", True) for d, t, g in rows], "doc_id long, text string, lang string, source string, score double, lang_pred string, held_out boolean").repartition(3)


# HTML.


def texts(pages):
    return html_extract.extract(pages, html_extract.trained())


def test_extraction_leaves_the_article():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- x --><div class="cookie-notice">We use cookies</div><div class="ad">Buy this now</div>
<article><h1>Head &amp; title</h1><p>First  paragraph&nbsp;with <b>bold</b>text and a <a href="/x">link</a>, long enough to be read.</p><p>Second one, also with some words in it.<br>New line</article>
<section id="comments"><h3>Comments</h3><div class="comment">I liked it</div></section><footer>&copy; someone</footer></body></html>"""
    assert texts([page]) == ["Head & title First paragraph with boldtext and a link, long enough to be read. Second one, also with some words in it. New line"]


def test_extraction_of_odd_pages():
    assert texts([None, "", "   "]) == ["", "", ""]
    assert texts(["<p>" * 3000 + "a"])[0] in ("a", "")
    assert texts(["<html><body><article><p>Éaux. Éaux.</p></article>"]) == ["Éaux. Éaux."]
    assert "<" not in texts(['<article><p>one two <a href="x>three</p><p>four five six</article>'])[0]


def test_extraction_of_drawn_pages():
    r = random.Random(5)
    lost = held = kept = 0
    for _ in range(150):
        page = html_extract.drawn_page(r)
        nodes, pieces = html_extract.parse(page)
        keep = html_extract.decode(nodes, html_extract.trained().score(html_extract.features(nodes)))
        for node, piece, _ in pieces:
            main = html_extract.MARK in piece
            held += main * len(piece)
            lost += (main and not keep[node]) * len(piece)
            kept += (not main and keep[node]) * len(piece)
    assert lost < 0.01 * held and kept < 0.05 * held


def test_decoding_is_the_best_consistent_choice():
    nodes = [html_extract.Node("root", -1, 0, [])] + [html_extract.Node("div", p, 1, []) for p in (0, 1, 1, 0)]
    odds = np.array([1.0, -2.0, 3.0, -1.0, -4.0])
    assert html_extract.decode(nodes, odds).tolist() == [True, True, True, False, False]
    assert html_extract.decode(nodes, np.array([1.0, -5.0, 3.0, -1.0, 2.0])).tolist() == [True, False, False, False, True]


def test_pages_table(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (1, "u", "<article><p>Some words of text here.</p></article>", "y")], "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_extract.main_texts(pages).collect())
    assert got == [(1, "", 0), (1, "Some words of text here.", 24)]
    assert html_extract.main_texts(pages.where("page_id > 5")).collect() == []


# Language.


def brute_grams(text):
    out = {}
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        framed = f" {w} "
        for g in [*w, *(framed[i : i + 2] for i in range(len(framed) - 1)), *(framed[i : i + 3] for i in range(len(framed) - 2))]:
            out[g] = out.get(g, 0) + 1
    return out


@pytest.mark.parametrize("text", ["The cat sat on the mat.", "Größe, ça va? 42 x", "", "a", "123 ---", "the the the tho"])
def test_ngrams(text):
    codes, counts = np.unique(language_id.gram_codes(language_id._points(text)), return_counts=True)
    assert sorted(counts.tolist()) == sorted(brute_grams(text).values())


def test_languages(spark):
    r = random.Random(1)
    stems = {"aa": ["lon", "mar", "tik", "ola"], "bb": ["schw", "ung", "keit", "über"], "cc": ["zzo", "gli", "ché", "per"]}
    rows = [(k, " ".join("".join(r.choices(stems[g], k=2)) for _ in range(30)), g) for k, g in enumerate(r.choices(list(stems), k=300))]
    rows += [(300, None, "aa"), (301, "", None), (302, "12 34 !!", "aa"), (303, "lonmar tikola " * 20_000, None), (None, "schwung", None)]
    got = language_id.predict_languages(docs(spark, rows)).collect()
    pred = {x["doc_id"]: x["lang_pred"] for x in got}
    assert all(pred[d] == g for d, _, g in rows[:300]) and len(got) == 305
    assert (pred[300], pred[301], pred[302], pred[303], pred[None]) == ("und", "und", "und", "aa", "bb")
    assert all(0 <= x["score"] <= 1 for x in got)
    assert {x["lang_pred"] for x in language_id.predict_languages(docs(spark, [(1, "text", None)])).collect()} == {"und"}


# Licences.


def test_licences(spark):
    mit = license_scan.TEMPLATES["MIT"].split(" ")
    lines = "\n".join(" ".join(mit[i : i + 9]) for i in range(0, len(mit), 9))
    rows = [(1, f"some text\n{lines}\nmore of it here", "en"), (2, "Code.\nReleased under the MIT License.\nEnd", "en"), (3, "of the in the any person", "en"), (4, None, "en"), (5, "", "en"), (5, "LICENSED under the apache license version 2.0!", "en")]
    got = sorted((r["doc_id"], r["license"], r["first_line"]) for r in license_scan.scan(docs(spark, rows)).collect())
    assert got == [(1, "MIT", 1), (2, "MIT-notice", 1), (5, "Apache-2.0-notice", 0)]


def test_licences_inside_lines(spark):
    mit = license_scan.TEMPLATES["MIT"]
    other = " ".join(f"word{i} of the thing" for i in range(300))
    rows = [(1, f"{other} {mit} {other}", "en"), (2, "Copyright 2020 Foo. Released under the MIT License.", "en"), (3, mit.replace(" ", "\r"), "en"), (4, f"one\n{other} Licensed under CC BY-NC 4.0. {other}\nthree", "en"), (5, other, "en")]
    got = sorted((r["doc_id"], r["license"], r["dice"], r["first_line"], r["n_lines"]) for r in license_scan.scan(docs(spark, rows)).collect())
    assert got == [(1, "MIT", 1.0, 0, 1), (2, "MIT-notice", 1.0, 0, 1), (3, "MIT", 1.0, 0, 1), (4, "CC-BY-NC-4.0-notice", 1.0, 1, 1)]


def test_versions_of_licences():
    every = license_scan.all_templates()
    t = license_scan.Templates(every, 80)
    other = "of the thing and other words " * 20

    def found(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return [x[1] for x in t.matches(data, np.array([0, len(data)]), words=True)]

    for name in every:
        assert found(f"{other} {every[name]} {other}") == [name], name
    assert found("This is licensed under the GNU General Public License, version 2.") == ["GPL-2.0-notice"]
    assert found("one " + every["GPL-2.0-notice"] + " two " + every["GPL-3.0-notice"]) == ["GPL-3.0-notice", "GPL-2.0-notice"]
    copy = every["LGPL-2.1-text"].split()
    assert found(" ".join(copy[:2000] + ["changed"] * 40 + copy[2040:])) == ["LGPL-2.1-text"]


def test_licence_windows_equal_brute_force():
    r = random.Random(4)
    own = {("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("a", "c"), ("c", "b")}
    t = license_scan.Templates({"x": "a b c d a c b"}, 70)
    for _ in range(200):
        words = r.choices("abcde", k=r.randint(0, 40))
        runs = [set(zip(words[i:j], words[i + 1 : j])) for i in range(len(words)) for j in range(i + 2, len(words) + 1)]  # noqa: B905
        best = max((2 * len(b & own) / (len(b) + len(own)) for b in runs), default=0)
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        got = t.matches(data, np.array([0, len(data)]), words=True)
        assert (got[0][2] if got else None) == (pytest.approx(best) if best >= 0.7 else None)


def test_licence_runs_equal_brute_force():
    r = random.Random(3)
    template = license_scan.TEMPLATES["ISC"]
    bigrams = lambda s: {(a, b) for w in [re.findall(r"[a-z0-9]+", s.lower())] for a, b in zip(w, w[1:])}  # noqa: B905, E731
    own = bigrams(template)
    t = license_scan.Templates({"ISC": template}, 60)
    for _ in range(30):
        words = template.split(" ")
        for _ in range(r.randint(0, 12)):
            words[r.randrange(len(words))] = r.choice(["other", "thing", "of"])
        text = "".join(w + r.choice([" ", " ", "\n"]) for w in words)
        rows = text.split("\n")
        best = max((2 * len(b & own) / (len(b) + len(own)) for i in range(len(rows)) for j in range(i, len(rows)) if (b := bigrams("\n".join(rows[i : j + 1])))), default=0)
        data = np.frombuffer(text.encode(), np.uint8)
        got = t.matches(data, np.array([0, len(data)]))
        assert (got[0][2] if got else None) == (pytest.approx(best) if best >= 0.6 else None)


# BPE.


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    tables = pytest.importorskip("public_tokenizers")
    path = tables.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    coder = bpe.WordBpe(bpe.read_vocabulary(path))
    odd = ["", " ", "İstanbul ΣΑΣ<|endoftext|>x 's don't I'LL été   a　b\x85c ½ ² 10,000 \U0001f600\U0001f44d\U0001f3fd", "a" * 3000, "ab" * 400 + " 漢字かな\t\r\n<|startoftext|>", "été"]
    for text in odd:
        ids = library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == ids and coder.decode(ids) == library.decode(ids, skip_special_tokens=False)
        n, a, b = coder.digests(text)
        assert n == len(ids) and coder.digests(text) == (n, a, b)
    frame = docs(spark, [(k, t, "en") for k, t in enumerate([*odd, None])])
    encoded = bpe.encode_documents(frame, path)
    back = {r["doc_id"]: r["text"] for r in bpe.decode_documents(encoded, path).collect()}
    assert back[5] == library.decode(library.encode(odd[5], add_special_tokens=False).ids, skip_special_tokens=False) and back[6] == ""
    assert bpe.round_trip_digests(frame.where("doc_id > 99"), path).collect() == []


# Toxicity and quality.


def test_folding():
    assert toxicity.fold("Ідіоt 1d1ot").split() == ["idiot", "idiot"]
    assert toxicity.fold("l.o.s-er! L​oser").split() == ["ioser", "ioser"]
    assert toxicity.fold(None).strip() == ""


def labelled(spark):
    r = random.Random(2)
    plain = ["".join(r.choices("abcdefgh", k=5)) for _ in range(200)]
    rows, labels = [], []
    for k in range(600):
        words, bad = r.choices(plain, k=r.randint(20, 150)), k % 5 == 0
        if bad:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(["moron", "M0ron", "trash"])
        elif k % 5 == 1:
            words[3:5] = ["trash", "can"]
        junk = k % 3 == 0
        if junk:
            words = [w.upper() + "$$$" for w in words] if k % 2 else words[:2] * 40
        rows.append((k, " ".join(words), "en"))
        labels.append((k, int(not junk), int(bad and not junk)))
    rows += [(600, None, "en"), (601, "", "en"), (602, "moron " * 30_000, "en"), (None, "trash", None)]
    return docs(spark, rows), spark.createDataFrame([*labels, (1, None, None), (None, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    d, labels = labelled(spark)
    known = {r["doc_id"]: r["toxic"] for r in labels.where("doc_id is not null and toxic is not null").collect()}
    got = toxicity.predict_toxicity(d, labels).collect()
    wrong = [r["doc_id"] for r in got if r["doc_id"] in known and known[r["doc_id"]] != r["predicted"]]
    assert len(got) == 604 and len(wrong) < 12
    by = {r["doc_id"]: r for r in got}
    assert by[602]["predicted"] == 1 and by[600]["predicted"] == by[601]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in toxicity.predict_toxicity(d, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.learn_lexicon(Sample([], [], {})).score("x") == 0.0


def test_exceptions_do_not_count():
    lexicon = toxicity.Lexicon({" trash ": 5.0, " mor": 1.0, " moron ": 6.0}, [" trash can "], [0.0, 1.0, 0.0])
    assert lexicon.sums("the trash can")[0] == 0 and lexicon.sums("trash can trash")[0] == 5 and lexicon.sums("moron")[0] == 6


def test_quality(spark):
    d, labels = labelled(spark)
    known = {r["doc_id"]: r["quality"] for r in labels.where("doc_id is not null and quality is not null").collect()}
    got = quality.predict_quality(d, labels).collect()
    wrong = [r["doc_id"] for r in got if r["held_out"] and r["doc_id"] in known and known[r["doc_id"]] != r["predicted"]]
    assert len(got) == 604 and len(wrong) < 6 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality.predict_quality(d, labels.where("quality = 1")).collect()} == {1.0}


def test_gradients_of_the_bag_network():
    r = np.random.default_rng(1)
    net, x, first = quality.AttentionBag(), r.normal(size=(9, quality.FEATURES)), np.array([0, 2, 3, 9])
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([0.5, 0.2, 0.3])

    def loss():
        p = net.forward(x, first)["y"]
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    f = net.forward(x, first)
    grads = net.gradients(f, weight * (f["y"] - y))
    for name, value in net.p.items():
        at = tuple(int(r.integers(s)) for s in value.shape)
        old = value[at]
        value[at] = old + 1e-5
        up = loss()
        value[at] = old - 1e-5
        assert (up - loss()) / 2e-5 == pytest.approx(grads[name][at], abs=1e-6)
        value[at] = old


def test_sample_is_bounded(spark):
    d, labels = labelled(spark)
    s = labelled_sample(d, labels, "quality", ~language_id.held_out(5, 0), each=20)
    assert len(s.texts) <= 40 and set(s.labels) == {0, 1} and all(w > 1 for w in s.weight.values())


# Search.


def test_search_equals_brute_force(spark):
    r = np.random.default_rng(4)
    vectors = r.normal(size=(400, 16)) * np.where(r.random(400) < 0.1, 40, 1)[:, None]
    vectors[50:90] = vectors[7]
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(vectors)]
    rows += [(1000, None), (1050, [1.0, None]), (1100, [float("nan")] * 16), (1150, [float("inf")] * 16), (None, rows[0][1]), (1200, []), (50, rows[3][1])]
    got = top_k(spark.createDataFrame([(i, v, 1, "a") for i, v in rows], "vec_id long, embedding array<float>, rank int, v string")).collect()
    good = [(i, np.floor(np.float32(v).astype(float) * 256).astype(np.int64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    want = set()
    for q, x in good:
        if q % 50 == 0:
            s = sorted((-int(x @ y), i) for i, y in good if i != q)[:5]
            want |= {(q, k + 1, i, -z) for k, (z, i) in enumerate(s)} if q != 50 else set()
    assert {tuple(g) for g in got if g["query_id"] != 50} == want
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    huge = spark.createDataFrame([(0, [1e30, 1.0]), (1, [0.5, 2.0]), (2, [-1e30, 3.0]), (50, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r["vec_id"], r["score"]) for r in top_k(huge).where("query_id = 50 and vec_id = 1").collect()][0][1:] == (1, 256 * (128 + 512))


def test_slices_add_up():
    r = np.random.default_rng(5)
    values = r.integers(-300, 300, (500, 8))
    index = BitSlicedIndex(values, 20)
    q = r.integers(-50, 50, 8)
    sums = index.sums(q.tolist())
    got = sum(np.unpackbits(s.view(np.uint8), bitorder="little")[:500].astype(np.int64) << b for b, s in enumerate(sums))
    exact = values @ q
    assert np.unique(got - exact).size == 1
    assert index.kth(sums, 5) == np.sort(got)[-5]
    assert set(np.argsort(-exact)[:5]) <= set(BitSlicedIndex(values, 5).candidates(q, 5).tolist())
