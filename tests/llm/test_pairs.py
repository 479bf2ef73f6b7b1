"""Near duplicates, repeated passages and benchmark passages against brute force."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from knotwork.llm._shared import text_bytes
from knotwork.llm.decontamination import Items, contaminated, without_contaminated
from knotwork.llm.jaccard_join import near_duplicate_classes, one_of_each_class
from knotwork.llm.suffix_dedup import repeated_bytes, without_repeats
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, node long, row long, label string"


def made(seed: int) -> list[tuple[int, str | None]]:
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdeéß", k=r.randint(1, 6))) for _ in range(300)]

    def prose(n: int) -> list[str]:
        return r.choices(vocabulary, k=n)

    rows: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "one  TWO"), (5, "one two three four five")]
    base, passage, line = prose(150), prose(70), prose(18)
    for _ in range(25):
        copy = list(base)
        for _ in range(r.randint(0, 6)):
            copy[r.randrange(len(copy))] = r.choice(vocabulary)
        rows.append((len(rows), " ".join(copy)))
    for _ in range(12):
        rows.append((len(rows), " ".join(base)))
    for _ in range(15):
        own = prose(r.randint(5, 120))
        at = r.randrange(len(own))
        rows.append((len(rows), " ".join(own[:at] + passage + own[at:])))
    for _ in range(30):
        rows.append((len(rows), " ".join(line + prose(r.randint(0, 6)))))
    rows.append((len(rows), "ab " * 4000))
    rows.append((len(rows), "x" * 3000))
    rows.append((len(rows), " ".join(prose(20_000))))
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", 1, 2, "z") for d, t in rows], DOCS).repartition(5)


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    rows = made(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicate_classes(frame(spark, rows)).collect()}
    assert got == brute.classes(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_links_equal_brute_force(spark, seed):
    rows = made(seed)
    rows += [(d + 1000, t) for d, t in rows[:20]]
    sets = {d: brute.shingle_set(t) for d, t in rows}
    links = {a: sum(4 * len(x & y) >= 3 * len(x | y) and bool(x) and a != b for b, y in sets.items()) for a, x in sets.items()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in near_duplicate_classes(frame(spark, rows)).collect()}
    assert got == {d: (*c, links[d]) for d, c in brute.classes(rows).items()} and max(links.values()) > 20


def test_links_where_one_shingle_is_in_hundreds_of_classes(spark):
    r = random.Random(9)
    passage, rows = [f"p{i}" for i in range(30)], []
    for k in range(300):
        own = [f"w{r.randrange(4000)}" for _ in range(r.randint(0, 14))]
        rows.append((len(rows), " ".join(own[:6] + passage + own[6:])))
        if k % 3 == 0:
            copy = own + ["x"]
            rows.append((len(rows), " ".join(copy[:6] + passage + copy[6:])))
    sets = {d: brute.shingle_set(t) for d, t in rows}
    links = {a: sum(4 * len(x & y) >= 3 * len(x | y) and a != b for b, y in sets.items()) for a, x in sets.items()}
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["n_links"]) for x in near_duplicate_classes(frame(spark, rows)).collect()}
    classes = brute.classes(rows)
    assert got == {d: (*c, links[d]) for d, c in classes.items()} and len({c for _, c in classes.values()}) > 100


def test_one_row_of_each_class_stays(spark):
    same, other = "same words again and again here", "quite another text of some words here"
    rows = [(7, same, "a"), (7, same, "a"), (None, same, "b"), (9, "", "c"), (9, "", "c"), (7, other, "d"), (3, other, "e"), (None, "nobody else has these words at all", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Row string").repartition(3)
    kept = one_of_each_class(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.where("Row in ('c', 'e', 'f') or Row = 'a'").dropDuplicates(["Row"]).union(docs.where("Row = 'c'").limit(1)).collect()))


def test_classes_of_empty_and_repeated_rows(spark):
    assert near_duplicate_classes(frame(spark, [(1, "a")]).where("doc_id > 5")).collect() == []
    rows = [(7, "same words again and again here"), (7, "same words again and again here"), (None, "same words again and again here"), (9, "")]
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in near_duplicate_classes(frame(spark, rows)).collect())
    assert got == [(-1, 7), (7, 7), (7, 7), (9, 9)]


@pytest.mark.parametrize("seed", [3, 4])
def test_repeats_equal_brute_force(spark, seed):
    rows = made(seed)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeated_bytes(frame(spark, rows)).collect()}
    assert got == brute.removed(rows)
    wide = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeated_bytes(frame(spark, rows), meet=3).collect()}
    assert wide == got


def test_repeats_around_a_crowded_anchor_equal_brute_force(spark):
    r = random.Random(8)
    line = "".join(r.choices("abcdefgh ", k=160))
    pairs = ["".join(r.choices("ijklmnop ", k=30)) for _ in range(60)]
    rows = [(k, "".join(r.choices("qrstuvw ", k=r.randint(0, 40))) + r.choice(pairs) + line + r.choice(pairs) + "".join(r.choices("qrstuvw ", k=r.randint(0, 9)))) for k in range(4600)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeated_bytes(frame(spark, rows)).collect()}
    assert got == brute.removed(rows) and 300 < sum(x[1] > 0 for x in got.values()) < 4600


def test_texts_without_repeats_keep_columns_of_any_name(spark):
    once = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(260))
    rows = [(2, "a", 1, once + " own", "x"), (3, "b", 2, once, None)]
    docs = spark.createDataFrame(rows, "row long, marks string, doc_id long, Text string, row_ string")
    got = without_repeats(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [(2, "a", 1, " own", "x"), (3, "b", 2, "", None)]


def test_repeats_in_one_text_and_in_repeated_rows(spark):
    once = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(260))
    rows = [(1, once + "|" + once), (2, "unlike"), (None, None)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in repeated_bytes(frame(spark, rows)).collect()}
    assert got == {1: (521, 520), 2: (6, 0), None: (0, 0)}
    twice = repeated_bytes(frame(spark, [(1, once), (1, once)])).collect()
    assert [(r["n_removed"], r["n_spans"]) for r in twice] == [(260, 1), (260, 1)]
    assert repeated_bytes(frame(spark, rows).where("doc_id > 9")).collect() == []


def test_texts_without_repeats_keep_whole_characters(spark):
    once = "é" * 3 + "".join(chr(97 + (i * i + i // 7) % 26) for i in range(260))
    kept = {r["doc_id"]: (r["text"], r["label"]) for r in without_repeats(frame(spark, [(1, once + " own"), (2, once + " ours"), (3, None)])).collect()}
    assert kept == {1: ("wn", "z"), 2: ("urs", "z"), 3: (None, "z")}


def test_leaks_with_repeated_shingles(spark):
    items = [(1, "a b " * 6 + "a"), (2, "c " * 30 + "d e f g h i j k l m"), (3, " ".join(f"w{i}" for i in range(40)))]
    texts = ["b a " * 6 + "b", "x y z " + "b a " * 6 + "b q", "a b " * 300, "c " * 27 + "d e f g h i j k l m", "d e f g h i j k l m " + "c " * 28, " ".join(f"w{i}" for i in range(1, 41))]
    rows = list(enumerate(texts))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(frame(spark, rows), bench).collect()}
    assert got == brute.leaks(rows, items) and {(0, 1), (1, 1), (2, 1)} <= got


def test_windows_of_short_vocabularies_equal_brute_force():
    r = random.Random(6)
    for _ in range(150):
        item = " ".join(r.choices("ab", k=r.randint(5, 25)))
        texts = [" ".join(r.choices("ab", k=r.randint(0, 60))) for _ in range(8)]
        found = Items([7], [item]).matches(*text_bytes(pa.array(texts)), 75)
        assert {(x[0], x[1]) for x in found} == brute.leaks(list(enumerate(texts)), [(7, item)])


def test_leaks_equal_brute_force(spark):
    r = random.Random(5)
    vocabulary = ["".join(r.choices("abcde", k=r.randint(1, 5))) for _ in range(400)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(3, 60)))) for i in range(30)] + [(30, "a b c")]
    rows: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, items[5][1].upper()), (3, items[6][1].replace(" ", "\n "))]
    for k in range(40):
        own, item = r.choices(vocabulary, k=r.randint(0, 200)), r.choice(items)[1].split(" ")
        for _ in range(r.randint(0, 3)):
            item[r.randrange(len(item))] = r.choice(vocabulary)
        at = r.randint(0, len(own))
        rows.append((len(rows), " ".join(own[:at] + item + own[at:])))
    rows.append((len(rows), " ".join(r.choices(vocabulary, k=30_000))))
    bench = spark.createDataFrame([(i, t, "x") for i, t in items] + [(99, None, "x")], "item_id long, text string, doc_id string")
    got = [(r["doc_id"], r["item_id"]) for r in contaminated(frame(spark, rows), bench).collect()]
    assert set(got) == brute.leaks(rows, items) and len(set(got)) == len(got)
    clean = {r["doc_id"] for r in without_contaminated(frame(spark, rows), bench).collect()}
    assert clean == {d for d, _ in rows} - {d for d, _ in got}
    assert contaminated(frame(spark, rows), bench.where("item_id > 1000")).collect() == []
