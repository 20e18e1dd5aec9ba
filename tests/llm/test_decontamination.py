import random

import numpy as np
import pytest

from cases import SCHEMA, awkward, documents, edited, prose
from gaugeweave.llm import decontamination as d

BENCH = "item_id long, text string, doc_id long, score double"


def bench(spark, items):
    return spark.createDataFrame([(i, t, 0, 0.0) for i, t in items], BENCH)


def smith_waterman(a, b):
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(max(0, above[j] + (d.MATCH if x == y else d.OTHER), above[j + 1] + d.GAP, now[-1] + d.GAP))
        best, above = max(best, *now), now
    return best


def test_alignment_equals_brute_force():
    rng = random.Random(1)
    items = [[rng.randrange(6) for _ in range(rng.randrange(1, 20))] for _ in range(80)]
    texts = [[rng.randrange(6) for _ in range(rng.randrange(1, 40))] for _ in range(80)]
    assert d.alignment_scores(items, texts).tolist() == [smith_waterman(a, b) for a, b in zip(items, texts)]


def test_copies_and_edits_are_found_and_clean_documents_left(spark):
    items = [(i, prose(1000 + i, 40)) for i in range(20)]
    texts = [(i, prose(i, 300)) for i in range(60)]
    for i in range(60, 80):
        item = items[i - 60][1]
        texts.append((i, prose(i, 100) + " " + (item if i % 3 == 0 else edited(item, 6) if i % 3 == 1 else item.upper().replace(" ", ", ")) + " " + prose(i + 500, 90)))
    got = d.contamination(documents(spark, texts), bench(spark, items)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, i - 60) for i in range(60, 80)}
    assert all(0.5 <= r["score"] <= 1 for r in got)


def test_scores_equal_brute_force_for_all_pairs(spark):
    items = [(i, prose(2000 + i, 25)) for i in range(5)]
    texts = [(i, prose(i, 50) + " " + edited(items[i % 5][1], 4 + i)) for i in range(12)]
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in d.contamination(documents(spark, texts), bench(spark, items)).collect()}
    for doc, text in texts:
        for item, words in items:
            a, b = d.words_of(words), d.words_of(text)
            share = smith_waterman(a, b) / (d.MATCH * len(a))
            assert ((doc, item) in got) == (share >= 0.5)
            if share >= 0.5:
                assert got[doc, item] == pytest.approx(share)


def test_a_passage_in_most_documents_is_found(spark):
    item = prose(77, 30)
    texts = [(i, prose(i, 60) + (" " + item if i % 3 else "")) for i in range(200)]
    got = {r["doc_id"] for r in d.contamination(documents(spark, texts), bench(spark, [(5, item)])).collect()}
    assert got == {i for i in range(200) if i % 3}


def test_a_frequent_excerpt_is_found_beside_a_whole_copy(spark):
    item = prose(66, 50)
    excerpt = " ".join(item.split(" ")[:32])
    texts = [(0, prose(0, 60) + " " + item)] + [(i, prose(i, 60) + (" " + excerpt if i <= 25 else "")) for i in range(1, 40)]
    got = {r["doc_id"] for r in d.contamination(documents(spark, texts), bench(spark, [(5, item)])).collect()}
    assert got == set(range(26))


def test_long_items_are_found_by_their_segments(spark):
    item = prose(88, 400)
    part = " ".join(item.split(" ")[128:192])
    got = d.contamination(documents(spark, [(1, prose(1, 200) + " " + part), (2, prose(2, 200))]), bench(spark, [(1, item)])).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 1)]


def test_awkward_rows(spark):
    items = bench(spark, [(1, None), (2, ""), (3, "two words"), (None, prose(1, 300)), (4, prose(1, 300)), (4, prose(1, 300))])
    docs = awkward(spark)
    got = {(r["doc_id"], r["item_id"]) for r in d.contamination(docs, items).collect()}
    assert got == {(1, 4), (2, 4), (3, 4)}
    kept = d.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4  # the copy without an id cannot be named
    empty = spark.createDataFrame([], SCHEMA)
    assert d.contamination(empty, items).count() == 0 and d.contamination(docs, bench(spark, [])).count() == 0


def test_words_drop_punctuation():
    assert d.words_of("Él dijo: «No» — ¿sí? O'Neil’s") == [w.encode() for w in "él dijo no sí o neil s".split()]
    assert np.all([w for w in d.words_of("x_y 3.5")])
