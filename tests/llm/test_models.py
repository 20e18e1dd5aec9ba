import math
import zlib

import numpy as np
import pytest

from cases import SCHEMA, awkward, documents, prose
from gaugeweave.llm import language_id, toxicity
from gaugeweave.llm.queries import op6_toxicity, op9_language_id

LABELS = "doc_id long, quality int, toxic int, score double, fold int"
SF = "/root/testdata/sf0.01"


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0


def test_ratios_are_those_of_the_formula(spark):
    counts = [("the", 90, 30), ("fool", 0, 25), ("rare", 1, 1), ("kind", 40, 0)]
    ratios, rest = toxicity.log_ratios(spark.createDataFrame(counts, "word string, ordinary long, toxic long"), discount=2.0, share=1e-6)
    n_o, n_t = 131, 56
    lam_o, lam_t = 1 - (88 + 38) / n_o, 1 - (28 + 23) / n_t
    assert rest == pytest.approx(math.log(lam_t / lam_o))
    assert "rare" not in ratios  # wholly left to the shared counts, where it has the same ratio
    for w, o, t in counts:
        p = (o + t) / (n_o + n_t)
        want = math.log((max(t - 2, 0) / n_t + lam_t * p) / (max(o - 2, 0) / n_o + lam_o * p))
        assert ratios.get(w, rest) == pytest.approx(want)


def test_word_counts_equal_brute_force(spark):
    rows = [("a b c", 0), ("a b", 1), ("c d", 1), ("", 0)] * 30
    learning = spark.createDataFrame(rows, "words string, toxic int").repartition(5)
    got = {r["word"]: (r["ordinary"], r["toxic"]) for r in toxicity.word_counts(learning).collect()}
    assert got == {"a": (30, 30), "b": (30, 30), "c": (30, 30), "d": (0, 30)}


def test_toxic_words_are_learned_without_held_out_labels(spark):
    texts = [(i, prose(i, 60) + (" grumble" if i % 7 == 0 else "")) for i in range(1500)]
    labels = [(i, 1, int(i % 7 == 0) if not held(i) else 1 - int(i % 7 == 0), 0.0, 1) for i in range(1500)]  # held-out labels lie
    got = toxicity.toxicity(documents(spark, texts), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == 1500
    for r in got:
        assert r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["predicted"] == int(r["doc_id"] % 7 == 0)


def test_rare_words_count_as_they_do_on_a_small_table(spark, monkeypatch):
    texts = [(i, prose(i, 60) + (f" slur{'abcdefgh'[i % 8]}" if i % 7 == 0 else "")) for i in range(1500)] + [(None, prose(1, 60) + " slurb")]
    labels = spark.createDataFrame([(i, 1, int(i % 7 == 0), 0.0, 1) for i in range(1500)], LABELS)
    docs = documents(spark, texts)
    score = lambda: sorted((r["doc_id"] or -1, r["score"], r["predicted"]) for r in toxicity.toxicity(docs, labels).collect())
    want = score()
    monkeypatch.setattr(toxicity.log_ratios, "__defaults__", (2.0, 0.01))
    monkeypatch.setattr(toxicity, "SHARE", 0.01)  # the planted words and some others are rare now
    got = score()
    assert [(d, p) for d, _, p in got] == [(d, p) for d, _, p in want] and sum(p for *_, p in got) >= 200
    assert np.allclose([x for _, x, _ in got], [x for _, x, _ in want], atol=1e-6)
    kept = {r["doc_id"] for r in toxicity.drop_toxic(docs, labels).collect()}
    assert kept == {d for d, _, p in got if not p and d >= 0}


def test_lists_of_rare_words_and_rows_without_them_are_not_moved(spark, monkeypatch):
    monkeypatch.setattr(toxicity.log_ratios, "__defaults__", (2.0, 0.01))
    monkeypatch.setattr(toxicity, "SHARE", 0.01)
    texts = [(i, prose(i, 60) + (f" slur{'abcdefgh'[i % 8]}" if i % 7 == 0 else "")) for i in range(1500)]
    labels = spark.createDataFrame([(i, 1, int(i % 7 == 0), 0.0, 1) for i in range(1500)], LABELS)
    scored = toxicity.toxicity(documents(spark, texts), labels)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange" in x and "hashpartitioning" in x]
    assert moved and not any("digest" in x for x in moved) and "Union" in plan
    assert sum(r["predicted"] for r in scored.collect()) == len(range(0, 1500, 7))


def test_tasks_receive_as_many_words_as_their_bound_allows(spark, monkeypatch):
    # None of 150 words has a share of 2e-6 of both classes' counts.
    counts = [(f"w{i}", 10 + i % 3, 5) for i in range(150)] + [("once", 1, 2), ("the", 9_000_000, 4_000_000)]
    counts = spark.createDataFrame(counts, "word string, ordinary long, toxic long")
    ratios, rest = toxicity.log_ratios(counts)
    assert len(ratios.hashes) == 151 and toxicity.rare_ratios(counts).isEmpty() and "once" not in ratios
    assert not toxicity.Model(counts).any_rare
    monkeypatch.setattr(toxicity, "TASK_WORDS", 120)
    few, same = toxicity.log_ratios(counts)
    rare = {r["word"]: r["ratio"] for r in toxicity.rare_ratios(counts).collect()}
    assert same == rest and "the" in few and len(few.hashes) <= 120 and len(few.hashes) + len(rare) == 151
    assert all(rare[w] == pytest.approx(ratios.get(w)) and w not in few for w in rare)


def test_awkward_rows_and_missing_labels(spark):
    docs, none = awkward(spark), spark.createDataFrame([], LABELS)
    odd = spark.createDataFrame([(1, 1, 1, 0.0, 1), (None, 1, 1, 0.0, 1), (3, None, None, 0.0, 1), (99, 1, 0, 0.0, 1), (1, 1, 0, 0.0, 1)], LABELS)
    for labels in (none, odd):
        got = toxicity.toxicity(docs, labels).collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
        assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    assert toxicity.drop_toxic(docs, none).count() == docs.count()
    assert toxicity.toxicity(spark.createDataFrame([], SCHEMA), none).count() == 0


def test_held_out_accuracy_on_documents(spark):
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = [(r["predicted"], truth[r["doc_id"]]) for r in op6_toxicity(spark, SF).collect() if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([a == b for a, b in got]) > 0.9


def test_trigram_vectors_bind_permuted_letters():
    a, b, c = (language_id.letter_vector(ord(x)) for x in "abc")
    bound = np.roll(a, 2) * np.roll(b, 1) * c
    first, last = language_id.letter_vector(32), language_id.letter_vector(32)
    want = np.roll(first, 2) * np.roll(a, 1) * b + bound.astype(int) + np.roll(b, 2) * np.roll(c, 1) * last
    got = language_id.Profiles().of(["ABC", "", None, "1 2"])
    assert np.allclose(got[0], want / np.linalg.norm(want), atol=1e-5)
    assert not got[1:].any()


def test_trigrams_of_words():
    unpack = lambda t: sorted("".join(map(chr, (g >> 42, (g >> 21) & 0x1FFFFF, g & 0x1FFFFF))) for g in language_id.grams(t)[0].tolist())
    assert unpack("Ab, 1c!") == sorted([" ab", "ab ", "b c", " c "])
    assert unpack("  ") == [] and unpack("é") == [" é "]


def test_languages_are_learned_without_held_out_rows(spark):
    kinds = {"aa": "bababu kaka muba", "bb": "streng schnell krach", "cc": "жук мир дом"}
    rows = [(i, f"{kinds[k]} {kinds[k][::-1]} {i}", k if not held(i) else "zz") for i in range(300) for k in [list(kinds)[i % 3]]]
    got = language_id.languages(documents(spark, rows)).collect()
    assert len(got) == 300
    for r in got:
        assert r["lang_pred"] == list(kinds)[r["doc_id"] % 3] and 0 < r["score"] <= 1 and r["held_out"] == held(r["doc_id"])


def test_awkward_language_rows(spark):
    docs = awkward(spark)
    got = language_id.languages(docs).collect()
    assert len(got) == docs.count()
    assert all(r["lang_pred"] == ("en" if r["text"] else "und") for r in language_id.languages(docs.where("doc_id < 4")).join(docs.select("doc_id", "text"), "doc_id").collect())
    assert {r["lang_pred"] for r in got if r["doc_id"] in (4, 5, 6)} == {"und"}
    unknown = docs.withColumn("lang", docs["lang"].substr(9, 0)).na.replace("", None, "lang")
    assert {r["lang_pred"] for r in language_id.languages(unknown).collect()} == {"und"}
    assert language_id.languages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_held_out_language_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = [r["lang_pred"] == truth[r["doc_id"]] for r in op9_language_id(spark, SF).collect() if r["held_out"]]
    assert np.mean(got) > 0.98
