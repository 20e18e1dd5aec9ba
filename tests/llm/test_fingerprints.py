import hashlib
import random

import pytest

from cases import SCHEMA, awkward, documents, edited, prose
from gaugeweave.llm import fingerprints as fp
from gaugeweave.llm.fingerprints import Spliceable, changed, first_ids, fingerprint, likeness, of_text, splices


def brute(rows):
    """Followers by sorting everything, fingerprints afresh."""
    placed = sorted(((i, t or "") for i, t in rows if i is not None), key=lambda r: (r[0], r[1].encode()))
    pairs = [(i, t, placed[(k + 1) % len(placed)][1]) for k, (i, t) in enumerate(placed)]
    pairs += [(None, t or "", t or "") for i, t in rows if i is None]
    out = []
    for i, text, follower in pairs:
        half = len(text) // 2
        other = text[: len(text) - half] + follower[:half]
        own = of_text(text)
        out.append((i, len(text), other, own.hex(), of_text(other).hex(), own.likeness(of_text(other)), own.likeness(of_text(follower))))
    return sorted(out, key=str)


def same(docs, parts=None):
    got = sorted((tuple(r) for r in splices(docs, parts).collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    return got


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_followers_across_ranges_equal_brute_force(spark, parts):
    same(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), parts)
    same(awkward(spark), parts)


def test_spread_ids_ties_and_single_rows(spark):
    rng = random.Random(3)
    ids = [rng.randrange(-(2**62), 2**62) for _ in range(300)] + [2**63 - 1, 2**63 - 2, -(2**63), 5, 5, 5, 5]
    rows = [(i, prose(k, rng.randrange(30)) + "\n" * rng.randrange(3) + prose(k + 1, 9)) for k, i in enumerate(ids)]
    same(documents(spark, rows + rows[:3] + [(None, None), (None, "a b")]), 20)
    same(documents(spark, [(7, "lonely text")]), 4)
    same(documents(spark, [(None, "lonely text")]), 4)
    assert splices(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ranges_are_even(spark):
    firsts = first_ids(spark.range(10_000).selectExpr("id * id AS doc_id"), 10)
    assert len(firsts) == 10 and firsts[0] == 0
    sizes = [sum(a <= i * i < b for i in range(10_000)) for a, b in zip(firsts, [*firsts[1:], 10**9])]
    assert max(sizes) < 2 * min(sizes)


def test_order_of_paragraphs_does_not_matter_but_their_number_does():
    a, b, c = "first one here", "the second", "third"
    assert of_text("\n".join([a, b, c])) == of_text("\n".join([c, a, b]))
    assert of_text("\n".join([a, b])) != of_text("\n".join([a, b, b]))
    assert of_text(f"{a}\n{b}") != of_text(f"{a}\n\n{b}") and of_text("") != of_text("\n")
    assert of_text("ab") != of_text("ba") and of_text(a + " " + b) != of_text(b + " " + a)
    assert of_text("x" * 70_000) != of_text("x" * 70_001)
    assert len({of_text(str(i)).hex() for i in range(2000)}) == 2000


def test_insertion_and_deletion_without_the_text(spark):
    rows = [(i, "\n".join(prose(i * 7 + k, 12) for k in range(4)), prose(i, 5) + "\n" + prose(i + 50, 6)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more string")
    known = fingerprint(docs)
    grown = changed(known, insert="more")
    whole = {r["doc_id"]: r["fingerprint"] for r in fingerprint(docs.selectExpr("doc_id", "concat(more, '\\n', text) AS text")).collect()}
    assert {r["doc_id"]: r["fingerprint"] for r in grown.collect()} == whole
    back = {r["doc_id"]: r["fingerprint"] for r in changed(grown, delete="more").collect()}
    assert back == {r["doc_id"]: r["fingerprint"] for r in known.collect()}
    assert fp.Fingerprint.of_hex(whole[3]).hex() == whole[3]
    odd = spark.createDataFrame([(None, "a"), (of_text("b").hex(), None), (of_text("b").hex(), "")], "fingerprint string, more string")
    assert [r["fingerprint"] for r in changed(odd, insert="more").collect()] == [None, of_text("b").hex(), of_text("b").hex()]


@pytest.mark.parametrize("seed", range(5))
def test_splicing_by_deletion_and_insertion_equals_hashing_afresh(seed):
    rng = random.Random(seed)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab \n é日") for _ in range(rng.randrange(40))) for _ in range(2))
        text, print_ = Spliceable(a).edited(b)
        half = len(a) // 2
        assert text == a[: len(a) - half] + b[:half]
        assert print_ == of_text(text) and Spliceable(a).whole == of_text(a)


def test_likeness_follows_the_share_of_equal_text(spark):
    base = prose(1, 900)
    words = base.split(" ")
    near = [(1.0, base), (0.75, " ".join(words[:675]) + " " + prose(5, 225)), (0.5, " ".join(words[:450]) + " " + prose(6, 450)), (0.0, prose(77, 900))]
    values = [of_text(base).likeness(of_text(t)) for _, t in near]
    assert values[0] == 1.0 and all(x > y + 0.1 for x, y in zip(values, values[1:]))
    assert all(abs(v - s) < 0.2 for v, (s, _) in zip(values, near))
    assert of_text("").likeness(of_text("")) == 1.0 and of_text("").likeness(of_text("some text")) == 0.0
    assert of_text(base).likeness(of_text(edited(base, 50))) > 0.6
    pairs = spark.createDataFrame([(of_text("a b").hex(), of_text("a b").hex()), (None, "00")], "a string, b string")
    assert [r["likeness"] for r in likeness(pairs, "a", "b").collect()] == [1.0, None]


def test_long_texts_in_pieces_equal_one_piece(monkeypatch):
    text = "\n".join(prose(i, 60) for i in range(20))
    whole = of_text(text)
    monkeypatch.setattr(fp, "CHUNK", 97)
    assert of_text(text) == whole


def test_awkward_rows_and_replaced_columns(spark):
    docs = awkward(spark).withColumnRenamed("key", "fingerprint")
    got = fingerprint(docs).collect()
    assert len(got) == docs.count() and all(r["fingerprint"] == of_text(r["text"]).hex() for r in got)
    assert fingerprint(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hashlib.sha512(b"a b").digest().hex() == of_text("a b").hex()[:128]
