import hashlib
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import SCHEMA, awkward, documents, edited, prose
from gaugeweave.llm import exact_dedup, minhash_dedup
from gaugeweave.llm.components import components


def brute_components(rows, words, percent):
    sets = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        s = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
        sets.setdefault(doc, []).append(s)
    root = {d: d for d in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(root), 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: find(d) for d in root}, sets


def test_near_duplicates_equal_brute_force(spark):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want, sets = brute_components(rows, 2, 80)
    got = minhash_dedup.near_duplicates(docs, words=2).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
            assert r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]}


def test_chain_of_edits_is_one_component(spark):
    text, rows = prose(9, 400), []
    for i in range(12):  # neighbours are similar, ends are not
        rows.append((100 - i, text))
        words = text.split(" ")
        words[i * 30 : i * 30 + 12] = [f"new{i}x{k}" for k in range(12)]
        text = " ".join(words)
    want, _ = brute_components(rows, 5, 80)
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(documents(spark, rows)).collect()}
    assert got == want and set(got.values()) == {89}


def test_families_below_the_threshold_stay_apart(spark):
    base = prose(11, 200).split(" ")
    rows = [(f * 100 + k, " ".join(base[:150] + [f"f{f}w{i}" for i in range(50)] + [f"k{k}"])) for f in range(6) for k in range(9)]
    want, _ = brute_components(rows, 2, 80)
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(documents(spark, rows), words=2).collect()}
    assert got == want


def test_dropping_keeps_one_of_each_group_and_rows_without_id(spark):
    docs = awkward(spark)
    kept = minhash_dedup.drop_near_duplicates(docs, words=2)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] for r in kept.select("doc_id").collect() if r["doc_id"] is not None))
    want, _ = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], 2, 80)
    assert ids == sorted([d for d, c in want.items() if d == c] + [12])
    assert kept.where("doc_id IS NULL").count() == 2


def test_miss_probability_of_the_tensored_keys():
    rng, missed = np.random.default_rng(5), 0
    for _ in range(300):
        pool = rng.integers(0, 2**64, 450, dtype=np.uint64)
        a, b = np.unique(pool[:425]), np.unique(pool[25:])  # similarity 400 / 450
        x, y = minhash_dedup.minimum_hashes(a), minhash_dedup.minimum_hashes(b)
        same = (minhash_dedup.small_collections(x) == minhash_dedup.small_collections(y)).sum()
        missed += same < 2
    assert missed == 0


def test_prefix_pairs_hold_every_pair_at_the_threshold(spark):
    rng, rows = np.random.default_rng(8), []
    passage = [f"p{i}" for i in range(60)]
    for f in range(12):  # families that share a passage; members at, above and below the threshold
        base = passage + [f"f{f}w{i}" for i in range(40)]
        for k, edits in enumerate((0, 3, 6, 9, 10, 11, 12, 25)):
            words = list(base)
            for at in rng.choice(100, edits, replace=False):
                words[at] = f"f{f}k{k}e{at}"
            rows.append((f * 10 + k, " ".join(words)))
    rows.append((3, rows[20][1]))  # an id with two texts
    docs = documents(spark, rows + rows[:5]).select("doc_id", "text")
    _, sets = brute_components(rows, 1, 80)
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if any(100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b])}
    alone = docs.select("doc_id").distinct().selectExpr("doc_id", "doc_id AS component")
    sizes = minhash_dedup.fingerprints(docs, 1, 4).selectExpr("doc_id", "n", "array_repeat(7, 14) AS parts")
    got = {(r["a"], r["b"]) for r in minhash_dedup.prefix_pairs(alone, sizes, docs, 1, 80).collect()}
    assert want and want <= got
    assert all(a // 10 == b // 10 or 3 in (a, b) for a, b in got)  # the shared passage alone brings none together
    apart = alone.selectExpr("doc_id", "0L AS component")
    assert minhash_dedup.prefix_pairs(apart, sizes, docs, 1, 80).isEmpty()


def test_unlike_members_of_a_family_make_no_pair(spark):
    """Every member holds 60 of the same 100 words, so all prefixes meet; only pairs that may be similar become rows."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{k}" for k in sorted(rng.choice(100, 60, replace=False)))) for i in range(60)]
    rows += [(100, rows[0][1]), (101, rows[1][1] + " more"), (102, " ".join(rows[2][1].split(" ")[:-12]))]
    docs = documents(spark, rows).select("doc_id", "text")
    _, sets = brute_components(rows, 1, 80)
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if any(100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b])}
    alone = docs.selectExpr("doc_id", "doc_id AS component")
    sizes = minhash_dedup.fingerprints(docs, 1, 4).withColumn("parts", F.expr("array_repeat(7, 14)"))
    got = {(r["a"], r["b"]) for r in minhash_dedup.prefix_pairs(alone, sizes, docs, 1, 80).collect()}
    assert {(0, 100), (1, 101), (2, 102)} <= want <= got and len(got) < 20


def test_chain_is_joined_without_hubs(spark, monkeypatch):
    """Links that the rounds of hubs miss are found by prefixes."""
    whole, calls = minhash_dedup.confirmed, []

    def late(pairs, *rest):
        calls.append(pairs)
        return whole(pairs.limit(0) if len(calls) < 3 else pairs, *rest)

    monkeypatch.setattr(minhash_dedup, "confirmed", late)
    test_chain_of_edits_is_one_component(spark)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert minhash_dedup.near_duplicates(empty).count() == 0
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert minhash_dedup.drop_near_duplicates(empty).count() == 0
    assert exact_dedup.drop_exact_duplicates(empty).count() == 0


@pytest.mark.parametrize("links", [[], [(1, 1)], [(1, 2), (2, 3), (9, 8), (3, 9), (20, 21), (None, 4), (4, None)]])
def test_components(spark, links):
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == ({1: 1, 2: 1, 3: 1, 8: 1, 9: 1, 20: 20, 21: 20} if len(links) > 1 else {})


def test_a_long_chain_is_one_component(spark):
    links = spark.range(1, 300).selectExpr("id AS a", "id + 1 AS b")
    assert {r["component"] for r in components(links).collect()} == {1}


def brute_exact(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc is None, doc or 0, doc))
    return {k: (min(v)[3], len(v)) for k, v in groups.items()}


def test_exact_duplicates_equal_brute_force(spark):
    docs = awkward(spark).repartition(7)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute_exact(rows)
    got = exact_dedup.exact_duplicates(docs).collect()
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    assert len(got) == len(rows)
    for r in got:
        assert (r["keep_id"], r["group_size"]) == by_sha[r["text_sha256"]]
        assert r["kept"] == (r["doc_id"] == r["keep_id"])


def test_more_partitions_than_a_round_takes(spark):
    docs = documents(spark, [(i, f"text {i % 5}" + " " * (i % 3)) for i in range(300)]).repartition(100)
    got = exact_dedup.exact_duplicates(docs)
    assert got.select("keep_id", "group_size").distinct().count() == 5
    assert {r[0] for r in got.where("kept").select("doc_id").collect()} == {2, 5, 8, 11, 14}


def test_a_row_that_only_differs_in_its_witness_is_not_merged():
    import pyarrow as pa

    names = ["run", "digest", "witness", "size", "points", "doc_id", "n"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in ([0, 0], [b"x", b"x"], [1, 2], [3, 3], [3, 3], [1, 2], [1, 1])], names=names)
    assert sum(len(out) for out in exact_dedup.merge_run(iter([batch]))) == 2


def test_dropping_exact_copies_keeps_one_row_of_each_text(spark):
    docs = awkward(spark)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in kept.collect()]
    assert sorted(texts) == sorted({re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in docs.collect()})


def test_edits_are_no_exact_copies(spark):
    base = prose(1, 50)
    docs = documents(spark, [(1, base), (2, edited(base, 40)), (3, base.replace(" ", "\n"))])
    assert sorted(r["doc_id"] for r in exact_dedup.drop_exact_duplicates(docs).collect()) == [1, 2]
