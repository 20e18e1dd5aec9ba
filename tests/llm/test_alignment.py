import hashlib
import random
from collections import Counter

import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cases import SCHEMA, awkward
from gaugeweave.llm import alignment
from gaugeweave.llm.alignment import Aligner, SideA, align, counted, overlaps, pair_counts
from gaugeweave.llm.bpe import byte_letters
from gaugeweave.llm.queries import op13_alignment
from gaugeweave.session import materialize

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", "a", " ", "  x  y\n\n", "é日本🙂▁x", "<|endoftext|> <s></s> <unk> <0x41>", "\x00 z", "\t\ttab 　x", "naïve ﬁ ①",
       "word" * 5000, "日" * 4000, "don't I'll  we've\r\n1234567 x.y", "﻿bom"]


@pytest.fixture(scope="module")
def sides():
    library, letters = Tokenizer.from_file(A), byte_letters()
    library.encode_special_tokens = True
    library.no_truncation()
    library.no_padding()
    pieces = {i: bytes(map(letters.__getitem__, t)) for t, i in library.get_vocab().items() if t != "<|endoftext|>"}
    return library, pieces, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(sides, text):
    """Counts, groups and links of one text by walking over both sides' ends."""
    library, pieces, model = sides
    if not text:
        return 0, 0, 0, 0, "", Counter()
    whole = (" " + text).encode()
    a, b = library.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
    bytes_a = [pieces[i] for i in a]
    names = [model.id_to_piece(i) for i in b]
    bytes_b = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, names)]
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return 0, 0, 0, 0, "", Counter()
    i = j = end_a = end_b = 0
    groups, group_a, group_b, links = [], [], [], Counter()
    while i < len(a) or j < len(b):
        if end_a <= end_b and i < len(a):
            end_a += len(bytes_a[i])
            group_a.append(a[i])
            i += 1
        else:
            end_b += len(bytes_b[j])
            group_b.append(b[j])
            j += 1
        if end_a == end_b:
            groups.append((group_a, group_b))
            links[group_a[-1], group_b[-1]] += 1
            group_a, group_b = [], []
    # In a group without a common end inside, m and n tokens overlap in m + n - 1 pairs.
    n_overlaps = sum(len(x) + len(y) - 1 for x, y in groups)
    texts = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    return len(a), len(b), len(groups), n_overlaps, texts, links


def seen(row):
    return (row["n_a"], row["n_b"], row["n_groups"], row["n_overlaps"], row["groups"], Counter({(x["a"], x["b"]): x["n"] for x in row["links"]}))


def test_overlaps_of_random_ranges_equal_all_pairs():
    rng = random.Random(4)
    for _ in range(50):
        a, b = [], []
        base = 0
        for doc in range(rng.randrange(1, 5)):
            size = rng.randrange(0, 30)
            for side in (a, b):
                cuts = sorted({0, size, *(rng.randrange(size + 1) for _ in range(8))})
                side += [(doc, base + s, base + e) for s, e in zip(cuts, cuts[1:])]
            base += size
        left, right = (pd.DataFrame(x, columns=["doc", "at", "end"], dtype="int64") for x in (a, b))
        got = list(zip(*(x.tolist() for x in overlaps(left, right))))
        assert got == [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[1] < y[2] and y[1] < x[2]]


def test_whole_query_equals_brute_force(spark, sides):
    got = {r["doc_id"]: r for r in op13_alignment(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    known = {r["doc_id"]: brute(sides, r["text"]) for r in docs}
    totals = sum((k[5] for k in known.values()), Counter())
    most = {}
    for (_, b), n in totals.items():
        most[b] = max(n, most.get(b, 0))
    assert len(got) == len(docs)
    for doc_id, (n_a, n_b, n_groups, n_overlaps, groups, links) in known.items():
        r = got[doc_id]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_overlaps"], r["n_links"]) == (n_a, n_b, n_groups, n_overlaps, sum(links.values()))
        assert r["groups_sha256"] == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        assert r["n_best"] == sum(n for p, n in links.items() if totals[p] == most[p[1]])
        assert r["count_sum"] == sum(n * totals[p] for p, n in links.items())


def test_awkward_rows(spark, sides):
    docs = awkward(spark).unionByName(spark.createDataFrame([(100 + i, t, "en", "s", 1, "k", 7, "c", 0, "z") for i, t in enumerate(ODD)], SCHEMA))
    docs = docs.withColumnRenamed("key", "links").withColumnRenamed("n", "block")
    rows = align(docs, A, B).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert seen(r) == brute(sides, r["text"])
    assert [r["n_a"] for r in rows if r["text"] and "▁" in r["text"]] == [0]
    written = materialize(align(docs, A, B), "aligned")
    sums = counted(written)
    assert sums.count() == docs.count() and "block" not in sums.columns and "lang" in sums.columns
    empty = materialize(align(spark.createDataFrame([], SCHEMA), A, B), "aligned")
    assert counted(empty).count() == 0 and pair_counts(empty).count() == 0


def test_small_batches_give_the_same(monkeypatch):
    aligner = Aligner(open(A, encoding="utf-8").read(), open(B, "rb").read())
    texts = [f"a text of {i % 7} words and number {i}" for i in range(60)]
    whole = aligner.aligned(texts)
    parts = [aligner.aligned(texts[i : i + 7]) for i in range(0, 60, 7)]
    for k, column in enumerate(whole):
        assert column.to_pylist() == [x for p in parts for x in p[k].to_pylist()]
    monkeypatch.setattr(alignment, "BATCH_BYTES", 40)
    batch = pa.RecordBatch.from_arrays([pa.array(texts + [None, "x" * 100, ""])], names=["text"])
    pieces = [p["text"].to_pylist() for p in alignment._batches(batch, "text")]
    assert sum(pieces, []) == texts + [None, "x" * 100, ""] and max(map(len, pieces)) <= 3


def test_the_slower_library_gives_the_same_ids():
    side = SideA(open(A, encoding="utf-8").read())
    slow = SideA(open(A, encoding="utf-8").read())
    slow.fast, slow.library = None, Tokenizer.from_file(A)
    slow.library.encode_special_tokens = True
    rng = random.Random(9)
    texts = [t for t in ODD if t] + ["".join(rng.choice("ab'stll  \n\té日🙂1.,<|") for _ in range(60)) for _ in range(300)]
    for text in texts:
        ids = side.encode(" " + text)
        assert ids == slow.encode(" " + text)
        assert b"".join(side.bytes[i] for i in ids) == (" " + text).encode() and slow.gives_bytes_again(ids, (" " + text).encode())
