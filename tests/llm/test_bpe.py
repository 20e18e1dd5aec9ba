import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cases import SCHEMA, awkward, documents
from gaugeweave.llm import bpe

FILE = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "  ", "a", "a b", " a  b ", "a\n b", "a \n\n  b\t", "it's we'll  '  's", "x" * 5000, "ab" * 3000 + " " + "7" * 4000, "=" * 2000,
    " " * 3000 + "end", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "<|endo" + "ftext|", "naïve café x y 日本語" * 200,
    "\x1c \x1d a \x85 b", "🙂" * 900, "".join(random.Random(1).choices("abcXYZ012+/", k=9000)),
]


@pytest.fixture(scope="module")
def coder():
    with open(FILE, encoding="utf-8") as file:
        return bpe.Coder(file.read())


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(FILE)


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_equal_to_the_library(coder, tokenizer, i):
    ids = coder.encode(TEXTS[i])
    assert ids == tokenizer.encode(TEXTS[i], add_special_tokens=False).ids
    assert coder.decode(ids) == TEXTS[i] == tokenizer.decode(ids, skip_special_tokens=False)


def test_random_texts(coder, tokenizer):
    rng = random.Random(7)
    signs = "aaabcdeé \t\n '.-0123日🙂" + " " * 6
    for _ in range(400):
        text = "".join(rng.choices(signs, k=rng.randrange(120)))
        assert coder.encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_joins_of_any_two_halves(coder):
    rng = random.Random(3)
    piece = "".join(rng.choices("aeinrst", k=1200)).encode()
    whole = coder.leaf(piece)
    for cut in (1, 2, 255, 600, 1199):
        assert coder.join(coder.tree(piece[:cut]), coder.tree(piece[cut:])) == whole


def test_documents_of_many_parts(spark, tokenizer):
    rng = random.Random(5)
    words = " ".join("".join(rng.choices("abcdef", k=rng.randrange(1, 9))) for _ in range(30_000))
    texts = [(1, words), (2, "z" * 150_000), (3, words[:40_000] + "q" * 90_000 + "9" * 40_000 + words[:100]), (4, "\n" * 70_000 + " x"), (None, words)]
    got = bpe.encode(documents(spark, texts), FILE).collect()
    assert len(got) == 5
    for r in got:
        assert r["token_ids"] == tokenizer.encode(r["text"], add_special_tokens=False).ids
        assert r["n_tokens"] == len(r["token_ids"])


def test_parts_do_not_end_in_white_space(coder, tokenizer):
    rng, texts = random.Random(6), ["好\n\n" + "z" * 40_000, "\n\n" + "z" * 40_000 + "\n \n字" + "q" * 40_000 + "\n\n"]
    texts.append("a\n\n字" + "\n" * 40_000 + "x\n\n")
    for k in range(5):
        texts.append("x" * k + "".join("".join(rng.choices("好字日本語", k=9)) + "。" + "\n\n" * (i % 5 == k) for i in range(8_000)))
    texts += ["x" * k + "好\n\n字\n  日" * 8_000 for k in range(8)]
    for text in texts:
        parts = list(coder.parts(text))
        assert "".join(part for _, part in parts) == text
        ids, open_ = [], []
        for n, (joined, part) in enumerate(parts):
            whole = not joined and not (n + 1 < len(parts) and parts[n + 1][0])
            if not joined:
                ids, open_ = ids + bpe._tree_join(coder, open_), []
            open_.append(coder.encode(part) if whole else coder.tree(part.encode()))
        assert ids + bpe._tree_join(coder, open_) == tokenizer.encode(text, add_special_tokens=False).ids


def test_awkward_rows(spark, tokenizer):
    docs = awkward(spark)
    got = bpe.decode(bpe.encode(docs, FILE), FILE)
    assert got.columns == [*docs.columns, "token_ids", "n_tokens", "decoded"]
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["token_ids"] == ids and r["decoded"] == (r["text"] or "")
    assert bpe.encode(spark.createDataFrame([], SCHEMA), FILE).count() == 0


def test_query_digests(spark, tokenizer):
    from gaugeweave.llm.queries import op4_bpe

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op4_bpe(spark, sf).collect():
        ids = tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_decoding_where_tokens_are_made(spark, tokenizer):
    docs = awkward(spark).selectExpr("*", "1 AS __row", "'old' AS decoded", "2 AS n_tokens")
    texts = [(1, "word " * 20_000), (2, "x" * 40_000 + " y")]
    more = documents(spark, texts)
    for table in (docs, more):
        got = bpe.encode(table, FILE, decoded=True)
        kept = [c for c in table.columns if c not in ("decoded", "n_tokens")]
        assert got.columns == [*kept, "token_ids", "n_tokens", "decoded"] and got.count() == table.count()
        for r in got.collect():
            assert r["decoded"] == (r["text"] or "") and r["n_tokens"] == len(r["token_ids"])
            assert r["token_ids"] == tokenizer.encode(r["text"] or "", add_special_tokens=False).ids


def test_stretches_end_at_certain_cuts(coder, tokenizer):
    rng = random.Random(8)
    for k in range(60):
        words = ["".join(rng.choices("abc'é好.\n\t \x1f9", k=rng.choice((1, 3, 9, 300)))) for _ in range(400)]
        text = rng.choice((" ", "  ", "\n ", "")).join(words)[: rng.randrange(3_000, 20_000)]
        at, ends = 0, []
        while at < len(text):
            at = coder.cut(text, at)
            ends.append(at)
        assert ends[-1] == len(text) and ends == sorted(set(ends))
        assert coder.encode(text) == tokenizer.encode(text, add_special_tokens=False).ids
