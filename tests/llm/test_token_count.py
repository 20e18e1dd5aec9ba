import random

import public_tokenizers
import pytest
from tokenizers.models import Unigram

from cases import SCHEMA, awkward
from gaugeweave.llm.token_count import BLANK, Lexicon, count_tokens, lexicon_of

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def library(pieces, fallback):
    vocabulary = [("<unk>", 0.0)] + ([(f"<0x{b:02X}>", -1e9) for b in range(256)] if fallback else []) + pieces
    return Unigram(vocabulary, 0, fallback)


def test_equal_to_the_library_on_documents(spark):
    pieces, fallback = lexicon_of(MODEL)
    model, own = library(pieces, fallback), Lexicon(pieces, fallback)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    for text in [r["text"] for r in docs] + ["a  b   c ", " ", "  x", "é\n\t日本 🙂🙂", "y" * 300]:
        assert own.count(text) == len(model.tokenize(BLANK + text.replace(" ", BLANK)))


@pytest.mark.parametrize("seed", range(6))
def test_ties_follow_the_tokenizer(seed):
    """Few distinct scores give many equal paths of different lengths; the unknown sign and the blank occur too."""
    rng = random.Random(seed)
    pieces = list({"".join(rng.choices("abc" + BLANK * (seed % 2), k=rng.randrange(1, 4))): float(-rng.randrange(1, 4)) for _ in range(25)}.items())
    for fallback in (True, False):
        own, model = Lexicon(pieces, fallback), library(pieces, fallback)
        for _ in range(300):
            text = "".join(rng.choices("abcc xé", k=rng.randrange(1, 14)))
            assert own.count(text) == len(model.tokenize(BLANK + text.replace(" ", BLANK))), text


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = count_tokens(docs, MODEL).collect()
    assert len(got) == docs.count()
    assert all(r["n_tokens"] == 0 for r in got if not r["text"]) and all(r["n_tokens"] > 0 for r in got if r["text"])
    assert count_tokens(spark.createDataFrame([], SCHEMA), MODEL).count() == 0
    assert Lexicon([], True).count("ab") == 5 and Lexicon([], False).count("ab") == 1
