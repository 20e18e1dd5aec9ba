import hashlib
import random
import re

import pytest

from cases import SCHEMA, awkward
from gaugeweave.llm.fill_in_middle import PLAIN, PSM, SPM, Marks, arranged, fill_in_middle, restore, restored_text, reverse, rotate, unit_ends

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@pytest.mark.parametrize("seed", range(4))
def test_rotations_give_the_stated_order_and_the_text_again(seed):
    rng = random.Random(seed)
    for _ in range(2000):
        text = "".join(rng.choice("ab é日\n\t 🙂<P\xa0") for _ in range(rng.randrange(14)))
        if "<P>" in text:
            continue
        units, data = UNIT.findall(text), text.encode()
        ends = [0, *unit_ends(data).tolist()]
        assert [data[a:b].decode() for a, b in zip(ends, ends[1:])] == units
        i, j = sorted(rng.randrange(len(units) + 1) for _ in range(2))
        p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
        for form, expected in ((PSM, f"<P>{p}<S>{s}<M>{m}"), (SPM, f"<S>{s}<P>{p}<M>{m}"), (PLAIN, text)):
            output = arranged(data, ends[i], ends[j], form)
            assert output.decode() == expected
            assert restored_text(output, form) == data


def test_reversal_and_rotation_of_every_range():
    for n in range(7):
        data = bytes(range(n))
        for a in range(n + 1):
            for c in range(a, n + 1):
                buffer = bytearray(data)
                reverse(buffer, a, c)
                assert bytes(buffer) == data[:a] + data[a:c][::-1] + data[c:]
                for b in range(a, c + 1):
                    buffer = bytearray(data)
                    rotate(buffer, a, b, c)
                    assert bytes(buffer) == data[:a] + data[b:c] + data[a:b] + data[c:]


def by_formula(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_whole_table_and_awkward_rows(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(i, t, "en", "s", 1, "k", 7, "c", 0, "z") for i, t in enumerate(
        ["<P>x y", "a <S> b", "<M>", "x" * 300_000, "a b " * 60_000, "end \n", "\n\n", "é 日本\v🙂 z", "a\xa0b c"] * 3)], SCHEMA)
    for docs in (given, awkward(spark), odd):
        got = restore(fill_in_middle(docs)).collect()
        assert len(got) == docs.count()
        for r in got:
            assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == by_formula(r["doc_id"], r["text"])
            assert r["restored"] == (r["text"] or "")
    forms = [r["form"] for r in fill_in_middle(given).collect()]
    assert {PLAIN, PSM, SPM} == set(forms)


def test_columns_of_the_same_names_are_replaced_and_others_kept(spark):
    docs = spark.createDataFrame([(1, "a b", 9, "old", "o", 3)], "doc_id long, text string, n int, output string, form string, key int")
    row = fill_in_middle(docs).first().asDict()
    assert sorted(row) == ["doc_id", "form", "key", "middle_chars", "n", "output", "prefix_chars", "text"]
    assert row["n"] == 2 and row["key"] == 3 and row["form"] in (PLAIN, PSM, SPM)


def test_empty_table_other_marks_and_null_output(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert restore(fill_in_middle(empty)).count() == 0
    marks = Marks(b"[pre]", b"[suf]", b"[mid]")
    docs = spark.createDataFrame([(i, f"<P> a b c {i}") for i in range(40)], "doc_id long, text string")
    rows = restore(fill_in_middle(docs, percent=100, spm_percent=50, marks=marks), marks=marks).collect()
    assert all(r["restored"] == r["text"] and "[mid]" in r["output"] for r in rows)
    assert restore(spark.createDataFrame([(None, "psm")], "output string, form string")).first()["restored"] is None
