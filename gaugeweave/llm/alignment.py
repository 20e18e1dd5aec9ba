"""Alignment of two tokenizers' tokens over the same bytes.

Both sides' tokens are laid out as byte ranges. A batch of documents is one pair of tables, and an as-of join by document
finds for each token start the token of the other side that covers it. Of two overlapping tokens the one that starts
later (or both) starts inside the other, so the union of the joins in both directions is all overlaps. Overlaps whose
ranges end together are links; their ends cut the document into groups.

Side A is a byte-level BPE vocabulary over a blank and the text, side B a sentencepiece model over the text, to which
it adds the blank itself. A document whose tokens do not give these bytes again on both sides has no tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from gaugeweave.llm.bpe import PATTERN, byte_letters
from gaugeweave.llm.tables import to_arrow
from gaugeweave.session import materialize

BATCH_BYTES, BATCH_ROWS = 1 << 20, 256  # texts of one pair of tables; a longer text is a batch of its own
BLOCK_ROWS, BLOCK_LINKS = 4096, 1 << 20  # documents whose counts are looked up together
ALIGNED = "n_a long, n_b long, n_groups long, n_overlaps long, groups string, links array<struct<a: int, b: int, n: int>>"


class SideA:
    """Byte-level BPE: ids of texts, and the bytes of each id.

    If the merges are numbered like their tokens, as usual, the merge loop of tiktoken gives the same ids several times
    faster than the tokenizers library (compared in the tests); else that library is used.
    """

    def __init__(self, vocabulary: str):
        data, letters = json.loads(vocabulary), byte_letters()
        special = {t["content"] for t in data["added_tokens"]}
        ids = {t: i for t, i in data["model"]["vocab"].items() if t not in special}
        of = {i: bytes(map(letters.__getitem__, t)) for t, i in ids.items()}
        merged = [ids[m.replace(" ", "") if isinstance(m, str) else "".join(m)] for m in data["model"]["merges"]]
        self.sizes = np.zeros(max(of) + 1, np.int64)
        self.sizes[list(of)] = [len(b) for b in of.values()]
        self.bytes = of
        self.fast = self.library = None
        if merged == sorted(merged):
            self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={b: i for i, b in of.items()}, special_tokens={})
        else:
            self.library = Tokenizer.from_str(vocabulary)
            self.library.encode_special_tokens = True
            self.library.no_truncation()
            self.library.no_padding()

    def encode(self, text: str) -> list[int]:
        if self.fast is not None:
            return self.fast.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids

    def gives_bytes_again(self, ids: list[int], whole: bytes) -> bool:
        """The merge loop only ever joins the bytes it was given; a library may have changed them before."""
        return self.fast is not None or b"".join(map(self.bytes.__getitem__, ids)) == whole


class SideB:
    """A sentencepiece model: ids of texts, and the bytes of each id."""

    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Aligner:
    """Both sides, and the texts of ids with what may follow them in a list of groups."""

    def __init__(self, vocabulary: str, model: bytes):
        self.a, self.b = SideA(vocabulary), SideB(model)
        n = max(len(self.a.sizes), len(self.b.sizes))
        # Number with separator: token n before another of its side, last A token of a group, last B token of a group.
        self.texts = np.array([f"{i}{end}" for end in ",|;" for i in range(n)], dtype=object).reshape(3, n)

    def tokens(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; none for a text that is null, empty, or not given again by both."""
        b = self.b.encode([t or "" for t in texts])
        out_a, out_b = [], []
        for text, ids_b in zip(texts, b):
            ids_a: list[int] = []
            if text:
                whole = (" " + text).encode("utf-8", "replace")
                if b"".join(map(self.b.bytes.__getitem__, ids_b)) == whole:
                    ids_a = self.a.encode(" " + text)
                    if not self.a.gives_bytes_again(ids_a, whole):
                        ids_a = []
            out_a.append(ids_a)
            out_b.append(ids_b if ids_a else [])
        return out_a, out_b

    def aligned(self, texts: list[str | None]) -> list[pa.Array]:
        """The columns of ``ALIGNED`` for a batch of texts."""
        a, b = map(_laid_out, self.tokens(texts), (self.a.sizes, self.b.sizes))
        over_a, over_b = overlaps(a, b)
        together = a["end"].to_numpy()[over_a] == b["end"].to_numpy()[over_b]
        last_a, last_b = over_a[together], over_b[together]
        doc, n = a["doc"].to_numpy()[last_a], len(texts)
        count = lambda docs: np.bincount(docs, minlength=n)
        numbers = [count(a["doc"]), count(b["doc"]), count(doc), count(a["doc"].to_numpy()[over_a])]
        return [*(pa.array(x, pa.int64()) for x in numbers), self._groups(a, b, last_a, last_b, n),
                _links(doc, a["id"].to_numpy()[last_a], b["id"].to_numpy()[last_b], n)]

    def _groups(self, a: pd.DataFrame, b: pd.DataFrame, last_a: np.ndarray, last_b: np.ndarray, n: int) -> pa.Array:
        """``a1,a2|b1;a3|b2,b3`` for each document: the groups in order, A ids before B ids."""
        kind_a, kind_b = np.zeros(len(a), np.int8), np.zeros(len(b), np.int8)
        kind_a[last_a], kind_b[last_b] = 1, 2
        group_a, group_b = np.cumsum(kind_a > 0) - (kind_a > 0), np.cumsum(kind_b > 0) - (kind_b > 0)
        # Tokens of B stand behind the A tokens of their group and all groups before, and the other way round.
        until_a, until_b = np.append(last_a + 1, len(a)), np.append(0, last_b + 1)
        place_a = np.arange(len(a)) + until_b[group_a]
        place_b = np.arange(len(b)) + until_a[group_b]
        text = np.empty(len(a) + len(b), dtype=object)
        text[place_a] = self.texts[kind_a, a["id"].to_numpy()]
        text[place_b] = self.texts[kind_b, b["id"].to_numpy()]
        ends = np.cumsum(np.bincount(a["doc"], minlength=n) + np.bincount(b["doc"], minlength=n)).tolist()
        return pa.array(["".join(text[s:e])[:-1] for s, e in zip([0, *ends], ends)], pa.string())


def _laid_out(tokens: list[list[int]], sizes: np.ndarray) -> pd.DataFrame:
    """``doc, id, at, end``: the tokens of a batch as byte ranges, counted on from document to document."""
    ids = np.fromiter(chain.from_iterable(tokens), np.int64, sum(map(len, tokens)))
    end = np.cumsum(sizes[ids])
    return pd.DataFrame({"doc": np.repeat(np.arange(len(tokens)), [len(t) for t in tokens]), "id": ids, "at": end - sizes[ids], "end": end})


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs whose ranges overlap, in order of A, then B.

    Both tables cover the same bytes without gaps, in order of ``at``.
    """
    left = a[["doc", "at"]].assign(a=np.arange(len(a)))
    right = b[["doc", "at"]].assign(b=np.arange(len(b)))
    covering = pd.merge_asof(left, right, on="at", by="doc")  # for each A token the B token it starts in
    covered = pd.merge_asof(right, left, on="at", by="doc")
    a_covers = covered["a"].to_numpy()
    later = np.flatnonzero(a["at"].to_numpy()[a_covers] < b["at"].to_numpy())  # equal starts are in the first join already
    pairs = np.sort(np.concatenate([left["a"].to_numpy() * len(b) + covering["b"].to_numpy(), a_covers[later] * len(b) + later]))
    return pairs // max(len(b), 1), pairs % max(len(b), 1)


def _links(doc: np.ndarray, id_a: np.ndarray, id_b: np.ndarray, n: int) -> pa.Array:
    """For each document its distinct linked id pairs, with how often it has them."""
    bits = int(max(id_a.max(initial=0), id_b.max(initial=0))).bit_length()
    pairs, times = np.unique((doc << bits | id_a) << bits | id_b, return_counts=True)
    doc, id_a, id_b = pairs >> 2 * bits, pairs >> bits & (1 << bits) - 1, pairs & (1 << bits) - 1
    offsets = np.append(0, np.cumsum(np.bincount(doc, minlength=n))).astype(np.int32)
    fields = [pa.array(x.astype(np.int32)) for x in (id_a, id_b, times)]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["a", "b", "n"]))


_ALIGNERS: dict[int, Aligner] = {}


def _batches(batch: pa.RecordBatch, texts: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about a megabyte of text."""
    sizes = np.array([len(t) if t is not None else 0 for t in batch[texts].cast(pa.binary()).to_pylist()], np.int64)
    start = held = 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and (held + size > BATCH_BYTES or i - start >= BATCH_ROWS):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def align(docs: DataFrame, vocabulary: str, model: str, text_column: str = "text") -> DataFrame:
    """All rows and columns with the tokens of both sides aligned.

    ``n_a, n_b, n_groups, n_overlaps long``; ``groups string``, the ids of both sides in groups that end together,
    ``a1,a2|b1;a3|b2,b3``; ``links``, the id pairs whose tokens end together with how often the document has them;
    ``block long``, a number that some neighbouring rows share. Existing columns of these names are replaced.

    ``vocabulary`` and ``model`` are paths read on the driver; what is sent to the tasks is of the files' size. Special
    tokens' strings are plain text. Null and empty texts, and those that one side does not give again byte for byte,
    have zeros, an empty text and no links. Repeated rows are aligned each on its own; an empty table gives an empty one.
    Rows are read by their text only, so no id may be hot; a task holds a megabyte of texts, or one longer text.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as a, open(model, "rb") as b:
        shared = spark.sparkContext.broadcast((a.read(), b.read()))
    added = StructType.fromDDL(ALIGNED + ", block long")
    kept = docs.drop(*added.names)
    target = to_arrow(spark, ALIGNED + ", block long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value)
        if key not in _ALIGNERS:
            _ALIGNERS[key] = Aligner(*shared.value)
        block, rows, links = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            for part in _batches(batch, text_column):
                found = _ALIGNERS[key].aligned(part[text_column].to_pylist())
                held = len(found[-1].values)
                if rows + part.num_rows > BLOCK_ROWS or links + held > BLOCK_LINKS:
                    block, rows, links = block + bool(rows), 0, 0
                rows, links = rows + part.num_rows, links + held
                found = [f.cast(t.type) for f, t in zip(found, target)]
                fields = [part.schema.field(i) for i in range(part.num_columns)] + list(target)
                columns = [*part.columns, *found, pa.array(np.full(part.num_rows, block), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    return kept.mapInArrow(run, StructType(kept.schema.fields + added.fields))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``a, b int, links long, best boolean``: how many links a pair of ids has, and whether no other A id has more with this B id."""
    pairs = aligned.select(F.explode("links").alias("l")).select("l.a", "l.b", "l.n")
    counts = materialize(pairs.groupBy("a", "b").agg(F.sum("n").alias("links")), "pair-counts")
    most = counts.groupBy("b").agg(F.max("links").alias("most"))
    return counts.join(most, "b").select("a", "b", "links", (F.col("links") == F.col("most")).alias("best"))


def counted(aligned: DataFrame) -> DataFrame:
    """All rows of a written result of ``align`` with ``n_links, n_best, count_sum long`` instead of links and block.

    Counts are over all rows given. Each block of neighbouring rows looks its distinct pairs up once: what moves is a
    block's distinct pairs, not every document's, and no pair or document is a group of its own, however frequent. A
    block holds at most 4096 rows and a million pairs, or a single batch of ``align`` that has more.
    """
    others = [f for f in aligned.schema.fields if f.name not in ("links", "block")]
    added = StructType.fromDDL("n_links long, n_best long, count_sum long")
    out = StructType([f for f in others if f.name not in added.names] + added.fields)
    kept = aligned.select(*[f"`{f.name}`" for f in out.fields if f.name not in added.names], "links", "block")
    asked = kept.select(F.col("block").alias("asker"), F.explode("links").alias("l")).select("asker", "l.a", "l.b").distinct()
    answers = asked.join(pair_counts(aligned), ["a", "b"]).select("asker", "a", "b", F.col("links").alias("count"), "best")
    names = [f.name for f in out.fields if f.name not in added.names]

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        links = pa.concat_arrays(left["links"].chunks) if len(left) else pa.array([], left["links"].type)
        sizes, inner = links.value_lengths().to_numpy(), links.flatten()
        a, b, n = (inner.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "b", "n"))
        known = right["a"].to_numpy().astype(np.int64) << 32 | right["b"].to_numpy()
        order = np.argsort(known)
        found = order[np.searchsorted(known, a << 32 | b, sorter=order)] if len(a) else np.zeros(0, np.int64)
        count, best = right["count"].to_numpy()[found], right["best"].to_numpy(zero_copy_only=False)[found]
        doc = np.repeat(np.arange(len(left)), sizes)
        sums = []
        for value in (n, n * best, n * count):
            total = np.zeros(len(left), np.int64)
            np.add.at(total, doc, value)
            sums.append(pa.array(total))
        return pa.table([*(left[c] for c in names), *sums], names=[*names, *added.names])

    return kept.groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(look_up, out)
