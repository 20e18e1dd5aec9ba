"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

Test items are cut into segments of at most 96 words (64 words apart by 32 if longer). Every run of three words of a
segment is a seed, however many documents hold it: an excerpt that is everywhere has only such seeds. One pass takes
the passages (blocks of 64 words with 96 words on either side) that hold a seed; seeds join passages to segments. Pairs
with too few words in common for the threshold are left out, which loses none, and the others are aligned: match 2,
other word -1, gap -1. The score is the best local alignment as a share of a perfect one; 0.5 and more is contamination.

Tasks receive bitmaps of a fixed size that only save moving passages; which seed belongs to which item is an equi-join.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeweave.llm.shingles import WordHashes, windows
from gaugeweave.llm.tables import columns, in_bitmap, marks, rows, without
from gaugeweave.session import materialize

SEED, SEGMENT, LONG, STRIDE, BLOCK = 3, 96, 64, 32, 64
THRESHOLD = 0.5
MATCH, OTHER, GAP = 2, -1, -1
_APART = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_SIGNS = re.compile("[\u0080-¿ -⁯　-〿]")


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case, without punctuation."""
    if not text:
        return []
    low = text.lower()
    if not low.isascii():
        low = _SIGNS.sub(" ", low)
    return low.encode("utf-8", "replace").translate(_APART).split()


def segments(bench: DataFrame) -> DataFrame:
    """``(item_id, segment, words)``; items of fewer than three words have no seed and give no row."""

    def work(batches):
        for batch in batches:
            out = []
            for item, text in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist()):
                words = words_of(text)
                if item is None or len(words) < SEED:
                    continue
                starts = [0] if len(words) <= SEGMENT else range(0, len(words) - STRIDE, STRIDE)
                size = SEGMENT if len(words) <= SEGMENT else LONG
                for i, s in enumerate(starts):
                    out.append((item, i, b" ".join(words[s : s + size]).decode()))
            yield out

    return rows(bench, work, "item_id long, segment int, words string")


def seeds_of(parts: DataFrame) -> DataFrame:
    def work(batches):
        memo = WordHashes()
        for batch in batches:
            out = []
            for item, segment, words in zip(*(batch[c].to_pylist() for c in ("item_id", "segment", "words"))):
                hashed = memo.of(words.encode().split())
                out += [(g, item, segment) for g in np.unique(windows(hashed, SEED)).view(np.int64).tolist()]
            yield out

    return rows(parts, work, "seed long, item_id long, segment int")


def _marks(seeds: DataFrame):
    """A bitmap by the seed's own top bits (seeds are hashes already)."""
    return seeds.sparkSession.sparkContext.broadcast(marks(seeds.selectExpr("shiftrightunsigned(seed, 40) AS at")))


def _hits(grams: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    return np.flatnonzero(in_bitmap(wanted, grams >> np.uint64(40)))


def passages(docs: DataFrame, wanted) -> DataFrame:
    """``(doc_id, block, seeds, words)`` of the blocks in which a seed begins."""

    def work(batches):
        memo = WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part, out = batch.slice(start, 256), []
                for doc, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                    words = words_of(text)
                    if len(words) < SEED:
                        continue
                    grams = windows(memo.of(words), SEED)
                    hits = _hits(grams, wanted.value)
                    for block in np.unique(hits // BLOCK).tolist():
                        own = hits[hits // BLOCK == block]
                        near = words[max(0, block * BLOCK - SEGMENT) : (block + 1) * BLOCK + SEGMENT]
                        out.append((doc, block, np.unique(grams[own]).view(np.int64), b" ".join(near).decode("utf-8", "replace")))
                yield out

    source = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    return rows(source, work, "doc_id long, block int, seeds array<long>, words string")


def alignment_scores(items: list[list[int]], texts: list[list[int]]) -> np.ndarray:
    """Best Smith-Waterman score of each pair of word-number lists, all pairs advancing together."""
    n, m = max(map(len, items)), max(map(len, texts))
    a, b = np.full((len(items), n), -1, np.int64), np.full((len(items), m), -2, np.int64)
    for i, (x, y) in enumerate(zip(items, texts)):
        a[i, : len(x)], b[i, : len(y)] = x, y
    above = np.zeros((len(items), m + 1), np.int32)
    best = np.zeros(len(items), np.int32)
    ramp = np.arange(m + 1, dtype=np.int32) * -GAP
    for i in range(n):
        now = np.maximum(above + GAP, 0)
        np.maximum(now[:, 1:], above[:, :-1] + np.where(b == a[:, i : i + 1], MATCH, OTHER), out=now[:, 1:])
        above = np.maximum.accumulate(now + ramp, axis=1) - ramp  # gaps along the passage
        np.maximum(best, above.max(axis=1), out=best)
    return best


def words_in_common(items: list[list[int]], texts: list[list[int]]) -> np.ndarray:
    """How many words each pair shares, repeated ones as often as both have them; no alignment matches more."""
    out = []
    for item, text in zip(items, texts):
        held = Counter(text)
        out.append(sum(min(n, held[w]) for w, n in Counter(item).items()))
    return np.array(out, np.int64)


def contamination(docs: DataFrame, bench: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id",
                  text_column: str = "text") -> DataFrame:
    """One row ``doc_id, item_id, score`` for each document and test item whose alignment reaches ``threshold``.

    Null, empty and short texts (under three words) match nothing. Rows that share an id count as one document;
    rows with a null id, in either table, are left out. Other columns are not read. Empty tables give no rows.
    """
    docs = columns(docs, doc_id=id_column, text=text_column).selectExpr("CAST(doc_id AS LONG) AS doc_id", "text")
    bench = columns(bench, item_id="item_id", text="text").selectExpr("CAST(item_id AS LONG) AS item_id", "text")
    parts = materialize(segments(bench), "segments")
    seeds = materialize(seeds_of(parts), "seeds")
    found = materialize(passages(docs, _marks(seeds)), "passages")
    pairs = found.select("doc_id", "block", F.explode("seeds").alias("seed")).join(seeds, "seed")
    pairs = pairs.select("doc_id", "block", "item_id", "segment").distinct()
    joined = pairs.join(found.select("doc_id", "block", F.col("words").alias("passage")).distinct(), ["doc_id", "block"])
    joined = joined.join(parts, ["item_id", "segment"]).select("doc_id", "item_id", "words", "passage")

    def work(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                numbers: dict[str, int] = {}
                number = lambda text: [numbers.setdefault(w, len(numbers)) for w in text.split(" ")]
                items = [number(t) for t in part["words"].to_pylist()]
                texts = [number(t) for t in part["passage"].to_pylist()]
                perfect = MATCH * np.array([len(x) for x in items])
                share = MATCH * words_in_common(items, texts) / perfect  # an upper bound of the score
                near = np.flatnonzero(share >= threshold)
                if len(near):
                    share[near] = alignment_scores([items[i] for i in near], [texts[i] for i in near]) / perfect[near]
                ids = zip(part["doc_id"].to_pylist(), part["item_id"].to_pylist(), share.tolist())
                yield [x for x in ids if x[2] >= threshold]

    scored = rows(joined, work, "doc_id long, item_id long, score double")
    return scored.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def drop_contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The documents that align with no test item; rows without id stay."""
    bad = materialize(contamination(docs, bench).select(F.col("doc_id").alias("__bad")).distinct(), "contaminated")
    return without(docs, docs["doc_id"], bad)
