"""Document fingerprints: a homomorphic hash of the multiset of a text's paragraphs.

A paragraph is hashed into a wide vector; a text's fingerprint is the sum of the vectors of its paragraphs, lane by lane
modulo powers of two. The order of the paragraphs does not matter, and a paragraph is inserted or deleted by adding or
subtracting its vector. The vector has two parts:

* eight lanes modulo 2^64, the SHA-512 digest of the paragraph: equal sums mean equal multisets (for texts that are not
  built to collide);
* 512 lanes modulo 2^32, in which each run of twelve bytes of the paragraph counts one up or down, in a lane and with a
  sign taken from its hash. As signed numbers the sums keep angles: the cosine of two texts' lanes estimates that of
  their counts of such runs, within about 1/sqrt(512). That is their likeness.

Paragraphs end at line feeds. An empty text has no paragraphs and the zero vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeweave.llm.tables import rows, with_columns

DIGEST_LANES, LANES, RUN, CHUNK = 8, 512, 12, 1 << 20
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_GAP = b"\0" * RUN
_SPLICED = ("doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, "
            "near_next double")


class Fingerprint:
    """Sums of paragraph vectors; ``+`` inserts, ``-`` deletes."""

    __slots__ = ("digest", "lanes")

    def __init__(self, digest: np.ndarray | None = None, lanes: np.ndarray | None = None):
        self.digest = np.zeros(DIGEST_LANES, np.uint64) if digest is None else digest
        self.lanes = np.zeros(LANES, np.uint32) if lanes is None else lanes

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.digest + other.digest, self.lanes + other.lanes)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.digest - other.digest, self.lanes - other.lanes)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and bool((self.digest == other.digest).all() and (self.lanes == other.lanes).all())

    def hex(self) -> str:
        return self.digest.astype(">u8").tobytes().hex() + self.lanes.astype(">u4").tobytes().hex()

    @staticmethod
    def of_hex(text: str) -> Fingerprint:
        data = bytes.fromhex(text)
        cut = 8 * DIGEST_LANES
        return Fingerprint(np.frombuffer(data[:cut], ">u8").astype(np.uint64), np.frombuffer(data[cut:], ">u4").astype(np.uint32))

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal fingerprints, else the cosine of the signed lanes, at least 0; 0 beside a text without runs."""
        if self == other:
            return 1.0
        a, b = (x.lanes.view(np.int32).astype(np.float64) for x in (self, other))
        size = float(np.sqrt(a @ a) * np.sqrt(b @ b))
        return min(max(float(a @ b) / size, 0.0), 1.0) if size else 0.0


def of_paragraphs(joined: bytes | None) -> Fingerprint:
    """The sum of the vectors of the paragraphs that ``joined`` holds, one to a line; None holds none, b"" an empty one."""
    out = Fingerprint()
    if joined is None:
        return out
    for paragraph in joined.split(b"\n"):
        out.digest += np.frombuffer(hashlib.sha512(paragraph).digest(), ">u8")
    counts = np.zeros(2 * LANES, np.int64)
    for places in _places(joined):
        counts += np.bincount(places, minlength=2 * LANES)
    out.lanes = (counts[0::2] - counts[1::2]).astype(np.uint32)
    return out


def of_text(text: str | None) -> Fingerprint:
    return of_paragraphs(text.encode("utf-8", "replace") if text else None)


def _places(joined: bytes) -> Iterator[np.ndarray]:
    """For each byte the lane and sign (twice the lane, plus one for down) of the run that begins there.

    Line feeds become a gap of zeros, so no run reaches into another paragraph, and a run that the end of its paragraph
    cuts short is filled with zeros. A megabyte at a time, so that the arrays stay small whatever the text.
    """
    for start in range(0, len(joined), CHUNK):
        own = joined[start : start + CHUNK].replace(b"\n", _GAP)
        data = np.frombuffer(own + joined[start + CHUNK : start + CHUNK + RUN].replace(b"\n", _GAP) + _GAP, np.uint8)[: len(own) + RUN]
        one = data.astype(np.uint64)
        two = one[:-1] * _STEP + one[1:]
        four = two[:-2] * (_STEP ^ two.dtype.type(2)) + two[2:]
        eight = four[:-4] * (_STEP ^ two.dtype.type(4)) + four[4:]
        n = len(own)
        run = eight[:n] * (_STEP ^ two.dtype.type(8)) + four[8 : n + 8]
        run = run[data[:n] != 0]
        run ^= run >> np.uint64(29)
        run *= _MIX
        yield (run >> np.uint64(54)).view(np.int64)


def fingerprint(docs: DataFrame, text_column: str = "text", name: str = "fingerprint") -> DataFrame:
    """All rows and columns with the fingerprint as hexadecimal text; an existing column of the name is replaced.

    Equal texts, and texts with the same paragraphs in another order, have equal fingerprints. Null and empty texts have
    the zero vector. Repeated rows stay repeated; an empty table gives an empty table. Every row is worked on alone.
    """

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([of_text(t).hex() for t in batch[text_column].to_pylist()], pa.string())]

    return with_columns(docs, work, f"{name} string")


def changed(fingerprints: DataFrame, column: str = "fingerprint", insert: str | None = None, delete: str | None = None) -> DataFrame:
    """``column`` after inserting the paragraphs of one text column and deleting those of another, without the text.

    A null or empty text changes nothing; a null fingerprint stays null.
    """

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        known = batch["__known"].to_pylist()
        added = batch[insert].to_pylist() if insert else [None] * len(known)
        removed = batch[delete].to_pylist() if delete else [None] * len(known)
        new = [None if k is None else (Fingerprint.of_hex(k) + of_text(a) - of_text(r)).hex() for k, a, r in zip(known, added, removed)]
        return [pa.array(new, pa.string())]

    known = fingerprints.withColumn("__known", fingerprints[column])
    return with_columns(known, work, f"{column} string").drop("__known")


def likeness(fingerprints: DataFrame, a: str, b: str, name: str = "likeness") -> DataFrame:
    """All rows and columns with the likeness of two fingerprint columns; null beside a null."""

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        pairs = zip(batch[a].to_pylist(), batch[b].to_pylist())
        near = [None if x is None or y is None else Fingerprint.of_hex(x).likeness(Fingerprint.of_hex(y)) for x, y in pairs]
        return [pa.array(near, pa.float64())]

    return with_columns(fingerprints, work, f"{name} double")


class Spliceable:
    """A text whose last half (rounded down) may be replaced by the beginning of another.

    Paragraphs before the one that the cut touches stay, so they are hashed once; the fingerprint of the edited text is
    the text's own after deleting the paragraphs from there on and inserting the new ones.
    """

    def __init__(self, text: str):
        self.text, self.cut = text, len(text) - len(text) // 2
        self.touched = text.rfind("\n", 0, self.cut) + 1
        before = of_text(text[: self.touched - 1]) if self.touched > 1 else of_paragraphs(b"" if self.touched else None)
        self.replaced = of_paragraphs(text[self.touched :].encode("utf-8", "replace") if text else None)
        self.whole = before + self.replaced

    def edited(self, follower: str) -> tuple[str, Fingerprint]:
        """The edited text and its fingerprint."""
        if not self.text:
            return "", self.whole
        text = self.text[: self.cut] + follower[: len(self.text) // 2]
        return text, self.whole - self.replaced + of_paragraphs(text[self.touched :].encode("utf-8", "replace"))


def splices(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """``doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next``: documents beside their followers.

    The follower of a document is the next one by ascending ``doc_id`` (whole numbers), of the last one the first.
    ``edited`` is the text with its last half replaced by the follower's beginning, ``near_edited`` the likeness to that,
    ``near_next`` the likeness to the whole follower. Null texts count as empty. Rows with the same id are ordered by
    text. A row without an id has no place in the order and is its own follower; so is the only row of a table. Other
    columns are left out. An empty table gives an empty table.

    Ids are dealt to ``parts`` (default: ``spark.sql.shuffle.partitions``) ranges of about equal size; texts move once.
    The first row of each range also goes to the range before, where it only is a follower. The driver holds two numbers
    for each range. Within a range two texts and 64 rows in work are in memory.
    """
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    known = own.where("doc_id IS NOT NULL")
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    firsts = first_ids(known.select("doc_id"), parts)
    last = len(firsts) - 1

    @F.pandas_udf("array<int>")
    def homes(ids: pd.Series) -> pd.Series:
        """The row's own range, and for a range's first id also the range before as -1 - range."""
        values = ids.to_numpy(np.int64)
        at = np.searchsorted(firsts, values, side="right") - 1
        leads = firsts[at] == values
        before = np.where(at == 0, last, at - 1)
        return pd.Series([[a, -1 - b] if lead else [a] for a, b, lead in zip(at.tolist(), before.tolist(), leads.tolist())])

    placed = known.withColumn("home", F.explode(homes("doc_id"))).selectExpr(
        "if(home < 0, -1 - home, home) AS part", "home < 0 AS follows", "doc_id", "text")
    lone = rows(own.where("doc_id IS NULL"), _alone, _SPLICED)
    # Ranges are dealt out by number, then read in order: a task may have several of them.
    inside = placed.repartition(max(len(firsts), 1), "part").sortWithinPartitions("part", "follows", "doc_id", "text")
    return rows(inside, _in_order, _SPLICED).unionByName(lone)


def first_ids(ids: DataFrame, parts: int) -> np.ndarray:
    """The smallest id of each of at most ``parts`` ranges of about equal numbers of rows, ascending."""
    cuts = F.percentile_approx("doc_id", F.array(*[F.lit(i / parts) for i in range(parts)]), F.lit(max(10_000, 10 * parts)))
    bounds = np.unique(np.array(ids.agg(cuts.alias("at")).first()["at"] or [], np.int64))

    @F.pandas_udf("int")
    def part(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds[1:], values.to_numpy(np.int64), side="right").astype(np.int32))

    # A bound may be no id itself (the sketch holds doubles), so the ids that begin the ranges are looked up.
    begins = ids.groupBy(part("doc_id").alias("part")).agg(F.min("doc_id").alias("first")).collect()
    return np.array(sorted(r["first"] for r in begins), np.int64)


def _slices(batches: Iterator[pa.RecordBatch], size: int = 64) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t.decode("utf-8", "replace") for t in batch["text"].cast(pa.binary()).to_pylist()]


def _compared(doc_id: int | None, own: Spliceable, follower: Spliceable) -> tuple:
    edited, after = own.edited(follower.text)
    near = own.whole.likeness(after), own.whole.likeness(follower.whole)
    return doc_id, len(own.text), edited, own.whole.hex(), after.hex(), *near


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Each row beside the one after it; a row that only follows ends its range."""
    held = None  # the row before: id and text
    for batch in _slices(batches):
        out = []
        for follows, doc_id, text in zip(batch["follows"].to_pylist(), batch["doc_id"].to_pylist(), _texts(batch)):
            if follows and held is None:
                continue
            here = Spliceable(text)
            if held is not None:
                out.append(_compared(*held, here))
            held = None if follows else (doc_id, here)
        yield out


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    for batch in _slices(batches):
        yield [_compared(None, here, here) for here in map(Spliceable, _texts(batch))]
