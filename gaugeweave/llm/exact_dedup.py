"""Exact duplicates by a tree of merges over sorted digest runs.

Every input partition makes one run: for each digest the row that stays so far and how many rows it stands for,
sorted by digest. In each round the runs of 16 partitions meet, cut by digest into shards, and are merged into one
run; after three rounds one run is left (4096 run numbers; partitions beyond that share a number). A run holds a
digest once, so a text that fills a third of the table is one entry per run from the first level on, and no task
sees more of it than 16 entries. Merging passes over rows in order and keeps one entry in memory.
"""

from __future__ import annotations

import hashlib

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeweave.llm.tables import columns, rows, without
from gaugeweave.session import materialize

RUN_BITS, ROUND_BITS = 12, 4
WHITE = b" \t\n\x0b\x0c\r"
ENTRY = "run int, digest binary, witness long, size long, points long, doc_id long, n long"


def digests(docs: DataFrame) -> DataFrame:
    """Each row's SHA-256 of the text without ASCII white space, and a second, independent hash with the length."""

    def work(batches):
        for batch in batches:
            out = []
            for doc, points, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "points", "text"))):
                kept = (text or b"").translate(None, WHITE)
                out.append((doc, points, hashlib.sha256(kept).digest(), xxhash.xxh3_64_intdigest(kept, 1) >> 1, len(kept)))
            yield out

    source = docs.selectExpr("doc_id", "CAST(coalesce(char_length(text), 0) AS LONG) AS points", "CAST(text AS BINARY) AS text")
    return rows(source, work, "doc_id long, points long, digest binary, witness long, size long")


def merge_run(batches):
    """Adjacent entries of one text become one; the better row stays and the counts are added.

    Entries are one text only if SHA-256, second hash and length all agree.
    """
    entry = None
    for batch in batches:
        out = []
        for row in zip(*(batch[c].to_pylist() for c in ("run", "digest", "witness", "size", "points", "doc_id", "n"))):
            if entry is not None and entry[:4] == row[:4]:
                best = min(entry, row, key=_rank)
                entry = (*best[:6], entry[6] + row[6])
            else:
                if entry is not None:
                    out.append(entry)
                entry = row
        yield out
    if entry is not None:
        yield [entry]


def _rank(entry):
    """Most code points first, then the smallest id; a null id comes last."""
    return -entry[4], entry[5] is None, entry[5] or 0


def merged(entries: DataFrame) -> DataFrame:
    keys = ["run", "digest", "witness", "size"]
    return rows(entries.sortWithinPartitions(*keys), merge_run, ENTRY)


def merge_tree(prints: DataFrame) -> DataFrame:
    """One entry for each distinct text, ``digest, witness, size, points, doc_id (that stays), n``."""
    run = F.pmod(F.spark_partition_id(), F.lit(1 << RUN_BITS)).alias("run")
    runs = merged(prints.select(run, "digest", "witness", "size", "points", "doc_id", F.lit(1).cast("long").alias("n")))
    shard = F.substring("digest", 1, 2)
    for _ in range(RUN_BITS // ROUND_BITS):
        upper = F.shiftright("run", ROUND_BITS).alias("run")
        exchanged = runs.select(upper, "digest", "witness", "size", "points", "doc_id", "n").repartition("run", shard)
        runs = merged(exchanged)
    return runs.drop("run")


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Groups of documents whose texts are equal once ASCII white space is deleted.

    Returns for each row ``doc_id, keep_id, group_size, kept, text_sha256``. The row with the most code points in
    the original text stays, then the smallest id; null text counts as empty, and all empty texts are one group. A
    null id stays only if all ids of its group are null; then ``keep_id`` is null and ``kept`` is true for all of
    them. Rows that repeat an id and a text are all ``kept`` if the id stays: the id cannot tell them apart. Other
    columns are not read.
    """
    docs = columns(docs, doc_id=id_column, text=text_column).selectExpr("CAST(doc_id AS LONG) AS doc_id", "text")
    prints = materialize(digests(docs), "digests")
    groups = merge_tree(prints).selectExpr("digest", "witness", "size", "doc_id AS keep_id", "n AS group_size")
    out = prints.join(materialize(groups, "digest-groups"), ["digest", "witness", "size"])
    return out.selectExpr("doc_id", "keep_id", "group_size", "doc_id <=> keep_id AS kept", "lower(hex(digest)) AS text_sha256")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts; of rows that repeat both id and text, one."""
    found = materialize(exact_duplicates(docs), "exact-groups")
    dropped = found.where("NOT kept").selectExpr("doc_id AS __id", "text_sha256 AS __sha").distinct()
    again = found.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").selectExpr("doc_id AS __id").distinct()
    dropped, again = materialize(dropped, "dropped"), materialize(again, "repeated")
    once = without(docs, docs["doc_id"], dropped.where("__id IS NOT NULL").select("__id").distinct())
    if again.isEmpty() and dropped.where("__id IS NULL").isEmpty() and not _split_ids(found):
        return once
    return _row_by_row(docs, found)


def _split_ids(found: DataFrame) -> bool:
    """Whether some id stays with one text and is dropped with another."""
    return not found.groupBy("doc_id").agg(F.min("kept").alias("l"), F.max("kept").alias("h")).where("l <> h").isEmpty()


def _row_by_row(docs: DataFrame, found: DataFrame) -> DataFrame:
    """For tables that repeat ids: decided by id and text together, and equal rows become one."""
    text = F.sha2(F.regexp_replace(F.coalesce(docs["text"], F.lit("")), r"[\x20\x09-\x0D]", "").cast("binary"), 256)
    stays = found.where("kept").selectExpr("doc_id AS __id", "text_sha256 AS __sha", "true AS __stays").distinct()
    marked = docs.withColumn("__key", text)
    joined = marked.join(stays, marked["doc_id"].eqNullSafe(stays["__id"]) & (marked["__key"] == stays["__sha"]), "left_semi")
    # Among rows of one id and text the longest original stays.
    longest = joined.select(F.col("doc_id").alias("__id"), F.col("__key").alias("__sha"), F.char_length(F.coalesce("text", F.lit(""))).alias("__len"))
    longest = longest.groupBy("__id", "__sha").agg(F.max("__len").alias("__len"))
    best = joined.join(longest, joined["doc_id"].eqNullSafe(longest["__id"]) & (joined["__key"] == longest["__sha"])
                       & (F.char_length(F.coalesce(joined["text"], F.lit(""))) == longest["__len"]), "left_semi")
    return best.dropDuplicates(["doc_id", "__key"]).drop("__key")
