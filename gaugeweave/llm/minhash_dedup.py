"""Near duplicates: tensored MinHash banding, exact confirmation, connected components.

A document is the set of its word shingles. 14 small collections of three minimum hashes each are computed, and a
table key is made of every *pair* of collections: 91 keys of six minimum hashes from 42 hash functions, where
independent tables would need 546. A pair of documents of similarity s shares a key unless fewer than two of the 14
collections agree (each with probability s^3): it is missed with probability 7e-4 at s = 0.8, 4e-5 at 0.85 and 6e-7
at 0.9; unrelated documents meet with probability 91 s^6.

Documents with the same set form a class first, so copies never meet in a key. Then every class is compared with the
smallest member of its buckets, and in buckets that still hold several components the first member of each component
with the first of the bucket; links are confirmed on the full sets. So the work in a family of copies is linear.

What then still lies in a bucket of several components is paired exactly, by prefixes of the sets instead of by
buckets. The shingles of these documents are put in one order, rarest first. Of two sets of similarity t or more, each
has one of its first n - ceil(t n) + 1 shingles in common with the other's, so only documents of different components
that share such a shingle and a key can be similar. The condition of that join bounds the similarity from above by 1024 parities of
either set, so members of a family that share a passage only are told apart inside the join and make no pair. No pair that
could join two components is left out.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gaugeweave.llm.components import components
from gaugeweave.llm.shingles import WordHashes, mixed, shingle_set, words_of
from gaugeweave.llm.tables import bitmap, bitmap_position, columns, in_bitmap, rows, without
from gaugeweave.session import materialize

COLLECTIONS, EACH, MARKS = 14, 3, 16
_RANDOM = np.random.default_rng(20240131)
_FACTORS = _RANDOM.integers(1, 2**63, COLLECTIONS * EACH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RANDOM.integers(0, 2**63, COLLECTIONS * EACH, dtype=np.uint64)
_STEP = 1 << 14


def minimum_hashes(shingles: np.ndarray) -> np.ndarray:
    """42 minimum hashes; those of collection c are c, c + 14 and c + 28."""
    least = np.full(COLLECTIONS * EACH, np.uint64(2**64 - 1))
    for start in range(0, len(shingles), _STEP):
        part = np.multiply.outer(_FACTORS, shingles[start : start + _STEP])
        part += _OFFSETS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def small_collections(least: np.ndarray) -> np.ndarray:
    """One 32-bit value for each collection: its three minimum hashes together."""
    out = np.arange(COLLECTIONS, dtype=np.uint64)
    for i in range(EACH):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + least[i * COLLECTIONS : (i + 1) * COLLECTIONS])
    return (out >> np.uint64(32)).astype(np.uint32)


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether the shingles of each of 1024 bins are odd in number, as 16 words of 64 bits.

    A shingle that only one of two sets holds changes one bit, so the sets differ in no fewer shingles than in bits.
    """
    odd = np.bincount((shingles >> np.uint64(54)).astype(np.int64), minlength=64 * MARKS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def may_reach(percent: int) -> str:
    """SQL over ``n`` and ``marks`` of either side: false only if 100 * intersection < percent * union is certain.

    With d shingles in one set only, the union is (n_a + n_b + d) / 2 and the intersection (n_a + n_b - d) / 2.
    """
    apart = " + ".join(f"bit_count(marks_a[{i}] ^ marks_b[{i}])" for i in range(MARKS))
    return f"{100 + percent} * ({apart}) <= {100 - percent} * (n_a + n_b)"


def fingerprints(docs: DataFrame, words: int, least: int) -> DataFrame:
    """``docs(doc_id, text)`` to size, set hash and, for sets of ``least`` shingles or more, collections and parities."""

    def work(batches):
        memo = WordHashes()
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                s = shingle_set(memo.of(words_of(text or b"")), words)
                digest = xxhash.xxh3_128_digest(s.tobytes())
                high, low = np.frombuffer(digest, ">i8").tolist()
                if len(s) < least:
                    out.append((doc, len(s), high, low, None, None))
                    continue
                hashes = minimum_hashes(s)
                out.append((doc, len(s), high, low, small_collections(hashes).view(np.int32), parities(s)))
            yield out

    schema = "doc_id long, n long, high long, low long, parts array<int>, marks array<long>"
    return rows(docs.selectExpr("doc_id", "CAST(text AS BINARY) AS text"), work, schema)


def full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """The shingle sets of the documents in ``ids``, made again from their texts."""
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(ids))

    def work(batches):
        memo, words_set = WordHashes(), wanted.value
        for batch in batches:
            batch = batch.filter(in_bitmap(words_set, batch["at"].to_numpy()))
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield [(doc, shingle_set(memo.of(words_of(text or b"")), words).tobytes())
                       for doc, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist())]

    source = docs.where("doc_id IS NOT NULL").select("doc_id", F.expr("CAST(text AS BINARY)").alias("text"),
                                                    bitmap_position(F.col("doc_id")).alias("at"))
    return rows(source, work, "doc_id long, shingles binary").join(ids, "doc_id", "left_semi")


def table_keys(reps: DataFrame) -> DataFrame:
    """``(doc_id, parts)`` to ``(key, doc_id)``: a key for each pair of collections."""
    p = F.col("parts")
    pairs = [(i, j) for i in range(COLLECTIONS) for j in range(i + 1, COLLECTIONS)]
    keys = F.array(*[F.xxhash64(F.lit(i * COLLECTIONS + j), p[i], p[j]) for i, j in pairs])
    return reps.select("doc_id", F.explode(keys).alias("key"))


def confirmed(pairs: DataFrame, sizes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Of ``pairs(a, b)``, those with 100 * intersection >= percent * union, on full sets.

    Sizes and parities exclude most unlike pairs exactly; only documents of the remaining pairs have their sets made.
    Sets are joined to pairs by either end, so a hub with very many links is a skewed join, which Spark splits.
    """
    left, right = (sizes.selectExpr(f"doc_id AS {x}", f"n AS n_{x}", f"marks AS marks_{x}") for x in "ab")
    near = pairs.join(right, "b").join(left, "a")
    near = near.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) AND {may_reach(percent)}")
    near = materialize(near.select("a", "b").distinct(), "near-pairs")
    ids = near.selectExpr("explode(array(a, b)) AS doc_id").distinct()
    sets = materialize(full_sets(docs, ids, words), "shingle-sets")

    def compare(batches):
        for batch in batches:
            out = []
            for a, b, sa, sb in zip(*(batch[c].to_pylist() for c in ("a", "b", "sa", "sb"))):
                x, y = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    out.append((a, b))
            yield out

    full = near.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    full = full.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    return rows(full, compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """Near-duplicate groups of all documents.

    Returns for each row ``doc_id, n_shingles, component_id, kept``. Words are split at ASCII white space, A-Z in
    lower case. Texts with fewer words than a shingle are one shingle; null, empty and blank texts have an empty set
    and are linked with nothing. Rows that share an id are one document. A row with a null id links nothing, has a
    null component and is kept. Other columns are not read.
    """
    docs = columns(docs, doc_id=id_column, text=text_column).selectExpr("CAST(doc_id AS LONG) AS doc_id", "text")
    least = -(-percent // (100 - percent))  # smaller sets are only similar to themselves
    prints = materialize(fingerprints(docs, words, least), "fingerprints")

    known = prints.where("n > 0 AND doc_id IS NOT NULL")
    classes = known.groupBy("n", "high", "low").agg(F.min("doc_id").alias("rep"))
    members = materialize(
        prints.select("doc_id", "n", "high", "low")
        .join(classes, ["n", "high", "low"], "left")
        .withColumn("rep", F.expr("CASE WHEN n = 0 THEN doc_id WHEN doc_id IS NOT NULL THEN rep END"))
        .select("doc_id", "n", "rep"),
        "members",
    )
    reps = members.where("doc_id = rep").select("doc_id").distinct()
    sizes = materialize(
        known.where(f"n >= {least}").select("doc_id", "n", "parts", "marks").join(reps, "doc_id", "left_semi"), "classes"
    )

    keys = table_keys(sizes)
    buckets = keys.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub < last")
    shared = materialize(keys.join(buckets.select("key", "hub"), "key"), "buckets")
    # First every document meets the smallest hub of all its buckets: one pair each, which joins families of copies.
    first = shared.groupBy("doc_id").agg(F.min("hub").alias("a")).where("a < doc_id").selectExpr("a", "doc_id AS b")
    links = materialize(confirmed(first, sizes, docs, words, percent), "hub-links")
    # Texts that share an id are joined through it.
    same_id = members.where("doc_id <> rep").selectExpr("doc_id AS a", "rep AS b").join(reps.selectExpr("doc_id AS a"), "a", "left_semi")
    labels = materialize(components(links.union(same_id)), "components")

    held = materialize(_open_buckets(shared, labels), "open-buckets")
    firsts = held.groupBy("key", "component").agg(F.min("doc_id").alias("b"))
    second = firsts.join(held.groupBy("key").agg(F.min("doc_id").alias("a")), "key").where("a <> b").select("a", "b").distinct()
    links, labels = _joined(links, confirmed(second, sizes, docs, words, percent), labels, same_id)

    held = materialize(_open_buckets(held.select("key", "doc_id"), labels).groupBy("doc_id").agg(F.min("component").alias("component")), "open")
    if not held.isEmpty():
        pairs = prefix_pairs(held, sizes, docs, words, percent)
        links, labels = _joined(links, confirmed(pairs, sizes, docs, words, percent), labels, same_id)

    named = labels.select(F.col("node").alias("rep"), "component")
    out = members.join(named, "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    return out.selectExpr("doc_id", "n AS n_shingles", "component_id",
                          "coalesce(doc_id = component_id, true) AS kept")


def _joined(links: DataFrame, found: DataFrame, labels: DataFrame, same_id: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links with those found since, and the components of all."""
    found = materialize(found, "further-links")
    if found.isEmpty():
        return links, labels
    links = links.union(found)
    return links, materialize(components(links.union(same_id)), "components")


def _open_buckets(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """``(key, doc_id, component)`` of the buckets that hold more than one component."""
    named = shared.select("key", "doc_id").join(labels.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    named = named.withColumn("component", F.coalesce("component", "doc_id"))
    several = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return named.join(several.select("key"), "key").select("key", "doc_id", "component")


def prefix_pairs(held: DataFrame, sizes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs of ``held(doc_id, component)``, of different components, that share a key and a shingle of their prefixes.

    Every pair of similarity ``percent`` that shares a key is among them. A window holds the shingles of one set only;
    texts that share an id are several sets, and repeated rows lengthen a prefix, which loses nothing. A shingle that
    stays in the prefixes of one component is dropped before the join. If ``sizes`` holds parities, pairs that they exclude
    are not made.
    """
    sets = full_sets(docs, held.select("doc_id"), words)

    def spread(batches):
        for batch in batches:
            for doc, held_set in zip(batch["doc_id"].to_pylist(), batch["shingles"].to_pylist()):
                values, own = np.frombuffer(held_set, np.int64), xxhash.xxh3_64_intdigest(held_set) >> 1
                for start in range(0, len(values), _STEP):
                    yield [(doc, own, len(values), x) for x in values[start : start + _STEP].tolist()]

    every = materialize(rows(sets, spread, "doc_id long, own long, n long, shingle long"), "open-shingles")
    counted = every.join(every.groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "shingle")
    # Shingles of one document come first in its order and meet nothing, so they need only be counted.
    rank = F.row_number().over(Window.partitionBy("doc_id", "own").orderBy(F.desc("held"), F.desc("shingle")))
    # From the end of the order: all but the last ceil(t n) - 1 shingles are the prefix.
    prefix = counted.withColumn("last", rank).where(f"last >= ceil({percent} * n / 100)").select("shingle", "doc_id")
    named = materialize(prefix.join(held, "doc_id"), "prefixes")
    facts = [c for c in ("n", "parts", "marks") if c in sizes.columns]
    several = named.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    named = named.join(several.select("shingle"), "shingle").join(sizes.select("doc_id", *facts), "doc_id")
    named = materialize(named, "shared-prefixes")
    left, right = ([F.col(c).alias(f"{c}_{side}") for c in ("doc_id", "component", *facts)] for side in "ab")
    both = named.select("shingle", *left).join(named.select("shingle", *right), "shingle")
    equal = " + ".join(f"CAST(parts_a[{i}] = parts_b[{i}] AS INT)" for i in range(COLLECTIONS))
    alike = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) AND {equal} >= 2"
    if "marks" in facts:
        alike += f" AND {may_reach(percent)}"
    both = both.where(f"doc_id_a < doc_id_b AND component_a <> component_b AND {alike}")
    return both.selectExpr("doc_id_a AS a", "doc_id_b AS b").distinct()


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near copies; of each group the one with the smallest id stays, rows without id too."""
    found = near_duplicates(docs, words, percent)
    dropped = materialize(found.where("NOT kept").select(F.col("doc_id").alias("__dropped")).distinct(), "dropped")
    return without(docs, docs["doc_id"], dropped)
