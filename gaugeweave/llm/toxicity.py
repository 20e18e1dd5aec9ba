"""Toxicity: class-conditional Kneser-Ney models of words, compared by length-normalised log-likelihood.

For each class c (toxic, ordinary) a word has the probability

    p_c(w) = max(n_c(w) - D, 0) / N_c + lambda_c * p(w),     p(w) = n(w) / N

n_c(w) counts the class's learning documents that hold w, n(w) those of both classes: the Kneser-Ney continuation
count, in how many different contexts (documents) a word occurs rather than how often, shared by both classes. D is
the absolute discount; lambda_c gives the discounted mass to the shared counts, so a rare expression is judged by
them and differs between the classes by lambda alone.

Learning rows are those with labels whose crc32(doc_id) mod 5 is 1 to 4. Folds 1 to 3 give the counts, from all
their rows; fold 4 fits a logistic curve on five figures of a document: mean log-likelihood ratio of its words
(length-normalised), the largest ratio of a word, the mean of the three largest, how many exceed a ratio of 2 as a
share of the root of the length, and the log length. Rows of fold 0 are never learned from.

The counts grow with the labelled documents. Words that neither class counts more than D times have exactly the ratio
of the shared backoff and need no row. Of the others a task receives the 2^22 most frequent ones at most, whatever the
input, by their 64-bit hash in 16 bytes each; with a ``share`` set, those with at least that share of a class's counts,
2 / share words at most by construction. The ratios of all rarer words stay in a table and are joined to the distinct
words of the texts that hold them.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeweave.llm.tables import BITMAP_WORDS, bitmap, bitmap_position, columns, fold, held_out, in_bitmap, rows, without
from gaugeweave.session import materialize

WORD = re.compile(r"[^\W\d_]+")
DISCOUNT = 2.0
SHARE: float | None = None
TASK_WORDS = 1 << 22
FIT_ROWS = 200_000
FLUSH = 400_000


def distinct_words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def labelled_words(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(fold, toxic, words)`` of the learning rows; only documents that may have a label leave their task."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    # Written, so that the planner knows its size and moves no words where it is small.
    known = materialize(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "labels")
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(known.select("doc_id")))

    def work(batches):
        marks = wanted.value
        for batch in batches:
            batch = batch.filter(in_bitmap(marks, batch["at"].to_numpy()))
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield [(doc, " ".join(distinct_words(text))) for doc, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist())]

    source = docs.where("doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    source = source.select("doc_id", "text", bitmap_position(F.col("doc_id")).alias("at"))
    words = rows(source, work, "doc_id long, words string")
    return words.join(known, "doc_id").select("doc_id", fold(F.col("doc_id")).alias("fold"), "toxic", "words")


def word_counts(learning: DataFrame) -> DataFrame:
    """In how many documents of either class each word occurs."""

    def work(batches):
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for toxic, words in zip(batch["toxic"].to_pylist(), batch["words"].to_pylist()):
                counts[toxic].update(words.split())
            if len(counts[0]) + len(counts[1]) > FLUSH:
                yield _rows_of(*counts)
                counts = Counter(), Counter()
        yield _rows_of(*counts)

    partial = rows(learning.select("toxic", "words"), work, "word string, ordinary long, toxic long")
    return partial.groupBy("word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def _rows_of(ordinary, toxic):
    return [(w, ordinary.get(w, 0), toxic.get(w, 0)) for w in ordinary.keys() | toxic.keys()]


def _totals(counts: DataFrame, discount: float) -> tuple[float, float, float, float] | None:
    """The counts of either class and what the discount leaves to the shared ones; None without both classes."""
    total = counts.agg(
        F.sum("ordinary"), F.sum("toxic"),
        F.sum(F.expr(f"greatest(ordinary - {discount}, 0D)")), F.sum(F.expr(f"greatest(toxic - {discount}, 0D)")),
    ).first()
    if not total[0] or not total[1]:
        return None
    n_o, n_t, left_o, left_t = map(float, total)
    return n_o, n_t, 1 - left_o / n_o, 1 - left_t / n_t


def _rank(n_o: float, n_t: float):
    return F.expr(f"CAST(floor(32 * log2(greatest(ordinary / {n_o!r}D, toxic / {n_t!r}D))) AS INT)")


def _is_frequent(counts: DataFrame, n_o: float, n_t: float, discount: float, share: float | None):
    """Whether a word is sent: it has the share, or the lowest rank from which no more than ``TASK_WORDS`` are left."""
    if share is not None:
        return (F.col("ordinary") >= max(share * n_o, discount)) | (F.col("toxic") >= max(share * n_t, discount))
    # One row for each rank, a doubling having 32 of them, comes to the driver.
    ranks = counts.where(f"greatest(ordinary, toxic) > {discount}").groupBy(_rank(n_o, n_t).alias("rank")).count().collect()
    held, cut = 0, 0
    for rank, n in sorted(map(tuple, ranks), reverse=True):
        held += n
        if held > TASK_WORDS:
            return _rank(n_o, n_t) > rank
        cut = rank
    return _rank(n_o, n_t) >= cut


class Ratios:
    """Ratios by the 64-bit hash of a word, in order of the hash."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order]

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ratio of each hash, and whether it has one."""
        if not len(self.hashes):
            return np.zeros(len(hashes)), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.values[at], self.hashes[at] == hashes

    def get(self, word: str, default: float | None = None) -> float | None:
        (value,), (known,) = self.of(word_hashes([word]))
        return float(value) if known else default

    def __contains__(self, word: str) -> bool:
        return self.get(word) is not None


def word_hashes(words) -> np.ndarray:
    """As ``xxhash64`` of Spark."""
    return np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "replace"), 42) for w in words], np.uint64)


def log_ratios(counts: DataFrame, discount: float = DISCOUNT, share: float | None = SHARE) -> tuple[Ratios, float]:
    """Log p_toxic(w) / p_ordinary(w) of the words that are sent, and the ratio of the shared backoff."""
    total = _totals(counts, discount)
    if not total:
        return Ratios(np.zeros(0, np.uint64), np.zeros(0)), 0.0
    n_o, n_t, lam_o, lam_t = total
    rest = math.log(lam_t / lam_o)
    often = counts.where(f"greatest(ordinary, toxic) > {discount}").where(_is_frequent(counts, n_o, n_t, discount, share))
    words = often.select(F.xxhash64("word").alias("at"), "ordinary", "toxic").toArrow()  # at most TASK_WORDS or 2 / share rows
    o, t = words["ordinary"].to_numpy().astype(float), words["toxic"].to_numpy().astype(float)
    shared = (o + t) / (n_o + n_t)
    ratio = np.log((np.maximum(t - discount, 0) / n_t + lam_t * shared) / (np.maximum(o - discount, 0) / n_o + lam_o * shared))
    return Ratios(words["at"].to_numpy().astype(np.int64).view(np.uint64), ratio), rest


def rare_ratios(counts: DataFrame, discount: float = DISCOUNT, share: float | None = SHARE) -> DataFrame:
    """``(word, ratio)`` of all words that ``log_ratios`` leaves out and whose ratio is not that of the backoff."""
    total = _totals(counts, discount)
    if not total:
        return counts.selectExpr("word", "0D AS ratio").limit(0)
    n_o, n_t, lam_o, lam_t = total
    rare = counts.where(f"greatest(ordinary, toxic) > {discount}").where(~_is_frequent(counts, n_o, n_t, discount, share))
    shared = f"(ordinary + toxic) / {n_o + n_t!r}D"
    p = lambda c, n, lam: f"(greatest({c} - {discount}, 0D) / {n!r}D + {lam!r}D * {shared})"
    return rare.selectExpr("word", f"ln({p('toxic', n_t, lam_t)} / {p('ordinary', n_o, lam_o)}) AS ratio")


class Model:
    """Ratios of the frequent words with those of the rest, for tasks; the table of rare words, and which may be in it."""

    def __init__(self, counts: DataFrame, share: float | None = None):
        share = SHARE if share is None else share
        spark = counts.sparkSession
        ratios, rest = log_ratios(counts, share=share)
        self.rare = materialize(rare_ratios(counts, share=share), "rare-ratios")
        self.any_rare = not self.rare.isEmpty()
        marked = bitmap(self.rare.select("word")) if self.any_rare else None
        self.shared = spark.sparkContext.broadcast((ratios, rest, marked))

    def figures(self, texts: DataFrame, words_of, curve: Curve | None = None) -> DataFrame:
        """Columns of ``texts`` but ``text`` and the five figures of each row, or with a curve its ``score``.

        ``words_of(text)`` gives distinct words. A task knows the ratios of all words but the rare ones; those it finds
        are looked up for each row that has some.
        """
        others = [c for c in texts.columns if c != "text"]
        shared, any_rare = self.shared, self.any_rare

        def work(batches):
            ratios, rest, marked = shared.value
            for batch in batches:
                for start in range(0, batch.num_rows, 512):
                    part, out = batch.slice(start, 512), []
                    lists = [list(words_of(text)) for text in part["text"].to_pylist()]
                    hashes = word_hashes(w for words in lists for w in words)
                    values, known = ratios.of(hashes)
                    values[~known] = rest
                    maybe = ~known & in_bitmap(marked, hashes % np.uint64(BITMAP_WORDS * 64)) if any_rare else None
                    end = 0
                    for words in lists:
                        begin, end = end, end + len(words)
                        own, rare = values[begin:end], []
                        if any_rare and (hit := maybe[begin:end]).any():
                            rare, own = [words[i] for i in np.flatnonzero(hit)], own[~hit]
                        top = sorted(own.tolist(), reverse=True)
                        out.append((len(words), math.fsum(top), sum(x > 2 for x in top), top[:3], len(rare), rare))
                    others_of = [part[c].to_pylist() for c in others]
                    if any_rare:
                        yield list(zip(*others_of, *zip(*out)))
                    else:
                        yield _judged(others_of, [_five(*x[:4]) for x in out], curve)

        kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.select(*others).schema)
        judged = f"{kept}, " + ("a double, b double, c double, d double, e double" if curve is None else "score double")
        if not any_rare:
            return rows(texts.select("text", *others), work, judged)
        schema = f"{kept}, n long, total double, above long, top array<double>, n_rare int, rare array<string>"
        partial = rows(texts.select("text", *others), work, schema)
        partial = materialize(partial.withColumn("__row", F.monotonically_increasing_id()), "partial-figures")
        # A row and a word move, a row and a ratio come back: neither texts nor lists of words are moved.
        looked = partial.where("n_rare > 0").select("__row", F.explode("rare").alias("word"))
        found = looked.join(self.rare, "word").select("__row", "ratio").repartition("__row")
        found = found.groupBy("__row").agg(F.sort_array(F.collect_list("ratio")).alias("found"))
        partial = partial.drop("rare")
        more = partial.where("n_rare > 0").join(found, "__row", "left").drop("__row")
        none = partial.where("n_rare = 0").drop("__row").withColumn("found", F.expr("CAST(NULL AS array<double>)"))
        return self._finished(more.unionByName(none), others, judged, curve)

    def _finished(self, partial: DataFrame, others: list[str], schema: str, curve: Curve | None) -> DataFrame:
        """Rare words that the table does not have are left with the ratio of the backoff."""
        shared = self.shared

        def work(batches):
            rest = shared.value[1]
            for batch in batches:
                figures = []
                for n, total, above, top, n_rare, found in zip(
                    *(batch[c].to_pylist() for c in ("n", "total", "above", "top", "n_rare", "found"))
                ):
                    more = (found or []) + [rest] * (n_rare - len(found or ()))
                    figures.append(_five(n, total + math.fsum(more), above + sum(x > 2 for x in more), top + more))
                yield _judged([batch[c].to_pylist() for c in others], figures, curve)

        return rows(partial.select("n", "total", "above", "top", "n_rare", "found", *others), work, schema)


def _judged(others: list[list], figures: list[tuple[float, ...]], curve: Curve | None) -> list[tuple]:
    if not figures:
        return []
    judged = figures if curve is None else zip(curve(np.array(figures)).tolist())
    return [(*values, *x) for *values, x in zip(*others, judged)]


def _five(n: int, total: float, above: int, top: list[float]) -> tuple[float, ...]:
    if not n:
        return 0.0, 0.0, 0.0, 0.0, 0.0
    top = sorted(top, reverse=True)[:3]
    return total / n, top[0], sum(top) / 3, above / math.sqrt(n), math.log(n)


class Curve:
    """Logistic regression with a small ridge on standardised figures, fitted by Newton steps; 0 if nothing was fitted."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.fitted = len(x) > 0
        self.mean = x.mean(axis=0) if len(x) else np.zeros(5)
        self.scale = x.std(axis=0) + 1e-9 if len(x) else np.ones(5)
        self.weights = np.zeros(6)
        if len(x):
            z = self._design(x)
            for _ in range(40):
                p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
                slope = z.T @ (p - y) + 1e-2 * self.weights
                bend = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + 1e-2 * np.eye(6)
                self.weights -= np.linalg.solve(bend, slope)

    def _design(self, x):
        return np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.zeros(len(x))
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ self.weights, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, share: float | None = None):
    """The model and the curve. The curve has six weights and is fitted on at most ``fit_rows`` rows of fold 4."""
    learning = materialize(labelled_words(docs, labels), "labelled-words")
    counts = materialize(word_counts(learning.where("fold IN (1, 2, 3)")), "word-counts")
    model = Model(counts, share)
    last = learning.where("fold = 4").selectExpr("xxhash64(doc_id) AS at", "CAST(toxic AS double) AS y", "words AS text")
    sample = model.figures(last, lambda words: set(words.split()))
    data = sample.orderBy(*sample.columns).limit(fit_rows).toArrow()
    x = np.column_stack([data[c].to_numpy() for c in "abcde"]) if data.num_rows else np.zeros((0, 5))
    return model, Curve(x, data["y"].to_numpy())


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Null and empty texts, and texts without a letter, get the score of a text with no evidence. A null id is scored
    and never held out or learned from. Several labels of one id count as toxic if one is. Without labels of both
    classes every ratio is 0, and without labels in fold 4 every score is. Only the two named columns are read, and of them only the text reaches the score.
    """
    docs = columns(docs, doc_id=id_column, text=text_column).selectExpr("CAST(doc_id AS LONG) AS doc_id", "text")
    labels = columns(labels, doc_id="doc_id", toxic="toxic")
    scored = _scores(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), *fit(docs, labels))
    return scored.selectExpr("doc_id", "held_out", "score", "CAST(score >= 0.5 AS INT) AS predicted")


def _scores(texts: DataFrame, model: Model, curve: Curve) -> DataFrame:
    """Columns of ``texts`` but ``text``, and ``score``."""
    return model.figures(texts, distinct_words, curve)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the models do not reject, decided by their texts, so that a null id does not matter."""
    learned = columns(docs, doc_id="doc_id", text="text").selectExpr("CAST(doc_id AS LONG) AS doc_id", "text")
    texts = docs.select(_digest(docs["text"]).alias("key"), docs["text"].alias("text"))
    scored = _scores(texts, *fit(learned, columns(labels, doc_id="doc_id", toxic="toxic")))
    bad = materialize(scored.where("score >= 0.5").select(F.col("key").alias("__bad")).distinct(), "toxic-texts")
    return without(docs, _digest(docs["text"]), bad)


def _digest(text):
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))
