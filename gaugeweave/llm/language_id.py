"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 in 1024 dimensions, made from its code point alone. A trigram's vector
binds its letters: the elementwise product of the first letter's vector permuted twice, the second's permuted once
and the third's as it is. A document bundles (adds) the vectors of its trigrams; a language's prototype bundles its
learning documents, each with length one. A document gets the language with the largest cosine.

Words are runs of letters in lower case, set apart by blanks that count as letters, so word beginnings and ends are
part of the profile.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeweave.llm.tables import columns, held_out, rows
from gaugeweave.session import materialize

DIMENSIONS, PERMUTATION, BLOCK = 1024, 1, 128
LANGUAGES = 4096
MEMO = 1 << 14


def letter_vector(code: int) -> np.ndarray:
    return np.random.default_rng([code, 97]).integers(0, 2, DIMENSIONS, dtype=np.int8) * np.int8(2) - np.int8(1)


class Profiles:
    """Bundled vectors of texts; vectors of letters and of trigrams met are kept, up to a bound."""

    def __init__(self):
        self.letters: dict[int, tuple[np.ndarray, ...]] = {}
        self.empty()

    def empty(self):
        self.places: dict[int, int] = {}
        self.vectors = np.zeros((1024, DIMENSIONS), np.float32)

    def _turned(self, code: int) -> tuple[np.ndarray, ...]:
        found = self.letters.get(code)
        if found is None:
            if len(self.letters) > 4096:
                self.letters.clear()
            v = letter_vector(code)
            found = self.letters[code] = tuple(np.roll(v, PERMUTATION * k) for k in range(3))
        return found

    def _place(self, gram: int) -> int:
        at = self.places[gram] = len(self.places)
        if at >= len(self.vectors):
            self.vectors = np.vstack([self.vectors, np.zeros_like(self.vectors)])
        a, b, c = gram >> 42, (gram >> 21) & 0x1FFFFF, gram & 0x1FFFFF
        self.vectors[at] = self._turned(a)[2] * self._turned(b)[1] * self._turned(c)[0]
        return at

    def of(self, texts: list[str | None]) -> np.ndarray:
        """A vector of length one for each text, zero for a text without letters."""
        if len(self.places) > MEMO:
            self.empty()
        counted = [grams(t) for t in texts]
        known = np.unique(np.concatenate([g for g, _ in counted])) if counted else np.zeros(0, np.int64)
        places = np.fromiter((self.places.get(g, -1) for g in known.tolist()), np.int64, len(known))
        for i in np.flatnonzero(places < 0):
            places[i] = self._place(int(known[i]))
        counts = np.zeros((len(texts), len(known)), np.float32)
        for i, (g, n) in enumerate(counted):
            counts[i, np.searchsorted(known, g)] = n
        out = counts @ self.vectors[places]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 32 for what is not a letter; made once in each worker."""
    global _TABLE
    if _TABLE is None:
        table = np.full(0x110000, 32, np.int32)
        for code in range(0x110000):
            ch = chr(code)
            if ch.isalpha():
                low = ch.lower()
                table[code] = ord(low) if len(low) == 1 else code
        _TABLE = table
    return _TABLE


_TABLE: np.ndarray | None = None


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams, three code points in one number, and how often each occurs."""
    codes = _letters()[np.frombuffer(f" {text or ''} ".encode("utf-32-le", "replace"), np.uint32)].astype(np.int64)
    blank = codes == 32
    codes = codes[~(blank & np.roll(blank, 1)) | (np.arange(len(codes)) == 0)]
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.unique((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:], return_counts=True)


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages, sorted, and the bundle of each one's learning documents.

    A task adds up its documents by language and returns one row for each language and dimension; the driver
    receives a row for each language, refused beyond 4096 languages.
    """
    learning = docs.where("lang IS NOT NULL").where(~held_out(F.col("doc_id"))).select("lang", "text")

    def work(batches):
        profiles, sums = Profiles(), {}
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                vectors = profiles.of(part["text"].to_pylist())
                langs = np.array(part["lang"].to_pylist(), object)
                for lang in set(langs.tolist()):
                    sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(axis=0, dtype=np.float64)
        # Whole numbers add up alike in any order, so a repeated task changes nothing.
        for lang, v in sums.items():
            yield [(lang, d, x) for d, x in enumerate(np.rint(v * 2**24).astype(np.int64).tolist())]

    parts = rows(learning, work, "lang string, dim int, value long").groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    parts = materialize(parts, "prototypes")
    langs = sorted(r[0] for r in parts.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(langs) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    out = np.zeros((len(langs), DIMENSIONS), np.float32)
    data = parts.toArrow()
    place = {lang: i for i, lang in enumerate(langs)}
    out[[place[x] for x in data["lang"].to_pylist()], data["dim"].to_numpy()] = data["value"].to_numpy()
    return langs, out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def languages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row; the score is the cosine, from 0 to 1.

    ``und`` and 0 for null and empty texts, texts without a letter, and when nothing could be learned. Equal cosines
    go to the first language in order. A null id is neither held out nor a learning row. Other columns are not read.
    """
    docs = columns(docs, doc_id=id_column, text=text_column, lang=lang_column)
    docs = docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text", "lang")
    model = docs.sparkSession.sparkContext.broadcast(prototypes(docs.where("doc_id IS NOT NULL")))

    def work(batches):
        langs, bundles = model.value
        profiles = Profiles()
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                ids, held = part["doc_id"].to_pylist(), part["held_out"].to_pylist()
                vectors = profiles.of(part["text"].to_pylist())
                if not langs:
                    yield [(d, h, "und", 0.0) for d, h in zip(ids, held)]
                    continue
                near = vectors @ bundles.T
                best = near.argmax(axis=1)
                some = np.abs(vectors).sum(axis=1) > 0
                yield [(d, h, langs[b] if s else "und", min(1.0, max(0.0, float(c))) if s else 0.0)
                       for d, h, b, s, c in zip(ids, held, best, some, near.max(axis=1))]

    source = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows(source, work, "doc_id long, held_out boolean, lang_pred string, score double")
