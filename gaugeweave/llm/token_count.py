"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton enumerates all vocabulary pieces that end at each character; dynamic programming carries the
best score and the number of pieces, no path. Tie rules of unigram tokenizers: a later candidate replaces an earlier one
only if its score is higher, and candidates come by their start, so of equal scores the longest last piece wins. A
character that is no piece itself may be unknown, at the lowest score less ten; neighbouring unknown characters are one
unknown token, or with byte fallback one token for each UTF-8 byte.

Blanks become U+2581 and one is put before the text. If no piece holds that sign behind another character, the search
falls apart at every word, so counts of words met before are kept; otherwise whole texts are searched.
"""

from __future__ import annotations

import re

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK, PENALTY, MEMO = "▁", 10.0, 1 << 18
LOWEST = float("-inf")
_RUNS = re.compile(" *[^ ]+| +")


class Lexicon:
    """Pieces with scores; ``bytes_of_unknown`` says whether bytes stand for unknown characters."""

    def __init__(self, pieces: list[tuple[str, float]], bytes_of_unknown: bool):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - PENALTY
        self.bytes_of_unknown = bytes_of_unknown
        self.by_words = not any(BLANK in p.lstrip(BLANK) for p, _ in pieces)
        self.memo: dict[str, int] = {}

    def search(self, text: str) -> int:
        """Pieces of the best segmentation of ``text``, in which blanks are signs already."""
        ends: list[list[tuple[int, float]]] = [[] for _ in text]
        if len(self.automaton):
            for end, found in self.automaton.iter(text):
                ends[end].append(found)
        best, pieces, unknown = [0.0], [0], [False]
        for e, found in enumerate(ends):
            top, longest = LOWEST, 0
            single = False
            for length, score in found:
                if length == 1:
                    single = True
                score += best[e + 1 - length]
                if score > top or score == top and length > longest:
                    top, longest = score, length
            if not single and best[e] + self.unknown > top:
                cost = len(text[e].encode("utf-8", "replace")) if self.bytes_of_unknown else int(not unknown[e])
                best.append(best[e] + self.unknown)
                pieces.append(pieces[e] + cost)
                unknown.append(True)
            else:
                best.append(top)
                pieces.append(pieces[e + 1 - longest] + 1)
                unknown.append(False)
        return pieces[-1]

    def _missed(self, word: str) -> int:
        n = self.search(BLANK + word)
        if len(word) <= 64:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.by_words or not self.bytes_of_unknown:
            return self.search(BLANK + text.replace(" ", BLANK))
        words = text.split(" ")
        if "" not in words:
            get, missed = self.memo.get, self._missed
            return sum([get(w) or missed(w) for w in words])
        return sum(self.search(run.replace(" ", BLANK)) for run in _RUNS.findall(" " + text))


_LEXICONS: dict[int, Lexicon] = {}


def lexicon_of(model: str) -> tuple[list[tuple[str, float]], bool]:
    """Pieces and scores of a sentencepiece file; control, unknown and byte pieces are no text."""
    import sentencepiece

    known = sentencepiece.SentencePieceProcessor(model_file=model)
    size = known.get_piece_size()
    special = [known.is_control(i) or known.is_unknown(i) or known.is_byte(i) or known.is_unused(i) for i in range(size)]
    pieces = [(known.id_to_piece(i), known.get_score(i)) for i in range(size) if not special[i]]
    return pieces, any(known.is_byte(i) for i in range(size))


def count_tokens(docs: DataFrame, model: str, text_column: str = "text", name: str = "n_tokens") -> DataFrame:
    """All rows and columns with ``n_tokens long``; an existing column of that name is replaced.

    ``model`` is the path of a vocabulary with scores, read on the driver. Null and empty texts have no tokens.
    """
    pieces, fallback = lexicon_of(model)
    shared = docs.sparkSession.sparkContext.broadcast((tuple(pieces), fallback))
    key = hash((shared.value, PENALTY))

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        if key not in _LEXICONS:
            _LEXICONS[key] = Lexicon(list(shared.value[0]), shared.value[1])
        lexicon = _LEXICONS[key]
        return pd.Series([lexicon.count(t) for t in texts], dtype="int64")

    return docs.withColumn(name, count(docs[text_column]))
