"""Byte-level BPE encoding and decoding with tree concatenation.

A text is cut where the tokenizer cuts in any case: at a blank between two characters that are not white space. Leaves
of the tree are stretches of up to 4,096 characters that end at such a cut; a library's merge loop encodes them. An
uncut piece of more than 256 characters is halved down to leaves; the halves are encoded on their own, and around each
join a window is encoded again. The window grows until its first token is the one the left side has there and its last
token the one of the right side. Then all neighbouring tokens are pairs that BPE itself leaves apart, which makes the
result the encoding of the whole.

Documents over 32,768 characters are cut into parts that different tasks encode; the parts of a document meet when
they are numbers already.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import cached_property
from itertools import chain

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeweave.llm.tables import rows, with_columns
from gaugeweave.session import materialize

LEAF, STRETCH, PART, WINDOW = 256, 4_096, 32_768, 4
ID_BITS = 24
ID, NONE = (1 << ID_BITS) - 1, 1 << 62
RUN = re.compile(rf"\S{{{LEAF}}}|\s{{{LEAF}}}")  # without such a run no piece is longer than a leaf
SAFE = re.compile(r"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])")
# Fixed value: the pattern by which byte-level BPE of this family cuts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file, to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Coder:
    """Encoder and decoder made from the text of a vocabulary file."""

    def __init__(self, vocabulary: str):
        data, byte = json.loads(vocabulary), byte_letters()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        ids = data["model"]["vocab"]
        self.bytes: dict[int, bytes] = {i: bytes(map(byte.__getitem__, t)) for t, i in ids.items() if t not in self.special}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.first = {b: ids[t] for t, b in byte.items()}
        self.pattern = regex.compile(PATTERN)
        # If tokens are numbered in the order of their merges, as usual, ranks say the same as the merges.
        pieces = {t: i for i, t in self.bytes.items() if i not in self.special.values()}
        new = [ids["".join(p)] for p in self._pairs(data)]
        in_order = all(a <= b for a, b in zip(new, new[1:]))
        self.short = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=pieces, special_tokens={}) if in_order else None
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self._text = vocabulary

    @staticmethod
    def _pairs(data: dict) -> list[list[str]]:
        return [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]

    @cached_property
    def merges(self) -> dict[tuple[int, int], int]:
        """Rank and new token of a pair in one number: the smallest is the pair to merge. Made when a long piece comes."""
        data = json.loads(self._text)
        ids = data["model"]["vocab"]
        return {(ids[a], ids[b]): rank << ID_BITS | ids[a + b] for rank, (a, b) in enumerate(self._pairs(data))}

    def leaf(self, piece: bytes) -> list[int]:
        """BPE of one uncut piece: the pair of the lowest rank, leftmost first, until none is left."""
        ids = [self.first[b] for b in piece]
        get = self.merges.get
        if len(ids) <= 32:
            ranks = [get(p, NONE) for p in zip(ids, ids[1:])]
            while ranks and (best := min(ranks)) < NONE:
                i = ranks.index(best)
                ids[i : i + 2] = [best & ID]
                del ranks[i]
                if i:
                    ranks[i - 1] = get((ids[i - 1], ids[i]), NONE)
                if i < len(ranks):
                    ranks[i] = get((ids[i], ids[i + 1]), NONE)
            return ids
        after = [*range(1, len(ids)), -1]
        before = [*range(-1, len(ids) - 1)]
        heap = [(m, i, p) for i, p in enumerate(zip(ids, ids[1:])) if (m := get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, pair = heapq.heappop(heap)
            j = after[i]
            if ids[i] != pair[0] or j < 0 or ids[j] != pair[1]:
                continue
            new = m & ID
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (m := get((new, ids[k]))) is not None:
                    heapq.heappush(heap, (m, i, (new, ids[k])))
            h = before[i]
            if h >= 0 and (m := get((ids[h], new))) is not None:
                heapq.heappush(heap, (m, h, (ids[h], new)))
        return [t for t in ids if t >= 0]

    def tree(self, piece: bytes) -> list[int]:
        """BPE of an uncut piece of any length: halves, joined."""
        if len(piece) <= LEAF:
            return self.leaf(piece)
        half = len(piece) // 2
        return self.join(self.tree(piece[:half]), self.tree(piece[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The tokens of two neighbouring stretches of one uncut piece as tokens of the whole."""
        if not left or not right:
            return left or right
        size = WINDOW
        while True:
            a, b = left[-size:], right[:size]
            again = self.leaf(b"".join(map(self.bytes.__getitem__, a + b)))
            begins = len(a) == len(left) or again[0] == a[0]
            ends = len(b) == len(right) or again[-1] == b[-1]
            if begins and ends and (len(again) > 1 or len(a) == len(left) and len(b) == len(right)):
                return left[: len(left) - len(a)] + again + right[len(b) :]
            size *= 2

    def uncut(self, text: str) -> list[int]:
        """Tokens of a stretch between certain cuts: at once, or piece by piece if one is longer than a leaf."""
        if self.short is not None and not RUN.search(text):
            return self.short.encode_ordinary(text)
        pieces = self.pattern.findall(text)
        if self.short is not None and max(map(len, pieces)) <= LEAF:
            return self.short.encode_ordinary(text)
        return list(chain.from_iterable(self.tree(p.encode("utf-8", "replace")) for p in pieces))

    @staticmethod
    def cut(text: str, at: int) -> int:
        """The last certain cut within a stretch from ``at``, else the first one behind it, else the end."""
        end = at + STRETCH
        if end >= len(text):
            return len(text)
        i = text.rfind(" ", at + 1, end)
        while i > 0:
            if SAFE.match(text, i):
                return i
            i = text.rfind(" ", at + 1, i)
        found = SAFE.search(text, end)
        return found.start() if found else len(text)

    def ordinary(self, text: str) -> list[int]:
        out, at = [], 0
        while at < len(text):
            end = self.cut(text, at)
            out += self.uncut(text[at:end] if at or end < len(text) else text)
            at = end
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if not any(s in text for s in self.special):
            return self.ordinary(text)
        parts = self.split_special.split(text)
        return list(chain.from_iterable([self.special[p]] if p in self.special else self.ordinary(p) for p in parts if p))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def parts(self, text: str):
        """``(joined to the part before, text)``: parts that can be encoded apart.

        Parts that are not joined are whole by the pattern; joined ones belong to one uncut piece. How the pattern cuts
        white space depends on what follows, so a part does not end with it unless it is a single piece.
        """
        for p in self.split_special.split(text):
            if p in self.special:
                yield False, p
                continue
            held, blank = "", []  # blank: pieces of white space after what is held
            for i, stretch in enumerate(SAFE.split(p)):
                stretch = stretch if i == 0 else " " + stretch
                for piece in [stretch] if len(stretch) <= PART else self.pattern.findall(stretch):
                    if held and len(held) + sum(map(len, blank)) + len(piece) > PART:
                        yield False, held
                        held = ""
                    if len(piece) > PART:
                        yield from ((False, b) for b in blank)
                        blank = []
                        for at in range(0, len(piece), PART):
                            yield at > 0, piece[at : at + PART]
                    elif piece.isspace():
                        blank.append(piece)
                    else:
                        held, blank = held + "".join(blank) + piece, []
            if held or blank:
                yield False, held + "".join(blank)


_CODERS: dict[int, Coder] = {}


def _coder(shared) -> Coder:
    """One coder for each worker process and vocabulary."""
    key = hash(shared.value)
    if key not in _CODERS:
        _CODERS[key] = Coder(shared.value)
    return _CODERS[key]


def _lists(values: list[list[int]]) -> pa.Array:
    ends = [0]
    for v in values:
        ends.append(ends[-1] + len(v))
    flat = pa.array(chain.from_iterable(values), pa.int32(), size=ends[-1])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, type=pa.list_(pa.field("element", pa.int32())))


def _unused(docs: DataFrame, name: str) -> str:
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def encode(docs: DataFrame, vocabulary: str, text_column: str = "text", decoded: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` with ``token_ids array<int>`` and ``n_tokens long``.

    With ``decoded`` the tokens are decoded again where they are made, into ``decoded string``: one Python worker for
    both. ``vocabulary`` is the path of a byte-level BPE file, read on the driver (its size is that of the vocabulary).
    Null and empty texts give an empty list, repeated rows stay as they are, an empty table stays empty. Existing columns
    of the new names are replaced; all others, whatever their names, are kept.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())
    added = "token_ids array<int>, n_tokens long" + (", decoded string" if decoded else "")
    docs = docs.drop("token_ids", "n_tokens", *(["decoded"] if decoded else []))

    def short(batch: pa.RecordBatch) -> list[pa.Array]:
        coder = _coder(shared)
        ids = [coder.encode(t) for t in batch[text_column].to_pylist()]
        out = [_lists(ids), pa.array([len(i) for i in ids], pa.int64())]
        return [*out, pa.array([coder.decode(i) for i in ids], pa.string())] if decoded else out

    is_long = F.coalesce(F.char_length(docs[f"`{text_column}`"]) > PART, F.lit(False))
    near = with_columns(docs.where(~is_long), short, added)
    row_id = _unused(docs, "__row")
    far = materialize(docs.where(is_long).withColumn(row_id, F.monotonically_increasing_id()), "long-texts")

    def cut(batches):
        coder = _coder(shared)
        for batch in batches:
            for row, text in zip(batch["__row"].to_pylist(), batch["text"].to_pylist()):
                yield [(row, i, joined, part) for i, (joined, part) in enumerate(coder.parts(text))]

    def encode_parts(batches):
        coder = _coder(shared)
        for batch in batches:
            for row, i, joined, part, whole in zip(*(batch[c].to_pylist() for c in ("__row", "part", "joined", "text", "whole"))):
                found = coder.encode(part) if whole else coder.tree(part.encode("utf-8", "replace"))
                yield [(row, i, joined, found)]

    def meet(batches):
        """Parts of a document are neighbours and in order; only one document is held."""
        coder, row, done, open_ = _coder(shared), None, [], []

        def whole(ids):
            return (row, ids, len(ids), coder.decode(ids)) if decoded else (row, ids, len(ids))

        for batch in batches:
            out = []
            for r, joined, ids in zip(*(batch[c].to_pylist() for c in ("__row", "joined", "ids"))):
                if r != row and row is not None:
                    out.append(whole(done + _tree_join(coder, open_)))
                    done, open_ = [], []
                row = r
                if not joined:
                    done, open_ = done + _tree_join(coder, open_), []
                open_.append(ids)
            yield out
        if row is not None:
            yield [whole(done + _tree_join(coder, open_))]

    parts = rows(far.select(F.col(row_id).alias("__row"), F.col(f"`{text_column}`").alias("text")), cut, "__row long, part int, joined boolean, text string")
    # A piece that goes on in the next part is no whole piece either.
    parts = materialize(parts, "text-parts")
    following = parts.where("joined").selectExpr("__row", "part - 1 AS part", "true AS goes_on")
    parts = parts.join(following, ["__row", "part"], "left").selectExpr("__row", "part", "joined", "text", "NOT joined AND goes_on IS NULL AS whole")
    coded = rows(parts.repartition("__row", "part"), encode_parts, "__row long, part int, joined boolean, ids array<int>")
    met = rows(coded.repartition("__row").sortWithinPartitions("__row", "part"), meet, f"{row_id} long, {added}")
    return near.unionByName(far.join(met, row_id).drop(row_id))


def _tree_join(coder: Coder, parts: list[list[int]]) -> list[int]:
    while len(parts) > 1:
        parts = [coder.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else []


def decode(coded: DataFrame, vocabulary: str) -> DataFrame:
    """All columns with ``decoded string``, the text of ``token_ids``; an existing column of that name is replaced.

    Null ids give an empty text, unknown ids an error.
    """
    with open(vocabulary, encoding="utf-8") as file:
        shared = coded.sparkSession.sparkContext.broadcast(file.read())

    def text(batch: pa.RecordBatch) -> list[pa.Array]:
        coder = _coder(shared)
        return [pa.array([coder.decode(ids or []) for ids in batch["token_ids"].to_pylist()], pa.string())]

    return with_columns(coded, text, "decoded string")
