"""Fill-in-middle examples by block rotation inside one buffer.

A text is cut at two unit ends into prefix, middle and suffix. The three marks are inserted where their blocks begin,
which gives prefix, middle, suffix; two neighbouring blocks then change places by three reversals (each block alone,
then both together), which needs no second copy of the text. The same rotations, taken back in the opposite order,
give the text again.

Units are a word with the white space before it, or white space at the end of the text. All work is on UTF-8 bytes:
white space is one byte each, so unit ends never fall inside a character.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gaugeweave.llm.tables import with_columns

PLAIN, PSM, SPM = "plain", "psm", "spm"
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


@dataclass(frozen=True)
class Marks:
    """What stands before prefix, suffix and middle. A text that holds one of them stays plain."""

    prefix: bytes = b"<P>"
    suffix: bytes = b"<S>"
    middle: bytes = b"<M>"

    def inside(self, text: bytes) -> bool:
        return self.prefix in text or self.suffix in text or self.middle in text


def unit_ends(text: bytes) -> np.ndarray:
    """Where the units of a text end, in bytes; the last one is the length of a text that is not empty."""
    if not text:
        return np.zeros(0, np.int64)
    blank = _BLANK[np.frombuffer(text, np.uint8)]
    return np.append(np.flatnonzero(blank[1:] & ~blank[:-1]) + 1, len(text))


def reverse(buffer: bytearray, start: int, end: int) -> None:
    """The bytes from ``start`` to ``end`` in the opposite order, in place."""
    view, half = np.frombuffer(buffer, np.uint8)[start:end], (end - start) // 2
    low = view[:half].copy()
    view[:half] = view[::-1][:half]
    view[len(view) - half :] = low[::-1]


def rotate(buffer: bytearray, start: int, between: int, end: int) -> None:
    """The neighbouring blocks ``[start, between)`` and ``[between, end)`` change places."""
    reverse(buffer, start, between)
    reverse(buffer, between, end)
    reverse(buffer, start, end)


def arranged(text: bytes, first: int, second: int, form: str, marks: Marks = Marks()) -> bytes:
    """The text cut at the two byte positions, in the order of ``form``."""
    if form == PLAIN:
        return text
    buffer = bytearray(text)
    for at, mark in ((second, marks.suffix), (first, marks.middle), (0, marks.prefix)):
        buffer[at:at] = mark
    middle_at = len(marks.prefix) + first
    suffix_at = middle_at + len(marks.middle) + second - first
    rotate(buffer, middle_at, suffix_at, len(buffer))  # prefix, suffix, middle
    if form == SPM:
        rotate(buffer, 0, middle_at, middle_at + len(buffer) - suffix_at)
    return bytes(buffer)


def restored_text(output: bytes, form: str, marks: Marks = Marks()) -> bytes:
    """The text that ``arranged`` made ``output`` of, from output and form alone."""
    if form == PLAIN:
        return output
    buffer = bytearray(output)
    middle_at = buffer.find(marks.middle)
    if form == SPM:
        prefix_at = buffer.find(marks.prefix)
        rotate(buffer, 0, prefix_at, middle_at)
    suffix_at = buffer.find(marks.suffix)
    rotate(buffer, suffix_at, middle_at, len(buffer))  # the middle begins where the suffix began
    last = suffix_at + len(buffer) - middle_at
    for at, mark in ((last, marks.suffix), (suffix_at, marks.middle), (0, marks.prefix)):
        del buffer[at : at + len(mark)]
    return bytes(buffer)


def draws(doc_id, seed: int) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 from seed and id; a null id counts as an empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def _points(text: bytes) -> int:
    return int(np.count_nonzero(np.frombuffer(text, np.uint8) & 0xC0 != 0x80))


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, marks: Marks = Marks(),
                   id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All rows and columns with ``n long, form string, prefix_chars long, middle_chars long, output string``.

    ``percent`` of the texts are cut, ``spm_percent`` of these begin with the suffix. Form and cuts depend on seed, id
    and number of units only, so repeated rows give equal results whatever task they are in; rows with equal ids and
    other texts share the draw. Null and empty texts are ``plain`` with an empty output, texts that hold a mark are
    ``plain`` unchanged; plain rows have null lengths. A null id is drawn like an id without digits. Existing columns of
    the five names are replaced; an empty table gives an empty table. Each row is worked on alone, so no group can be
    hot, and memory is that of the 256 rows in work.
    """

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for doc_id, text in zip(batch[id_column].to_pylist(), batch[text_column].cast(pa.binary()).to_pylist()):
            text = text or b""
            ends = np.append(0, unit_ends(text))
            n = len(ends) - 1
            h1, h2, h3, h4 = draws(doc_id, seed)
            if not text or h3 % 100 >= percent or marks.inside(text):
                out.append((n, PLAIN, None, None, text))
                continue
            first, second = (int(ends[u]) for u in sorted((h1 % (n + 1), h2 % (n + 1))))
            form = SPM if h4 % 100 < spm_percent else PSM
            out.append((n, form, _points(text[:first]), _points(text[first:second]), arranged(text, first, second, form, marks)))
        n, form, prefix, middle, output = zip(*out)
        return [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                pa.array(output, pa.binary()).cast(pa.string())]

    return with_columns(docs, work, "n long, form string, prefix_chars long, middle_chars long, output string")


def restore(arranged_docs: DataFrame, marks: Marks = Marks(), name: str = "restored") -> DataFrame:
    """All rows and columns with the text that ``output`` was made of, from ``output`` and ``form`` alone.

    A null output gives null; an existing column of the name is replaced.
    """

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        pairs = zip(batch["output"].cast(pa.binary()).to_pylist(), batch["form"].to_pylist())
        texts = [None if output is None else restored_text(output, form, marks) for output, form in pairs]
        return [pa.array(texts, pa.binary()).cast(pa.string())]

    return with_columns(arranged_docs, work, f"{name} string")
