"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Characters of text that a Python worker turns into objects at a time.
CHUNK_CHARS = 4_000_000


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int, list[str]]]:
    """(first row, end row, texts) slices of a batch with about `limit` bytes of text each; a null text becomes ''."""
    array = batch.column(batch.schema.get_field_index(column))
    rows, start = len(array), 0
    lengths = pc.fill_null(pc.binary_length(array), 0).to_pylist()
    size = 0
    for i in range(rows):
        size += lengths[i]
        if size >= limit:
            yield start, i + 1, [x or "" for x in array.slice(start, i + 1 - start).to_pylist()]
            start, size = i + 1, 0
    if start < rows:
        yield start, rows, [x or "" for x in array.slice(start).to_pylist()]


def _is_word(char: str) -> bool:
    """Whether the tokenizers library takes a code point for a letter or a number."""
    from tokenizers import Regex, pre_tokenizers

    return not pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), "removed").pre_tokenize_str(char)


class Splitter:
    """Pre-tokens by a pattern, with letters and numbers as the tokenizers' own Unicode tables have them.

    The regex module may know letters of a later Unicode version: for code points
    that unicodedata does not know, the tokenizers library is asked.
    """

    STAND_IN = "\ue000"

    def __init__(self, pattern: str):
        self.pattern = regex.compile(pattern)
        self.assigned: set[str] = set()

    def _plain(self, text: str) -> str | None:
        """text with a private-use stand-in for each code point that is no letter or number there; None if it has none."""
        if text.isascii():
            return None
        new = set(text) - self.assigned
        if new:
            odd = {c for c in new if unicodedata.category(c) == "Cn" and not _is_word(c)}
            self.assigned |= new - odd
            if odd:
                return text.translate({ord(c): self.STAND_IN for c in odd})
        return None

    def findall(self, text: str) -> list[str]:
        plain = self._plain(text)
        if plain is None:
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(plain)]

    def spans(self, text: str) -> Iterator[tuple[str, int]]:
        """(pre-token, its end) in order."""
        plain = self._plain(text)
        for m in self.pattern.finditer(text if plain is None else plain):
            yield text[m.start() : m.end()], m.end()
