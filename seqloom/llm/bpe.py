"""BPE encoding and decoding (operator 3) and the cached word encoder behind operator 1.

A tokenizer file is read for its rules: added tokens, normalizer, pre-token
pattern, vocabulary and merges. `MergeEncoder` encodes one pre-token with a
priority queue of merge ranks over a doubly linked symbol list. Pre-tokens are
encoded independently of one another, so each distinct one is encoded once per
worker and kept in a bounded cache.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from seqloom import runtime
from seqloom.llm.texts import Splitter, chunks
from seqloom.llm.workers import memory

#: Distinct pre-tokens that a worker remembers before it starts afresh (bounds its memory; changes no result).
CACHE_WORDS = 300_000
#: ... or once they have so many characters.
CACHE_CHARS = 8_000_000
#: Unicode White_Space, which is what \s means in the tokenizer file.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: The pattern of the word tokenizer, and the same for texts of Latin-1 letters in lower case, where the classes are short lists.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS, _NUMBERS = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff\xc0-\xd6\xd8-\xde", r"0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN = re.compile(rf"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}{SPACE}]+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 for itself, others from U+0100 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Rules:
    """The parts of a word-level BPE tokenizer file that encoding needs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"].get("pretokenizers", [])
        steps = [(x["type"], x.get("content")) for x in (spec["normalizer"] or {}).get("normalizers", [])]
        known = (
            model["type"] == "BPE"
            and steps == [("NFC", None), ("Replace", " "), ("Lowercase", None)]
            and [x["type"] for x in pre] == ["Split", "ByteLevel"]
            and pre[0]["behavior"] == "Removed"
            and pre[0]["invert"]
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])
            and spec["decoder"] is None
        )
        if not known:
            raise ValueError(f"{path}: not a word BPE tokenizer with NFC, lower case and end-of-word suffix")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks: dict[tuple[str, str], int] = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.added.items()}
        self._added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self._latin = pre[0]["pattern"]["Regex"] == WORDS
        self._words = Splitter(pre[0]["pattern"]["Regex"].replace(r"\s", SPACE))
        self.letters = byte_letters()
        self._normalizer = library_tokenizer(path).normalizer

    def normal(self, text: str) -> str:
        """NFC, then lower case, once each; white space only separates words here, so runs of it need no replacing.

        Latin-1 texts are in NFC as they are; others are normalized by the tokenizers library, whose Unicode tables may be of another version than Python's.
        """
        return text.lower() if is_latin(text) else self._normalizer.normalize_str(text)

    def _split(self, text: str) -> list[str]:
        text = self.normal(text)
        if self._latin and is_latin(text):
            return LATIN.findall(text)
        return self._words.findall(text)

    def words(self, text: str) -> list[str]:
        """Pre-tokens in order; an added token stands among them as its own string."""
        if self._added and "<" in text and len(parts := self._added.split(text)) > 1:
            out: list[str] = []
            for i, part in enumerate(parts):
                if i % 2:
                    out.append(part)
                else:
                    out += self._split(part)
            return out
        return self._split(text)


def library_tokenizer(path: str):
    """The tokenizers library's tokenizer of a file, without truncation and padding, in one thread."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class MergeEncoder:
    """Encodes single pre-tokens: a heap of (merge rank, position) over a doubly linked list of symbols."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def symbols(self, word: str) -> list[str]:
        r = self.rules
        if word in r.added:
            return [word]
        sym = [r.letters[b] for b in word.encode()]
        sym[-1] += r.suffix
        n = len(sym)
        if n == 1:
            return sym
        ranks = r.ranks
        get = ranks.get
        heap = [(rank, i) for i in range(n - 1) if (rank := get((sym[i], sym[i + 1]))) is not None]
        if not heap:
            return sym
        heapq.heapify(heap)
        push, pop = heapq.heappush, heapq.heappop
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while heap:
            rank, i = pop(heap)
            left = sym[i]
            if left is None:
                continue
            j = after[i]
            if j >= n or get((left, sym[j])) != rank:
                continue  # stale: a neighbour has changed since this entry was queued
            merged = sym[i] = left + sym[j]
            sym[j] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (rank := get((merged, sym[k]))) is not None:
                    push(heap, (rank, i))
            h = before[i]
            if h >= 0 and (rank := get((sym[h], merged))) is not None:
                push(heap, (rank, h))
        return [s for s in sym if s is not None]


class CachedCodec:
    """word -> (ids as little-endian u32 bytes, decoded text of the word), each distinct word once."""

    def __init__(self, path: str):
        self.rules = Rules(path)
        self.encoder = MergeEncoder(self.rules)
        self.ids: dict[str, bytes] = {}
        self.text: dict[str, str] = {}
        self.chars = 0

    def learn(self, words: list[str]) -> None:
        new = set(words).difference(self.ids)
        if not new:
            return
        size = sum(map(len, new))
        if len(self.ids) + len(new) > CACHE_WORDS or self.chars + size > CACHE_CHARS:
            self.ids.clear()
            self.text.clear()
            new = set(words)
            self.chars, size = 0, sum(map(len, new))
        self.chars += size
        rules, symbols = self.rules, self.encoder.symbols
        for w in new:
            sym = symbols(w)
            ids = [rules.added[w]] if w in rules.added else [rules.vocab[s] for s in sym]
            self.ids[w] = struct.pack(f"<{len(ids)}I", *ids)
            self.text[w] = " ".join(rules.names[i] for i in ids)


_codecs: dict[str, CachedCodec] = memory("codecs")


def codec(path: str) -> CachedCodec:
    """This worker's codec of a tokenizer file (workers are reused, so the cache outlives a task)."""
    if path not in _codecs:
        _codecs[path] = CachedCodec(path)
    return _codecs[path]


def encode_ids(text: str, path: str) -> np.ndarray:
    c = codec(path)
    words = c.rules.words(text)
    c.learn(words)
    return np.frombuffer(b"".join(map(c.ids.__getitem__, words)), dtype="<u4")


def decode_ids(ids, path: str) -> str:
    """Vocabulary strings of the ids, one space between them (the file names no decoder)."""
    names = codec(path).rules.names
    return " ".join(names[int(i)] for i in ids)


def round_trip(docs: DataFrame, tokenizer_path: str, keep: bool = True) -> DataFrame:
    """Encode and decode whole texts.

    docs: any table with a `text` column and a `doc_id`; other columns are ignored.
    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, with keep, ids and
    decoded. A null text counts as empty: no ids, empty decoded text. Repeated
    rows give a row each. One pass over the input; nothing is shuffled.
    """
    runtime.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        for batch in batches:
            ids = batch.column(0)
            for start, end, texts in chunks(batch):
                counts, first, second, raw, shown = [], [], [], [], []
                for text in texts:
                    words = c.rules.words(text)
                    c.learn(words)
                    data = b"".join(map(c.ids.__getitem__, words))
                    back = " ".join(map(c.text.__getitem__, words))
                    counts.append(len(data) // 4)
                    first.append(hashlib.sha256(data).hexdigest())
                    second.append(hashlib.sha256(back.encode()).hexdigest())
                    if keep:
                        raw.append(np.frombuffer(data, "<u4").astype("<i4"))
                        shown.append(back)
                columns = {"doc_id": ids.slice(start, end - start), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(first, pa.string()), "decoded_sha256": pa.array(second, pa.string())}
                if keep:
                    columns |= {"ids": pa.array(raw, pa.list_(pa.int32())), "decoded": pa.array(shown, pa.string())}
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep else "")
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, schema)


class LibraryWords:
    """ids of distinct words from the tokenizers library, as bytes of the given width."""

    def __init__(self, path: str):
        self.rules = Rules(path)
        self.tokenizer = library_tokenizer(path)
        self.tokenizer.normalizer = None  # words are normalized already: a second time can change them
        size = max(self.rules.names) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.zeros(size, bool)
        if self.rules.suffix:
            for i, s in self.rules.names.items():
                self.ends[i] = s.endswith(self.rules.suffix)
        self.ids: dict[str, bytes] = {w: np.array([i], self.dtype).tobytes() for w, i in self.rules.added.items()}
        self.chars = 0

    def learn(self, words: set[str]) -> None:
        new = words.difference(self.ids)
        if not new:
            return
        size = sum(map(len, new))
        if len(self.ids) + len(new) > 3 * CACHE_WORDS // 2 or self.chars + size > CACHE_CHARS:  # an entry is half as large as the codec's
            self.ids = {w: self.ids[w] for w in self.rules.added}
            new = words.difference(self.ids)
            self.chars, size = 0, sum(map(len, new))
        self.chars += size
        todo = list(new)
        # Many words in one call, one space between them; each word's last token bears the end-of-word suffix.
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(todo)], add_special_tokens=False)[0].ids, self.dtype)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(todo):
            data, width, at = ids.tobytes(), self.dtype.itemsize, 0
            for w, cut in zip(todo, (cuts * width).tolist(), strict=True):
                self.ids[w] = data[at:cut]
                at = cut
        else:
            for w, e in zip(todo, self.tokenizer.encode_batch_fast(todo, add_special_tokens=False), strict=True):
                self.ids[w] = np.array(e.ids, self.dtype).tobytes()

    def encode(self, texts: list[str], together: int = 100) -> list[bytes]:
        """Ids of each text; new words of `together` texts are encoded in one call."""
        out: list[bytes] = []
        for at in range(0, len(texts), together):
            split = [self.rules.words(t) for t in texts[at : at + together]]
            self.learn(set().union(*split))
            get = self.ids.__getitem__
            out += [b"".join(map(get, words)) for words in split]
        return out


_library: dict[str, LibraryWords] = memory("library_words")


def library_words(path: str) -> LibraryWords:
    if path not in _library:
        _library[path] = LibraryWords(path)
    return _library[path]
