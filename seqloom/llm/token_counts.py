"""Edit-aware token counts (operator 5).

A document keeps a segment tree over its pre-tokens: leaves hold short runs of
pre-tokens with their lengths and token counts, inner nodes the sums. An edit
finds the leaves it touches from the sums, splits anew from a little before the
edit until a boundary falls on an old one behind it, encodes only those
pre-tokens, and updates the sums on the way to the root. Everything after that
boundary stands as it was: a pre-token depends on the text from its start on.

Texts are plain text here: strings of special tokens have no special meaning.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom import runtime
from seqloom.llm.packing import PATTERN, byte_encoder
from seqloom.llm.texts import Splitter, chunks
from seqloom.llm.workers import memory

SPLIT = Splitter(PATTERN)
#: Pre-tokens of a new leaf; a leaf that edits have grown to four times that makes the tree be built anew.
LEAF = 32
#: Pre-tokens before the one that an edit touches which may change with it (white space looks two ahead).
CONTEXT = 2
CACHE_WORDS, CACHE_CHARS = 300_000, 8_000_000
#: Pre-tokens of more characters are not remembered.
LONG = 200

_counts: dict[str, dict[str, int]] = memory("token_counts")


class Counter:
    """Token counts of pre-tokens, each distinct one encoded once per worker."""

    def __init__(self, tokenizer_path: str):
        self.known = _counts.setdefault(tokenizer_path, {})
        self.encoder = byte_encoder(tokenizer_path, special=False)

    def __call__(self, words: list[str]) -> list[int]:
        known = self.known
        try:
            return list(map(known.__getitem__, words))
        except KeyError:
            new = set(words).difference(known)
            if len(known) + len(new) > CACHE_WORDS or sum(map(len, new)) > CACHE_CHARS:
                known.clear()
                new = set(words)
            for w, n in zip(new, self.encoder.counts(list(new)), strict=True):
                known[w] = n
            counts = list(map(known.__getitem__, words))
            for w in [w for w in new if len(w) > LONG]:
                del known[w]
            return counts


class Tree:
    """Segment tree of a text: (code points, tokens) sums over leaves of pre-tokens."""

    def __init__(self, text: str, counter: Counter):
        self.counter = counter
        self.encoded = 0  # code points encoded, in all
        self._build(SPLIT.findall(text))
        self.encoded = self.chars

    def _build(self, words: list[str]) -> None:
        counts = self.counter(words)
        self.leaves = [words[i : i + LEAF] for i in range(0, len(words), LEAF)] or [[]]
        n = self.width = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.length, self.tokens = [0] * (2 * n), [0] * (2 * n)
        for i, leaf in enumerate(self.leaves):
            self.length[n + i] = len("".join(leaf))
            self.tokens[n + i] = sum(counts[i * LEAF : i * LEAF + len(leaf)])
        for i in range(n - 1, 0, -1):
            self.length[i] = self.length[2 * i] + self.length[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def chars(self) -> int:
        return self.length[1]

    @property
    def count(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(w for leaf in self.leaves for w in leaf)

    def _leaf_at(self, position: int) -> tuple[int, int]:
        """(leaf, code points before it) of the leaf that holds a position; the last leaf for the end."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if position >= before + self.length[node] and self._any(node + 1):
                before += self.length[node]
                node += 1
        return node - self.width, before

    def _any(self, node: int) -> bool:
        return self.length[node] > 0

    def _set(self, leaf: int, words: list[str], counts: list[int]) -> None:
        self.leaves[leaf] = words
        node = self.width + leaf
        self.length[node], self.tokens[node] = len("".join(words)), sum(counts)
        while node > 1:
            node //= 2
            self.length[node] = self.length[2 * node] + self.length[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def tokens_before(self, position: int) -> int:
        """Tokens of the pre-tokens that end at or before a position."""
        leaf, before = self._leaf_at(position)
        node, total = self.width + leaf, 0
        while node > 1:
            if node & 1:
                total += self.tokens[node - 1]
            node //= 2
        words = self.leaves[leaf]
        inside = bisect_right(list(accumulate(map(len, words))), position - before)
        return total + sum(self.counter(words[:inside]))

    def replace(self, position: int, removed: int, inserted: str) -> None:
        """Replace `removed` code points at `position` (both cut to the text) by `inserted`."""
        position = min(max(position, 0), self.chars)
        removed = min(max(removed, 0), self.chars - position)
        if not removed and not inserted:
            return
        first, before = self._leaf_at(position)
        words = list(self.leaves[first])
        ends = list(accumulate(map(len, words), initial=before))
        at = bisect_right(ends, position) - 1  # the word that holds the position
        while at < CONTEXT and first > 0:  # context reaches into the leaf before
            first -= 1
            if extra := self.leaves[first]:
                words = extra + words
                before -= self.length[self.width + first]
                at += len(extra)
        start = max(0, at - CONTEXT)
        kept, tail = words[:start], words[start:]
        origin = before + sum(map(len, kept))
        # Old text from the restart on, leaf by leaf, as far as it proves necessary.
        last = first
        while last + 1 < len(self.leaves) and last < self._leaf_at(position)[0]:
            last += 1  # leaves that the words gathered above come from
        old = "".join(tail)
        while origin + len(old) < position + removed and last + 1 < len(self.leaves):
            last += 1
            tail = tail + self.leaves[last]
            old += "".join(self.leaves[last])
        while True:
            offset = position - origin
            new = old[:offset] + inserted + old[offset + removed :]
            shift = len(inserted) - removed
            boundary = {e + shift for e in accumulate(map(len, tail), initial=0) if e >= offset + removed}
            complete = last + 1 == len(self.leaves)
            made, reached = [], 0
            for word, end in SPLIT.spans(new):
                # A match near the end of what is at hand may go on in the next leaf.
                if not complete and end + CONTEXT >= len(new):
                    reached = -1
                    break
                made.append(word)
                reached = end
                if reached >= offset + len(inserted) and reached in boundary:
                    break
            if reached < 0 or (not complete and reached < len(new) and reached not in boundary) or (not complete and not made):
                last += 1
                tail = tail + self.leaves[last]
                old += "".join(self.leaves[last])
                continue
            break
        ends_at = list(accumulate(map(len, tail), initial=0))
        rest = tail[bisect_right(ends_at, reached - shift) - 1 :] if reached < len(new) else []
        self.encoded += sum(map(len, made))
        whole = kept + made + rest
        if len(whole) > 4 * LEAF * (last - first + 1):
            self._build([w for leaf in self.leaves[:first] for w in leaf] + whole + [w for leaf in self.leaves[last + 1 :] for w in leaf])
            return
        share = -(-len(whole) // (last - first + 1)) if whole else 0
        for i in range(first, last + 1):
            part = whole[(i - first) * share : (i - first + 1) * share]
            self._set(i, part, self.counter(part))


def edit_counts(docs: DataFrame, edits: DataFrame | None, tokenizer_path: str, keep_text: bool = False) -> DataFrame:
    """Token counts before and after edits.

    docs: doc_id, text; other columns are ignored. edits: doc_id and `edits`, an
    array of (position int, removed int, inserted string) applied in order, each to
    the text that the one before left; None if docs itself has the column
    `edits`. Positions and lengths are in code points and are cut to the text;
    null fields count as 0 or ''. A null text is empty; a document without edits
    keeps its count. Repeated rows give a row each; an empty table none. Returns
    doc_id, n_tokens, edited_tokens, n_chars, edited_chars, reencoded_chars (code
    points encoded for the edits) and, with keep_text, edited_text.
    """
    runtime.ship(docs.sparkSession)
    rows = docs.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    rows = rows.select("doc_id", "text", "edits") if edits is None else rows.select("doc_id", "text").join(edits.select(F.col("doc_id").cast("bigint").alias("doc_id"), "edits"), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer_path)
        for batch in batches:
            for a, b, texts in chunks(batch):
                out: list[tuple] = []
                for text, todo in zip(texts, batch.column(2).slice(a, b - a).to_pylist(), strict=True):
                    tree = Tree(text, counter)
                    n, count, done = tree.chars, tree.count, tree.encoded
                    apply(tree, todo or ())
                    out.append((count, tree.count, n, tree.chars, tree.encoded - done, tree.text() if keep_text else None))
                columns = list(zip(*out, strict=True))
                names = ["n_tokens", "edited_tokens", "n_chars", "edited_chars", "reencoded_chars"]
                made = {"doc_id": batch.column(0).slice(a, b - a)} | {k: pa.array(c, pa.int64()) for k, c in zip(names, columns, strict=False)}
                yield pa.RecordBatch.from_pydict(made | ({"edited_text": pa.array(columns[5], pa.string())} if keep_text else {}))

    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, edited_tokens bigint, n_chars bigint, edited_chars bigint, reencoded_chars bigint" + (", edited_text string" if keep_text else ""))


def apply(tree: Tree, edits: Iterable[dict]) -> None:
    for e in edits:
        if e is not None:
            tree.replace(e["position"] or 0, e["removed"] or 0, e["inserted"] or "")
