"""Seed generation: variable-length and fixed hashes over the reduced alphabet."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom import runtime
from seqloom.functions import codec
from seqloom.functions.alphabet import BLOSUM62, REDUCED, ReducedAlphabet, ScoreMatrix

# Shortest and longest seed, the score at which a seed may end, context length.
SHORTEST, LONGEST, THRESHOLD, CONTEXT = 6, 8, 39, 10


@dataclass(frozen=True)
class SeedRules:
    reduced: ReducedAlphabet = REDUCED
    matrix: ScoreMatrix = BLOSUM62
    shortest: int = SHORTEST
    longest: int = LONGEST
    threshold: int = THRESHOLD
    context: int = CONTEXT

    @property
    def bits(self) -> int:
        """Bits of a class in a hash."""
        return shift_bits(self.reduced.max_code)

    @property
    def max_hash(self) -> int:
        return (1 << (self.bits * self.longest)) - 1

    @property
    def packed(self) -> bool:
        """Whether a context fits a long, four bits a class; others are class strings."""
        return self.context <= 15 and max(self.reduced.code_of.values()) < 16

    @property
    def ctx_type(self) -> str:
        return "bigint" if self.packed else "string"

    @property
    def scores(self) -> np.ndarray:
        return self.matrix.class_scores(self.reduced)


def shift_bits(max_code: int) -> int:
    """ceil(log2(max_code)): enough for codes up to max_code + 1 unless that is a power of two; hashes stay as defined."""
    return max(1, (max_code - 1).bit_length())


def hash_all(classes: np.ndarray, rules: SeedRules) -> tuple[np.ndarray, np.ndarray]:
    """(hash, length) of the seed at each position of a class array; length 0 where there is none.

    Classes are taken one after another up to the longest; each must be that of
    a regular letter, and the end is tested only when a further class is at hand.
    """
    n = len(classes)
    padded = np.concatenate([classes.astype(np.int64), np.full(rules.longest, 255)])
    scores = np.concatenate([rules.scores, np.zeros(256 - len(rules.scores), np.int64)])
    value, score, length = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    open_, good = np.ones(n, bool), np.ones(n, bool)
    for k in range(rules.longest):
        c = padded[k : k + n]
        valid = c <= rules.reduced.max_code
        good &= valid | ~open_
        open_ &= valid
        if k >= rules.shortest:
            open_ &= score < rules.threshold
        value = np.where(open_, (value << rules.bits) + c + 1, value)
        score += np.where(open_, scores[c], 0)
        length[open_] = k + 1
    return np.where(good, value, 0), np.where(good, length, 0)


def contexts(classes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(packed context, inside) of each position: the classes of [p - size/2, p - size/2 + size), four bits each."""
    n, half = len(classes), size // 2
    packed, inside = np.zeros(n, np.int64), np.zeros(n, bool)
    if n >= size:
        runs = np.zeros(n - size + 1, np.int64)
        for k in range(size):
            runs = (runs << 4) | classes[k : k + len(runs)].astype(np.int64)
        packed[half : half + len(runs)] = runs
        inside[half : half + len(runs)] = True
    return packed, inside


def context_column(classes: np.ndarray, at: np.ndarray, rules: SeedRules, low: np.ndarray | int = 0, high: np.ndarray | int | None = None) -> pa.Array:
    """Contexts of some positions, null where they leave their sequence [low, high): packed, or as class strings where they do not fit."""
    size, half = rules.context, rules.context // 2
    inside = (at - half >= low) & (at - half + size <= (len(classes) if high is None else high))
    if rules.packed:
        return pa.array(contexts(classes, size)[0][at], pa.int64(), mask=~inside)
    letters = np.frombuffer(codec.CLASS_LETTERS.encode(), np.uint8)[np.minimum(classes, len(codec.CLASS_LETTERS) - 1)]
    rows = letters[np.where(inside, at - half, 0)[:, None] + np.arange(size)].tobytes().decode() if inside.any() else ""
    return pa.array([rows[i * size : (i + 1) * size] if x else None for i, x in enumerate(inside.tolist())], pa.string())


def drop_nested(length: np.ndarray) -> np.ndarray:
    """Which seeds stay: one goes if the next position's seed ends no later."""
    stays = length > 0
    stays[:-1] &= ~((length[1:] > 0) & (length[:-1] - 1 >= length[1:]))
    return stays


def subject_seeds(sequences: DataFrame, rules: SeedRules | None = None) -> DataFrame:
    """hash, seq_id, pos (1-based), seed_len, ctx (null outside) of a database's sequences; seeds nested in the next one are dropped. No shuffle."""
    rules = rules or SeedRules()
    runtime.ship(sequences.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gap = np.array([255], np.uint8)  # no class: seeds end there

        def solve(ids: list[int], held: list[np.ndarray]) -> pa.RecordBatch:
            classes = np.concatenate([x for one in held for x in (one, gap)])
            high = np.cumsum([len(x) + 1 for x in held]) - 1
            low = high - [len(x) for x in held]
            value, length = hash_all(classes, rules)
            at = np.flatnonzero(drop_nested(length))
            owner = np.searchsorted(high, at, side="right")
            return pa.RecordBatch.from_pydict({"hash": value[at], "seq_id": np.array(ids, np.int64)[owner], "pos": (at - low[owner] + 1).astype(np.int32), "seed_len": length[at].astype(np.int32), "ctx": context_column(classes, at, rules, low[owner], high[owner])})

        for batch in batches:
            ids, held, size = [], [], 0
            for seq_id, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(seq_id)
                held.append(rules.reduced.lookup[rules.reduced.alphabet.encode(seq or "")])
                size += len(held[-1])
                if size >= 1 << 18:
                    yield solve(ids, held)
                    ids, held, size = [], [], 0
            if ids:
                yield solve(ids, held)

    return runtime.widen(sequences.select(F.col("seq_id").cast("bigint"), "seq")).mapInArrow(run, f"hash bigint, seq_id bigint, pos int, seed_len int, ctx {rules.ctx_type}")


def query_seeds(frames: DataFrame, rules: SeedRules | None = None) -> DataFrame:
    """query_id, frame, pos, hash, checked, ctx of masked frames at least a context long; nested seeds stay."""
    rules = rules or SeedRules()
    runtime.ship(frames.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for query_id, frame, seq in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if len(seq or "") < rules.context:
                    continue
                classes = rules.reduced.lookup[rules.reduced.alphabet.encode(seq)]
                value, length = hash_all(classes, rules)
                at = np.flatnonzero(length)
                half = rules.context // 2
                checked = (at >= half) & (at < len(classes) - half)
                yield pa.RecordBatch.from_pydict({"query_id": np.full(len(at), query_id, np.int64), "frame": np.full(len(at), frame, np.int32), "q_pos": (at + 1).astype(np.int32), "hash": value[at], "checked": checked, "q_ctx": context_column(classes, at, rules)})

    return frames.select(F.col("query_id").cast("bigint"), F.col("frame").cast("int"), "masked").mapInArrow(run, f"query_id bigint, frame int, q_pos int, hash bigint, checked boolean, q_ctx {rules.ctx_type}")


# Native forms, for use inside other plans.


def class_windows(rows: DataFrame, keys: list[str], classes: str, count: int = LONGEST) -> DataFrame:
    """keys, pos (1-based) and class codes c0, c1, ... of the residues from there on (null past the end), for every position.

    The class string becomes an array once a sequence; each position takes a
    slice of it, so the work is linear in the length.
    """
    codes = F.transform(F.split(classes, ""), lambda x: F.call_function("instr", F.lit(codec.CLASS_LETTERS), x) - 1)
    # Exploding keeps Catalyst from computing the array anew for each position.
    held = rows.where(F.length(classes) > 0).select(*keys, F.explode(F.array(codes)).alias("_codes"))
    windows = F.transform(F.sequence(F.lit(1), F.size("_codes")), lambda i: F.slice("_codes", i, count))
    spread = held.select(*keys, F.posexplode(windows).alias("_p", "_w"))
    return spread.select(*keys, (F.col("_p") + 1).alias("pos"), *[F.get("_w", F.lit(k)).alias(f"c{k}") for k in range(count)])


def variable_hash(codes: list[Column], rules: SeedRules | None = None) -> Column:
    """struct<hash, seed_len> of class codes at a position, as hash_all; null where there is none."""
    rules = rules or SeedRules()
    scores = rules.scores.tolist()
    valid = [F.coalesce(c <= rules.reduced.max_code, F.lit(False)) for c in codes]
    point = F.array(*[F.lit(int(s)) for s in scores])
    value, score, answer = F.lit(0).cast("bigint"), F.lit(0), F.lit(None).cast("struct<hash:bigint,seed_len:int>")
    levels = []
    for k in range(rules.longest):
        if k >= rules.shortest:
            levels.append((valid[k] & (score >= rules.threshold), F.struct(value.alias("hash"), F.lit(k).alias("seed_len"))))
        value = value * (1 << rules.bits) + codes[k] + 1
        score = score + F.when(valid[k], F.try_element_at(point, codes[k] + 1))
    head = F.lit(True)
    for k in range(rules.shortest):
        head = head & valid[k]
    result = F.when(F.lit(True) & valid[-1], F.struct(value.alias("hash"), F.lit(rules.longest).alias("seed_len"))).otherwise(answer)
    for k in range(rules.longest - 1, rules.shortest - 1, -1):
        condition, found = levels[k - rules.shortest]
        result = F.when(~valid[k], answer).when(condition, found).otherwise(result)
    return F.when(head, result).otherwise(answer)


def fixed_hash(codes: list[Column], bits: int = 4) -> Column:
    """Hash of a fixed number of classes, without the one added to each: null if a class is missing."""
    value = F.lit(0).cast("bigint")
    for c in codes:
        value = value * (1 << bits) + c
    return value


def nested_elimination(seeds: DataFrame) -> DataFrame:
    """seeds (seq_id, pos, seed_len) without those whose next position's seed ends no later."""
    w = Window.partitionBy("seq_id").orderBy("pos")
    nxt = F.lead(F.struct("pos", "seed_len")).over(w)
    nested = (nxt["pos"] == F.col("pos") + 1) & (F.col("seed_len") - 1 >= nxt["seed_len"])
    return seeds.withColumn("_nested", F.coalesce(nested, F.lit(False))).where("not _nested").drop("_nested")


def one_mismatch(hashes: DataFrame, length: int, max_code: int) -> DataFrame:
    """hash, neighbour: every fixed hash of `length` classes that differs in one class (length * max_code of them)."""
    bits = shift_bits(max_code)
    place = F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("place")
    spread = hashes.select("hash", place).select("hash", "place", F.explode(F.sequence(F.lit(0), F.lit(max_code))).alias("code"))
    shift = F.col("place") * bits
    now = F.expr(f"shiftright(hash, place * {bits}) & {(1 << bits) - 1}")
    changed = F.col("hash") + (F.col("code") - now) * F.pow(F.lit(2), shift).cast("bigint")
    return spread.where(F.col("code") != now).select("hash", changed.cast("bigint").alias("neighbour"))
