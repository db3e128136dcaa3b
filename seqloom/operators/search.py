"""Search operators: queries, seed joins, filters, extension, results."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom import runtime
from seqloom.functions import alignment as al
from seqloom.functions import codec, masking
from seqloom.functions import statistics as st
from seqloom.functions.alphabet import BLOSUM62, ScoreMatrix


@dataclass(frozen=True)
class SearchOptions:
    """Fixed defaults: gap costs; X-drops and trigger in bits; results a query and a subject."""

    matrix: ScoreMatrix = BLOSUM62
    gap_open: int = 11
    gap_extend: int = 1
    mask: bool = True
    ungapped_drop_bits: float = 7.0
    trigger_bits: float = 22.0
    presearch_bits: float = 15.0
    final_bits: float = 25.0
    results: int = 10
    per_subject: int = 1

    @property
    def gapped(self) -> tuple[st.Karlin, float, float]:
        return st.gapped_parameters(self.matrix.name, self.gap_open, self.gap_extend)


def frames_of(queries: DataFrame, dna: bool) -> DataFrame:
    """query_id, name, base_len, frames: a protein is its own frame 0; DNA has six frames, none below 3 letters."""
    seq = F.coalesce("seq", F.lit(""))
    if dna:
        return queries.select("query_id", "name", F.length(seq).alias("base_len"), codec.six_frames(seq).alias("frames"))
    own = F.array(F.struct(F.lit(0).alias("frame"), codec.normalize(seq).alias("seq")))
    return queries.select("query_id", "name", F.length(seq).alias("base_len"), own.alias("frames"))


def prepare(queries: DataFrame, dna: bool, options: SearchOptions) -> DataFrame:
    """query_id, frame, name, base_len, m, masked, ux, trigger: a row a frame.

    masked: low-complexity residues replaced by the unknown letter; a frame too
    short to judge is masked as a whole. ux and trigger: the query's raw ungapped
    drop and trigger, from the composition of all its masked frames together. m:
    the query's length in residues.
    """
    runtime.ship(queries.sparkSession)
    matrix, alphabet = options.matrix, options.matrix.alphabet
    ideal = st.ideal_ungapped(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for query_id, name, base, frames in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                made = []
                for f in frames or []:
                    masked = masking.mask(f["seq"], alphabet.unknown) if options.mask else f["seq"]
                    made.append((f["frame"], alphabet.unknown * len(f["seq"]) if masked is None else masked))
                if not made:
                    continue
                p = st.query_ungapped(np.concatenate([alphabet.encode(s) for _, s in made]), matrix, ideal)
                ux, trigger = st.cutoff_from_bits(options.ungapped_drop_bits, p), st.score_from_bits(options.trigger_bits, p)
                out += [(query_id, frame, name, base, base // 3 if dna else base, masked, ux, trigger) for frame, masked in made]
            if out:
                columns = list(zip(*out, strict=True))
                kinds = [("query_id", pa.int64()), ("frame", pa.int32()), ("name", pa.string()), ("base_len", pa.int32()), ("m", pa.int32()), ("masked", pa.string()), ("ux", pa.int32()), ("trigger", pa.int32())]
                yield pa.RecordBatch.from_pydict({k: pa.array(c, t) for (k, t), c in zip(kinds, columns, strict=True)})

    return frames_of(queries, dna).mapInArrow(run, "query_id bigint, frame int, name string, base_len int, m int, masked string, ux int, trigger int")


def seed_hits(query_seeds: DataFrame, clustered: DataFrame, single: DataFrame, most: int, packed: bool = True) -> DataFrame:
    """query_id, frame, q_pos, seq_id, s_pos of seed matches.

    Clusters are judged by their representatives, one row a cluster: a query seed
    within most + 1 mismatches of it (or without a context of its own) passes to
    all members; the representative itself needs `most`. Seeds of no cluster
    match by hash alone. Give query_seeds as a written table: where its size is
    small, Spark sends it to the database's seeds, which then stay in place.
    """
    distance = F.when(F.col("checked"), codec.context_distance(F.col("q_ctx"), F.col("rep_ctx"), packed)).otherwise(0)
    heads = clustered.select("hash", "rep_ctx").distinct()
    passed = query_seeds.join(heads, "hash").withColumn("d", distance).where(F.greatest(F.col("d") - 1, F.lit(0)) <= most)
    members = passed.join(clustered.select("hash", "rep_ctx", "seq_id", "pos", "is_rep"), ["hash", "rep_ctx"]).where(~F.col("is_rep") | (F.col("d") <= most))
    columns = ["query_id", "frame", "q_pos", "seq_id", F.col("pos").alias("s_pos")]
    return members.select(*columns).unionByName(query_seeds.join(single, "hash").select(*columns))


#: Frames of queries that are sent to every task at a time; more queries go block by block.
FRAME_BYTES = 64 << 20
#: Hits of a subject that one task extends; a subject with more is sent to several.
SUBJECT_HITS = 1 << 18
#: Hits that a kernel extends at a time.
BLOCK_HITS = 20_000


class Frames:
    """Masked frames of a block of queries, as one array of codes."""

    def __init__(self, table: pa.Table, matrix: ScoreMatrix):
        texts = table.column("masked").to_pylist()
        self.codes = np.concatenate([np.zeros(0, np.uint8), *(matrix.alphabet.encode(x) for x in texts)])
        lengths = np.array([len(x) for x in texts], np.int64)
        self.high = np.cumsum(lengths)
        self.low = self.high - lengths
        self.ux, self.trigger = (table.column(c).to_numpy().astype(np.int64) for c in ("ux", "trigger"))
        self.queries, at = np.unique(table.column("query_id").to_numpy(), return_inverse=True)
        self.row = np.full(len(self.queries) * 6, -1)
        self.row[at * 6 + table.column("frame").to_numpy()] = np.arange(len(texts))

    def rows(self, query_id: np.ndarray, frame: np.ndarray) -> np.ndarray:
        return self.row[np.searchsorted(self.queries, query_id) * 6 + frame]


@dataclass
class Hits:
    """Seed hits with the sequences around them, by subject, query, frame, diagonal and place."""

    query_id: np.ndarray
    frame: np.ndarray
    seq_id: np.ndarray
    q: al.Lanes
    s: al.Lanes
    ux: np.ndarray
    trigger: np.ndarray
    follows: np.ndarray  # the hit before is on the same diagonal of the same frame and subject

    def take(self, i: np.ndarray) -> Hits:
        """Some of the hits, in order."""
        line = np.cumsum(~self.follows)[i]
        lanes = lambda x: al.Lanes(x.codes, x.at[i], x.low[i], x.high[i])
        return Hits(self.query_id[i], self.frame[i], self.seq_id[i], lanes(self.q), lanes(self.s), self.ux[i], self.trigger[i], np.append(False, line[1:] == line[:-1])[: len(i)])

    @property
    def places(self) -> dict[str, np.ndarray]:
        """0-based places in query and subject."""
        return {"q_hit": (self.q.at - self.q.low).astype(np.int32), "s_hit": (self.s.at - self.s.low).astype(np.int32)}


def extend_hits(hits: DataFrame, frames: DataFrame, sequences: DataFrame, kernel: Callable[[Hits], pa.RecordBatch | None], schema: str, matrix: ScoreMatrix = BLOSUM62) -> DataFrame:
    """Apply kernel to all hits (query_id, frame, seq_id, q_pos, s_pos) with their sequences.

    A subject with hits is moved once, whatever their number (once a part where
    it has more than SUBJECT_HITS, dealt by query and frame); hits follow it in
    order, as plain rows. Frames are sent to all tasks up to FRAME_BYTES; where
    there are more, block by block of queries.
    """
    spark = hits.sparkSession
    runtime.ship(spark)
    size = frames.agg(F.coalesce(F.sum(F.length("masked") + 64), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / FRAME_BYTES))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    rows = hits.select("query_id", "frame", "seq_id", F.col("s_pos").cast("int").alias("s_pos"), (F.col("s_pos") - F.col("q_pos")).cast("int").alias("diagonal"), block.alias("block"))
    rows = runtime.materialize(rows, partition_by="block" if blocks > 1 else None)
    out = None
    for b in range(blocks):
        part = frames.where(block == b).select("query_id", "frame", "masked", "ux", "trigger").toArrow()
        made = _extend_block(rows.where(F.col("block") == b) if blocks > 1 else rows, Frames(part, matrix), sequences, kernel, schema, matrix)
        out = made if out is None else out.unionByName(made)
    return out


def _extend_block(rows: DataFrame, frames: Frames, sequences: DataFrame, kernel: Callable[[Hits], pa.RecordBatch | None], schema: str, matrix: ScoreMatrix) -> DataFrame:
    spark = rows.sparkSession
    counts = runtime.materialize(rows.groupBy("seq_id").agg(F.ceil(F.count("*") / F.lit(SUBJECT_HITS)).cast("int").alias("parts")))
    hot = counts.where("parts > 1")
    dealt = rows.join(hot, "seq_id", "left").withColumn("part", F.pmod(F.xxhash64("query_id", "frame"), F.coalesce("parts", F.lit(1))).cast("int"))
    subjects = sequences.select(F.col("seq_id").cast("bigint").alias("seq_id"), "seq").join(counts, "seq_id").select("seq_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "seq")
    key = ["seq_id", "part", "query_id", "frame", "diagonal", "s_pos"]
    both = dealt.select(*key, F.lit(None).cast("string").alias("seq")).unionByName(subjects, allowMissingColumns=True).select(*key, "seq")
    shared = spark.sparkContext.broadcast(frames)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        held: list[pa.RecordBatch] = []
        size, subject = 0, np.zeros(0, np.uint8)  # the subject that the first rows at hand belong to

        def solve(t: pa.Table) -> tuple[pa.RecordBatch | None, np.ndarray]:
            texts = t.column("seq").drop_null().to_pylist()
            codes = [subject, *(matrix.alphabet.encode(x or "") for x in texts)]
            is_hit = t.column("seq").is_null().to_numpy()
            at = np.flatnonzero(is_hit)
            if not len(at):
                return None, codes[-1]
            owner = np.cumsum(~is_hit)[at]
            lengths = np.array([len(x) for x in codes], np.int64)
            high = np.cumsum(lengths)
            low = high - lengths
            # A subject's row comes before its hits: nulls, which sort first.
            number = lambda name: t.column(name).fill_null(0).to_numpy()[at].astype(np.int64)
            seq_id, query_id, frame, diagonal, s_pos = map(number, ("seq_id", "query_id", "frame", "diagonal", "s_pos"))
            row = f.rows(query_id, frame)
            line = np.stack([owner, row, diagonal])
            follows = np.append(False, (line[:, 1:] == line[:, :-1]).all(axis=0))
            q = al.Lanes(f.codes, f.low[row] + s_pos - diagonal - 1, f.low[row], f.high[row])
            s = al.Lanes(np.concatenate(codes), low[owner] + s_pos - 1, low[owner], high[owner])
            return kernel(Hits(query_id, frame.astype(np.int32), seq_id, q, s, f.ux[row], f.trigger[row], follows)), codes[-1]

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < BLOCK_HITS:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            line = np.stack([t.column(c).fill_null(-1).to_numpy().astype(np.int64) for c in key[:-1]])
            cut = int((line != line[:, -1:]).any(axis=0).nonzero()[0].max(initial=-1)) + 1
            if cut:  # a diagonal's hits stay together
                found, subject = solve(t.slice(0, cut))
                if found is not None:
                    yield found
                held = t.slice(cut).to_batches()
                size = t.num_rows - cut
        if held:
            found, _ = solve(pa.Table.from_batches(held).combine_chunks())
            if found is not None:
                yield found

    partitions = max(runtime.partitions_for(rows, 1 << 20), int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return both.repartition(partitions, "seq_id", "part").sortWithinPartitions(*key).mapInArrow(run, schema)


def unchained(hits: Hits, matrix: np.ndarray) -> np.ndarray:
    """Rows of the hits that stay: those not connected to the hit before them on their diagonal."""
    i = np.flatnonzero(hits.follows)
    stays = np.ones(len(hits.follows), bool)
    if len(i):
        some = hits.take(i)
        before = hits.q.at[i - 1]
        stays[i[al.connected(some.q, some.s, before, matrix, some.ux)]] = False
    return np.flatnonzero(stays)


def chained(q: np.ndarray, s: np.ndarray, at: np.ndarray, matrix: np.ndarray, ux: int) -> np.ndarray:
    """Which hits (subject place, query place; 0-based) of two sequences stay, by unchained()."""
    n = len(at)
    order = np.lexsort((at[:, 0], at[:, 0] - at[:, 1]))
    d = at[order]
    diagonal, zero = d[:, 0] - d[:, 1], np.zeros(n, np.int64)
    follows = np.append(False, diagonal[1:] == diagonal[:-1])
    hits = Hits(zero, zero, zero, al.Lanes(q, d[:, 1], zero, np.full(n, len(q))), al.Lanes(s, d[:, 0], zero, np.full(n, len(s))), np.full(n, ux), zero, follows)
    stays = np.zeros(n, bool)
    stays[order[unchained(hits, matrix)]] = True
    return stays


def triggered(hits: Hits, matrix: np.ndarray) -> np.ndarray:
    """Rows of the hits whose ungapped score exceeds their query's trigger."""
    return np.flatnonzero(al.ungapped_score(hits.q, hits.s, matrix, hits.ux) > hits.trigger)


CANDIDATE = "query_id bigint, frame int, seq_id bigint, score int, q_start int, q_end int, s_start int, s_end int, q_hit int, s_hit int"


def presearch(hits: DataFrame, frames: DataFrame, sequences: DataFrame, options: SearchOptions) -> DataFrame:
    """query_id, frame, seq_id, score, q_start, q_end, s_start, s_end, q_hit, s_hit of candidates (0-based).

    Cheap to dear: ungapped trigger, chain filter, gapped extension without
    traceback, each over many hits at once.
    """
    matrix = options.matrix.values
    cutoff = st.score_from_bits(options.presearch_bits, options.gapped[0])

    def kernel(hits: Hits) -> pa.RecordBatch | None:
        hits = hits.take(triggered(hits, matrix))
        hits = hits.take(unchained(hits, matrix))
        if not len(hits.seq_id):
            return None
        left, right = al.gapped_hits(hits.q, hits.s, matrix, options.gap_open, options.gap_extend, cutoff)
        return pa.RecordBatch.from_pydict({"query_id": hits.query_id, "frame": hits.frame, "seq_id": hits.seq_id} | spans(left, right, hits.places) | hits.places)

    return extend_hits(hits, frames, sequences, kernel, CANDIDATE, options.matrix)


def spans(left: al.Extensions, right: al.Extensions, places: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """score, q_start, q_end, s_start, s_end (0-based, inclusive) of extensions to both sides of hits."""
    q, s = places["q_hit"], places["s_hit"]
    found = {"score": left.score + right.score, "q_start": q - left.query, "q_end": q + right.query - 1, "s_start": s - left.subject, "s_end": s + right.subject - 1}
    return {k: v.astype(np.int32) for k, v in found.items()}


def final_alignments(chosen: DataFrame, frames: DataFrame, sequences: DataFrame, options: SearchOptions) -> DataFrame:
    """The chosen candidates extended again with traceback and the final drop: coordinates, length, mismatches, gap openings and extensions, cigar."""
    runtime.ship(chosen.sparkSession)
    matrix, alphabet = options.matrix.values, options.matrix.alphabet
    cutoff = st.score_from_bits(options.final_bits, options.gapped[0])
    joined = chosen.select("query_id", "frame", "seq_id", "q_hit", "s_hit").join(frames.select("query_id", "frame", "masked"), ["query_id", "frame"]).join(sequences.select("seq_id", "seq"), "seq_id")

    def lanes(texts: list[str], at: np.ndarray) -> al.Lanes:
        codes = [alphabet.encode(x) for x in texts]
        high = np.cumsum([len(x) for x in codes])
        low = high - [len(x) for x in codes]
        return al.Lanes(np.concatenate(codes), low + at, low, high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):  # traced cells of some lanes at a time
                batch = whole.slice(at, 200)
                places = {"q_hit": batch.column(3).to_numpy(), "s_hit": batch.column(4).to_numpy()}
                q, s = lanes(batch.column(5).to_pylist(), places["q_hit"]), lanes(batch.column(6).to_pylist(), places["s_hit"])
                left, right = al.gapped_hits(q, s, matrix, options.gap_open, options.gap_extend, cutoff, trace=True)
                found = spans(left, right, places)
                edits: dict[str, list] = {k: [] for k in ("length", "mismatches", "gap_opens", "gap_extends", "cigar")}
                for i in range(batch.num_rows):
                    script = al.merge(al.flip(left.scripts[i]), right.scripts[i])
                    a = al.Alignment(*(int(found[k][i]) for k in ("score", "q_start", "q_end", "s_start", "s_end")), script)
                    counts = al.edit_counts(q.codes[q.low[i] : q.high[i]], s.codes[s.low[i] : s.high[i]], a)
                    for k, v in zip(edits, (*counts, "".join(f"{n}{'M' if op == al.SUBSTITUTION else op}" for op, n in script)), strict=True):
                        edits[k].append(v)
                yield pa.RecordBatch.from_pydict({"query_id": batch.column(0), "frame": batch.column(1), "seq_id": batch.column(2)} | found | {k: pa.array(v, pa.string() if k == "cigar" else pa.int32()) for k, v in edits.items()})

    return joined.select("query_id", "frame", "seq_id", "q_hit", "s_hit", "masked", "seq").mapInArrow(run, "query_id bigint, frame int, seq_id bigint, score int, q_start int, q_end int, s_start int, s_end int, length int, mismatches int, gap_opens int, gap_extends int, cigar string")
