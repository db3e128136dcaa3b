"""The whole search as one plan: queries against a database, best alignments a query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom import runtime
from seqloom.functions import codec
from seqloom.functions import statistics as st
from seqloom.operators import ranking
from seqloom.operators.search import SearchOptions, final_alignments, prepare, presearch, seed_hits
from seqloom.operators.seeds import query_seeds
from seqloom.sources.database import Database


def search(db: Database, queries: DataFrame, dna: bool = False, options: SearchOptions | None = None) -> DataFrame:
    """Alignments of queries (query_id, name, seq) with a database's sequences.

    Returns query_id, rank, query, subject, identity, length, mismatches,
    gap_opens, q_start, q_end, s_start, s_end, evalue, bits, score, frame, cigar;
    coordinates 1-based and inclusive, on DNA in bases of the query (descending
    on the reverse strand). Null or empty sequences find nothing.
    """
    rules, settings = db.settings.rules, db.settings
    options = options or SearchOptions(matrix=settings.matrix)
    frames = runtime.materialize(prepare(queries, dna, options))
    wanted = runtime.materialize(query_seeds(frames, rules))
    hits = seed_hits(wanted, db.clustered, db.single, settings.hit_mismatches, rules.packed)
    candidates = presearch(hits, frames, db.sequences, options)
    chosen = runtime.materialize(ranking.top_k(ranking.cap_per_subject(candidates, options.per_subject), options.results).drop("rank"))
    found = final_alignments(chosen, frames, db.sequences, options)
    return report(found, frames, db, dna, options)


def report(found: DataFrame, frames: DataFrame, db: Database, dna: bool, options: SearchOptions) -> DataFrame:
    """Coordinates, identity, bit score and E-value of final alignments, ranked anew by their final coordinates."""
    p, alpha, beta = options.gapped
    s = db.settings
    about = frames.where("frame = 0").select("query_id", F.col("name").alias("query"), "base_len", "m")
    lengths = [r["m"] for r in about.select("m").distinct().collect()]  # at most a row a distinct query length
    spaces = {m: float(st.search_space(s.total_length, m, s.sequences, st.length_adjustment(m, s.total_length, s.sequences, p, alpha, beta))) for m in lengths}
    space = db.sequences.sparkSession.createDataFrame(list(spaces.items()) or [(0, 1.0)], "m int, space double")
    k, f = F.col("q_start") + 1, F.col("frame")
    if dna:
        q_start, q_end = codec.dna_start(k, f, F.col("base_len")), codec.dna_end(F.col("q_end") + 1, f, F.col("base_len"))
    else:
        q_start, q_end = k, F.col("q_end") + 1
    ranked = ranking.top_k(found, options.results)
    named = ranked.join(about, "query_id").join(space, "m").join(db.sequences.select("seq_id", F.col("name").alias("subject")), "seq_id")
    wrong = F.col("mismatches") + F.col("gap_opens") + F.col("gap_extends")
    return named.select(
        "query_id",
        F.col("rank").cast("int").alias("rank"),
        "query",
        "subject",
        ((1 - wrong / F.col("length")) * 100).cast("float").alias("identity"),
        "length",
        "mismatches",
        "gap_opens",
        q_start.cast("int").alias("q_start"),
        q_end.cast("int").alias("q_end"),
        (F.col("s_start") + 1).alias("s_start"),
        (F.col("s_end") + 1).alias("s_end"),
        st.e_value(F.col("score"), F.col("space"), p).alias("evalue"),
        st.bit_score(F.col("score"), p).cast("float").alias("bits"),
        "score",
        "frame",
        "cigar",
    )
