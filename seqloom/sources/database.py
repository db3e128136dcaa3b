"""The indexed database: Parquet tables, written once and searched many times."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom import runtime
from seqloom.functions.alphabet import BLOSUM62, PROTEIN, REDUCED_CLASSES, ScoreMatrix, parse_matrix, parse_reduced
from seqloom.operators.clustering import cluster
from seqloom.operators.seeds import CONTEXT, THRESHOLD, SeedRules, subject_seeds

TABLES = ("sequences", "clustered", "single", "settings")


@dataclass(frozen=True)
class Settings:
    """How a database was built; searches must use the same."""

    reduced: str = REDUCED_CLASSES
    threshold: int = THRESHOLD
    context: int = CONTEXT
    clustering: bool = True
    total_length: int = 0
    sequences: int = 0
    max_length: int = 0
    matrix_name: str = BLOSUM62.name
    matrix_text: str = ""  # in the form of a matrix file; empty: BLOSUM62

    @property
    def matrix(self) -> ScoreMatrix:
        return parse_matrix(self.matrix_text, PROTEIN, self.matrix_name) if self.matrix_text else BLOSUM62

    @property
    def rules(self) -> SeedRules:
        return SeedRules(parse_reduced(self.reduced), self.matrix, threshold=self.threshold, context=self.context)

    @property
    def cluster_mismatches(self) -> int:
        """A tenth of the context."""
        return int(self.context * 0.1 + 1e-6)

    @property
    def hit_mismatches(self) -> int:
        """A fifth of the context."""
        return self.context - int(self.context * 0.8 + 1e-6)


@dataclass
class Database:
    sequences: DataFrame  # seq_id, name, seq
    clustered: DataFrame  # hash, ctx, seq_id, pos, rep_ctx, is_rep
    single: DataFrame  # hash, seq_id, pos
    settings: Settings


def statistics(sequences: DataFrame) -> DataFrame:
    """total_length, sequences, max_length."""
    n = F.length("seq")
    return sequences.agg(F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("total_length"), F.count("*").alias("sequences"), F.coalesce(F.max(n), F.lit(0)).cast("int").alias("max_length"))


def chunks(sequences: DataFrame, size: int) -> DataFrame:
    """seq_id, chunk_id: sequences in order, a new chunk once the residues before a sequence and its own exceed `size`.

    By the running sum of lengths, so a chunk boundary needs no look-back: chunk =
    floor(residues up to and with this sequence, less one, / size).
    """
    run = runtime.running_sum(sequences.select("seq_id", F.length("seq").cast("bigint").alias("n")), "seq_id", "n", "run")
    return run.select("seq_id", F.floor((F.col("run") - 1) / F.lit(size)).cast("int").alias("chunk_id"))


def build(sequences: DataFrame, reduced: str = REDUCED_CLASSES, threshold: int = THRESHOLD, context: int = CONTEXT, clustering: bool = True, matrix: ScoreMatrix = BLOSUM62) -> Database:
    """Seeds and clusters of a table of sequences (seq_id, name, seq). Contexts may have any length, the reduced alphabet any number of classes."""
    row = statistics(sequences).first()
    settings = Settings(reduced, threshold, context, clustering, row["total_length"], row["sequences"], row["max_length"], matrix.name, "" if matrix is BLOSUM62 else matrix.text())
    seeds = runtime.materialize(subject_seeds(sequences, settings.rules))  # the scan runs once, whatever reads it
    if clustering:
        clustered, single = cluster(seeds, settings.cluster_mismatches)
    else:
        clustered, single = cluster(seeds.where("false"), 0)[0], seeds
    return Database(sequences.select("seq_id", "name", "seq"), clustered.select("hash", "ctx", "seq_id", "pos", "rep_ctx", "is_rep"), single.select("hash", "seq_id", "pos"), settings)


def save(db: Database, path: str, mode: str = "errorifexists") -> None:
    """One Parquet table each; seeds are written sorted by hash within files, so scans for few hashes skip row groups."""
    db.sequences.write.mode(mode).parquet(f"{path}/sequences")
    db.clustered.sortWithinPartitions("hash").write.mode(mode).parquet(f"{path}/clustered")
    db.single.sortWithinPartitions("hash").write.mode(mode).parquet(f"{path}/single")
    spark = db.sequences.sparkSession
    spark.createDataFrame([(json.dumps(asdict(db.settings)),)], "settings string").coalesce(1).write.mode(mode).parquet(f"{path}/settings")


def load(spark: SparkSession, path: str) -> Database:
    settings = Settings(**json.loads(spark.read.parquet(f"{path}/settings").first()["settings"]))
    return Database(*(spark.read.parquet(f"{path}/{t}") for t in TABLES[:3]), settings)
