"""Score matrices and reduced alphabets from files that Spark can read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.functions.alphabet import PROTEIN, Alphabet, ReducedAlphabet, ScoreMatrix, parse_matrix, parse_reduced


def _text(spark: SparkSession, path: str) -> str:
    """A small file as a whole (matrices have some kilobytes)."""
    return spark.read.text(path, wholetext=True).first()["value"]


def read_matrix(spark: SparkSession, path: str, alphabet: Alphabet = PROTEIN) -> ScoreMatrix:
    return parse_matrix(_text(spark, path), alphabet, path.rpartition("/")[2])


def read_reduced(spark: SparkSession, path: str, alphabet: Alphabet = PROTEIN) -> ReducedAlphabet:
    return parse_reduced(_text(spark, path), alphabet)


def matrix_table(spark: SparkSession, matrix: ScoreMatrix) -> DataFrame:
    """Long form: a, b, score."""
    return spark.createDataFrame(matrix.rows(), "a string, b string, score int")
