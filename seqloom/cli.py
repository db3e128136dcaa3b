"""Command line: `db` builds a database from FASTA, `aln` searches it.

    python -m seqloom.cli db -i proteins.fa -o database
    python -m seqloom.cli aln -d database -i queries.fa -q d -o results
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from seqloom import runtime
from seqloom.functions.alphabet import BLOSUM62
from seqloom.operators.search import SearchOptions
from seqloom.plans import homology
from seqloom.sources import database, fasta, matrices


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="seqloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)
    db = commands.add_parser("db", help="build a database")
    db.add_argument("-i", dest="input", required=True, help="FASTA file of proteins")
    db.add_argument("-o", dest="output", required=True, help="folder of the database")
    db.add_argument("-C", dest="clustering", choices="TF", default="T", help="cluster seeds")
    db.add_argument("-L", dest="context", type=int, default=10, help="context length of clustering")
    db.add_argument("-s", dest="threshold", type=int, default=39, help="score at which a seed may end")
    db.add_argument("-r", dest="reduced", help="file of the reduced alphabet")
    db.add_argument("-M", dest="matrix", help="file of the score matrix (searches need published statistics for its name: BLOSUM62 or PAM30)")
    aln = commands.add_parser("aln", help="search a database")
    aln.add_argument("-d", dest="database", required=True)
    aln.add_argument("-i", dest="input", required=True, help="FASTA file of queries")
    aln.add_argument("-o", dest="output", required=True, help="folder of tabular text")
    aln.add_argument("-q", dest="kind", choices="pd", default="p", help="queries are proteins or DNA")
    aln.add_argument("-t", dest="target", choices="p", default="p", help="the database is of proteins")
    aln.add_argument("-F", dest="filter", choices="TF", default="T", help="mask low-complexity segments of queries")
    aln.add_argument("-b", dest="results", type=int, default=10, help="alignments a query")
    aln.add_argument("-v", dest="per_subject", type=int, default=1, help="alignments a query and subject")
    for p in (db, aln):
        p.add_argument("--master", help="Spark master; the environment's by default")
    return top


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    builder = SparkSession.builder.appName("seqloom")
    spark = (builder.master(args.master) if args.master else builder).getOrCreate()
    rows = fasta.with_dense_ids(fasta.read_fasta(spark, args.input))
    if args.command == "db":
        reduced = " ".join(matrices.read_reduced(spark, args.reduced).classes) if args.reduced else database.REDUCED_CLASSES
        matrix = matrices.read_matrix(spark, args.matrix) if args.matrix else BLOSUM62
        database.save(database.build(rows, reduced, args.threshold, args.context, args.clustering == "T", matrix), args.output)
    else:
        stored = database.load(spark, args.database)
        options = SearchOptions(matrix=stored.settings.matrix, mask=args.filter == "T", results=args.results, per_subject=args.per_subject)
        found = homology.search(stored, rows.withColumnRenamed("seq_id", "query_id"), args.kind == "d", options)
        fasta.write_tsv(found, args.output)
    runtime.drop_all(spark)


if __name__ == "__main__":
    main()
