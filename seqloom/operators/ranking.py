"""Ranking of alignments: order, best per subject, top K, containment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


HITS = ("s_hit", "q_hit")


def order(alignments: DataFrame) -> list[Column]:
    """Score, then query span, then subject span, all descending; then place in the database and in the query, and that of the hit where there is one."""
    hit = [F.asc(c) for c in HITS if c in alignments.columns]
    return [F.desc("score"), (F.col("q_end") - F.col("q_start")).desc(), (F.col("s_end") - F.col("s_start")).desc(), F.asc("seq_id"), F.asc("s_start"), F.asc("q_start"), F.asc("frame"), *hit]


def best_per_subject(alignments: DataFrame) -> DataFrame:
    """The first alignment of each query and subject."""
    w = Window.partitionBy("query_id", "seq_id").orderBy(*order(alignments))
    return alignments.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def top_k(alignments: DataFrame, k: int) -> DataFrame:
    """The first k alignments of each query, with their rank. The rank filter is pushed below the shuffle."""
    w = Window.partitionBy("query_id").orderBy(*order(alignments))
    return alignments.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def contains(a: str, b: str) -> Column:
    """Whether alignment a holds b: the same start, the same end, or b within a on both axes (columns prefixed by a. and b.)."""
    c = lambda side, name: F.col(f"{side}.{name}")
    start = (c(a, "q_start") == c(b, "q_start")) & (c(a, "s_start") == c(b, "s_start"))
    end = (c(a, "q_end") == c(b, "q_end")) & (c(a, "s_end") == c(b, "s_end"))
    inside = (c(a, "q_start") <= c(b, "q_start")) & (c(a, "q_end") >= c(b, "q_end")) & (c(a, "s_start") <= c(b, "s_start")) & (c(a, "s_end") >= c(b, "s_end"))
    return start | end | inside


def cap_per_subject(alignments: DataFrame, cap: int) -> DataFrame:
    """Up to `cap` alignments of each query and subject, in order, none held by an accepted one.

    Greedy within a query and subject; a group has a row a candidate of one pair
    of sequences, which their lengths bound.
    """
    if cap == 1:
        return best_per_subject(alignments)
    columns, hit = alignments.columns, [c for c in HITS if c in alignments.columns]

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_q=pdf.q_end - pdf.q_start, _s=pdf.s_end - pdf.s_start).sort_values(["score", "_q", "_s", "s_start", "q_start", "frame", *hit], ascending=[False] * 3 + [True] * (3 + len(hit)), kind="stable")
        taken: list[tuple] = []
        rows = []
        for i, r in enumerate(pdf.itertuples(index=False)):
            if len(taken) == cap:
                break
            held = any((a.q_start == r.q_start and a.s_start == r.s_start) or (a.q_end == r.q_end and a.s_end == r.s_end) or (a.q_start <= r.q_start and a.q_end >= r.q_end and a.s_start <= r.s_start and a.s_end >= r.s_end) for a in taken if a.frame == r.frame)
            if not held:
                taken.append(r)
                rows.append(i)
        return pdf.iloc[rows][columns]

    return alignments.groupBy("query_id", "seq_id").applyInPandas(pick, alignments.schema)
