"""Line dedup (operator 2), with DataFrame functions only.

Lines that are not blank are hashed. Winnowing selects the least hash of each
window of `window` lines: its position is a fingerprint, and any two runs of that
many equal lines have one in common. A line of `long_words` words or more is a
fingerprint of its own. Positions are joined by fingerprint; those found once go.
Each of the others is extended to both sides: to the windows that selected it,
some of its lines before it and some behind. Extensions that are equal to an
earlier one, by 128 bits of hash over all their lines, are matches; touching and
overlapping matches make up the maximal repeated runs, and all but a run's first
occurrence is deleted.

A third of the documents may share a line: neither join deals the rows of such a
fingerprint or match to one task (runtime.join_hot), and no pairs of positions
are formed, as each extension is compared with the first one of its kind alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom import runtime

LOWEST = -(1 << 63)
#: Occurrences of a fingerprint or a match that are dealt to one task.
HOT_ROWS = 1 << 10


def _trimmed(line: Column) -> Column:
    return F.trim(line)


def _words(line: Column) -> Column:
    """One more than the spaces in a trimmed line."""
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def fingerprints(docs: DataFrame, window: int, long_words: int) -> DataFrame:
    """ord, th, at, fp, around: a row a selected position, with its hash and the windows that selected it: their first line, number of lines and two hashes of all their lines.

    Lines are numbered 0, 1, ... among those that are not blank.
    """
    x = F.filter(F.transform(F.split("text", "\n"), _trimmed), lambda e: e != "")
    base = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LOWEST)).alias("ord"), F.xxhash64("text").alias("th"), x.alias("x"))
    entries = F.transform("x", lambda e: F.struct(F.xxhash64(e).alias("a"), F.xxhash64(F.lit(1), e).alias("b"), (_words(e) >= long_words).alias("long")))
    # Exploding keeps Catalyst from repeating the expressions for each use below.
    held = base.select("ord", "th", F.explode(F.array(entries)).alias("e"))
    count = F.greatest(F.size("e") - window + 1, F.lit(0))
    runs = F.transform(F.slice("e", 1, count), lambda r, i: F.struct(i.alias("at"), F.array(r["a"]).alias("a"), F.array(r["b"]).alias("b")))
    for k in range(1, window):
        runs = F.zip_with(runs, F.slice("e", k + 1, count), lambda r, y: F.struct(r["at"].alias("at"), F.concat(r["a"], F.array(y["a"])).alias("a"), F.concat(r["b"], F.array(y["b"])).alias("b")))
    least = F.transform(runs, lambda r: F.struct((r["at"] + F.array_position(r["a"], F.array_min(r["a"])) - 1).cast("int").alias("of"), F.array_min(r["a"]).alias("fp"), r["at"].alias("at"), F.lit(window).alias("n"), F.xxhash64(r["a"]).alias("k"), F.xxhash64(r["b"]).alias("l")))
    wide = held.select("ord", "th", "e", F.explode(F.array(least)).alias("w"))
    # Windows that select the same position follow one another: the first of them stands for the position.
    first = F.filter("w", lambda r, i: (i == 0) | (r["of"] != F.get(F.col("w"), i - 1)["of"]))
    around = lambda r: F.transform(F.filter(F.slice("w", r["at"] + 1, window), lambda y: y["of"] == r["of"]), lambda y: F.struct(y["at"], y["n"], y["k"], y["l"]))
    chosen = F.transform(first, lambda r: F.struct(r["of"].alias("at"), r["fp"].alias("fp"), around(r).alias("around")))
    alone = F.transform(F.filter(F.transform("e", lambda r, i: F.struct(i.alias("at"), r.alias("r"))), lambda r: r["r"]["long"]), lambda r: F.struct(r["at"].alias("at"), r["r"]["a"].alias("fp"), F.array(F.struct(r["at"].alias("at"), F.lit(1).alias("n"), r["r"]["a"].alias("k"), r["r"]["b"].alias("l"))).alias("around")))
    return wide.select("ord", "th", F.explode(F.concat(chosen, alone)).alias("r")).select("ord", "th", "r.at", "r.fp", "r.around")


def repeated_lines(docs: DataFrame, window: int = 2, long_words: int = 50) -> DataFrame:
    """ord, th, gone: the numbers (among lines that are not blank) to delete, for documents that have any.

    Positions are ordered by doc_id (null first), text hash and line. Rows of the
    same doc_id and text are one document given twice and get the same lines.
    """
    positions = runtime.materialize(fingerprints(docs, window, long_words))
    place = F.xxhash64("ord", "th", "at")
    shared = positions.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("rows")).where("a <> b").select("fp", "rows")
    joined = runtime.join_hot(positions, runtime.materialize(shared), ["fp"], "rows", hot_rows=HOT_ROWS)
    extended = joined.select("ord", "th", F.explode("around").alias("w")).select("w.k", "w.l", "w.n", F.struct("ord", "th", "w.at").alias("p"))
    extended = runtime.materialize(extended)
    first = extended.groupBy("k", "l", "n").agg(F.min("p").alias("first"), F.count("*").alias("rows")).where("rows > 1")
    later = runtime.join_hot(extended, runtime.materialize(first), ["k", "l", "n"], "rows", hot_rows=HOT_ROWS).where("p > first")
    lines = F.sequence(F.col("p.at"), F.col("p.at") + F.col("n") - 1)
    return later.groupBy(F.col("p.ord").alias("ord"), F.col("p.th").alias("th")).agg(F.array_distinct(F.flatten(F.collect_set(lines))).alias("gone"))


def dedup_lines(docs: DataFrame, window: int = 2, long_words: int = 50) -> DataFrame:
    """docs with the lines of later repeated runs deleted, and n_lines, removed_lines.

    A run is `window` or more consecutive lines (blank ones apart and skipped), or
    one line of `long_words` words or more (words: what single spaces part). Lines
    are compared without spaces at their ends. The first run in order of doc_id
    stays. Other columns pass through, whatever their names but for n_lines and
    removed_lines. A null text stays null with 0 lines; an empty text has one
    blank line. If every line goes, the text is empty. An empty table gives none.
    """
    own = "_ld"  # names of columns in between must not be those of docs
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    ord_, th, gone_, raw, o, t, lines, filled = (f"{own}{i}" for i in range(8))
    gone = repeated_lines(docs, window, long_words).select(F.col("ord").alias(ord_), F.col("th").alias(th), F.col("gone").alias(gone_))
    rest = [c for c in docs.columns if c not in ("text", "n_lines", "removed_lines")]
    rows = docs.select(*rest, F.col("text").alias(raw), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LOWEST)).alias(o), F.xxhash64("text").alias(t))
    both = rows.join(gone, (F.col(o) == F.col(ord_)) & (F.col(t) == F.col(th)), "left")
    # Exploding makes the lines a column, not an expression to repeat for each line.
    split = both.select(*rest, gone_, F.explode(F.array(F.split(raw, "\n"))).alias(lines))
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    full = F.filter(every, lambda i: _trimmed(F.element_at(lines, i + 1)) != "")
    marked = split.select(*rest, lines, F.explode(F.array(F.when(F.col(gone_).isNotNull(), full))).alias(filled), gone_)
    drop = F.transform(gone_, lambda i: F.element_at(filled, i + 1))
    kept = F.transform(F.array_except(every, drop), lambda i: F.element_at(lines, i + 1))
    text = F.when(F.col(lines).isNull(), F.lit(None)).when(F.col(gone_).isNull(), F.array_join(lines, "\n")).otherwise(F.array_join(kept, "\n"))
    out = marked.select(*rest, text.alias("text"), F.when(F.col(lines).isNull(), 0).otherwise(F.size(lines)).cast("bigint").alias("n_lines"), F.coalesce(F.size(gone_), F.lit(0)).cast("bigint").alias("removed_lines"))
    order = [c for c in docs.columns if c not in ("n_lines", "removed_lines")]
    return out.select(*order, "n_lines", "removed_lines")


def oracle(window: int = 2, long_words: int = 50) -> str:
    """DuckDB SQL for the digest query over `documents`."""
    leads = "".join(f", lead(x, {k}) over w as x{k}, lead(i, {k}) over w as i{k}" for k in range(1, window))
    run = " || chr(10) || ".join(["x", *(f"x{k}" for k in range(1, window))])
    places = ", ".join(["i", *(f"i{k}" for k in range(1, window))])
    last = f"x{window - 1}"
    return f"""
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i
  from documents where text is not null),
filled as (select doc_id, i, trim(line) as x from lines where trim(line) <> ''),
next as (select doc_id, i, x{leads} from filled window w as (partition by doc_id order by i)),
runs as (
  select 'r' || {run} as key, doc_id, i, [{places}] as places from next where {last} is not null
  union all
  select 's' || x, doc_id, i, [i] from filled where length(x) - length(replace(x, ' ', '')) + 1 >= {long_words}),
later as (select doc_id, places, row_number() over (partition by key order by doc_id, i) as r from runs),
gone as (select distinct doc_id, unnest(places) as i from later where r > 1),
kept as (
  select l.doc_id, count(*) as n_lines, count(g.i) as removed_lines,
         string_agg(case when g.i is null then l.line end, chr(10) order by l.i) as text
  from lines l left join gone g on l.doc_id = g.doc_id and l.i = g.i group by l.doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(removed_lines, 0) as removed_lines,
       md5(case when d.text is null then '' else coalesce(k.text, '') end) as text_md5
from documents d left join kept k on d.doc_id = k.doc_id
"""
