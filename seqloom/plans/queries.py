"""The registered queries of the search engine and the SQL that checks them.

The driver's tables hold no biology, so a document's or passage's letters are
its protein and its letters ACGT its DNA. Every query reads whole tables and
whole texts; where an operator has a value for each residue, the query returns
digests by document of all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom import runtime
from seqloom.functions import codec
from seqloom.functions import statistics as st
from seqloom.functions.alphabet import BLOSUM62, CODONS, DNA, PROTEIN, REDUCED, background
from seqloom.operators import kernels, ranking, search, seeds
from seqloom.plans import homology
from seqloom.sources import database, fasta, matrices

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# Inputs, in both languages.


def letters(pattern: str) -> Column:
    return F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), pattern, ""))


def proteins(spark: SparkSession, sf_dir: str, table: str = "documents", key: str = "doc_id") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key), letters("[^A-Za-z]").alias("seq"))


def dnas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", letters("[^ACGTacgt]").alias("seq"))


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proteins(spark, sf_dir).select(F.col("doc_id").alias("seq_id"), F.col("doc_id").cast("string").alias("name"), "seq")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proteins(spark, sf_dir, "benchmark", "item_id").select(F.col("item_id").alias("query_id"), F.col("item_id").cast("string").alias("name"), "seq")


L, CLASSES = PROTEIN.letters, "".join(codec.CLASS_LETTERS[REDUCED.code_of[x]] for x in PROTEIN.letters)


def _sql_protein(table: str = "documents", key: str = "doc_id", name: str = "p") -> str:
    return f"{name} as (select {key}, translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), 'OU', 'XX') as seq from {table})"


_SQL_DNA = "d as (select doc_id, upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g')) as seq from documents)"


def _sql_classes(source: str = "p", name: str = "c", key: str = "doc_id") -> str:
    return f"{name} as (select {key}, length(seq) as n, translate(seq, '{L}', '{CLASSES}') as cls from {source})"


def _sql_codes(source: str, key: str, name: str, count: int) -> str:
    """A row a position with class codes c0.. (null past the end)."""
    after = "".join(f", lead(c0, {k}) over w as c{k}" for k in range(1, count))
    return f"""{name}_l as (select {key}, n, unnest(string_split(cls, '')) as ch, unnest(range(1, n + 1)) as p from {source} where n > 0),
{name}_n as (select {key}, n, p, strpos('{codec.CLASS_LETTERS[:16]}', ch) - 1 as c0 from {name}_l),
{name} as (select {key}, n, p, c0{after} from {name}_n window w as (partition by {key} order by p))"""


def _sql_hash(source: str, key: str, name: str) -> str:
    """A row a position with a seed: hash and seed_len by the variable-length rule."""
    points, top = seeds.SeedRules().scores.tolist(), REDUCED.max_code
    score = lambda k: "(case c%d %s end)" % (k, " ".join(f"when {i} then {s}" for i, s in enumerate(points)))
    total = lambda k: " + ".join(score(i) for i in range(k))
    valid = lambda k: f"coalesce(c{k} <= {top}, false)"
    value = lambda k: " + ".join(f"(c{i} + 1) * {16 ** (k - 1 - i)}::bigint" for i in range(k))
    head = " and ".join(valid(k) for k in range(6))
    pick = f"case when s6 >= 39 then 6 when not {valid(7)} then 0 when s7 >= 39 then 7 else 8 end"
    return f"""{name}_a as (select *, {total(6)} as s6, {total(7)} as s7 from {source} where {head} and {valid(6)}),
{name}_b as (select *, {pick} as seed_len from {name}_a),
{name} as (select {key}, n, p, seed_len, case seed_len when 6 then {value(6)} when 7 then {value(7)} else {value(8)} end as hash from {name}_b where seed_len > 0)"""


# Encoding.


@query(f"""with {_sql_protein()}
select doc_id, length(seq) as n_residues,
  md5(array_to_string(list_transform(range(1, length(seq) + 1), lambda i: strpos('{L}', substr(seq, i, 1)) - 1), ',')) as codes_md5 from p""")
def encode_residues(spark, sf_dir):
    return proteins(spark, sf_dir).select("doc_id", F.length("seq").cast("bigint").alias("n_residues"), F.md5(F.array_join(codec.encode(F.col("seq")), ",")).alias("codes_md5"))


@query(f"with {_sql_protein()} select doc_id, md5(seq) as seq_md5 from p")
def decode_residues(spark, sf_dir):
    return proteins(spark, sf_dir).select("doc_id", codec.encode(F.col("seq")).alias("codes")).select("doc_id", F.md5(codec.decode(F.col("codes"))).alias("seq_md5"))


@query("""select doc_id, length(s) - length(regexp_replace(s, '[OU]', '', 'g')) as unknown
from (select doc_id, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) as s from documents)""")
def unknown_residues(spark, sf_dir):
    unknown = F.size(F.filter(F.split("seq", ""), lambda c: (c != "") & codec.is_unknown(c)))
    return proteins(spark, sf_dir).select("doc_id", unknown.cast("bigint").alias("unknown"))


@query(f"with {_sql_protein()}, {_sql_classes()} select doc_id, md5(cls) as classes_md5 from c")
def reduced_alphabet(spark, sf_dir):
    return proteins(spark, sf_dir).select("doc_id", F.md5(codec.reduce(F.col("seq"))).alias("classes_md5"))


@query(f"with {_SQL_DNA} select doc_id, md5(translate(reverse(seq), 'ACGT', 'TGCA')) as strand_md5 from d")
def reverse_complement(spark, sf_dir):
    return dnas(spark, sf_dir).select("doc_id", F.md5(codec.reverse_complement(F.col("seq"))).alias("strand_md5"))


_SQL_FRAMES = f"""{_SQL_DNA},
strands as (select doc_id, length(seq) as n, seq, translate(reverse(seq), 'ACGT', 'TGCA') as back from d where length(seq) >= 3),
frames as (select doc_id, n, f as frame, substr(case when f < 3 then seq else back end, 1 + f % 3) as s from strands, range(6) t(f)),
codons as (select map([{", ".join(f"'{k}'" for k in CODONS)}], [{", ".join(f"'{v}'" for v in CODONS.values())}]) as m),
aa as (select doc_id, n, frame, array_to_string(list_transform(range(0, length(s) // 3), lambda i: m[substr(s, 3 * i + 1, 3)]), '') as seq from frames, codons)"""


@query(f"with {_SQL_FRAMES} select doc_id, frame::integer as frame, length(seq) as n_residues, md5(seq) as seq_md5 from aa")
def translate_six_frames(spark, sf_dir):
    frames = dnas(spark, sf_dir).select("doc_id", F.explode(codec.six_frames(F.col("seq"))).alias("f"))
    return frames.select("doc_id", "f.frame", F.length("f.seq").cast("bigint").alias("n_residues"), F.md5("f.seq").alias("seq_md5"))


@query(f"""with {_SQL_FRAMES}, k as (select *, length(seq) as len from aa where length(seq) > 0)
select doc_id, frame::integer as frame,
  case when frame < 3 then frame + 1 else n - frame + 3 end as first_start,
  case when frame < 3 then 3 * (len - 1) + frame + 3 else n - (3 * (len - 1) + frame - 3) - 2 end as last_end,
  len as to_end, n // 3 as effective_length from k""")
def frame_coordinates(spark, sf_dir):
    """DNA coordinates of a frame's first and last residue, the first one's distance to the frame's end, the effective query length."""
    frames = dnas(spark, sf_dir).select("doc_id", F.length("seq").alias("n"), F.explode(codec.six_frames(F.col("seq"))).alias("f")).select("doc_id", "n", "f.frame", F.length("f.seq").alias("len")).where("len > 0")
    first, last = codec.dna_start(F.lit(1), F.col("frame"), F.col("n")), codec.dna_end(F.col("len"), F.col("frame"), F.col("n"))
    return frames.select("doc_id", "frame", first.cast("bigint").alias("first_start"), last.cast("bigint").alias("last_end"), F.col("len").cast("bigint").alias("to_end"), F.floor(F.col("n") / 3).cast("bigint").alias("effective_length"))


# Composition and statistics.


def _composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proteins(spark, sf_dir).select(F.explode(F.split(codec.normalize(F.col("seq")), "")).alias("letter")).where("letter <> ''").groupBy("letter").agg(F.count("*").alias("n"))


_SQL_COMPOSITION = f"{_sql_protein()}, comp as (select letter, count(*) as n from (select unnest(string_split(seq, '')) as letter from p) where letter <> '' group by letter)"


@query(f"with {_SQL_COMPOSITION} select letter, n from comp")
def residue_composition(spark, sf_dir):
    return _composition(spark, sf_dir)


def _frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = spark.createDataFrame([(x, x in PROTEIN.regular) for x in L], "letter string, regular boolean")
    counts = every.join(_composition(spark, sf_dir), "letter", "left").select("letter", F.when(F.col("regular"), F.coalesce("n", F.lit(0))).otherwise(0).alias("n"))
    whole = Window.partitionBy(F.lit(0))  # 25 rows
    return counts.withColumn("n", F.when(F.col("n") < 1, F.col("n") + 1).otherwise(F.col("n"))).withColumn("frequency", F.col("n") / F.sum("n").over(whole))


_SQL_FREQUENCIES = f"""{_SQL_COMPOSITION},
every as (select unnest(string_split('{L}', '')) as letter),
counts as (select every.letter, greatest(case when strpos('{PROTEIN.regular}', every.letter) > 0 then coalesce(n, 0) else 0 end, 1) as n from every left join comp on every.letter = comp.letter),
freq as (select letter, n / sum(n) over () as frequency from counts)"""


@query(f"with {_SQL_FREQUENCIES} select letter, round(frequency, 9) as frequency from freq")
def letter_frequencies(spark, sf_dir):
    """Composition of all documents with a pseudo-count for absent letters, normalized."""
    return _frequencies(spark, sf_dir).select("letter", F.round("frequency", 9).alias("frequency"))


_BACK = background()
_SQL_MATRIX = "m(a, b, score) as (values " + ", ".join(f"('{a}', '{b}', {s})" for a, b, s in BLOSUM62.rows()) + ")"
_SQL_BACK = "back(b, q) as (values " + ", ".join(f"('{x}', {v!r})" for x, v in zip(L, _BACK.tolist(), strict=True)) + ")"


@query(f"""with {_SQL_FREQUENCIES}, {_SQL_MATRIX}, {_SQL_BACK},
pairs as (select score, sum(frequency * q) as p from m join freq on m.a = freq.letter join back on m.b = back.b group by score)
select score, round(p / sum(p) over (), 9) as probability from pairs where p > 0""")
def score_distribution(spark, sf_dir):
    """Distribution of pair scores between the documents' composition and the background: a join of 25 x 25 letters."""
    pairs = matrices.matrix_table(spark, BLOSUM62)
    back = spark.createDataFrame(list(zip(L, _BACK.tolist(), strict=True)), "b string, q double")
    p = pairs.join(_frequencies(spark, sf_dir), pairs.a == F.col("letter")).join(back, "b").groupBy("score").agg(F.sum(F.col("frequency") * F.col("q")).alias("p")).where("p > 0")
    return p.select("score", F.round(F.col("p") / F.sum("p").over(Window.partitionBy(F.lit(0))), 9).alias("probability"))


@query(f"with {_SQL_MATRIX} select a, b, score from m")
def score_matrix_scan(spark, sf_dir):
    """The default matrix written as a matrix file, scanned and spread into rows."""
    header = " ".join(c for c in L if c != "J")
    rows = [f"{a} " + " ".join(str(BLOSUM62.values[i, j]) for j, c in enumerate(L) if c != "J") for i, a in enumerate(L) if a != "J"]
    path = runtime.work_dir(spark)
    spark.createDataFrame([("\n".join(["# a comment", header, *rows]),)], "value string").coalesce(1).write.text(path)
    return matrices.matrix_table(spark, matrices.read_matrix(spark, path))


@query(f"with {_sql_protein()} select coalesce(sum(length(seq)), 0)::bigint as total_length, count(*) as sequences, max(length(seq))::integer as max_length from p")
def db_stats(spark, sf_dir):
    return database.statistics(subjects(spark, sf_dir))


_SQL_RUN = f"{_sql_protein()}, run as (select doc_id, length(seq) as len, sum(length(seq)) over (order by doc_id) as total from p)"


@query(f"with {_SQL_RUN}, c as (select floor((total - 1) / 65536)::integer as chunk_id, len from run) select chunk_id, count(*) as sequences, sum(len)::bigint as total_length from c group by chunk_id")
def chunk_assignment(spark, sf_dir):
    """Sequences and residues of each chunk of 65,536 residues."""
    s = subjects(spark, sf_dir)
    sizes = s.select("seq_id", F.length("seq").alias("n"))
    return sizes.join(database.chunks(s, 65_536), "seq_id").groupBy("chunk_id").agg(F.count("*").alias("sequences"), F.sum("n").cast("bigint").alias("total_length"))


@query(f"""with {_SQL_RUN}, probes as (select i as probe, (i * 9973) as place from range(200) t(i))
select probe, doc_id, place - (total - len) as offset_in_sequence from probes join run on place >= total - len and place < total""")
def range_lookup_subject(spark, sf_dir):
    """Sequence and offset of 200 places of the concatenated database."""
    probes = spark.range(200).select(F.col("id").alias("probe"), (F.col("id") * 9973).alias("place"))
    return kernels.locate(probes, subjects(spark, sf_dir)).select("probe", F.col("seq_id").alias("doc_id"), F.col("offset").alias("offset_in_sequence"))


# Seeds.


def _codes(spark: SparkSession, sf_dir: str, count: int) -> DataFrame:
    """A row a position of all documents with `count` class codes."""
    rows = proteins(spark, sf_dir).select("doc_id", codec.reduce(F.col("seq")).alias("cls"))
    return seeds.class_windows(rows, ["doc_id"], "cls", count)


@query(f"""with {_sql_protein()}, {_sql_classes()}, {_sql_codes("c", "doc_id", "k", 6)}
select doc_id, count(*) as n, sum(c0 * 1048576 + c1 * 65536 + c2 * 4096 + c3 * 256 + c4 * 16 + c5)::bigint as hash_sum from k
where {" and ".join(f"c{i} <= {REDUCED.max_code}" for i in range(6))} group by doc_id""")
def kmer_hash_fixed(spark, sf_dir):
    """Fixed hashes of six classes at every position of all documents: count and sum."""
    rows = _codes(spark, sf_dir, 6)
    every = [F.col(f"c{k}") for k in range(6)]
    good = rows.where(" and ".join(f"c{k} <= {REDUCED.max_code}" for k in range(6)))
    return good.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(seeds.fixed_hash(every)).alias("hash_sum"))


_SQL_SEEDS = f'{_sql_protein()}, {_sql_classes()}, {_sql_codes("c", "doc_id", "k", 8)}, {_sql_hash("k", "doc_id", "s")}'


@query(f"with {_SQL_SEEDS} select doc_id, count(*) as n, sum(hash)::bigint as hash_sum, sum(seed_len)::bigint as length_sum from s group by doc_id")
def kmer_hash_variable(spark, sf_dir):
    """Variable-length hashes at every position, as native expressions."""
    rows = _codes(spark, sf_dir, 8)
    h = rows.select("doc_id", seeds.variable_hash([F.col(f"c{k}") for k in range(8)]).alias("s")).where("s is not null")
    return h.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("s.hash").alias("hash_sum"), F.sum("s.seed_len").cast("bigint").alias("length_sum"))


_SQL_NESTED = "kept as (select * from (select *, lead(p) over w as np, lead(seed_len) over w as nl from s window w as (partition by doc_id order by p)) where not coalesce(np = p + 1 and seed_len - 1 >= nl, false))"


@query(f"with {_SQL_SEEDS}, {_SQL_NESTED} select doc_id, count(*) as n, sum(hash)::bigint as hash_sum, sum(p)::bigint as pos_sum from kept group by doc_id")
def nested_seed_elimination(spark, sf_dir):
    """Database seeds of the Arrow kernel, nested ones dropped."""
    return seeds.subject_seeds(subjects(spark, sf_dir)).groupBy(F.col("seq_id").alias("doc_id")).agg(F.count("*").alias("n"), F.sum("hash").alias("hash_sum"), F.sum("pos").alias("pos_sum"))


@query(f"with {_SQL_SEEDS}, {_SQL_NESTED} select doc_id, count(*) as n, sum(p)::bigint as pos_sum from kept group by doc_id")
def nested_seed_window(spark, sf_dir):
    """The same elimination as a window over native hashes."""
    rows = _codes(spark, sf_dir, 8)
    h = rows.select(F.col("doc_id").alias("seq_id"), "pos", seeds.variable_hash([F.col(f"c{k}") for k in range(8)]).alias("s")).where("s is not null").select("seq_id", "pos", "s.seed_len")
    return seeds.nested_elimination(h).groupBy(F.col("seq_id").alias("doc_id")).agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"))


@query(f"""with {_sql_protein()}, {_sql_classes()}, {_sql_codes("c", "doc_id", "k", 3)},
h as (select distinct c0 * 256 + c1 * 16 + c2 as hash from k where c0 <= 9 and c1 <= 9 and c2 <= 9),
n as (select hash, hash + (code - (hash // (16 ** place)::bigint) % 16) * (16 ** place)::bigint as neighbour, (hash // (16 ** place)::bigint) % 16 as now, code from h, range(3) a(place), range(10) b(code))
select hash::bigint as hash, count(*) as neighbours, sum(neighbour)::bigint as neighbour_sum from n where code <> now group by hash""")
def one_mismatch_neighbours(spark, sf_dir):
    """Neighbourhoods of all distinct fixed hashes of three classes."""
    rows = _codes(spark, sf_dir, 3).where(f"c0 <= {REDUCED.max_code} and c1 <= {REDUCED.max_code} and c2 <= {REDUCED.max_code}")
    h = rows.select(seeds.fixed_hash([F.col(f"c{k}") for k in range(3)]).alias("hash")).distinct()
    return seeds.one_mismatch(h, 3, REDUCED.max_code).groupBy("hash").agg(F.count("*").alias("neighbours"), F.sum("neighbour").alias("neighbour_sum"))


# Joins and filters on seeds. Passages are unmasked here, so that SQL can follow.


def _query_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = passages(spark, sf_dir).select("query_id", F.lit(0).alias("frame"), codec.normalize(F.col("seq")).alias("masked"))
    return runtime.materialize(seeds.query_seeds(frames))


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query_seeds(spark, sf_dir).join(seeds.subject_seeds(subjects(spark, sf_dir)), "hash")


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with both contexts, and their distance."""
    return _matches(spark, sf_dir).where("checked and ctx is not null").withColumn("distance", codec.nibble_distance(F.col("q_ctx"), F.col("ctx")))


_SQL_QUERY_SEEDS = f"""{_sql_protein("benchmark", "item_id", "qp")}, {_sql_classes("qp", "qc", "item_id")}, {_sql_codes("qc", "item_id", "qk", 8)}, {_sql_hash("qk", "item_id", "qa")},
qs as (select item_id, n as qn, p as qpos, hash, (p - 1 >= 5 and p - 1 < n - 5) as checked from qa where n >= 10)"""
_SQL_MATCHES = f"{_SQL_SEEDS}, {_SQL_NESTED}, {_SQL_QUERY_SEEDS}, j0 as (select item_id, doc_id, qpos, kept.p as spos, checked, n as sn from qs join kept on qs.hash = kept.hash), j as (select j0.*, substr(qc.cls, (qpos - 5)::bigint, 10) as qctx, substr(c.cls, (spos - 5)::bigint, 10) as sctx from j0 join qc on j0.item_id = qc.item_id join c on j0.doc_id = c.doc_id)"
_SQL_NEAR = f"{_SQL_MATCHES}, near as (select *, hamming(qctx, sctx) as distance from j where checked and spos - 1 >= 5 and spos - 1 + 5 <= sn)"


@query(f"with {_SQL_MATCHES} select item_id, count(*) as matches, sum(qpos)::bigint as q_sum, sum(spos)::bigint as s_sum from j group by item_id")
def seed_join(spark, sf_dir):
    return _matches(spark, sf_dir).groupBy(F.col("query_id").alias("item_id")).agg(F.count("*").alias("matches"), F.sum("q_pos").alias("q_sum"), F.sum("pos").alias("s_sum"))


@query(f"with {_SQL_QUERY_SEEDS} select item_id, count(*) as seeds, sum(checked::integer)::bigint as checked from qs group by item_id")
def similarity_flag(spark, sf_dir):
    return _query_seeds(spark, sf_dir).groupBy(F.col("query_id").alias("item_id")).agg(F.count("*").alias("seeds"), F.sum(F.col("checked").cast("int")).alias("checked"))


@query(f"with {_SQL_NEAR} select item_id, count(*) as pairs, sum(distance)::bigint as distance_sum, sum((distance <= 2)::integer)::bigint as near from near group by item_id")
def hamming_filter(spark, sf_dir):
    return _near(spark, sf_dir).groupBy(F.col("query_id").alias("item_id")).agg(F.count("*").alias("pairs"), F.sum("distance").cast("bigint").alias("distance_sum"), F.sum((F.col("distance") <= 2).cast("int")).alias("near"))


def _diagonal_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).where("distance <= 2").select("query_id", "frame", "seq_id", "q_pos", F.col("pos").alias("s_pos"))


@query(f"""with {_SQL_NEAR}, w as (select item_id, qpos, lag(qpos) over (partition by item_id, doc_id, spos - qpos order by spos) as before from near where distance <= 2)
select item_id, count(*) as kept, sum(qpos)::bigint as q_sum from w where before is null or qpos > before + 1 group by item_id""")
def chain_filter_diagonal(spark, sf_dir):
    """Hits that do not adjoin the one before them on their diagonal."""
    return kernels.adjacent_filter(_diagonal_hits(spark, sf_dir)).groupBy(F.col("query_id").alias("item_id")).agg(F.count("*").alias("kept"), F.sum("q_pos").alias("q_sum"))


# Ranking, over runs of near hits on a diagonal: a run is a candidate whose score is its number of hits.


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _diagonal_hits(spark, sf_dir).groupBy("query_id", "frame", "seq_id", (F.col("s_pos") - F.col("q_pos")).alias("diagonal"))
    return g.agg(F.count("*").cast("int").alias("score"), F.min("q_pos").alias("q_start"), F.max("q_pos").alias("q_end"), F.min("s_pos").alias("s_start"), F.max("s_pos").alias("s_end"))


_SQL_RUNS = f"{_SQL_NEAR}, runs as (select item_id, doc_id, count(*)::integer as score, min(qpos)::integer as qs, max(qpos)::integer as qe, min(spos)::integer as ss, max(spos)::integer as se from near where distance <= 2 group by item_id, doc_id, spos - qpos)"
_SQL_ORDER = "score desc, qe - qs desc, se - ss desc, doc_id, ss, qs"


@query(f"with {_SQL_RUNS} select item_id, doc_id, score, qs as q_start, ss as s_start from (select *, row_number() over (partition by item_id, doc_id order by {_SQL_ORDER}) as r from runs) where r = 1")
def best_per_subject(spark, sf_dir):
    return ranking.best_per_subject(_runs(spark, sf_dir)).select(F.col("query_id").alias("item_id"), F.col("seq_id").alias("doc_id"), "score", "q_start", "s_start")


@query(f"with {_SQL_RUNS} select item_id, doc_id, score, r::integer as rank from (select *, row_number() over (partition by item_id order by {_SQL_ORDER}) as r from runs) where r <= 10")
def topk_per_query(spark, sf_dir):
    return ranking.top_k(_runs(spark, sf_dir), 10).select(F.col("query_id").alias("item_id"), F.col("seq_id").alias("doc_id"), "score", F.col("rank").cast("int").alias("rank"))


@query(f"""with {_SQL_RUNS}, best as (select *, row_number() over (partition by item_id, doc_id order by {_SQL_ORDER}) as r from runs)
select item_id, doc_id, score, r2::integer as rank from (select *, row_number() over (partition by item_id order by {_SQL_ORDER}) as r2 from best where r = 1) where r2 <= 10""")
def rank_alignments(spark, sf_dir):
    """One candidate a subject, ten subjects a query."""
    return ranking.top_k(ranking.cap_per_subject(_runs(spark, sf_dir), 1), 10).select(F.col("query_id").alias("item_id"), F.col("seq_id").alias("doc_id"), "score", F.col("rank").cast("int").alias("rank"))


@query(f"""with {_SQL_RUNS}, many as (select *, row_number() over (partition by item_id, doc_id order by {_SQL_ORDER}) as r from runs)
select b.item_id, count(*) as held from many b where exists (select 1 from many a where a.item_id = b.item_id and a.doc_id = b.doc_id and a.r < b.r and (
 (a.qs = b.qs and a.ss = b.ss) or (a.qe = b.qe and a.se = b.se) or (a.qs <= b.qs and a.qe >= b.qe and a.ss <= b.ss and a.se >= b.se))) group by b.item_id""")
def containment_filter(spark, sf_dir):
    """Candidates that a better one of the same pair of sequences holds."""
    runs = _runs(spark, sf_dir)
    w = Window.partitionBy("query_id", "seq_id").orderBy(*ranking.order(runs))
    many = runs.withColumn("r", F.row_number().over(w))
    a, b = many.alias("a"), many.alias("b")
    same = (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.seq_id") == F.col("b.seq_id")) & (F.col("a.r") < F.col("b.r"))
    return b.join(a, same & ranking.contains("a", "b"), "left_semi").groupBy(F.col("query_id").alias("item_id")).agg(F.count("*").alias("held"))


# Alignment statistics as columns.

_GAPPED, _ALPHA, _BETA = st.gapped_parameters()
_SQL_SCORES = "scores as (select p_partkey, (p_size * 7 + 20)::integer as score from part)"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_size") * 7 + 20).cast("int").alias("score"))


@query(f"with {_SQL_SCORES} select p_partkey, score, round((score * {_GAPPED.lam!r} - ln({_GAPPED.k!r})) / ln(2), 6) as bits from scores")
def bit_score(spark, sf_dir):
    return _scores(spark, sf_dir).select("p_partkey", "score", F.round(st.bit_score(F.col("score"), _GAPPED), 6).alias("bits"))


@query(f"with {_SQL_SCORES} select p_partkey, score, round(ln(4375.0::double * {_GAPPED.k!r} * exp(-{_GAPPED.lam!r} * score)), 6) as ln_evalue from scores")
def e_value(spark, sf_dir):
    return _scores(spark, sf_dir).select("p_partkey", "score", F.round(F.log(st.e_value(F.col("score"), F.lit(4375.0), _GAPPED)), 6).alias("ln_evalue"))


@query(f"""with {_SQL_SCORES} select p_partkey, floor((score / 8.0::double * ln(2) + ln({_GAPPED.k!r})) / {_GAPPED.lam!r})::bigint as raw_score, floor(score / 8.0::double * ln(2) / {_GAPPED.lam!r})::bigint as raw_drop from scores""")
def raw_cutoffs(spark, sf_dir):
    bits = F.col("score") / 8
    return _scores(spark, sf_dir).select("p_partkey", st.raw_from_bits(bits, _GAPPED).alias("raw_score"), st.raw_drop_from_bits(bits, _GAPPED).alias("raw_drop"))


@query(f"""with {_sql_protein()}, {_sql_protein("benchmark", "item_id", "q")}, s as (select sum(length(seq))::bigint as n, count(*)::bigint as k from p)
select item_id, greatest(1, (n - k * 5) * (length(seq) - 5))::bigint as space from q, s""")
def search_space(spark, sf_dir):
    """Effective search space of each passage at a length adjustment of 5."""
    row = database.statistics(subjects(spark, sf_dir)).first()
    m = F.length("seq").cast("bigint")
    return passages(spark, sf_dir).select(F.col("query_id").alias("item_id"), st.space_column(F.lit(row["total_length"]), m, F.lit(row["sequences"]), F.lit(5)).cast("bigint").alias("space"))


@query()
def length_adjustment(spark, sf_dir):
    """Adjustment and space of each passage as the search uses them."""
    row = database.statistics(subjects(spark, sf_dir)).first()
    return kernels.length_adjustments(passages(spark, sf_dir), row["total_length"], row["sequences"], _GAPPED, _ALPHA, _BETA)


# Kernels that SQL does not express; tests hold them against fixed values and plain versions.


@query()
def karlin_params(spark, sf_dir):
    """Ungapped parameters of every passage."""
    return kernels.karlin_parameters(passages(spark, sf_dir))


@query()
def seg_mask(spark, sf_dir):
    """Low-complexity masking of all documents."""
    return kernels.masked(subjects(spark, sf_dir)).select(F.col("seq_id").alias("doc_id"), F.length("masked").alias("n_residues"), F.expr("length(masked) - length(replace(masked, 'x', ''))").alias("n_masked"), F.md5("masked").alias("masked_md5"))


@query()
def cluster_leaders(spark, sf_dir):
    """Clusters of all documents' seeds: members of each hash."""
    db = database.build(subjects(spark, sf_dir))
    return db.clustered.groupBy("hash").agg(F.countDistinct("rep_ctx").alias("clusters"), F.count("*").alias("members"))


@query()
def cluster_prune(spark, sf_dir):
    """Seed matches through clusters' representatives, members expanded."""
    db = database.build(subjects(spark, sf_dir))
    hits = search.seed_hits(_query_seeds(spark, sf_dir), db.clustered, db.single, db.settings.hit_mismatches)
    return hits.groupBy(F.col("query_id").alias("item_id")).agg(F.count("*").alias("hits"), F.countDistinct("seq_id").alias("subjects"))


@query()
def ungapped_score(spark, sf_dir):
    """Ungapped X-drop scores of all near hits: count, sum and greatest a passage."""
    frames = search.prepare(passages(spark, sf_dir), False, search.SearchOptions(mask=False))
    scores = kernels.ungapped_scores(_diagonal_hits(spark, sf_dir), runtime.materialize(frames), subjects(spark, sf_dir))
    return scores.groupBy(F.col("query_id").alias("item_id")).agg(F.count("*").alias("hits"), F.sum("score").alias("score_sum"), F.max("score").alias("best"))


@query()
def gapped_align(spark, sf_dir):
    """Gapped candidates of all near hits before ranking: count, sum and greatest score a passage."""
    options = search.SearchOptions()
    frames = runtime.materialize(search.prepare(passages(spark, sf_dir), False, options))
    found = search.presearch(_diagonal_hits(spark, sf_dir), frames, subjects(spark, sf_dir), options)
    return found.groupBy(F.col("query_id").alias("item_id")).agg(F.count("*").alias("candidates"), F.sum("score").alias("score_sum"), F.max("score").alias("best"))


def _report(found: DataFrame) -> DataFrame:
    return found.select(F.col("query_id").alias("item_id"), "rank", "subject", F.round(F.col("identity").cast("double"), 4).alias("identity"), "length", "mismatches", "gap_opens", "q_start", "q_end", "s_start", "s_end", "evalue", F.round(F.col("bits").cast("double"), 4).alias("bits"), "score", "cigar")


@query()
def homology_search(spark, sf_dir):
    """All passages against all documents, as proteins."""
    return _report(homology.search(database.build(subjects(spark, sf_dir)), passages(spark, sf_dir)))


@query()
def homology_search_unclustered(spark, sf_dir):
    """The same without clustering the database."""
    return _report(homology.search(database.build(subjects(spark, sf_dir), clustering=False), passages(spark, sf_dir)))


@query()
def homology_search_stored(spark, sf_dir):
    """The same from a database written and loaded again, two alignments a subject."""
    path = runtime.work_dir(spark)
    database.save(database.build(subjects(spark, sf_dir)), path)
    return _report(homology.search(database.load(spark, path), passages(spark, sf_dir), options=search.SearchOptions(per_subject=2)))


@query()
def homology_search_translated(spark, sf_dir):
    """All passages as DNA, a codon a residue, in six frames against all documents' proteins."""
    first = {}
    for codon, residue in CODONS.items():
        first.setdefault(residue, codon)
    table = F.create_map(*[x for residue, codon in first.items() for x in (F.lit(residue), F.lit(codon))])
    codons = F.transform(F.split("seq", ""), lambda c: F.when(c != "", F.coalesce(table[c], F.lit("NNN"))).otherwise(F.lit("")))
    dna = passages(spark, sf_dir).select("query_id", "name", F.array_join(codons, "").alias("seq"))
    return _report(homology.search(database.build(subjects(spark, sf_dir)), dna, dna=True))


@query()
def result_lines(spark, sf_dir):
    """Results as lines of the tabular format."""
    db = database.build(subjects(spark, sf_dir))
    return fasta.to_tsv_lines(homology.search(db, passages(spark, sf_dir)))


@query(f"with {_sql_protein()} select doc_id::varchar as name, md5(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'))) as seq_md5 from documents")
def fasta_round_trip(spark, sf_dir):
    """Documents' proteins written as FASTA with lines of 60 letters and scanned again."""
    path = runtime.work_dir(spark)
    lines = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length("seq") - 1, F.lit(0)) / 60)), lambda i: F.substr("seq", (i * 60 + 1).cast("int"), F.lit(60))), "\n")
    subjects(spark, sf_dir).select(F.concat(F.lit(">"), F.col("name"), F.lit("\n"), lines)).write.text(path)
    return fasta.read_fasta(spark, path).select("name", F.md5("seq").alias("seq_md5"))
