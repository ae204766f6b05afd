"""Every operator as a query over the driver's tables, with the SQL it has to agree with.

documents are the reads, benchmark passages the index; pages give a second index, and turns of
conversations are mates of pairs. Texts become DNA by a fixed letter map.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as sql
from .functions import dna, format_count, format_record, reverse_complement
from .operators import index as ops
from .operators.classify import classify
from .operators.filtering import counters, rename
from .operators.frozen import freeze, slot
from .operators.minimizers import arrow_minimizers, sql_minimizers
from .params import FilterParams, KmerParams
from .scratch import scratch
from .sources import index_files
from .sources.fastx import interleaved
from .streaming.sessions import filter_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DEFAULT, SHORT = KmerParams(31, 15), KmerParams(11, 5)


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str, ambiguous: bool = False) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_no"), F.concat(F.lit("doc"), F.col("doc_id")).alias("header"), dna(F.col("text"), ambiguous).alias("seq"))


def index(spark: SparkSession, sf_dir: str, name: str = "benchmark", text: str = "text", params: KmerParams = DEFAULT) -> ops.MinimizerIndex:
    return ops.build(table(spark, sf_dir, name).select(dna(F.col(text)).alias("seq")), params)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns 2i and 2i+1 of a conversation."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.floor(F.col("turn") / 2)).alias("pair_no"), (F.col("turn") % 2).alias("mate"), F.concat_ws("_", F.lit("c"), "conv_id", "turn").alias("header"), dna(F.col("text")).alias("seq"))
    side = lambda n: turns.where(F.col("mate") == n).select("pair_no", F.col("header").alias(f"header{n + 1}"), F.col("seq").alias(f"seq{n + 1}"))
    return side(0).join(side(1), "pair_no")


PAIRS = f"""turns AS (SELECT conv_id * 1000 + turn // 2 AS id, turn % 2 AS mate, 'c_' || conv_id || '_' || turn AS header, {sql.dna('text')} AS seq FROM conversations),
pairs AS (SELECT id, a.header AS header1, a.seq AS seq1, b.header AS header2, b.seq AS seq2 FROM turns a JOIN turns b USING (id) WHERE a.mate = 0 AND b.mate = 1)"""


def pair_decisions(p: FilterParams, k: int, w: int) -> str:
    return f"""{PAIRS},
mates AS (SELECT id * 2 AS id, seq1 AS seq FROM pairs UNION ALL SELECT id * 2 + 1, seq2 FROM pairs),
{sql.minimizers('rm', 'mates', k, w)},
{sql.index('ix', 'benchmark', 'text', k, w)},
cnt AS (SELECT rm.id // 2 AS id, count(*) AS total_minimizers, count(DISTINCT ix.kmer) AS hit_count FROM rm LEFT JOIN ix USING (kmer) GROUP BY 1),
dec0 AS (SELECT pairs.*, coalesce(total_minimizers, 0) AS total_minimizers, coalesce(hit_count, 0) AS hit_count FROM pairs LEFT JOIN cnt USING (id)),
dec AS (SELECT *, {sql.keep(p)} AS keep FROM dec0)"""


# functions


@query(f"SELECT doc_id, {sql.dna('text')} AS seq, length({sql.dna('text')}) AS bp FROM documents")
def encode_dna(spark, d):
    return table(spark, d, "documents").select("doc_id", dna(F.col("text")).alias("seq")).withColumn("bp", F.length("seq"))


@query(f"SELECT item_id, {sql.revcomp(sql.dna('text'))} AS rc FROM benchmark")
def revcomp(spark, d):
    return table(spark, d, "benchmark").select("item_id", reverse_complement(dna(F.col("text"))).alias("rc"))


K1 = KmerParams(15, 1)
ALL = f"WITH s AS (SELECT item_id AS id, {sql.dna('text')} AS seq FROM benchmark), {sql.minimizers('m', 's', 15, 1)} SELECT id AS item_id, pos, kmer FROM m"


def spelled(rows: DataFrame, params: KmerParams) -> DataFrame:
    return rows.withColumn("kmer", ops.spelled(params))


@query(ALL)
def canonical_kmers(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", dna(F.col("text")).alias("seq"))
    return spelled(arrow_minimizers(rows, K1, ids=("item_id",)), K1)


# minimizers

POSITIONS = f"WITH {sql.reads()}, {sql.minimizers('m', 'reads', 31, 15)} SELECT id AS record_no, pos, kmer FROM m"


@query(POSITIONS)
def minimizer_positions(spark, d):
    return spelled(arrow_minimizers(reads(spark, d), DEFAULT), DEFAULT)


@query(POSITIONS)
def minimizer_positions_sql(spark, d):
    return sql_minimizers(reads(spark, d), DEFAULT)


@query(f"WITH {sql.reads(True)}, {sql.minimizers('m', 'reads', 31, 15)} SELECT id AS record_no, pos, kmer FROM m")
def minimizer_positions_ambiguous(spark, d):
    return spelled(arrow_minimizers(reads(spark, d, True), DEFAULT), DEFAULT)


LONG = KmerParams(41, 15)


@query(f"WITH {sql.reads()}, {sql.minimizers('m', 'reads', 41, 15)} SELECT id AS record_no, pos, kmer FROM m")
def minimizer_positions_k41(spark, d):
    return spelled(arrow_minimizers(reads(spark, d), LONG), LONG)


@query(f"WITH {sql.reads()}, {sql.minimizers('m', 'reads', 31, 15)} SELECT id AS record_no, count(*) AS n, count(DISTINCT kmer) AS n_distinct FROM m GROUP BY id")
def minimizer_count_per_doc(spark, d):
    return arrow_minimizers(reads(spark, d), DEFAULT).groupBy("record_no").agg(F.count("*").alias("n"), F.count_distinct("kmer").alias("n_distinct"))


# indexes


def kmers(i: ops.MinimizerIndex) -> DataFrame:
    return i.kmers.select(i.spelled().alias("kmer"))


BENCH, PAGES = sql.index("a", "benchmark", "text", 31, 15), sql.index("b", "pages", "html", 31, 15)


@query(f"WITH {BENCH} SELECT kmer FROM a")
def index_build(spark, d):
    return kmers(index(spark, d))


@query(f"WITH {sql.index('a', 'benchmark', 'text', 31, 1)} SELECT kmer FROM a")
def index_build_w1(spark, d):
    return kmers(index(spark, d, params=KmerParams(31, 1)))


@query(f"WITH {BENCH}, {PAGES} SELECT kmer FROM a UNION SELECT kmer FROM b")
def index_union(spark, d):
    return kmers(ops.union(index(spark, d), index(spark, d, "pages", "html")))


@query(f"WITH {BENCH}, {PAGES} SELECT kmer FROM a INTERSECT SELECT kmer FROM b")
def index_intersect(spark, d):
    return kmers(ops.intersect(index(spark, d), index(spark, d, "pages", "html")))


@query(f"WITH {BENCH}, {PAGES} SELECT kmer FROM a EXCEPT SELECT kmer FROM b")
def index_diff_index(spark, d):
    return kmers(ops.subtract(index(spark, d), index(spark, d, "pages", "html")))


@query(f"WITH {BENCH}, {sql.index('b', 'documents', 'text', 31, 15)} SELECT kmer FROM a EXCEPT SELECT kmer FROM b")
def index_diff_stream(spark, d):
    return kmers(ops.subtract_records(index(spark, d), reads(spark, d)))


@query(f"WITH {BENCH}, {sql.index('b', 'pages', 'html', 31, 1)} SELECT kmer FROM a EXCEPT SELECT kmer FROM b")
def index_diff_w1(spark, d):
    return kmers(ops.subtract(index(spark, d), index(spark, d, "pages", "html", KmerParams(31, 1))))


def _complex(algorithm: str, limit: float, invert: bool):
    def f(spark, d):
        i = index(spark, d, "pages", "html")
        bound = F.lit(limit).cast("float")
        kept = ops.scored(i, algorithm).where(F.col("value") < bound if invert else F.col("value") >= bound)
        return kept.select(i.spelled().alias("kmer"), F.round(F.col("value").cast("double"), 4).alias("value"))

    f.__name__ = f"index_filter_{algorithm}{'_invert' if invert else ''}"
    value = getattr(sql, algorithm)(31, "b")
    return query(f"WITH {PAGES} SELECT kmer, round(value::DOUBLE, 4) AS value FROM ({value}) WHERE value {'<' if invert else '>='} {limit}::FLOAT")(f)


for _args in (("kdust", 0.9, False), ("kdust", 0.9, True), ("shannon", 0.9, False), ("shannon", 0.9, True)):
    _complex(*_args)


@query(f"WITH {BENCH} SELECT row_number() OVER (ORDER BY kmer) AS n, kmer FROM a")
def index_dump(spark, d):
    return ops.dump(index(spark, d))


@query(f"WITH {BENCH} SELECT 'exact-u64' AS kind, 3 AS format_version, 31 AS k, 15 AS w, count(*) AS \"count\" FROM a")
def index_info(spark, d):
    return ops.info(index(spark, d))


# classification


def _classify(p: FilterParams, params: KmerParams = DEFAULT, ambiguous: bool = False, **options):
    def f(spark, d):
        out = classify(reads(spark, d, ambiguous), index(spark, d, params=params), p, **options)
        return out.select("record_no", "total_minimizers", "hit_count", "keep")

    return f, f"WITH {sql.decisions(p, params.k, params.w, ambiguous)} SELECT id AS record_no, total_minimizers, hit_count, keep FROM dec"


def _register(name: str, pair) -> None:
    f, text = pair
    f.__name__ = name
    query(text)(f)


_register("classify_single", _classify(FilterParams()))
_register("classify_joined", _classify(FilterParams(), broadcast_kmers=0))
_register("classify_prefix", _classify(FilterParams(prefix_length=400)))
_register("classify_strict_rel", _classify(FilterParams(5, 0.3), SHORT))
_register("classify_short", _classify(FilterParams(2, 0.1), SHORT))
_register("classify_ambiguous", _classify(FilterParams(), ambiguous=True))
_register("classify_k41", _classify(FilterParams(1, 0.0), LONG))

_kept = f"{sql.index('ix0', 'benchmark', 'text', 31, 15)}, ix AS (SELECT kmer FROM ({sql.kdust(31, 'ix0')}) WHERE value >= 0.95::FLOAT)"


@query(f"WITH {sql.decisions(FilterParams(), index_ctes=_kept)} SELECT id AS record_no, total_minimizers, hit_count, keep FROM dec")
def classify_complexity(spark, d):
    i = ops.retain_complexity(index(spark, d), 0.95)
    return classify(reads(spark, d), i).select("record_no", "total_minimizers", "hit_count", "keep")


_paired = FilterParams(2, 0.05)


@query(f"WITH {pair_decisions(_paired, 11, 5)} SELECT id AS pair_no, total_minimizers, hit_count, keep FROM dec")
def classify_paired(spark, d):
    return classify(pairs(spark, d), index(spark, d, params=SHORT), _paired, ("seq1", "seq2")).select("pair_no", "total_minimizers", "hit_count", "keep")


@query(f"WITH {pair_decisions(_paired, 11, 5)} SELECT id AS pair_no, total_minimizers, hit_count, keep FROM dec")
def classify_interleaved(spark, d):
    both = pairs(spark, d)
    mates = F.explode(F.array(*(F.struct((F.col("pair_no") * 2 + n).alias("record_no"), F.col(f"header{n + 1}").alias("header"), F.col(f"seq{n + 1}").alias("seq"), F.lit(None).cast("string").alias("qual")) for n in (0, 1)))).alias("m")
    again = interleaved(both.select(mates).select("m.*"))
    return classify(again, index(spark, d, params=SHORT), _paired, ("seq1", "seq2")).select("pair_no", "total_minimizers", "hit_count", "keep")


def _decided(spark, d, p: FilterParams, **options) -> DataFrame:
    return classify(reads(spark, d), index(spark, d), p, **options)


@query(f"WITH {sql.decisions(FilterParams())} SELECT id AS record_no, full_seq AS seq FROM dec WHERE keep")
def filter_search(spark, d):
    return _decided(spark, d, FilterParams()).where("keep").select("record_no", "seq")


_deplete = FilterParams(deplete=True)


@query(f"WITH {sql.decisions(_deplete)} SELECT id AS record_no, full_seq AS seq FROM dec WHERE keep")
def filter_deplete(spark, d):
    return _decided(spark, d, _deplete).where("keep").select("record_no", "seq")


@query(f"""WITH {sql.decisions(FilterParams())},
firsts AS (SELECT id, kmer, min(pos) AS pos FROM rm JOIN ix USING (kmer) GROUP BY id, kmer)
SELECT dec.id AS record_no, hit_count, coalesce((SELECT string_agg(kmer, ',' ORDER BY pos) FROM firsts WHERE firsts.id = dec.id), '') AS hits FROM dec""")
def filter_debug_hits(spark, d):
    return _decided(spark, d, FilterParams(), names=True).select("record_no", "hit_count", F.array_join("hit_kmers", ",").alias("hits"))


@query(f"WITH {sql.decisions(_deplete)} SELECT id AS record_no, (row_number() OVER (ORDER BY id))::VARCHAR AS header FROM dec WHERE keep")
def filter_rename(spark, d):
    return rename(_decided(spark, d, _deplete).where("keep").select("record_no", "header"), ["record_no"])


@query(f"WITH {sql.decisions(_deplete)} SELECT id AS record_no, row_number() OVER (ORDER BY id) AS n, TRUE AS well_formed FROM dec WHERE keep")
def filter_rename_random(spark, d):
    out = rename(_decided(spark, d, _deplete).where("keep").select("record_no", "header"), ["record_no"], random=True)
    return out.select("record_no", F.split("header", "-")[0].cast("long").alias("n"), F.col("header").rlike("^[1-9][0-9]*-[0-9]{1,20}$").alias("well_formed"))


@query(f"WITH {pair_decisions(_paired, 11, 5)} SELECT id AS pair_no, row_number() OVER (ORDER BY id) || ' /1' AS header1, row_number() OVER (ORDER BY id) || ' /2' AS header2 FROM dec WHERE keep")
def filter_rename_paired(spark, d):
    out = classify(pairs(spark, d), index(spark, d, params=SHORT), _paired, ("seq1", "seq2"))
    return rename(out.where("keep").select("pair_no", "header1", "header2"), ["pair_no"], pair=True)


def _counter_sql(n: int, bases: str) -> str:
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0 END"
    return f"""SELECT seqs_in, seqs_out, {share('seqs_out', 'seqs_in')} AS seqs_out_proportion, seqs_in - seqs_out AS seqs_removed, {share('(seqs_in - seqs_out)', 'seqs_in')} AS seqs_removed_proportion,
bp_in, bp_out, {share('bp_out', 'bp_in')} AS bp_out_proportion, bp_in - bp_out AS bp_removed, {share('(bp_in - bp_out)', 'bp_in')} AS bp_removed_proportion
FROM (SELECT count(*) * {n} AS seqs_in, (count(*) FILTER (WHERE keep)) * {n} AS seqs_out, coalesce(sum({bases}), 0)::BIGINT AS bp_in, coalesce(sum({bases}) FILTER (WHERE keep), 0)::BIGINT AS bp_out FROM dec)"""


@query(f"WITH {sql.decisions(_deplete)} {_counter_sql(1, 'length(full_seq)')}")
def filter_summary(spark, d):
    return counters(_decided(spark, d, _deplete))


@query(f"WITH {pair_decisions(_paired, 11, 5)} {_counter_sql(2, 'length(seq1) + length(seq2)')}")
def filter_summary_paired(spark, d):
    return counters(classify(pairs(spark, d), index(spark, d, params=SHORT), _paired, ("seq1", "seq2")), ("seq1", "seq2"))


_text = "'@doc' || id || chr(10) || full_seq || chr(10) || '+' || chr(10) || repeat('~', length(full_seq))"


def _formatted(fasta: bool) -> Callable:
    def f(spark, d):
        kept = _decided(spark, d, FilterParams()).where("keep")
        qual: Column = F.repeat(F.lit("~"), F.length("seq"))
        return kept.select("record_no", format_record(F.col("header"), F.col("seq"), qual, fasta).alias("value"))

    return f


_register("format_fastq", (_formatted(False), f"WITH {sql.decisions(FilterParams())} SELECT id AS record_no, {_text} AS value FROM dec WHERE keep"))
_register("format_fasta", (_formatted(True), f"WITH {sql.decisions(FilterParams())} SELECT id AS record_no, '>doc' || id || chr(10) || full_seq AS value FROM dec WHERE keep"))


@query("SELECT format('{:,}', sum(n_chars)::BIGINT) AS bases FROM documents")
def format_thousands(spark, d):
    return table(spark, d, "documents").agg(format_count(F.sum("n_chars")).alias("bases"))


# frozen indexes

_slot = lambda n, bits: f"('0x' || substr(md5(kmer), 1, 15))::BIGINT % {n} AS bucket, ('0x' || substr(md5(kmer), 17, {bits // 4}))::BIGINT AS fp"


@query(f"WITH {BENCH} SELECT DISTINCT {_slot('(SELECT count(*) FROM a)', 32)} FROM a")
def index_freeze(spark, d):
    return freeze(index(spark, d)).table


@query(f"WITH {BENCH} SELECT DISTINCT {_slot('(SELECT count(*) FROM a)', 16)} FROM a")
def index_freeze_16(spark, d):
    return freeze(index(spark, d), 16).table


@query(f"""WITH {sql.reads()}, {sql.minimizers('rm', 'reads', 31, 15)}, {BENCH},
z AS (SELECT DISTINCT {_slot('(SELECT count(*) FROM a)', 32)} FROM a),
cnt AS (SELECT id, count(*) AS total_minimizers, count(DISTINCT CASE WHEN z.fp IS NOT NULL THEN kmer END) AS hit_count FROM (SELECT id, kmer, {_slot('(SELECT count(*) FROM a)', 32)} FROM rm) LEFT JOIN z USING (bucket, fp) GROUP BY id),
dec0 AS (SELECT reads.id, coalesce(total_minimizers, 0) AS total_minimizers, coalesce(hit_count, 0) AS hit_count FROM reads LEFT JOIN cnt USING (id))
SELECT id AS record_no, total_minimizers, hit_count, {sql.keep(FilterParams())} AS keep FROM dec0""")
def filter_frozen(spark, d):
    return classify(reads(spark, d), freeze(index(spark, d))).select("record_no", "total_minimizers", "hit_count", "keep")


@query(f"""WITH {BENCH}, {PAGES}, z AS (SELECT DISTINCT {_slot('(SELECT count(*) FROM b)', 16)} FROM b), p AS (SELECT kmer FROM a UNION SELECT kmer FROM b)
SELECT kmer, (bucket, fp) IN (SELECT (bucket, fp) FROM z) AS found FROM (SELECT kmer, {_slot('(SELECT count(*) FROM b)', 16)} FROM p)""")
def frozen_membership(spark, d):
    """K-mers of two tables against a frozen index of one: all of its own are found, others by chance."""
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    index_files.save(index(spark, d, "pages", "html"), path)  # minimizers are selected once, and read for keys, count and probe
    i = index_files.load_exact(spark, path)
    z = freeze(i, 16)
    both = ops.union(index(spark, d), i)
    probe = both.kmers.select("kmer", *slot(both.spelled(), z.key_count, z.bits))
    found = probe.join(z.table.withColumn("found", F.lit(True)), ["bucket", "fp"], "left")
    return found.select(both.spelled().alias("kmer"), F.coalesce("found", F.lit(False)).alias("found"))


# streams


@query(f"WITH {sql.decisions(_deplete)} SELECT id AS record_no, total_minimizers, hit_count FROM dec WHERE keep")
def filter_stream_deplete(spark, d):
    out = f"{scratch(spark)}/{uuid.uuid4().hex}"
    schema = table(spark, d, "documents").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/documents.parquet*")
    stream = stream.select(F.col("doc_id").alias("record_no"), dna(F.col("text")).alias("seq"))
    done = filter_stream(stream, index(spark, d), lambda batch, _: batch.select("record_no", "total_minimizers", "hit_count").write.mode("append").parquet(f"{out}/rows"), f"{out}/state", _deplete)
    done.awaitTermination()
    return spark.read.parquet(f"{out}/rows")
