"""Sources, sinks and whole runs as queries: files are written from the driver's tables and read back."""

from __future__ import annotations

import json
import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as sql
from .api import Index
from .cli import execute, parser
from .functions import dna, format_record
from .operators import index as ops
from .operators.filtering import formatted
from .operators.frozen import freeze
from .params import FilterParams, KmerParams
from .plans.run import RunConfig, run
from .queries import BENCH, PAGES, PAIRS, SHORT, _counter_sql, _deplete, _paired, index, kmers, pair_decisions, pairs, query, reads, scratch, table
from .sources import fastx, index_files
from .sources.parser import ChunkParser
from .streaming.sessions import filter_stream

READS = f"SELECT 'doc' || doc_id AS header, coalesce({sql.dna('text')}, '') AS seq"


def _folder(spark: SparkSession) -> str:
    path = f"{scratch(spark)}/{uuid.uuid4().hex}".removeprefix("file:")
    os.makedirs(path)
    return path


def _records(spark: SparkSession, d: str, quality: bool = True) -> DataFrame:
    out = reads(spark, d).withColumn("seq", F.coalesce("seq", F.lit("")))
    return out.withColumn("qual", F.repeat(F.lit("I"), F.length("seq")) if quality else F.lit(None).cast("string"))


def _texts(records: DataFrame, fasta: bool = False) -> DataFrame:
    return records.select(format_record(F.col("header"), F.col("seq"), F.col("qual"), fasta).alias("value"))


def _named(name: str, oracle: str, f) -> None:
    f.__name__ = name
    query(oracle)(f)


# scans


@query(f"{READS}, TRUE AS is_fasta FROM documents")
def scan_fasta_multiline(spark, d):
    """Sequences over lines of 60 bases."""
    folder = _folder(spark)
    lines = _records(spark, d, False).select(F.concat(F.lit(">"), "header", F.lit("\n"), F.regexp_replace("seq", "(.{60})", "$1\n")).alias("value"))
    fastx.write_parts(lines, f"{folder}/x")
    return fastx.read_fastx(spark, f"{folder}/x/part-*").select("header", "seq", F.col("qual").isNull().alias("is_fasta"))


def _scan(codec: str | None, level: int | None, **options):
    def f(spark, d):
        folder = _folder(spark)
        fastx.write_parts(_texts(_records(spark, d)), f"{folder}/x", codec, level)
        return fastx.read_fastx(spark, f"{folder}/x/part-*", **options).select("header", "seq", F.length("qual").alias("n_qual"))

    return f


_fastq = f"{READS}, length(coalesce({sql.dna('text')}, '')) AS n_qual FROM documents"
for _name, _codec, _level in (("gzip", "gzip", 9), ("gzip_by_spark", "gzip", None), ("zstd", "zstd", 5), ("xz", "xz", 0)):
    _named(f"scan_fastq_{_name}", _fastq, _scan(_codec, _level))
_named("scan_fastq_in_ranges", _fastq, _scan(None, None, ordinals=False, split=20_000))


def _sink(ending: str):
    def f(spark, d):
        path = f"{_folder(spark)}/x.fastq{ending}"
        fastx.write_file(_texts(_records(spark, d).sort("record_no")), path)
        return fastx.read_fastx(spark, path).select("record_no", "header", "seq")

    return f


for _ending in ("", ".gz", ".zst", ".xz"):
    _named(f"sink_one_file{_ending.replace('.', '_')}", f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS record_no, header, seq FROM (SELECT doc_id, {READS[7:]} FROM documents)", _sink(_ending))


def _mates(spark, d: str, folder: str) -> tuple[str, str]:
    both = pairs(spark, d)
    for n in (1, 2):
        rows = both.sort("pair_no").select(F.col(f"header{n}").alias("header"), F.col(f"seq{n}").alias("seq"), F.repeat(F.lit("I"), F.length(f"seq{n}")).alias("qual"))
        fastx.write_file(formatted(rows), f"{folder}/{n}.fastq")
    return f"{folder}/1.fastq", f"{folder}/2.fastq"


_pairs = f"WITH {PAIRS} SELECT row_number() OVER (ORDER BY id) - 1 AS pair_no, header1, seq1, header2, seq2 FROM pairs"


@query(_pairs)
def scan_paired(spark, d):
    return fastx.read_paired(spark, *_mates(spark, d, _folder(spark))).select("pair_no", "header1", "seq1", "header2", "seq2")


@query(_pairs)
def scan_interleaved(spark, d):
    folder = _folder(spark)
    both = fastx.read_paired(spark, *_mates(spark, d, folder)).sort("pair_no")
    fastx.write_file(fastx.mates(both), f"{folder}/both.fastq.gz")
    return fastx.interleaved(fastx.read_fastx(spark, f"{folder}/both.fastq.gz")).select("pair_no", "header1", "seq1", "header2", "seq2")


@query("SELECT 0 AS record_no, '>a' AS header WHERE FALSE")
def scan_empty(spark, d):
    """Files under five bytes hold nothing."""
    path = f"{_folder(spark)}/x.fa"
    with open(path, "w") as f:
        f.write(">a\nA")
    return fastx.read_fastx(spark, path).select("record_no", "header")


@query(f"{READS} FROM documents")
def parse_chunks(spark, d):
    """Records of a byte stream that comes in pieces of seven bytes, one stream a task."""

    def parse(batches):
        stream, rows, held = ChunkParser(), [], 0

        def made():
            return pa.RecordBatch.from_arrays([pa.array([r.header for r in rows], pa.string()), pa.array([r.seq for r in rows], pa.string())], names=["header", "seq"])

        for batch in batches:
            for text in batch.column(0):
                data = (text.as_py() + "\r\n").encode()
                for at in range(0, len(data), 7):
                    rows += stream.push(data[at : at + 7])
                held += len(data)
                if held > fastx.BATCH:
                    yield made()
                    rows, held = [], 0
        rows += stream.finish()
        yield made()

    return _texts(_records(spark, d)).mapInArrow(parse, "header string, seq string")


# index files


@query(f"WITH {BENCH} SELECT kmer FROM a")
def index_file(spark, d):
    path = f"{_folder(spark)}/a.idx"
    index_files.export_idx(index(spark, d), path)
    return kmers(index_files.load(spark, path))


@query(f"WITH {sql.index('a', 'benchmark', 'text', 41, 15)} SELECT kmer FROM a")
def index_file_k41(spark, d):
    path = f"{_folder(spark)}/a.idx"
    index_files.export_idx(index(spark, d, params=KmerParams(41, 15)), path)
    return kmers(index_files.load(spark, path))


@query(f"WITH {BENCH} SELECT 'idx' AS format, 3 AS version, 31 AS k, 15 AS w, count(*) AS \"count\" FROM a")
def index_file_header(spark, d):
    path = f"{_folder(spark)}/a.idx"
    index_files.export_idx(index(spark, d), path)
    head = index_files.header(spark, path)
    return spark.createDataFrame([tuple(head.values())], "format string, version int, k int, w int, count long")


@query(f"WITH {PAGES} SELECT kmer FROM b")
def index_saved(spark, d):
    path = f"{_folder(spark)}/b"
    index_files.save(index(spark, d, "pages", "html"), path)
    return kmers(index_files.load(spark, path))


@query(f"WITH {BENCH} SELECT DISTINCT ('0x' || substr(md5(kmer), 1, 15))::BIGINT % (SELECT count(*) FROM a) AS bucket, ('0x' || substr(md5(kmer), 17, 8))::BIGINT AS fp FROM a")
def index_saved_frozen(spark, d):
    path = f"{_folder(spark)}/z"
    index_files.save(freeze(index(spark, d)), path)
    return index_files.load(spark, path).table


@query(f"WITH {BENCH} SELECT 'exact-u64' AS format, 31 AS k, 15 AS w, count(*) AS \"count\" FROM a")
def index_object(spark, d):
    """The Index class on a saved index."""
    path = f"{_folder(spark)}/a"
    index_files.save(index(spark, d), path)
    info = Index(path, spark=spark).info()
    return spark.createDataFrame([(info["format"], info["k"], info["w"], info["count"])], "format string, k int, w int, count long")


@query(f"SELECT count(*) AS records, coalesce(sum(length({sql.dna('text')})), 0)::BIGINT AS bp FROM documents")
def index_build_stats(spark, d):
    return ops.build_stats(reads(spark, d))


@query(f"""WITH {BENCH}, {PAGES}, u AS (SELECT kmer FROM a UNION SELECT kmer FROM b)
SELECT 1 AS step, (SELECT count(*) FROM a) AS size, (SELECT count(*) FROM a) AS total UNION ALL SELECT 2, (SELECT count(*) FROM u) - (SELECT count(*) FROM a), (SELECT count(*) FROM u)""")
def index_union_steps(spark, d):
    return ops.steps([index(spark, d), index(spark, d, "pages", "html")])


@query(f"""WITH {BENCH}, {PAGES}, i AS (SELECT kmer FROM a INTERSECT SELECT kmer FROM b)
SELECT 1 AS step, (SELECT count(*) FROM a) AS size, (SELECT count(*) FROM a) AS total UNION ALL SELECT 2, (SELECT count(*) FROM i), (SELECT count(*) FROM i)""")
def index_intersect_steps(spark, d):
    return ops.steps([index(spark, d), index(spark, d, "pages", "html")], "intersect")


# runs


def _run(spark, d: str, folder: str, **options) -> dict:
    path = f"{folder}/in.fastq"
    fastx.write_file(_texts(_records(spark, d).sort("record_no")), path)
    return run(spark, index(spark, d), RunConfig(path, params=_deplete, **options))


_kept = f"WITH {sql.decisions(_deplete)}"


@query(f"{_kept} SELECT row_number() OVER (ORDER BY id) - 1 AS record_no, 'doc' || id AS header, full_seq AS seq FROM dec WHERE keep")
def run_file(spark, d):
    """FASTQ in, one gzip file in order out."""
    folder = _folder(spark)
    _run(spark, d, folder, output=f"{folder}/out.fastq.gz", compression_level=3)
    return fastx.read_fastx(spark, f"{folder}/out.fastq.gz").select("record_no", "header", "seq")


@query(f"{_kept} SELECT 'doc' || id AS header, full_seq AS seq FROM dec WHERE keep")
def run_folder(spark, d):
    """FASTQ in, a folder of zstd files out, one a task; FASTA on request."""
    folder = _folder(spark)
    _run(spark, d, folder, output=f"{folder}/out.zst/", output_fasta=True)
    return fastx.read_fastx(spark, f"{folder}/out.zst/part-*").where("qual is null").select("header", "seq")


@query(f"{_kept} {_counter_sql(1, 'length(full_seq)')}")
def run_summary(spark, d):
    """Counters of the JSON summary."""
    folder = _folder(spark)
    _run(spark, d, folder, summary=f"{folder}/s.json")
    with open(f"{folder}/s.json") as f:
        got = json.load(f)
    names = [n for n in got if n.startswith(("seqs_", "bp_")) and "second" not in n]
    kinds = ", ".join(f"{n} {'double' if n.endswith('proportion') else 'long'}" for n in names)
    return spark.createDataFrame([tuple(got[n] for n in names)], kinds)


@query(f"{_kept} SELECT count(*) AS seqs_in, TRUE AS rates_fit FROM dec")
def run_rates(spark, d):
    """Rates are counts over seconds."""
    got = _run(spark, d, _folder(spark))
    fit = all(abs(got[f"{n}_per_second"] * got["time"] - got[f"{n}_in"]) < 1e-6 * max(1, got[f"{n}_in"]) and 0 < got[f"{n}_per_second_total"] <= got[f"{n}_per_second"] for n in ("seqs", "bp"))
    return spark.createDataFrame([(got["seqs_in"], fit)], "seqs_in long, rates_fit boolean")


@query(f"WITH {pair_decisions(_paired, 11, 5)} SELECT row_number() OVER (ORDER BY id) - 1 AS pair_no, row_number() OVER (ORDER BY id) || ' /1' AS header1, seq1, row_number() OVER (ORDER BY id) || ' /2' AS header2, seq2 FROM dec WHERE keep")
def run_paired(spark, d):
    """Two files in, two files out, renamed."""
    folder = _folder(spark)
    one, two = _mates(spark, d, folder)
    run(spark, index(spark, d, params=SHORT), RunConfig(one, two, f"{folder}/o1.fastq.gz", f"{folder}/o2.fastq.zst", params=_paired, rename=True))
    if fastx.is_empty(f"{folder}/o1.fastq.gz"):
        return spark.createDataFrame([], "pair_no long, header1 string, seq1 string, header2 string, seq2 string")
    return fastx.read_paired(spark, f"{folder}/o1.fastq.gz", f"{folder}/o2.fastq.zst").select("pair_no", "header1", "seq1", "header2", "seq2")


@query(f"WITH {sql.decisions(FilterParams(3, 0.02, deplete=True))} SELECT 'doc' || id AS header FROM dec WHERE keep")
def command_filter(spark, d):
    """Index and reads through the command line: index build, then filter."""
    folder = _folder(spark)
    fastx.write_parts(table(spark, d, "benchmark").select(F.concat(F.lit(">b"), "item_id", F.lit("\n"), dna(F.col("text"))).alias("value")), f"{folder}/bench")
    fastx.write_file(_texts(_records(spark, d).sort("record_no")), f"{folder}/in.fastq")
    for line in (["index", "build", f"{folder}/bench/part-*", "-o", f"{folder}/i"], ["filter", f"{folder}/i", f"{folder}/in.fastq", "-d", "-a", "3", "-r", "0.02", "-o", f"{folder}/out.fastq.xz", "-q"]):
        execute(spark, parser().parse_args(line))
    return fastx.read_fastx(spark, f"{folder}/out.fastq.xz").select("header")


@query(f"WITH {BENCH}, {PAGES}, u AS (SELECT kmer FROM a UNION SELECT kmer FROM b) SELECT (row_number() OVER (ORDER BY kmer))::VARCHAR AS header, kmer AS seq FROM u")
def command_union_dump(spark, d):
    folder = _folder(spark)
    for name, text in (("benchmark", "text"), ("pages", "html")):
        index_files.save(index(spark, d, name, text), f"{folder}/{name}")
    for line in (["index", "union", f"{folder}/benchmark", f"{folder}/pages", "-o", f"{folder}/u"], ["index", "dump", f"{folder}/u", "-o", f"{folder}/u.fa"]):
        execute(spark, parser().parse_args(line))
    return fastx.read_fastx(spark, f"{folder}/u.fa").select("header", "seq")


@query(f"WITH {sql.decisions(_deplete)} SELECT id AS record_no, (row_number() OVER (ORDER BY id))::VARCHAR AS header FROM dec WHERE keep")
def filter_stream_rename(spark, d):
    """Numbers of kept records go on from batch to batch."""
    out = _folder(spark)
    schema = table(spark, d, "documents").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/documents.parquet*")
    stream = stream.select(F.col("doc_id").alias("record_no"), F.lit("").alias("header"), dna(F.col("text")).alias("seq"))
    write = lambda batch, _: batch.select("record_no", "header").write.mode("append").parquet(f"{out}/rows")
    filter_stream(stream, index(spark, d), write, f"{out}/state", _deplete, rename_by=("record_no",)).awaitTermination()
    return spark.read.parquet(f"{out}/rows")
