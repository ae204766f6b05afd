"""FASTA/FASTQ as DataFrames: a Python data source, pairs, and writers with gzip, zstd and xz.

Each file is one task that numbers its records from 0. With `ordinals=False`, plain files are also
cut into byte ranges; record_no is then the byte offset of a record, which keeps order but doesn't
match mates.
"""

from __future__ import annotations

import glob
import gzip
import io
import lzma
import os
import shutil
import stat
import sys
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.sequence import format_record
from ..params import check_level
from ..scratch import scratch
from .parser import ChunkParser, Record

SCHEMA = "source string, record_no long, header string, seq string, qual string"
ARROW = pa.schema([("source", pa.string()), ("record_no", pa.int64()), ("header", pa.string()), ("seq", pa.string()), ("qual", pa.string())])
READ, BATCH = 1 << 20, 8 << 20
SPLIT = 128 << 20
#: Neighbouring ranges are read by one task, so that short ranges don't make a task each: tasks of a scan, up to TASK_BYTES a task.
TASKS, TASK_BYTES = 128, 32 << 20
#: Shorter files are taken for empty.
EMPTY_BYTES = 5
#: Standard input and pipes are copied to files of this ending, to which that rule does not apply.
SPOOLED = ".spooled.fastx"


def open_bytes(path: str, raw: bool = False):
    """A file for reading, decompressed by its magic bytes."""
    with open(path, "rb") as f:
        magic = f.read(6)
    if raw:
        return open(path, "rb")
    if magic[:2] == b"\x1f\x8b":
        return gzip.open(path, "rb")
    if magic[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True)
    if magic == b"\xfd7zXZ\x00":
        return lzma.open(path, "rb")
    return open(path, "rb")


class _Part(InputPartition):
    def __init__(self, path: str, start: int, end: int | None) -> None:
        super().__init__(None)
        self.path, self.start, self.end = path, start, end


def _resync(f, start: int, fastq: bool) -> int:
    """First record start at or behind a byte offset.

    A FASTQ line with @ starts a record if the second line behind it starts with +: a quality line
    is followed by a header and a sequence instead.
    """
    if start == 0:
        return 0
    f.seek(start - 1)
    f.readline()
    while True:
        at = f.tell()
        line = f.readline()
        if not line:
            return at
        if line[:1] == (b"@" if fastq else b">"):
            if not fastq:
                return at
            back = f.tell()
            f.readline()
            third = f.readline()
            f.seek(back)
            if third[:1] == b"+":
                return at


class FastxReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for given in options["path"].split(",") for p in (sorted(glob.glob(given)) or [given])]
        self.ordinals = str(options.get("ordinals", "true")).lower() != "false"
        self.split = int(options.get("split", SPLIT))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        sizes = {path: os.path.getsize(path) for path in self.paths}
        ranges = max(1, min(sum(sizes.values()) // TASKS, TASK_BYTES) // self.split)  # of one task
        step = ranges * self.split
        for path, size in sizes.items():
            with open(path, "rb") as f:
                plain = f.read(1) in (b">", b"@")
            if self.ordinals or not plain or size <= self.split:
                out.append(_Part(path, 0, None))
            else:
                out += [_Part(path, at, min(size, at + step)) for at in range(0, size, step)]
        return out

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, Record]] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part.path] * len(rows), pa.string()), pa.array([n for n, _ in rows], pa.int64()), *(pa.array([getattr(r, c) for _, r in rows], pa.string()) for c in ("header", "seq", "qual"))], schema=ARROW
            )

        for n, record in self._records(part):
            rows.append((n, record))
            held += len(record.seq)
            if held > BATCH or len(rows) >= 50_000:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()

    def _records(self, part: _Part) -> Iterator[tuple[int, Record]]:
        parser, n = ChunkParser(), 0
        with open_bytes(part.path, raw=part.end is not None) as f:
            if part.end is None:
                while data := f.read(READ):
                    for record in parser.push(data):
                        yield n, record
                        n += 1
            else:
                fastq = open(part.path, "rb").read(1) == b"@"
                start, end = _resync(f, part.start, fastq), _resync(f, part.end, fastq)
                f.seek(start)
                opened = start  # where the record that ends next began
                while f.tell() < end:
                    at, line = f.tell(), f.readline()
                    begins = (not parser.lines and line.strip()) if fastq else line[:1] == b">"
                    done = parser.push(line)
                    for record in done:
                        yield opened, record
                    if begins:
                        opened = at
                n = opened
            for record in parser.finish():
                yield n, record


class FastxSource(DataSource):
    """spark.read.format("fastx").load(path): records of FASTA and FASTQ files, plain or compressed."""

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FastxReader:
        return FastxReader(self.options)


def spooled(path: str | None) -> str:
    """A file that can be read twice: standard input (None or -), pipes and sockets are copied to one."""
    if path in (None, "-"):
        data = sys.stdin.buffer
    elif os.path.exists(path) and not stat.S_ISREG(os.stat(path).st_mode) and not os.path.isdir(path):
        data = open(path, "rb")
    else:
        return path
    with tempfile.NamedTemporaryFile("wb", suffix=SPOOLED, delete=False) as out:
        while piece := data.read(READ):
            out.write(piece)
    return out.name


def is_empty(path: str) -> bool:
    """Files under five bytes count as empty; so do compressed files with nothing in them."""
    if os.path.getsize(path) < (1 if path.endswith(SPOOLED) else EMPTY_BYTES):
        return True
    with open_bytes(path) as f:
        try:
            return not f.read(1)
        except (EOFError, lzma.LZMAError):
            return True


def check_paths(*paths: str | None) -> None:
    for path in paths:
        if path not in (None, "-") and not glob.glob(path):
            raise FileNotFoundError(f"no such input: {path}")


def read_fastx(spark: SparkSession, *paths: str, ordinals: bool = True, split: int = SPLIT) -> DataFrame:
    """(source, record_no, header, seq, qual) of files; qual is null for FASTA. Without ordinals, plain files are read in ranges of `split` bytes."""
    check_paths(*paths)
    full = [p for given in paths for p in glob.glob(given) if not is_empty(p)]
    if not full:
        return spark.createDataFrame([], SCHEMA)
    spark.dataSource.register(FastxSource)
    return spark.read.format("fastx").option("ordinals", str(ordinals).lower()).option("split", split).load(",".join(full))


PAIRED = ("header", "seq", "qual")


def read_paired(spark: SparkSession, first: str, second: str) -> DataFrame:
    """(pair_no, header1, seq1, qual1, header2, ...): mates of two files by position. Both or neither may be empty, and counts must agree."""
    check_paths(first, second)
    if is_empty(first) != is_empty(second):
        raise ValueError("one of two paired inputs is empty")
    a = read_fastx(spark, first).select(F.col("record_no").alias("pair_no"), *(F.col(c).alias(f"{c}1") for c in PAIRED), F.lit(True).alias("in1"))
    b = read_fastx(spark, second).select(F.col("record_no").alias("pair_no"), *(F.col(c).alias(f"{c}2") for c in PAIRED), F.lit(True).alias("in2"))
    both = a.join(b, "pair_no", "full")
    alone = F.when(F.col("in1").isNull() | F.col("in2").isNull(), F.raise_error(F.lit("paired inputs differ in their number of records")))
    return both.where(alone.isNull()).drop("in1", "in2")


def interleaved(records: DataFrame) -> DataFrame:
    """Pairs of consecutive records; an odd number of them is an error."""
    mate = F.col("record_no") % 2
    side = lambda n: [F.first(F.when(mate == n, F.struct(*PAIRED)), ignorenulls=True).alias(f"m{n}")]
    pairs = records.groupBy(F.floor(F.col("record_no") / 2).alias("pair_no")).agg(F.count("*").alias("n"), *side(0), *side(1))
    alone = F.when(F.col("n") != 2, F.raise_error(F.lit("interleaved input has an odd number of records")))
    return pairs.where(alone.isNull()).select("pair_no", *(F.col(f"m{n}.{c}").alias(f"{c}{n + 1}") for n in (0, 1) for c in PAIRED))


def codec_of(path: str) -> str | None:
    return {".gz": "gzip", ".zst": "zstd", ".xz": "xz"}.get(os.path.splitext(path)[1])


def open_writer(path: str, level: int | None = None):
    codec = codec_of(path)
    if codec and level is not None:
        check_level(codec, level)
    if codec == "gzip":
        return gzip.open(path, "wb", compresslevel=level or 2)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=level or 2).stream_writer(open(path, "wb"))
    if codec == "xz":
        return lzma.open(path, "wb", preset=2 if level is None else level)
    return open(path, "wb")


def _write_tasks(texts: DataFrame, folder: str, suffix: str, level: int | None, empty: bool) -> DataFrame:
    """(part, path) of the files that the tasks write, one a partition; where `empty` is false, none of partitions without rows."""

    def write(batches):
        from pyspark import TaskContext

        # a task that runs twice leaves one file, under its name only when whole
        part, out = TaskContext.get().partitionId(), None
        path = f"{folder}/part-{part:05d}"
        made = f"{path}.{TaskContext.get().taskAttemptId()}{suffix}"
        try:
            for batch in batches:
                if out is None and batch.num_rows:
                    out = open_writer(made, level)
                for text in batch.column(0).to_pylist():
                    out.write(text.encode() + b"\n")
            if out is None and empty:
                out = open_writer(made, level)
        finally:
            if out is not None:
                out.close()
        if out is not None:
            os.replace(made, path + suffix)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path + suffix])], names=["part", "path"])

    os.makedirs(folder, exist_ok=True)
    return texts.mapInArrow(write, "part int, path string")


def write_file(texts: DataFrame, path: str, level: int | None = None) -> None:
    """Texts (one column, in order) to one file.

    The tasks write a file a partition in the shared folder, and the driver joins their bytes: gzip members, zstd frames
    and xz streams may follow each other. Only where that folder is no mounted one do texts pass the driver, a partition
    at a time.
    """
    if (codec := codec_of(path)) and level is not None:
        check_level(codec, level)
    shared = scratch(texts.sparkSession).removeprefix("file:")
    mounted = "://" not in shared
    to_stdout = path == "-"
    if to_stdout:
        out = io.BufferedWriter(sys.stdout.buffer.raw if hasattr(sys.stdout.buffer, "raw") else sys.stdout.buffer)
    else:
        out = open(path, "wb") if mounted else open_writer(path, level)
    try:
        if not mounted:
            for row in texts.toLocalIterator():
                out.write(row[0].encode() + b"\n")
            return
        folder = f"{shared}/{uuid.uuid4().hex}"
        written = sorted(_write_tasks(texts, folder, os.path.splitext(path)[1] if codec else "", level, False).collect())
        for _, part in written:
            with open(part, "rb") as f:
                shutil.copyfileobj(f, out, BATCH)
            os.remove(part)
        if codec and not written:
            open_writer(path, level).close()
    finally:
        out.flush() if to_stdout else out.close()


def write_parts(texts: DataFrame, folder: str, codec: str | None = None, level: int | None = None) -> None:
    """Texts to a folder with one file a partition: plain and gzip by Spark's writer, zstd, xz and gzip of a given level by the tasks."""
    if codec is None or (codec == "gzip" and level is None):
        texts.write.mode("overwrite").option("compression", codec or "none").text(folder)
        return
    _write_tasks(texts, folder, {"gzip": ".gz", "zstd": ".zst", "xz": ".xz"}[codec], level, True).count()


def mates(pairs: DataFrame, fasta: bool = False) -> DataFrame:
    """Both mates' texts, first mate first, as rows of one column."""
    both = F.array(*(format_record(F.col(f"header{n}"), F.col(f"seq{n}"), F.col(f"qual{n}"), fasta) for n in (1, 2)))
    return pairs.select(F.explode(both).alias("value"))
