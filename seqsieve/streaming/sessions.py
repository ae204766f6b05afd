"""Structured Streaming, and sessions that take bytes in pieces.

Classification of a record needs no state, so a stream of records is a plain projection. The number
given to renamed records is the only thing that goes from batch to batch.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.classify import classify
from ..operators.filtering import counters, rename
from ..operators.frozen import FrozenIndex
from ..operators.index import MinimizerIndex
from ..params import FilterParams
from ..sources.parser import ChunkParser, FormatError, Record


def classify_stream(stream: DataFrame, index: MinimizerIndex, params: FilterParams | None = None, seqs: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Decisions on a stream of records (or pairs, one row each), without state; for indexes small enough to be sent to tasks."""
    return classify(stream, index, params, seqs)


def filter_stream(
    stream: DataFrame,
    index: MinimizerIndex | FrozenIndex,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    params: FilterParams | None = None,
    seqs: tuple[str, ...] = ("seq",),
    rename_by: tuple[str, ...] | None = None,
    **trigger,
) -> StreamingQuery:
    """Start a query that gives each micro-batch's kept records to `write(batch, batch_id)`; an index of any size or kind.

    rename_by: order of the records of a batch, which are then renamed by number. Numbers go on from
    batch to batch; what each batch ended with is kept beside the checkpoint, so a batch that runs
    again gets the same numbers.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        kept = classify(batch, index, params, seqs).where("keep")
        if rename_by:
            state = batch.sparkSession.read.schema("batch_id long, upto long")
            ends = f"{checkpoint}/renamed"
            before = 0
            if batch_id:
                before = state.parquet(f"{ends}/{batch_id - 1}").first()["upto"]
            kept = rename(kept, list(rename_by), pair=len(seqs) == 2, first=before)
            kept = kept.persist()
            upto = before + kept.count()
            batch.sparkSession.createDataFrame([(batch_id, upto)], "batch_id long, upto long").coalesce(1).write.mode("overwrite").parquet(f"{ends}/{batch_id}")
        write(kept, batch_id)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class FilterSession:
    """push(bytes) -> filtered bytes, finish() -> the rest, stats. Input and output may be gzip."""

    FIELDS = ("header", "seq", "qual")

    def __init__(self, spark: SparkSession, index: MinimizerIndex | FrozenIndex, params: FilterParams | None = None, rename: bool = False, output_fasta: bool = False, gzip_output: bool = False) -> None:
        self.spark, self.index, self.params = spark, index, params or FilterParams()
        self.rename, self.fasta = rename, output_fasta
        self.parser, self.kept, self.read = ChunkParser(), 0, 0
        self.stats = {"seqs_in": 0, "seqs_out": 0, "bp_in": 0, "bp_out": 0}
        self._unzip, self._first = None, True
        self._zip = zlib.compressobj(wbits=31) if gzip_output else None

    def _plain(self, data: bytes) -> bytes:
        if self._first and data:
            self._first = False
            if data[:1] == b"\x1f":
                self._unzip = zlib.decompressobj(wbits=31)
        if self._unzip is None:
            return data
        out = b""
        while data:  # members may follow each other
            out += self._unzip.decompress(data)
            data = self._unzip.unused_data
            if data:
                self._unzip = zlib.decompressobj(wbits=31)
        return out

    def _packed(self, data: bytes, last: bool = False) -> bytes:
        if self._zip is None:
            return data
        return self._zip.compress(data) + (self._zip.flush() if last else b"")

    def _filter(self, records: list[Record]) -> bytes:
        if not records:
            return b""
        rows = [(self.read + i, r.header, r.seq, r.qual) for i, r in enumerate(records)]
        self.read += len(rows)
        df = self.spark.createDataFrame(rows, "record_no long, header string, seq string, qual string")
        decided = classify(df, self.index, self.params).persist()
        for name, value in counters(decided).first().asDict().items():
            if name in self.stats:
                self.stats[name] += value
        out = []
        for row in decided.where("keep").sort("record_no").toLocalIterator():
            self.kept += 1
            out.append(_text(str(self.kept) if self.rename else row["header"], row["seq"], row["qual"], self.fasta))
        decided.unpersist()
        return "".join(out).encode()

    def push(self, data: bytes) -> bytes:
        return self._packed(self._filter(self.parser.push(self._plain(data))))

    def finish(self) -> bytes:
        return self._packed(self._filter(self.parser.finish()), True)


def _text(header: str, seq: str, qual: str | None, fasta: bool) -> str:
    return f">{header}\n{seq}\n" if fasta or qual is None else f"@{header}\n{seq}\n+\n{qual}\n"


class PairedFilterSession:
    """push1/push2 take either mate's bytes; each returns (bytes1, bytes2) of pairs complete so far."""

    def __init__(self, spark: SparkSession, index: MinimizerIndex | FrozenIndex, params: FilterParams | None = None, rename: bool = False, output_fasta: bool = False) -> None:
        self.spark, self.index, self.params = spark, index, params or FilterParams()
        self.rename, self.fasta = rename, output_fasta
        self.parsers, self.waiting = (ChunkParser(), ChunkParser()), ([], [])
        self.read = self.kept = 0
        self.stats = {"seqs_in": 0, "seqs_out": 0, "bp_in": 0, "bp_out": 0}

    def push1(self, data: bytes) -> tuple[bytes, bytes]:
        self.waiting[0].extend(self.parsers[0].push(data))
        return self._filter()

    def push2(self, data: bytes) -> tuple[bytes, bytes]:
        self.waiting[1].extend(self.parsers[1].push(data))
        return self._filter()

    def finish(self) -> tuple[bytes, bytes]:
        for queue, parser in zip(self.waiting, self.parsers):
            queue.extend(parser.finish())
        out = self._filter()
        if self.waiting[0] or self.waiting[1]:
            raise FormatError("paired inputs differ in their number of records")
        return out

    def _filter(self) -> tuple[bytes, bytes]:
        n = min(map(len, self.waiting))
        if not n:
            return b"", b""
        rows = [(self.read + i, a.header, a.seq, a.qual, b.header, b.seq, b.qual) for i, (a, b) in enumerate(zip(self.waiting[0][:n], self.waiting[1][:n]))]
        self.read += n
        for queue in self.waiting:
            del queue[:n]
        df = self.spark.createDataFrame(rows, "pair_no long, header1 string, seq1 string, qual1 string, header2 string, seq2 string, qual2 string")
        decided = classify(df, self.index, self.params, ("seq1", "seq2")).persist()
        for name, value in counters(decided, ("seq1", "seq2")).first().asDict().items():
            if name in self.stats:
                self.stats[name] += value
        out: tuple[list[str], list[str]] = ([], [])
        for row in decided.where("keep").sort("pair_no").toLocalIterator():
            self.kept += 1
            for n_, side in enumerate(out, 1):
                side.append(_text(f"{self.kept} /{n_}" if self.rename else row[f"header{n_}"], row[f"seq{n_}"], row[f"qual{n_}"], self.fasta))
        decided.unpersist()
        return "".join(out[0]).encode(), "".join(out[1]).encode()
