"""Minimizer indexes: one distinct column `kmer` and a header, and set algebra on them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import complexity, unpack
from ..params import FORMAT_VERSION, KmerParams
from .minimizers import arrow_minimizers


#: K-mers in an index that other k-mers are matched against in the tasks, before they travel.
SMALL_KMERS = 1_000_000


class FrozenIndexError(ValueError):
    """The operation needs an exact index."""


@dataclass(frozen=True)
class MinimizerIndex:
    """kmers: distinct canonical k-mers, packed long for k <= 31, else string."""

    kmers: DataFrame
    params: KmerParams
    version: int = FORMAT_VERSION

    def count(self) -> int:
        return self.kmers.count()

    def spelled(self) -> Column:
        return spelled(self.params)

    def cache(self) -> MinimizerIndex:
        return MinimizerIndex(self.kmers.cache(), self.params, self.version)


def spelled(params: KmerParams) -> Column:
    """The k-mer column as bases."""
    return unpack(F.col("kmer"), params.k) if params.packed else F.col("kmer")


def _exact(*indexes) -> None:
    for index in indexes:
        if not isinstance(index, MinimizerIndex):
            raise FrozenIndexError("a frozen index supports membership and info only")


def build_stats(records: DataFrame, seq: str = "seq") -> DataFrame:
    """One row: records and bp that an index is built from."""
    return records.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.length(seq)), F.lit(0)).cast("long").alias("bp"))


def steps(indexes: list[MinimizerIndex], what: str = "union") -> DataFrame:
    """step, size, total: what each input of a union adds, or what an intersection retains after it, in one aggregation.

    A k-mer is known by the first input that holds it, and by the first one from 1 on that doesn't.
    """
    _same(indexes, 1, what)
    n = len(indexes)
    tagged = reduce(DataFrame.unionByName, [i.kmers.select("kmer", F.lit(nth).alias("nth")) for nth, i in enumerate(indexes, 1)])
    held = tagged.groupBy("kmer").agg(F.min("nth").alias("first"), F.array_sort(F.collect_set("nth")).alias("all"))
    last = F.aggregate("all", F.lit(0), lambda acc, x: F.when(x == acc + 1, x).otherwise(acc))  # holds without a gap up to here
    per = held.groupBy((F.col("first") if what == "union" else last).cast("int").alias("step")).agg(F.count("*").alias("n"))
    all_ = indexes[0].kmers.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("step"))
    counted = F.broadcast(per).withColumnRenamed("step", "at")
    joined = all_.join(counted, F.col("at") <= F.col("step") if what == "union" else F.col("at") >= F.col("step"), "left")
    own = F.coalesce(F.sum(F.when(F.col("at") == F.col("step"), F.col("n"))), F.lit(0)) if what == "union" else F.coalesce(F.sum("n"), F.lit(0))
    return joined.groupBy("step").agg(own.alias("size"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def build(records: DataFrame, params: KmerParams | None = None, seq: str = "seq") -> MinimizerIndex:
    """Distinct minimizers of all records: partial, then final aggregation around one shuffle."""
    params = params or KmerParams()
    rows = records.select(F.lit(0).alias("record_no"), seq)
    return MinimizerIndex(arrow_minimizers(rows, params, seq).select("kmer").distinct(), params)


def _same(indexes: list[MinimizerIndex], least: int, what: str) -> None:
    _exact(*indexes)
    if len(indexes) < least:
        raise ValueError(f"{what} takes at least {least} index(es)")
    for other in indexes[1:]:
        if other.params != indexes[0].params:
            raise ValueError(f"{what} needs equal k and w, got {indexes[0].params} and {other.params}")


def union(*indexes: MinimizerIndex) -> MinimizerIndex:
    """All k-mers; one aggregation over all inputs."""
    _same(list(indexes), 1, "union")
    return MinimizerIndex(reduce(DataFrame.unionByName, [i.kmers for i in indexes]).distinct(), indexes[0].params)


def intersect(*indexes: MinimizerIndex) -> MinimizerIndex:
    """K-mers that all inputs hold. Inputs are distinct, so counting inputs needs one shuffle for any number of them."""
    _same(list(indexes), 2, "intersection")
    tagged = [i.kmers.select("kmer", F.lit(1).alias("one")) for i in indexes]
    counted = reduce(DataFrame.unionByName, tagged).groupBy("kmer").agg(F.sum("one").alias("n"))
    return MinimizerIndex(counted.where(F.col("n") == len(indexes)).select("kmer"), indexes[0].params)


def subtract(first: MinimizerIndex, second: MinimizerIndex) -> MinimizerIndex:
    """first without second; w of second must be equal, or 1 to mask every k-mer. The header of first stays."""
    _exact(first, second)
    if first.params.k != second.params.k:
        raise ValueError(f"difference needs equal k, got {first.params.k} and {second.params.k}")
    if second.params.w not in (1, first.params.w):
        raise ValueError(f"difference needs equal w, or 1 for the second index, got {first.params.w} and {second.params.w}")
    other = second.kmers
    if first.kmers.limit(SMALL_KMERS + 1).count() <= SMALL_KMERS:
        # of the second only what the first holds is of use; this filter also passes below the second's own distinct
        other = other.join(F.broadcast(first.kmers), "kmer", "left_semi")
    return MinimizerIndex(first.kmers.join(other, "kmer", "left_anti"), first.params, first.version)


def subtract_records(first: MinimizerIndex, records: DataFrame, k: int | None = None, w: int | None = None, seq: str = "seq") -> MinimizerIndex:
    """first without the minimizers of records; k and w count only if both are given, else those of first hold."""
    _exact(first)
    params = KmerParams(k, w) if k is not None and w is not None else first.params
    other = MinimizerIndex(arrow_minimizers(records.select(F.lit(0).alias("record_no"), seq), params, seq).select("kmer"), params)
    return subtract(first, other)


def _codes(batch: pa.RecordBatch, params: KmerParams) -> np.ndarray:
    """Bases of every k-mer of a batch as 0..3."""
    k, column = params.k, batch.column("kmer")
    if params.packed:
        return ((column.to_numpy()[:, None] >> np.arange(2 * (k - 1), -1, -2, dtype=np.int64)) & 3).astype(np.uint8)
    text = np.frombuffer("".join(column.to_pylist()).encode(), np.uint8).reshape(-1, k)
    return np.searchsorted(np.frombuffer(b"ACGT", np.uint8), text).astype(np.uint8)


def _kdust(code: np.ndarray) -> np.ndarray:
    """As functions.kdust; equal triplets are neighbours after sorting."""
    k = code.shape[1]
    triplets = code[:, :-2] * 16 + code[:, 1:-1] * 4 + code[:, 2:]
    triplets.sort(axis=1)
    run, pairs = np.zeros(len(triplets), np.int32), np.zeros(len(triplets), np.int64)
    for i in range(1, triplets.shape[1]):  # a run of length c adds 0 + 1 + .. + c-1
        run = np.where(triplets[:, i] == triplets[:, i - 1], run + 1, 0)
        pairs += run
    return (1 - pairs / ((k - 2) * (k - 3) / 2)).astype(np.float32)


def _shannon(code: np.ndarray) -> np.ndarray:
    """As functions.shannon, of bases that are all A, C, G or T."""
    share = np.stack([(code == b).sum(1) for b in range(4)]) / code.shape[1]
    bits = (share * np.log2(np.where(share > 0, share, 1.0))).sum(0)
    return (np.abs(bits) / 2).astype(np.float32)


def scored(index: MinimizerIndex, algorithm: str = "kdust") -> DataFrame:
    """kmer, value: every k-mer with its complexity (float)."""
    _exact(index)
    params = index.params
    if algorithm not in ("kdust", "shannon") or params.k <= 3 or (algorithm == "shannon" and params.k < 10):
        return index.kmers.select("kmer", complexity(F.lit(""), params.k, algorithm).alias("value"))  # a constant, or an error
    kernel = _kdust if algorithm == "kdust" else _shannon

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("kmer"), pa.array(kernel(_codes(batch, params)), pa.float32())], names=["kmer", "value"])

    return index.kmers.select("kmer").mapInArrow(run, f"kmer {'long' if params.packed else 'string'}, value float")


def retain_complexity(index: MinimizerIndex, threshold: float, algorithm: str = "kdust", invert: bool = False) -> MinimizerIndex:
    """K-mers of complexity at or above the threshold, or below it; compared as float, so both parts add up to the whole."""
    value, limit = F.col("value"), F.lit(threshold).cast("float")
    return MinimizerIndex(scored(index, algorithm).where(value < limit if invert else value >= limit).select("kmer"), index.params, index.version)


def dump(index: MinimizerIndex) -> DataFrame:
    """(n, kmer): bases of all k-mers, numbered from 1 in order.

    Numbers come from a range exchange and the counts of its partitions, so no single task sees all rows.
    """
    _exact(index)
    return number_rows(index.kmers.select(spelled(index.params).alias("kmer")), ["kmer"], "n").select("n", "kmer")


def number_rows(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their 1-based position in the given total order, without a global window.

    Rows are dealt by range; a partition's first number is one more than the sizes of those before
    it (one row a partition on the driver).
    """
    from pyspark.sql.window import Window

    # sampling for the ranges would evaluate rows once more
    rows = rows.persist(StorageLevel.DISK_ONLY)
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part_", F.spark_partition_id())
    ranged = ranged.persist(StorageLevel.DISK_ONLY)
    sizes = {r["part_"]: r["count"] for r in ranged.groupBy("part_").count().collect()}
    rows.unpersist()
    first, offsets = 0, []
    for part in sorted(sizes):
        offsets.append((part, first))
        first += sizes[part]
    lookup = F.create_map(*[F.lit(x) for pair in offsets for x in pair]) if offsets else F.create_map(F.lit(0), F.lit(0))
    within = F.row_number().over(Window.partitionBy("part_").orderBy(*order))
    return ranged.withColumn(name, (F.element_at(lookup, F.col("part_")) + within).cast("long")).drop("part_")


def info(index) -> DataFrame:
    """One row: kind, format_version, k, w, count."""
    if isinstance(index, MinimizerIndex):
        kind = "exact-u64" if index.params.k <= 32 else "exact-u128"
        rows, params = index.kmers, index.params
        count = F.count("*")
    else:
        kind, rows, params = "bff", index.table, index.params
        count = F.lit(index.key_count)
    return rows.agg(F.count("*").alias("rows_")).select(F.lit(kind).alias("kind"), F.lit(index.version).alias("format_version"), F.lit(params.k).alias("k"), F.lit(params.w).alias("w"), (F.col("rows_") if kind != "bff" else count).cast("long").alias("count"))
