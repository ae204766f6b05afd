"""Exact removal of long repeated byte strings by bucket-pointer refinement.

A suffix array of the corpus is never built whole. The suffixes that start a *governed run* are
sampled by content: every window of `length` bytes is governed by the smallest q-gram hash in it,
so equal windows are governed at equal offsets. Level by level, buckets of suffixes are refined by
sorting on bucket identifiers that cover later offsets:

1. the q-gram bucket of a run, refined by the identifier of the whole run;
2. cells of `CELL` window starts, bucketed by what all their windows share and refined by all that
   any of them covers;
3. single windows.

At each level a suffix alone in its bucket is dropped, one that shares its refined identifier is
settled (all its windows occur elsewhere) and leaves one representative, and only the rest goes
down. Identifiers are pairs of 64-bit hashes of the bytes. Sorting is a range exchange on
(bucket, identifier, document, position), so a hot bucket and a hot identifier are cut over several
tasks and a task only compares neighbours: nothing is collected per bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, partitions, prepare, signed
from .kernels import BASE_INV, BYTE_CODE, U, mix, powers, span_hash, text_bytes

Q = 48
CELL = 16
#: Window starts handled at once; positions fit POS_BITS.
SEGMENT, POS_BITS = 1 << 19, 20
ROWS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("did", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("p", pa.int32())])
ROWS_SQL = "k1 long, k2 long, did long, th long, start int, n int, p int"


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, from block-wise running minima."""
    pad = np.full((-len(x)) % w, 2**64 - 1, U)
    blocks = np.concatenate([x, pad]).reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(x) - w + 1
    return np.minimum(right[:m], left[w - 1 : w - 1 + m])


def prefixes(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_CODE[data] * powers(0x9E3779B97F4A7C15, len(data))[: len(data)], out=out[1:])
    return out


def runs(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """First window, window count, anchor position, bucket and identifier of each governed run."""
    q = min(Q, max(1, length // 2))
    w = length - q + 1
    sums = prefixes(data)
    h = mix((sums[q:] - sums[:-q]) * powers(BASE_INV, len(data))[: len(data) - q + 1])
    starts, anchors = [], []
    low = U((1 << POS_BITS) - 1)
    for at in range(0, len(data) - length + 1, SEGMENT):
        part = h[at : at + SEGMENT + w - 1]
        lead = sliding_min((part & ~low) | np.arange(len(part), dtype=U), w)
        p = (lead & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        starts.append(first + at)
        anchors.append(p[first] + at)
    start, p = map(np.concatenate, (starts, anchors))
    # a run goes on over the cut of a segment: one place must not be met twice
    fresh = np.concatenate([[True], p[1:] != p[:-1]])
    start, p = start[fresh], p[fresh]
    count = np.diff(np.append(start, len(data) - length + 1))
    ident = span_hash(sums, start, start + count - 1 + length)
    ident = mix(ident + count.astype(U) * U(0x2545F4914F6CDD1D) + (p - start).astype(U))
    return start, count, p, h[p], ident


def _rows(parts: list[tuple]) -> pa.RecordBatch | None:
    """Batch of ROWS from (k1, k2, did, th, start, n, p) of each document."""
    parts = [x for x in parts if len(x[0])]
    if not parts:
        return None
    size = [len(x[0]) for x in parts]
    whole = lambda i: np.concatenate([x[i] for x in parts])
    one = lambda i: np.repeat(np.array([x[i] for x in parts], np.int64), size)
    return pa.RecordBatch.from_arrays([pa.array(signed(whole(0))), pa.array(signed(whole(1))), pa.array(one(2)), pa.array(one(3)), *(pa.array(whole(i).astype(np.int32)) for i in (4, 5, 6))], schema=ROWS)


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, int, int]]:
    data, off = text_bytes(batch.column("text"))
    off, did, th = off.tolist(), batch.column("did").to_pylist(), batch.column("th").to_pylist()
    for i in range(batch.num_rows):
        yield i, data[off[i] : off[i + 1]], did[i], th[i]


def _level1(length: int):
    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        parts = []
        for _, data, did, th in _documents(batch):
            if len(data) >= length:
                start, n, p, bucket, ident = runs(data, length)
                parts.append((bucket, ident, did, th, start, n, p))
        return _rows(parts)

    return kernel


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    column = batch.column(name)
    flat = column.flatten()
    return np.append(0, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))), {f.name: flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i, f in enumerate(flat.type)}


def _level2(length: int):
    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        at, todo = _lists(batch, "todo")
        parts = []
        for i, data, did, th in _documents(batch):
            s, n, p = (todo[k][at[i] : at[i + 1]] for k in ("start", "n", "p"))
            low, high = p - (s + n - 1), p - s
            count = high // CELL - low // CELL + 1
            row = np.repeat(np.arange(len(s)), count)
            cell = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + (low // CELL)[row]
            p, low, high = p[row], np.maximum(low[row], CELL * cell), np.minimum(high[row], CELL * cell + CELL - 1)
            first, last = p - CELL * cell - CELL + 1, p - CELL * cell
            sums = prefixes(data)
            core = mix(span_hash(sums, last, first + length) + cell.astype(U))
            inside = (first >= 0) & (last + length <= len(data))
            whole = span_hash(sums, np.maximum(first, 0), np.minimum(last + length, len(data)))
            alone = mix(mix(np.full(len(p), th, np.int64).view(U) + U(did & (2**64 - 1))) + (p * 1024 + cell).astype(U))
            parts.append((core, np.where(inside, whole, alone), did, th, p - high, high - low + 1, p))
        return _rows(parts)

    return kernel


def _level3(length: int):
    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        at, todo = _lists(batch, "todo")
        parts = []
        for i, data, did, th in _documents(batch):
            s, n = (todo[k][at[i] : at[i + 1]] for k in ("start", "n"))
            s = np.repeat(s, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            sums = prefixes(data)
            parts.append((span_hash(sums, s, s + length), span_hash(sums, s + length // 2, s + length), did, th, s, np.ones(len(s), np.int64), s))
        return _rows(parts)

    return kernel


FLAGGED = pa.schema([*ROWS, ("settled", pa.bool_()), ("open", pa.bool_())])
FLAGGED_SQL = f"{ROWS_SQL}, settled boolean, open boolean"


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """settled: a neighbour in the sorted rows has the same identifier. open: goes to the next level.

    The ends of a partition count as if their bucket went on, so a bucket or an identifier cut over
    tasks loses nothing: the rows on both sides of the cut stay open.
    """
    held: pa.RecordBatch | None = None
    before: tuple[int, int] | None = None

    def emit(table: pa.RecordBatch, last: bool):
        nonlocal before
        k1, k2 = (table.column(i).to_numpy() for i in (0, 1))
        n = len(k1) - (not last)
        if n == 0:
            return None
        bucket = np.ones(len(k1) + 1, bool)
        same = np.zeros(len(k1) + 1, bool)
        bucket[1:-1] = k1[1:] == k1[:-1]
        same[1:-1] = bucket[1:-1] & (k2[1:] == k2[:-1])
        if before is not None:
            bucket[0] = before[0] == k1[0]
            same[0] = bucket[0] and before[1] == k2[0]
        settled = same[:-1] | same[1:]
        edge = (bucket[:-1] & ~same[:-1]) | (bucket[1:] & ~same[1:])
        settled, edge = settled[:n], edge[:n]
        before = (k1[n - 1], k2[n - 1])
        keep = np.flatnonzero(settled | edge)
        if not len(keep):
            return None
        rows = table.take(pa.array(keep))
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(settled[keep]), pa.array(edge[keep])], schema=FLAGGED)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if (out := emit(table, False)) is not None:
            yield out
        held = table.slice(table.num_rows - 1)
    if held is not None and (out := emit(held, True)) is not None:
        yield out


def _refine(rows: DataFrame, parts: int, *salt: str) -> DataFrame:
    """With salt columns, rows of one identifier can be cut over tasks, whatever their number."""
    return rows.repartitionByRange(parts, "k1", "k2", *salt).sortWithinPartitions("k1", "k2").mapInArrow(_flag, FLAGGED_SQL)


def _cut(length: int):
    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, runs_ = _lists(batch, "runs")
        kept, spans, sizes = [], [], []
        for i, data, _, _ in _documents(batch):
            s, n = (runs_[k][at[i] : at[i + 1]] for k in ("start", "n"))
            sizes.append(len(data))
            if not len(s):
                kept.append(data.tobytes())
                spans.append([])
                continue
            step = np.zeros(len(data) + 1, np.int64)
            np.add.at(step, s, 1)
            np.add.at(step, s + n - 1 + length, -1)
            covered = np.concatenate([[False], np.cumsum(step[:-1]) > 0, [False]])
            edge = np.flatnonzero(covered[1:] != covered[:-1]).tolist()
            spans.append([{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2])])
            kept.append(data[~covered[1:-1]].tobytes())
        return pa.RecordBatch.from_arrays([batch.column("did"), pa.array(sizes, pa.int64()), pa.array(spans, CUT.field("spans").type), pa.array(kept, pa.binary())], schema=CUT)

    return kernel


CUT = pa.schema([("did", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
NO_ID = -(2**63)


def remove_repeats(documents: DataFrame, length: int = 200) -> DataFrame:
    """One row per row of documents (doc_id, text): doc_id, n_bytes, spans (removed byte runs, end exclusive), kept (binary).

    A byte goes if a string of `length` bytes covers it that also starts anywhere else, in the same
    document or another; overlapping occurrences count. Texts are UTF-8 bytes, a null or empty text
    has no spans, texts shorter than `length` stay whole. Rows repeated as a whole count as two
    documents, rows that share a doc_id with other texts too; null doc_ids are kept. Other columns
    are ignored.
    """
    spark = documents.sparkSession
    prepare(spark)
    parts = partitions(spark)
    docs = documents.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    keys = ["did", "th"]

    def with_rows(rows: DataFrame, name: str, fields: list[str], how: str) -> DataFrame:
        lists = rows.groupBy(*keys).agg(F.collect_list(F.struct(*fields)).alias(name))
        return docs.join(lists.hint("shuffle_hash"), keys, how)

    salt = ["did", "start"]
    one = _refine(arrow_map(docs, _level1(length), ROWS_SQL), parts, *salt)
    two = _refine(arrow_map(with_rows(one.where("open"), "todo", ["start", "n", "p"], "inner"), _level2(length), ROWS_SQL), parts, *salt)
    three = _refine(arrow_map(with_rows(two.where("open"), "todo", ["start", "n"], "inner"), _level3(length), ROWS_SQL), parts, *salt)
    # windows alone in their task: only the first and last rows of the tasks, met here without salt
    ends = _refine(three.where("open").select(*ROWS.names), parts)
    settled = [x.where("settled").select(*keys, "start", "n") for x in (one, two, three, ends)]
    runs_ = reduce(DataFrame.unionByName, settled)
    out = arrow_map(with_rows(runs_, "runs", ["start", "n"], "left"), _cut(length), "did long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
    return out.select(F.when(F.col("did") != NO_ID, F.col("did")).alias("doc_id"), "n_bytes", "spans", "kept")
