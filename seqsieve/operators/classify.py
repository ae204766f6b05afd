"""Classification of records by the distinct index minimizers they hold.

Small indexes of any kind (their size is counted) travel to the tasks as sorted arrays: a task finds hits
while it selects minimizers, one row a record comes back, and nothing is shuffled. Larger ones are joined on
the distinct k-mers of each record, which travel as longs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import pack, unpack
from ..params import FilterParams
from .frozen import FrozenIndex, slots
from .index import MinimizerIndex
from .minimizers import chunks, classified, column_bytes, select, spell_words, words_at

#: Longs in an index that is sent to every task: one a k-mer, two where it is frozen or over 31 bases.
BROADCAST_KMERS = 8_000_000


def required(total: Column, params: FilterParams) -> Column:
    """Hits that make a match: the absolute threshold, or the rounded share of all minimizers (half up, at least 1)."""
    share = F.when(total > 0, F.greatest(F.lit(1.0), F.round(F.lit(float(params.rel_threshold)) * total))).otherwise(0.0)
    return F.greatest(F.lit(int(params.abs_threshold)), share.cast("long")).cast("long")


def keep(hits: Column, total: Column, params: FilterParams) -> Column:
    """Search keeps matches, depletion all others; without minimizers a record is kept by depletion only."""
    match = hits >= required(total, params)
    return F.when(total == 0, F.lit(params.deplete)).otherwise(~match if params.deplete else match)


class _Keys:
    """Membership in a set of one or two longs each."""

    def __init__(self, words: list[np.ndarray]) -> None:
        self.levels = [np.unique(w) for w in words] if len(words) > 1 else []
        self.sorted = np.sort(self._code(words)[0] if self.levels else words[0])

    def _code(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Both ranks as one number, and whether both words are known."""
        code, known = np.zeros(len(words[0]), np.int64), np.ones(len(words[0]), bool)
        for level, word in zip(self.levels, words):
            rank = np.minimum(np.searchsorted(level, word), len(level) - 1)
            known &= level[rank] == word
            code = code * len(level) + rank
        return code, known

    def has(self, words: list[np.ndarray]) -> np.ndarray:
        if not len(self.sorted):
            return np.zeros(len(words[0]), bool)
        value, known = self._code(words) if self.levels else (words[0], True)
        return known & (self.sorted[np.minimum(np.searchsorted(self.sorted, value), len(self.sorted) - 1)] == value)


def _key_columns(index: MinimizerIndex | FrozenIndex) -> list[Column]:
    """The longs that an index knows a k-mer by."""
    if isinstance(index, FrozenIndex):
        return [F.col("bucket").alias("j0_"), F.col("fp").alias("j1_")]
    if index.params.packed:
        return [F.col("kmer").alias("j0_")]
    return [pack(F.col("kmer").substr(1, 31)).alias("j0_"), pack(F.col("kmer").substr(32, index.params.k - 31)).alias("j1_")]


def _asked(index: MinimizerIndex | FrozenIndex):
    """A function of packed k-mers to the longs that an index knows them by; each distinct one is hashed once."""
    if not isinstance(index, FrozenIndex):
        return lambda words: words
    key_count, bits, k = index.key_count, index.bits, index.params.k

    def hashed(words: list[np.ndarray]) -> list[np.ndarray]:
        order = np.lexsort(words[::-1])
        new = np.ones(len(order), bool)
        new[1:] = np.any([w[order[1:]] != w[order[:-1]] for w in words], axis=0)
        nth = np.empty(len(order), np.int64)
        nth[order] = np.cumsum(new) - 1
        return [x[nth] for x in slots(spell_words([w[order[new]] for w in words], k), key_count, bits)]

    return hashed


def _minimizers(part: pa.RecordBatch, looked: list[str], params) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Number of minimizers of each record; record, packed k-mer and place (mate, then position) of each minimizer."""
    total, records, words, places = np.zeros(part.num_rows, np.int64), [], [], []
    for nth, c in enumerate(looked):
        data, off = column_bytes(part.column(c))
        record, at = select(data, off, params)
        total += np.bincount(record, minlength=part.num_rows)
        records.append(record)
        words.append(words_at(data, at, params.k))
        places.append(at - off[record] + (nth << 40))
    return total, np.concatenate(records), [np.concatenate(w) for w in zip(*words)], np.concatenate(places)


def _distinct(record: np.ndarray, words: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """Rows of the first place of each k-mer of each record, by record and place."""
    order = np.lexsort((at, *words[::-1], record))
    first = np.ones(len(order), bool)
    first[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in (record, *words)], axis=0)
    order = order[first]
    return order[np.lexsort((at[order], record[order]))]


def _hits_in_tasks(records: DataFrame, index: MinimizerIndex | FrozenIndex, looked: list[str], keys: _Keys, names: bool) -> DataFrame:
    params, asked = index.params, _asked(index)
    shared = records.sparkSession.sparkContext.broadcast(keys)
    columns = [c for c in records.columns if c not in looked]
    schema = ", ".join([*(f"`{records.schema[c].name}` {records.schema[c].dataType.simpleString()}" for c in columns), "total_minimizers long", "hit_count long", *["hit_kmers array<string>"] * names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        for batch in batches:
            for part in chunks(batch, looked):
                total, record, words, at = _minimizers(part, looked, params)
                hit = keys.has(asked(words))
                record, words, at = record[hit], [w[hit] for w in words], at[hit]
                rows = _distinct(record, words, at)
                hits = np.bincount(record[rows], minlength=part.num_rows).astype(np.int64)
                out = [*(part.column(c) for c in columns), pa.array(total), pa.array(hits)]
                if names:
                    text = [x.decode() for x in spell_words([w[rows] for w in words], params.k)]
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(hits)), pa.int32()), pa.array(text, pa.string())))
                yield pa.RecordBatch.from_arrays(out, names=[*columns, "total_minimizers", "hit_count", *["hit_kmers"] * names])

    return records.mapInArrow(run, schema)


def _hits_by_join(records: DataFrame, index: MinimizerIndex | FrozenIndex, looked: list[str], names: bool) -> DataFrame:
    """A decision depends on the sequences alone, so records are known by a digest of them: ids may repeat or be null.

    A task sends the distinct k-mers of each record and, in one more row, their number with repeats. Such a row has
    no k-mer and travels by the digest; only it and hits go on from the join.
    """
    params, asked = index.params, _asked(index)
    frozen, n_words = isinstance(index, FrozenIndex), 1 if params.packed else 2
    length = [F.length(c).cast("string") for c in looked]
    keyed = records.withColumn("digest_", F.sha2(F.concat_ws(":", *length, *looked), 256))
    ids = ["d0_", "d1_"]  # 120 bits of it
    keyed = keyed.withColumns({c: F.conv(F.substring("digest_", at, 15), 16, 10).cast("long") for c, at in zip(ids, (1, 17))}).drop("digest_")
    words = [f"w{i}_" for i in range(n_words)]
    keys = ["k0_", "k1_"] if frozen else words
    fields = [*ids, "total_", *words, *(keys if frozen else []), *["at_"] * names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, looked):
                total, record, kmer, at = _minimizers(part, looked, params)
                rows = _distinct(record, kmer, at)
                record, kmer, at = record[rows], [w[rows] for w in kmer], at[rows]
                own = [part.column(c).to_numpy(zero_copy_only=False) for c in ids]
                sent = [*kmer, *(asked(kmer) if frozen else [])]
                ends = [own[i % 2] for i in range(len(kmer))] + (own if frozen else [])
                none = np.ones(len(record), bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(np.concatenate([d[record], d])) for d in own),
                        pa.array(np.concatenate([np.zeros(len(record), np.int64), total]), mask=np.concatenate([none, np.zeros(len(total), bool)])),
                        *(pa.array(np.concatenate([a, b])) for a, b in zip(sent, ends)),
                        *[pa.array(np.concatenate([at, np.zeros(len(total), np.int64)]))] * names,
                    ],
                    names=fields,
                )

    rows = keyed.select(*ids, *looked).mapInArrow(run, ", ".join(f"{c} long" for c in fields))
    table = (index.table if frozen else index.kmers).select(*_key_columns(index), F.lit(True).alias("hit_"))
    same = F.col("total_").isNull()
    for nth, c in enumerate(keys):
        same &= F.col(c) == F.col(f"j{nth}_")
    met = rows.join(table, same, "left").where("hit_ or total_ is not null")
    kmer = F.when(F.col("hit_"), F.struct(*words))
    sums = [F.max("total_").alias("total_minimizers"), F.count_distinct(kmer).alias("hit_count")]
    if names:
        sums.append(F.array_sort(F.collect_set(F.when(F.col("hit_"), F.struct("at_", *words)))).alias("found_"))
    counted = met.groupBy(*ids).agg(*sums)
    if names:
        sizes = [params.k] if params.packed else [31, params.k - 31]
        counted = counted.withColumn("hit_kmers", F.transform("found_", lambda x: F.concat(*(unpack(x[w], n) for w, n in zip(words, sizes))))).drop("found_")
    return keyed.drop(*looked).join(counted, ids).drop(*ids)


def classify(
    records: DataFrame,
    index: MinimizerIndex | FrozenIndex,
    params: FilterParams | None = None,
    seqs: tuple[str, ...] = ("seq",),
    names: bool = False,
    broadcast_kmers: int = BROADCAST_KMERS,
) -> DataFrame:
    """records with total_minimizers (repeats count), hit_count (distinct, pooled over seqs), keep, and hit_kmers on request.

    seqs names one sequence column, or two for pairs: both mates get one decision, and a mate
    shorter than a k-mer counts nothing. Decisions do not depend on the size or kind of index used to
    find hits, nor on other columns: records may repeat.
    """
    params = params or FilterParams()
    looked = [f"look_{i}_" for i in range(len(seqs))]
    records = records.withColumns({name: classified(F.coalesce(F.col(c), F.lit("")), params.prefix_length) for name, c in zip(looked, seqs)})
    small, columns = None, _key_columns(index)
    if broadcast_kmers:
        # reads one row more than the limit at most, so an index of any size costs the driver a bounded array
        most = broadcast_kmers // len(columns)
        got = (index.table if isinstance(index, FrozenIndex) else index.kmers).select(*columns).limit(most + 1).toArrow()
        small = _Keys([got.column(i).to_numpy() for i in range(len(columns))]) if got.num_rows <= most else None
    if small is not None:
        out = _hits_in_tasks(records, index, looked, small, names)
    elif records.isStreaming:
        raise ValueError("this index has to be joined: classify micro-batches, as streaming.filter_stream does")
    else:
        out = _hits_by_join(records, index, looked, names)
    return out.withColumn("keep", keep(F.col("hit_count"), F.col("total_minimizers"), params))
