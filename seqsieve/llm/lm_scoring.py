"""Stupid-backoff scores of all documents under the n-gram counts of all documents.

Documents are first written as a table of blocks of about BLOCK bytes of text, packed, one row each; a
text is never cut. A block explodes its n-grams, counts them, and sends the distinct hashes to count
tables partitioned by hash: one packed, delta-coded list for a block and a partition, instead of a row
for each occurrence (a row costs about five times the bytes of its hash). A partition adds up what all
blocks sent and answers each list with the counts of the whole corpus, in the order it was asked. Back
in its block an n-gram meets its count, backoff is decided token by token, and logs are summed by
document.

With MIN_COUNT above 1, an n-gram of order 3 and more is only asked for if both n-grams one order below
it occur that often, without which it cannot either. A frequent n-gram costs one entry a block. Tasks
grow in number with the corpus, not in size: a task holds a block, or the lists of one partition, made for each PART bytes of text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, prepare, release
from .kernels import U, mix, text_bytes, word_hashes, words

ORDER, ALPHA, MIN_COUNT = 3, 0.4, 2
BLOCK = 8 << 20
#: Text for which one partition of the count tables is made.
PART = 16 << 20
#: Bits of an n-gram's hash. Of n distinct n-grams of one order, about n * n / 2**(WIDTH + 1) pairs share a count.
WIDTH = 56
_C = U(0x9DDFEA08EB382D69)

ASKED = pa.schema([("part", pa.int64()), ("k", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])
ASKED_SQL = "part long, k int, block long, hashes binary, counts binary"
TOLD = pa.schema([("block", pa.int64()), ("k", pa.int32()), ("part", pa.int64()), ("counts", pa.binary())])
TOLD_SQL = "block long, k int, part long, counts binary"
SCORED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("logprob", pa.float64())])


def _packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(kind).ravel()


BLOCKS = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("named", pa.binary()), ("ends", pa.binary()), ("texts", pa.binary()), ("n_bytes", pa.int64()), ("n_words", pa.int64())])
BLOCKS_SQL = "block long, ids binary, named binary, ends binary, texts binary, n_bytes long, n_words long"


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of this task's rows: ids and whether they are not null, ends of texts, and all bytes."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 33
    held: list[tuple] = []
    size = 0

    def close() -> pa.RecordBatch:
        nonlocal number
        data = np.concatenate([h[3] for h in held])
        ends = np.cumsum(np.concatenate([np.diff(h[2]) for h in held]))
        n_words = len(words(data, np.append(0, ends))[0])
        number += 1
        row = [number, np.concatenate([h[0] for h in held]).tobytes(), np.concatenate([h[1] for h in held]).tobytes(), zstandard.compress(ends.tobytes(), 1), zstandard.compress(data.tobytes(), 9), len(data), n_words]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, BLOCKS)], schema=BLOCKS)

    for batch in batches:
        data, off = text_bytes(batch.column("text"))
        ids = batch.column("doc_id")
        named, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        at = 0
        while at < batch.num_rows:
            to = min(batch.num_rows, max(at + 1, int(np.searchsorted(off, off[at] + BLOCK - size, "right")) - 1))
            if held and size + int(off[to] - off[at]) > BLOCK:
                yield close()
                held, size = [], 0
                continue
            held.append((ids[at:to], named[at:to], off[at : to + 1], data[off[at] : off[to]].copy()))
            size += int(off[to] - off[at])
            at = to
    if held:
        yield close()
    release()


class _Block:
    """N-grams of a block's documents; `known` fills with corpus counts by order."""

    def __init__(self, row: dict, parts: int, min_count: int) -> None:
        self.number, self.parts, self.least = row["block"], parts, min_count
        self.ids, self.named = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["named"], bool)
        data = np.frombuffer(zstandard.decompress(row["texts"]), np.uint8)
        starts, ends, rows = words(data, np.append(0, np.frombuffer(zstandard.decompress(row["ends"]), np.int64)))
        self.rows = rows
        self.word = word_hashes(data, starts, ends)
        self.pos = np.arange(len(starts)) - np.repeat(rows[:-1], np.diff(rows))
        self.hashes = {1: self.word}
        self.known: dict[int, np.ndarray] = {}

    def hash(self, k: int) -> np.ndarray:
        """Of the k-gram that ends at each word; junk where one would cross the document's start."""
        if k not in self.hashes:
            below = self.hash(k - 1)
            last = np.concatenate([np.zeros(1, U), below[:-1]]) if len(below) else below
            self.hashes[k] = mix(last * _C + self.word + U(k))
        return self.hashes[k]

    def viable(self, k: int) -> np.ndarray:
        """Words at which a k-gram can end that is worth asking for."""
        ok = self.pos >= k - 1
        if k > 2:
            enough = self.known[k - 1] >= self.least
            ok &= enough
            ok[1:] &= enough[:-1]
        return np.flatnonzero(ok)

    def lists(self, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(part, distinct hashes in order, counts) for each part with any."""
        at = self.viable(k)
        value, which, count = np.unique(self.hash(k)[at] >> U(64 - WIDTH), return_inverse=True, return_counts=True)
        part = (value % U(self.parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.order = at, place[which]
        edge = np.flatnonzero(np.concatenate([[True], part[order][1:] != part[order][:-1]])) if len(order) else order
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(order)]):
            own = order[a:b]
            yield int(part[own[0]]), value[own], count[own]

    def asked(self, k: int) -> list[tuple]:
        # of a hash, its partition is the remainder: the quotient is all that has to travel
        return [(part, k, self.number, _packed(np.diff(value // U(self.parts), prepend=U(0))), _packed(count.astype(np.uint32))) for part, value, count in self.lists(k)]

    def told(self, k: int, answers: dict[int, bytes]) -> None:
        flat = []
        for part, value, _ in self.lists(k):
            got = _unpacked(answers[part], np.int64)
            if len(got) != len(value):
                raise ValueError("an answer does not fit its block")
            flat.append(got)
        at, place = self.order
        self.known[k] = np.zeros(len(self.word), np.int64)
        if flat:
            self.known[k][at] = np.concatenate(flat)[place]

    def scores(self, order: int, total: int) -> np.ndarray:
        """Log score of each word."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.log(self.known[1] / total)
            for k in range(2, order + 1):
                count, below = self.known[k], np.concatenate([[1], self.known[k - 1][:-1]]) if len(out) else self.known[k]
                full = np.where(count >= max(1, self.least), np.log(count / below), math.log(ALPHA) + out)
                out = np.where(self.pos >= k - 1, full, out)
        return out


def _filled(block: _Block, right: pa.Table | None, upto: int) -> _Block:
    answers: dict[int, dict[int, bytes]] = {}
    for k, part, counts in zip(*(right.column(c).to_pylist() for c in ("k", "part", "counts"))) if right is not None else ():
        answers.setdefault(k, {})[part] = counts
    for k in range(1, upto + 1):
        block.told(k, answers.get(k, {}))
    return block


def _asked_table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), ASKED)], schema=ASKED) if rows else ASKED.empty_table()


def _answer(min_count: int):
    def answer(table: pa.Table) -> pa.Table:
        """Corpus counts for one partition of the tables: what each block asked for, in its order."""
        release()
        asked = [np.cumsum(_unpacked(x, np.uint64), dtype=np.uint64) for x in table.column("hashes").to_pylist()]
        counts = [_unpacked(x, np.uint32) for x in table.column("counts").to_pylist()]
        _, which = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(which, np.concatenate(counts)).astype(np.int64)
        k = table.column("k")[0].as_py()
        if k > 1:
            total[total < min_count] = 0
        ends = np.cumsum([len(x) for x in asked])
        told = [_packed(np.ascontiguousarray(total[which[b - len(x) : b]])) for x, b in zip(asked, ends)]
        return pa.Table.from_arrays([table.column("block").combine_chunks(), table.column("k").combine_chunks(), table.column("part").combine_chunks(), pa.array(told, pa.binary())], schema=TOLD)

    return answer


def backoff_scores(documents: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT) -> DataFrame:
    """doc_id, n_words, logprob for every row of documents (doc_id, text).

    Words are runs of bytes other than the six ASCII spaces, with A-Z lower-cased. A word scores
    log(c(ngram) / c(context)) for the longest n-gram of up to `order` words within the document
    that occurs `min_count` times in the corpus (1: every n-gram counts), plus log(ALPHA) for each
    longer one that doesn't, and log(c(word) / N) at last; logprob is the sum. A null text, or one
    without words, has 0 words and logprob 0. Repeated rows count each time and score alike; null ids
    are kept; a text of any length is scored as a whole; other columns are ignored; an empty table
    gives an empty table.
    """
    spark = documents.sparkSession
    prepare(spark)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # written once: blocks hold the same rows wherever they are read again
    blocks = materialize(rows.mapInArrow(_gather, BLOCKS_SQL))
    n_bytes, total = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    parts = max(partitions(spark), -(-n_bytes // PART))
    tasks = max(partitions(spark), -(-n_bytes // (4 * PART)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                release()
                block = _Block(row, parts, min_count)
                for k in (1, 2)[:order]:
                    yield from _asked_table(block.asked(k)).to_batches()
        release()

    def ask_more(k: int):
        def ask(left: pa.Table, right: pa.Table) -> pa.Table:
            release()
            return _asked_table([x for row in left.to_pylist() for x in _filled(_Block(row, parts, min_count), right, k - 1).asked(k)])

        return ask

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        release()
        if not left.num_rows:
            return SCORED.empty_table()
        block = _filled(_Block(left.to_pylist()[0], parts, min_count), right, order)
        per_doc = np.add.reduceat(np.append(block.scores(order, total), 0.0), np.minimum(block.rows[:-1], len(block.word)))
        n = np.diff(block.rows)
        return pa.Table.from_arrays([pa.array(block.ids, mask=~block.named), pa.array(n, pa.int64()), pa.array(np.where(n > 0, per_doc, 0.0))], schema=SCORED)

    count = lambda asked: asked.repartition(tasks, "part", "k").groupBy("part", "k").applyInArrow(_answer(min_count), TOLD_SQL)
    packed = blocks.select("block", "ids", "named", "ends", "texts").repartition(tasks, "block")
    told = count(blocks.drop("n_bytes", "n_words").mapInArrow(each, ASKED_SQL))
    for k in range(3, order + 1):
        more = packed.groupBy("block").cogroup(told.repartition(tasks, "block").groupBy("block")).applyInArrow(ask_more(k), ASKED_SQL)
        told = told.unionByName(count(more))
    return packed.groupBy("block").cogroup(told.repartition(tasks, "block").groupBy("block")).applyInArrow(score, "doc_id long, n_words long, logprob double")
