"""Minimizer selection: the sliding-window argmin over canonical k-mer hashes.

Two engines give the same rows (id, pos, kmer):

* `arrow_minimizers`: NumPy over whole Arrow batches, all records at once; the default.
* `sql_minimizers`: built-in expressions only, arrays over pieces of records.

A window is w consecutive k-mers without an ambiguous base. Its minimizer has the smallest hash;
equal hashes go to the leftmost k-mer if most of the window's bases are G or T, else to the
rightmost, so both strands choose the same k-mers. Consecutive windows with one choice give one
row; choices that come back later are rows of their own. The k-mer is the smaller strand.

The hash is a rolling XOR of rotated base codes, added for both strands modulo 2**32. Rotations
distribute over XOR, so all k-mer hashes are differences of one running XOR over the sequence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import KmerParams

CODE = {"A": 0x95C60474, "C": 0x62A02B4C, "T": 0x82572324, "G": 0x4BE24456}
PAIR = {"A": "T", "C": "G", "G": "C", "T": "A"}
M32 = 0xFFFFFFFF

_FWD, _REV = np.zeros(256, np.uint32), np.zeros(256, np.uint32)
_BASE, _AMBIGUOUS, _GT = np.zeros(256, np.uint64), np.ones(256, np.uint8), np.zeros(256, np.uint8)
for _n, _b in enumerate("ACGT"):
    for _c in (ord(_b), ord(_b.lower())):
        _FWD[_c], _REV[_c], _BASE[_c], _AMBIGUOUS[_c], _GT[_c] = CODE[_b], CODE[PAIR[_b]], _n, 0, _b in "GT"
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[97:123] -= 32
_COMPLEMENT = np.arange(256, dtype=np.uint8)
for _b, _c in PAIR.items():
    _COMPLEMENT[ord(_b)] = ord(_c)
#: Bases of records handled at once, and windows of them whose hashes are held at once, whatever a record's length.
CHUNK, PIECE = 1 << 20, 1 << 16
#: Windows of a piece of the SQL engine, and of the longer ones that these are cut from; places in a piece, a power of 2.
SQL_PIECE, SQL_BLOCK, SQL_PLACES = 1 << 10, 1 << 17, 1 << 12


def _rotl(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    n = (n & np.uint8(31)).astype(np.uint32)
    return (x << n) | (x >> ((np.uint32(32) - n) & np.uint32(31)))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    if w == 1:
        return x
    pad = np.full((-len(x)) % w, np.iinfo(np.uint64).max, np.uint64)
    rows = np.concatenate([x, pad]).reshape(-1, w)
    head = np.minimum.accumulate(rows, axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - w + 1
    return np.minimum(tail[:n], head[w - 1 : w - 1 + n])


def _windows(data: np.ndarray, params: KmerParams) -> tuple[np.ndarray, np.ndarray]:
    """Window starts without an ambiguous base, and the position each chooses."""
    k, w, span, n = params.k, params.w, params.span, len(data)
    at = np.arange(n, dtype=np.int64)
    turn = at.astype(np.uint8)  # rotations count modulo 32
    forward = np.bitwise_xor.accumulate(_rotl(_FWD[data], -turn))
    back = np.bitwise_xor.accumulate(_rotl(_REV[data], turn))
    kmers = n - k + 1
    before_f = np.concatenate([np.zeros(1, np.uint32), forward[: kmers - 1]])
    before_b = np.concatenate([np.zeros(1, np.uint32), back[: kmers - 1]])
    p = turn[:kmers]
    hashes = _rotl(forward[k - 1 :] ^ before_f, p + np.uint8(k - 1)) + _rotl(back[k - 1 :] ^ before_b, -p)
    high, low = hashes.astype(np.uint64) << np.uint64(32), at[:kmers].astype(np.uint64)
    low32 = np.uint64(M32)
    windows = n - span + 1
    left = (_sliding_min(high | low, w)[:windows] & low32).astype(np.int64)
    right = (low32 - (_sliding_min(high | (low32 - low), w)[:windows] & low32)).astype(np.int64)
    sums = lambda x: np.concatenate([np.zeros(1, np.int32), np.cumsum(x[data], dtype=np.int32)])
    gt, amb = sums(_GT), sums(_AMBIGUOUS)
    good = np.flatnonzero(amb[span:] == amb[:-span])
    strand = 2 * (gt[span:] - gt[:-span]) > span
    return good, np.where(strand, left, right)[good]


def select(data: np.ndarray, offsets: np.ndarray, params: KmerParams) -> tuple[np.ndarray, np.ndarray]:
    """Record number and position in `data` of all minimizers of concatenated records, in order."""
    span, n = params.span, len(data)
    records, places = [], []
    for low in range(0, n - span + 1, PIECE):  # pieces overlap by a window less one base, so none is lost or seen twice
        start, chosen = _windows(data[low : low + PIECE + span - 1], params)
        start += low
        record = np.searchsorted(offsets, start, "right") - 1
        whole = start + span <= offsets[record + 1]
        records.append(record[whole])
        places.append(chosen[whole] + low)
    if not records:
        none = np.zeros(0, np.int64)
        return none, none
    record, chosen = np.concatenate(records), np.concatenate(places)
    new = np.ones(len(record), bool)
    # a window apart (another record, or behind ambiguous bases) with the same choice cannot occur across records
    new[1:] = (chosen[1:] != chosen[:-1]) | (record[1:] != record[:-1])
    return record[new], chosen[new]


def pack_at(data: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Smaller strand of the k-mers at positions, two bits a base, first base highest; k up to 31."""
    fwd, rev = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    two, top = np.uint64(2), np.uint64(2 * (k - 1))
    for i in range(k):
        c = _BASE[data[at + i]]
        fwd = (fwd << two) | c
        rev = (rev >> two) | ((np.uint64(3) - c) << top)
    return np.minimum(fwd, rev).view(np.int64)


def words_at(data: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """Smaller strand of the k-mers at positions as one long (k up to 31), or as two, of its first 31 bases and the rest."""
    if k <= 31:
        return [pack_at(data, at, k)]

    def packed(places, codes) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for i in places:
            out = (out << 2) | codes(i)
        return out

    fwd = lambda i: _BASE[data[at + i]].view(np.int64)
    rev = lambda i: 3 - _BASE[data[at + k - 1 - i]].view(np.int64)
    (a, b), (c, d) = ((packed(range(31), codes), packed(range(31, k), codes)) for codes in (fwd, rev))
    forward = (a < c) | ((a == c) & (b <= d))
    return [np.where(forward, a, c), np.where(forward, b, d)]


def spell_words(words: list[np.ndarray], k: int) -> list[bytes]:
    """Bases of packed k-mers."""
    letters = np.frombuffer(b"ACGT", np.uint8)
    sizes = [k] if len(words) == 1 else [31, k - 31]
    text = np.concatenate([letters[(w[:, None] >> np.arange(2 * (n - 1), -1, -2, dtype=np.int64)) & 3] for w, n in zip(words, sizes)], axis=1)
    return np.ascontiguousarray(text).view(f"S{k}").ravel().tolist()


def spell_at(data: np.ndarray, at: np.ndarray, k: int) -> pa.Array:
    """Smaller strand of the k-mers at positions, as strings."""
    fwd = _UPPER[data[at[:, None] + np.arange(k)[None, :]]] if len(at) else np.zeros((0, k), np.uint8)
    rev = np.ascontiguousarray(_COMPLEMENT[fwd[:, ::-1]])
    fwd = np.ascontiguousarray(fwd)
    a, b = fwd.view(f"S{k}").ravel(), rev.view(f"S{k}").ravel()
    out = np.where((a <= b)[:, None], fwd, rev) if len(at) else fwd
    offsets = pa.py_buffer((np.arange(len(at) + 1) * k).astype(np.int32))
    return pa.StringArray.from_buffers(len(at), offsets, pa.py_buffer(np.ascontiguousarray(out)))


def kmers_at(data: np.ndarray, at: np.ndarray, params: KmerParams) -> pa.Array:
    return pa.array(pack_at(data, at, params.k)) if params.packed else spell_at(data, at, params.k)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its n+1 offsets; null rows are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(batch: pa.RecordBatch, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Slices of about CHUNK bases."""
    size = sum(np.diff(column_bytes(batch.column(c))[1]) for c in columns)
    if not len(size):
        return
    group = np.cumsum(size) // CHUNK
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])).tolist()
    for a, b in zip(first, [*first[1:], batch.num_rows]):
        yield batch.slice(a, b - a)


def classified(seq: Column, prefix_length: int = 0) -> Column:
    """What of a sequence is looked at: its first bases, then without one trailing newline."""
    part = seq.substr(1, prefix_length) if prefix_length else seq
    return F.regexp_replace(part, "\\n\\z", "")


def arrow_minimizers(records: DataFrame, params: KmerParams, seq: str = "seq", ids: tuple[str, ...] = ("record_no",)) -> DataFrame:
    """(ids, pos, kmer) of all records; kmer is a packed long for k <= 31, else a string."""
    kind = "long" if params.packed else "string"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in records.select(*ids).schema), "pos int", f"kmer {kind}"])
    names = [*ids, "pos", "kmer"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, [seq]):
                data, off = column_bytes(part.column(seq))
                record, at = select(data, off, params)
                row = pa.array(record)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(row) for c in ids), pa.array((at - off[record]).astype(np.int32)), kmers_at(data, at, params)], names=names)

    # records shorter than one window never reach Python
    return records.where(F.length(seq) >= params.span).select(*ids, seq).mapInArrow(run, schema)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _combined(items: Column, n: int, op: Callable[[Column, Column], Column]) -> Column:
    """Of each n neighbours of an array, by doubling; the last n - 1 are null."""
    shifted = lambda a, by: F.slice(a, F.lit(by + 1), F.size(a))

    def step(power: Column, size: int, done: Column | None, at: int) -> Column:
        if n & size:
            done, at = power if done is None else F.zip_with(done, shifted(power, at), op), at + size
        if 2 * size > n:
            return done
        double = lambda done: _let(F.zip_with(power, shifted(power, size), op), lambda power: step(power, 2 * size, done, at))
        return double(None) if done is None else _let(done, double)

    return _let(items, lambda items: step(items, 1, None, 0))


def _cut(rows: DataFrame, ids: tuple[str, ...], span: int, size: int) -> DataFrame:
    """Texts of `size` windows, (ids, from_, to_, text_) to the same; all but a record's first hold the window before theirs, too."""
    rows = rows.withColumn("at_", F.explode(F.sequence("from_", "to_", F.lit(size))))
    begin = lambda c: F.greatest(F.col(c) - 1, F.lit(0))
    to = F.least(F.col("to_"), F.col("at_") + (size - 1))
    text = F.substr("text_", begin("at_") - begin("from_") + 1, to - begin("at_") + span)
    return rows.select(*ids, F.col("at_").alias("from_"), to.alias("to_"), text.alias("text_"))


def sql_minimizers(records: DataFrame, params: KmerParams, seq: str = "seq", ids: tuple[str, ...] = ("record_no",)) -> DataFrame:
    """(ids, pos, kmer as string) by built-in expressions alone: arrays over pieces of records, and one row a window that nothing shuffles.

    Pieces travel once, so that records of any length and files of any layout are shared out evenly.
    """
    k, w, span = params.k, params.w, params.span
    session = records.sparkSession
    tasks = max(2 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    rows = records.select(*ids, F.lit(0).alias("from_"), F.upper(seq).alias("text_"))
    rows = rows.where(F.length("text_") >= span).withColumn("to_", F.length("text_") - span)
    rows = _cut(_cut(rows, ids, span, SQL_BLOCK), ids, span, SQL_PIECE).repartition(tasks, *ids, "from_")

    unknown = F.col("text_").rlike("[^ACGT]")
    known = F.when(unknown, F.regexp_replace("text_", "[^ACGT]", "A")).otherwise(F.col("text_"))
    flags = lambda text, ones: F.split(F.translate(text, "ACGT", ones), "").cast("array<int>")
    # codes of both strands in one long, turned by their place; the XOR of k of them is turned back by the k-mer's place
    table = F.array(*[F.lit(int(np.array((_turned(CODE[b], -i) << 32) | _turned(CODE[PAIR[b]], i), np.uint64).view(np.int64))) for i in range(32) for b in "ACGT"])
    coded = F.transform(flags(known, "0123"), lambda c, i: F.get(table, i.bitwiseAND(F.lit(31)) * 4 + c))
    m32 = F.lit(M32).cast("long")
    high, low = (F.lit(x).cast("long") for x in (-1 << 32, SQL_PLACES - 1))

    def hashed(x: Column, i: Column) -> Column:
        """Hash above the place."""
        both = lambda a, by: F.call_function("shiftrightunsigned", a, by).bitwiseAND(m32)
        forward = both(x.bitwiseAND(high).bitwiseOR(F.shiftrightunsigned(x, 32)), 32 - (i + (k - 1)).bitwiseAND(F.lit(31)))
        back = both(F.shiftleft(x, 32).bitwiseOR(x.bitwiseAND(m32)), i.bitwiseAND(F.lit(31)))
        return ((forward + back).bitwiseAND(m32) * SQL_PLACES).bitwiseOR(i.cast("long"))

    xor, plus = (lambda a, b: a.bitwiseXOR(b)), (lambda a, b: a + b)
    hashes = F.transform(F.slice(_combined(coded, k, xor), F.lit(1), F.length("text_") - (k - 1)), hashed)
    # strands matter only where equal hashes meet
    tied = lambda left: F.size(F.array_distinct(F.transform(left, lambda x: F.shiftright(x, SQL_PLACES.bit_length() - 1)))) < F.size(left)
    arrays = _let(
        hashes,
        lambda left: _let(
            tied(left),
            lambda t: F.struct(
                left.alias("left"), t.alias("tied"), F.when(t, F.transform(left, lambda x: x.bitwiseXOR(low))).alias("right"), F.when(t, _combined(flags(known, "0011"), span, plus)).alias("gt")
            ),
        ),
    )
    bad = F.when(unknown, _combined(flags(F.regexp_replace("text_", "[^ACGT]", "1"), "0000"), span, plus))
    first = F.when(F.col("from_") > 0, 1).otherwise(0)
    rows = rows.select(*ids, F.col("from_") - first, first, "text_", arrays, bad).toDF(*ids, "begin_", "first_", "text_", "a_", "bad_")
    rows = rows.select(*ids, "begin_", "first_", "text_", "a_", "bad_", F.explode(F.sequence("first_", F.length("text_") - span)).alias("i_"))

    def chosen(i: Column) -> Column:
        least = lambda side: F.array_min(F.slice(F.col(f"a_.{side}"), i + 1, F.lit(w))).bitwiseAND(low)
        return F.when(F.col("a_.tied") & (2 * F.get("a_.gt", i) <= span), low - least("right")).otherwise(least("left")).cast("int")

    whole = lambda i: F.col("bad_").isNull() | (F.get("bad_", i) == 0)
    i = F.col("i_")
    # a window behind ambiguous bases has a choice of its own
    rows = rows.where(whole(i) & ((i == 0) | ~whole(i - 1) | (chosen(i) != chosen(i - 1)))).withColumn("m_", chosen(i))
    kmer = F.substr("text_", F.col("m_") + 1, F.lit(k))
    return rows.select(*ids, (F.col("begin_") + F.col("m_")).alias("pos"), F.least(kmer, F.translate(F.reverse(kmer), "ACGT", "TGCA")).alias("kmer"))


def _turned(x: int, n: int) -> int:
    """Left rotation of 32 bits."""
    return ((x << n % 32) | (x >> 32 - n % 32)) & M32
