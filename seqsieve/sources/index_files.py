"""Index persistence: Parquet with a JSON sidecar, and the compact `.idx` format.

.idx: u8 version, u8 k, u8 w, u64 count (little endian), then count k-mers of ceil(k/4) bytes,
little endian, two bits a base from the lowest bits up, A C T G = 0 1 2 3.
"""

from __future__ import annotations

import json
import os
import struct
import urllib.request

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import pack
from ..operators.frozen import FrozenIndex
from ..operators.index import MinimizerIndex
from ..params import FORMAT_VERSION, KmerParams

SIDECAR = "_index.json"
HEAD = struct.Struct("<BBBQ")
_IDX = "ACTG"


class CorruptIndexError(ValueError):
    """An index file whose content doesn't match its header."""


def _put(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def save(index: MinimizerIndex | FrozenIndex, path: str) -> None:
    """Parquet under path/data and header under path/_index.json, on any file system Spark writes."""
    frozen = isinstance(index, FrozenIndex)
    rows = index.table if frozen else index.kmers
    rows.write.mode("overwrite").parquet(f"{path}/data")
    spark = rows.sparkSession
    count = index.key_count if frozen else spark.read.parquet(f"{path}/data").count()
    head = {"format": "frozen" if frozen else "exact", "version": index.version, "k": index.params.k, "w": index.params.w, "count": count}
    _put(spark, f"{path}/{SIDECAR}", json.dumps(head | ({"bits": index.bits} if frozen else {})))


def header(spark: SparkSession, path: str) -> dict:
    """Header of a saved index, without its rows."""
    if os.path.isfile(path):
        with open(path, "rb") as f:
            data = f.read(HEAD.size)
        if len(data) < HEAD.size:
            raise CorruptIndexError(f"{path}: truncated header")
        version, k, w, count = HEAD.unpack(data)
        return {"format": "idx", "version": version, "k": k, "w": w, "count": count}
    return json.loads(spark.read.text(f"{path}/{SIDECAR}").first()[0])


def load(spark: SparkSession, path: str) -> MinimizerIndex | FrozenIndex:
    """Whatever index is at path: saved exact or frozen, or an .idx file."""
    head = header(spark, path)
    if head["version"] != FORMAT_VERSION:
        raise CorruptIndexError(f"{path}: format version {head['version']}, expected {FORMAT_VERSION}")
    if head["format"] == "idx":
        return import_idx(spark, path)
    params = KmerParams(head["k"], head["w"])
    rows = spark.read.parquet(f"{path}/data")
    if head["format"] == "frozen":
        return FrozenIndex(rows, params, head["count"], head["bits"], head["version"])
    return MinimizerIndex(rows, params, head["version"])


def load_exact(spark: SparkSession, path: str) -> MinimizerIndex:
    from ..operators.index import FrozenIndexError

    index = load(spark, path)
    if not isinstance(index, MinimizerIndex):
        raise FrozenIndexError(f"{path} is frozen; this needs an exact index")
    return index


def export_idx(index: MinimizerIndex, path: str) -> int:
    """Write an .idx file, one partition of k-mers at a time, in their order; returns the count."""
    k, size = index.params.k, -(-index.params.k // 4)
    count = 0
    with open(path, "wb") as out:
        out.write(HEAD.pack(index.version, k, index.params.w, 0))
        for row in index.kmers.select(index.spelled().alias("kmer")).sort("kmer").toLocalIterator():
            value = 0
            for i, c in enumerate(row[0]):
                value |= _IDX.index(c) << 2 * i
            out.write(value.to_bytes(size, "little"))
            count += 1
        out.seek(0)
        out.write(HEAD.pack(index.version, k, index.params.w, count))
    return count


def import_idx(spark: SparkSession, path: str, rows_at_once: int = 1 << 20) -> MinimizerIndex:
    """Read an .idx file; truncated files and duplicates are errors.

    Byte ranges are decoded in parallel by tasks that open the file; either strand is accepted.
    """
    head = header(spark, path)
    params, size, count = KmerParams(head["k"], head["w"]), -(-head["k"] // 4), head["count"]
    if os.path.getsize(path) != HEAD.size + count * size:
        raise CorruptIndexError(f"{path}: {count} k-mers announced, {(os.path.getsize(path) - HEAD.size) / size:g} found")
    k, head_size = params.k, HEAD.size

    def decode(batches):
        letters = np.frombuffer(_IDX.encode(), np.uint8)
        for batch in batches:
            for first in batch.column(0).to_pylist():
                with open(path, "rb") as f:
                    f.seek(head_size + first * size)
                    data = np.frombuffer(f.read(min(rows_at_once, count - first) * size), np.uint8).reshape(-1, size)
                codes = np.stack([(data >> s) & 3 for s in (0, 2, 4, 6)], 2).reshape(len(data), -1)[:, :k]
                text = letters[codes]
                yield pa.RecordBatch.from_arrays([pa.array([t.tobytes().decode() for t in text], pa.string())], names=["kmer"])

    starts = spark.range(0, max(count, 1), rows_at_once).where(F.col("id") < count)
    kmers = starts.mapInArrow(decode, "kmer string")
    kmers = kmers.select(F.least("kmer", F.translate(F.reverse("kmer"), "ACGT", "TGCA")).alias("kmer")).distinct()
    if params.packed:
        kmers = kmers.select(pack(F.col("kmer")).alias("kmer"))
    if (found := kmers.count()) != count:
        raise CorruptIndexError(f"{path}: {count} k-mers announced, {found} distinct found")
    return MinimizerIndex(kmers, params, head["version"])


def fetch(name: str, k: int = 31, w: int = 15, folder: str = ".", base: str | None = None, output: str | None = None) -> str:
    """Download a prebuilt index {base}/{version}/{name}.k{k}w{w}.idx to output, or into folder; it appears under its name only when whole."""
    base = base or os.environ.get("SEQSIEVE_INDEX_URL")
    if not base:
        raise ValueError("no index server: give base or set SEQSIEVE_INDEX_URL")
    file = f"{name}.k{k}w{w}.idx"
    path = output or os.path.join(folder, file)
    urllib.request.urlretrieve(f"{base.rstrip('/')}/{FORMAT_VERSION}/{file}", path + ".tmp")
    os.replace(path + ".tmp", path)
    return path
