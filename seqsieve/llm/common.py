"""Shared plumbing: Arrow batch limits, tables cut from their lineage, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: An Arrow batch that goes to Python holds about so many bytes at most, unless one row is larger.
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Bound what one Arrow batch brings into a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a temporary one only where all tasks run in this process, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it: its lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by materialize once nothing reads it."""
    jvm = df.sparkSession._jvm
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def release() -> None:
    """Give freed memory back to the system: Python workers live on between tasks, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def arrow_map(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := kernel(batch)) is not None:
                yield out
        release()

    prepare(df.sparkSession)
    return df.mapInArrow(run, schema)


class Forest:
    """Union-find over integers; the root of a set is its smallest member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def stars(self) -> tuple[list[int], list[int]]:
        pairs = [(self.find(x), x) for x in list(self.parent)]
        pairs = [(r, x) for r, x in pairs if r != x]
        return [p[0] for p in pairs], [p[1] for p in pairs]


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk of a million edges becomes stars; connectivity stays and memory is bounded."""
    forest, seen = Forest(), 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(a, b)
        seen += batch.num_rows
        if seen > 1_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in forest.stars()], schema=EDGES)
            forest, seen = Forest(), 0
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in forest.stars()], schema=EDGES)
    release()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b: long) that is not the smallest of its component.

    Alternating large-star and small-star rounds over the edge table, each written to the shared
    folder, until nothing changes: O(log n) rounds, nothing on the driver but two sums a round.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")
    now = materialize(edges.mapInArrow(_contract, "a long, b long").distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("u").alias("b")), F.struct(F.col("m").alias("a"), F.col("v").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        new = materialize(small)
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now)
        now = new
        if seen == mark or not seen[0]:
            return now.select(F.col("b").alias("node"), F.col("a").alias("component"))
        mark = seen
