"""Mixing sources to target weights with hash-threshold histograms.

Sizes are summed by source and by the leading bits of a document's hash. The running sum over the
buckets of a source finds the bucket in which its budget ends; only that boundary bucket is summed
again by the next bits, until it holds one hash. Documents below the threshold are taken: nothing
is sorted by document, and a source of any size is a few thousand sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, discard, materialize
from .kernels import text_bytes, words

WEIGHTS = (3.0, 1.0, 2.0)
BITS = 12
FILLS = 3
#: Thresholds of at most so many sources are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def word_counts(documents: DataFrame) -> DataFrame:
    """documents (doc_id, source, text) as doc_id, source, size, h: number of words of the text (null: 0) and a hash of the row."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, off = text_bytes(batch.column("text"))
        size = np.diff(words(data, off)[2])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(size, pa.int64()), batch.column("h")], names=["doc_id", "source", "size", "h"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text", row_hash().alias("h"))
    return arrow_map(rows, kernel, "doc_id long, source string, size long, h long")


def row_hash() -> Column:
    return F.xxhash64("doc_id", "text", F.lit("mix"))


def targets(sizes: DataFrame, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """source, source_size, target: `share` of all words dealt by WEIGHTS in code point order (null last), none above limit * source_size.

    The excess of capped sources goes to the others by weight. With sources by falling need of a cap
    (limit * size / weight ascending), the first k are capped and the rest share what they leave.
    """
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("nth") - 1) % len(WEIGHTS) + 1).cast("int"))
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by.withColumn("nth", F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))).withColumn("weight", w)
    ranked = ranked.withColumn("cap", limit * F.col("source_size")).withColumn("need", F.col("cap") / F.col("weight"))
    order = Window.orderBy("need", "nth")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(Window.partitionBy(F.lit(0))) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    filled = ranked.withColumn("level", level)
    # the fill level is that of the first source that stays under its cap; later ones are lower
    filled = filled.withColumn("fill", F.max(F.when(F.col("need") >= F.col("level"), F.col("level"))).over(Window.partitionBy(F.lit(0))))
    return filled.select("source", "source_size", F.least("cap", F.coalesce(F.col("fill") * F.col("weight"), F.col("cap"))).alias("target"))


def thresholds(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """source, source_size, target, whole, at, used, picks: how often the mix takes a document.

    Each is taken `whole` times, and once more where the leading `used` bits of its hash are below
    `at`. What the boundary bucket still lacks is decided within it, level by level; at the last
    level the bucket is one hash that doesn't fit, and `picks` fills the gap with up to FILLS single
    documents behind the threshold, each the one that comes nearest.
    """
    open_ = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    open_ = materialize(open_.withColumn("lack", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("at", F.lit(0).cast("long")))
    level = 0
    while True:
        done = level * BITS
        bits = min(BITS, 64 - done)
        if bits <= 0:
            break
        inside = sizes.join(open_.select(F.col("source").alias("s"), "lack", "at"), F.col("source").eqNullSafe(F.col("s")) & (F.col("lack") > 0))
        if done:
            inside = inside.where(F.shiftrightunsigned("h", 64 - done) == F.col("at"))
        bucket = F.shiftrightunsigned("h", 64 - done - bits)
        sums = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n"), F.countDistinct("h").alias("hashes") if level else F.lit(2).alias("hashes"))
        upto = Window.partitionBy("source").orderBy("bucket")
        found = sums.withColumn("sum", F.sum("n").over(upto)).join(open_.select(F.col("source").alias("s"), "lack"), F.col("source").eqNullSafe(F.col("s")))
        edge = found.where((F.col("sum") - F.col("n") <= F.col("lack")) & (F.col("sum") > F.col("lack"))).select("s", "bucket", (F.col("lack") - F.col("sum") + F.col("n")).alias("left"), "n", "hashes")
        new = open_.withColumnRenamed("source", "source_").join(edge, F.col("source_").eqNullSafe(F.col("s")), "left")
        # no boundary: all of the bucket fits, so the threshold stays behind it
        step = F.when(F.col("bucket").isNotNull(), F.col("bucket")).when(F.col("lack") > 0, F.shiftleft(F.col("at") + 1, bits)).otherwise(F.shiftleft("at", bits))
        new = materialize(new.select(F.col("source_").alias("source"), "source_size", "target", "whole", F.coalesce("left", F.lit(0.0)).alias("lack"), step.alias("at"), F.coalesce("hashes", F.lit(0)).alias("hashes"), F.coalesce("n", F.lit(0)).alias("n")))
        discard(open_)
        open_ = new.drop("hashes", "n")
        level += 1
        if new.where("hashes > 1 and lack > 0").limit(1).count() == 0:
            break
    used = min(level * BITS, 64)
    now = open_.select("source", "source_size", "target", "whole", "at", F.lit(used).alias("used"), "lack", F.array().cast("array<bigint>").alias("picks"))
    for _ in range(FILLS):
        now = materialize(now)
        state = now.select(F.col("source").alias("s"), "lack", "at", "used", "picks")
        rest = sizes.where("size > 0").join(state, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") < 2 * F.col("lack")))
        rest = rest.where((_below("h") == 0) & ~F.array_contains("picks", F.col("h"))).groupBy("s", "h", "lack").agg(F.sum("size").alias("n")).where("n < 2 * lack")
        best = rest.groupBy("s").agg(F.min(F.struct(F.abs(F.col("lack") - F.col("n")).alias("off"), "n", "h")).alias("best"))
        new = now.join(best, F.col("source").eqNullSafe(F.col("s")), "left")
        now = new.select("source", "source_size", "target", "whole", "at", "used", (F.col("lack") - F.coalesce("best.n", F.lit(0))).alias("lack"), F.when(F.col("best").isNotNull(), F.concat("picks", F.array("best.h"))).otherwise(F.col("picks")).alias("picks"))
    return now.drop("lack")


def _below(h: str, plan: str = "") -> Column:
    """1 if the leading `used` bits of h are below `at`, as unsigned numbers."""
    at, used = f"{plan}at", f"{plan}used"
    lead = F.expr(f"shiftrightunsigned({h}, cast(64 - {used} as int))")
    whole = F.expr(f"cast(({h} ^ shiftleft(1L, 63)) < ({at} ^ shiftleft(1L, 63)) as long)")
    return F.when(F.col(used) < 64, (lead < F.col(at)).cast("long")).otherwise(whole)


def with_copies(rows: DataFrame, decided: DataFrame, h: Column, count: int) -> DataFrame:
    """rows (source, ...) with plan_mix_ (the source's thresholds) and copies_mix_."""
    small = decided.select(F.col("source").alias("source_mix_"), F.struct("source_size", "target", "whole", "at", "used", "picks").alias("plan_mix_"))
    if count <= BROADCAST_SOURCES:
        small = F.broadcast(small)
    joined = rows.withColumn("h_mix_", h).join(small, F.col("source").eqNullSafe(F.col("source_mix_")), "left")
    extra = F.greatest(_below("h_mix_", "plan_mix_."), F.array_contains("plan_mix_.picks", F.col("h_mix_")).cast("long"))
    return joined.withColumn("copies_mix_", F.col("plan_mix_.whole") + extra).drop("h_mix_", "source_mix_")


def mix(documents: DataFrame, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of documents (doc_id, source, text).

    A null text has size 0; a null source is a source of its own, last in order. Copies of a text
    with different ids are decided one by one; rows equal in id and text are taken together. What a
    source takes is within half of its largest document of the target, and mostly far nearer. Other
    columns are ignored; an empty table gives an empty table. Reruns agree.
    """
    sizes = materialize(word_counts(documents))
    decided = materialize(thresholds(sizes, targets(sizes, share, limit)))
    out = with_copies(sizes, decided, F.col("h"), decided.count())
    return out.select("doc_id", "size", "plan_mix_.source_size", "plan_mix_.target", (F.col("copies_mix_") * F.col("size")).alias("taken"))


def mixed(documents: DataFrame, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """The mix itself: rows of documents as often as mix() takes them, with the same columns."""
    sizes = materialize(word_counts(documents))
    decided = materialize(thresholds(sizes, targets(sizes, share, limit)))
    out = with_copies(documents, decided, row_hash(), decided.count())
    times = F.explode(F.sequence(F.lit(1), F.col("copies_mix_").cast("int")))
    return out.where("copies_mix_ > 0").withColumn("copy_mix_", times).select(*documents.columns)
