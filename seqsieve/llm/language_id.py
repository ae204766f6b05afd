"""Language identification with a blended-spectrum string kernel.

A text is cut into equal segments of up to SEGMENT bytes. A segment is the set of its byte n-grams of
1 to ORDER bytes (letters lower-cased), each hashed to one of SLOTS presence bits; the kernel of two
segments is the size of the common set over the geometric mean of both sizes, and a text is the mean
of its segments, so the bits of a long text do not fill up. Landmarks from the training sample give
Nystroem features, and one ridge regression for each language against the rest is fitted on them. The
kernel against all landmarks and the regression are both linear in the presence bits, so scoring a
batch is one matrix product of bits with folded weights.

Training reads a bounded sample: SAMPLE rows, split evenly between all languages (one row of each
at least), chosen by a hash of id and text, and of each one segment chosen by that hash; LANDMARKS of
them serve as landmarks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, prepare
from .kernels import multi_range, text_bytes

ORDER = 4
BITS = 15
SLOTS = 1 << BITS
SAMPLE, LANDMARKS = 2048, 512
#: Rows drawn by hash for each row of the sample.
SPARE = 4
RIDGE, SHARP = 1e-2, 4.0
SEGMENT, ROWS = 8192, 256


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3, is 1; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == 1


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the equal segments of all texts in order, and the text of each; an empty text is one empty segment."""
    size = np.diff(offsets)
    count = np.maximum(1, -(-size // SEGMENT))
    row = np.repeat(np.arange(len(size)), count)
    nth = multi_range(count)
    return np.append(offsets[:-1][row] + size[row] * nth // count[row], offsets[-1]), row


def presence(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """uint8 matrix of segments by presence bits."""
    data, off = data[bounds[0] : bounds[-1]], bounds - bounds[0]
    rows = len(off) - 1
    out = np.zeros((rows, SLOTS), np.uint8)
    flat = out.reshape(-1)
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(off))
    left = off[1:][row] - np.arange(len(data))
    h = np.zeros(len(data), np.uint32)
    for n in range(1, ORDER + 1):
        if len(data) < n:
            break
        h = h[: len(data) - n + 1] * np.uint32(0x01000193) + data[n - 1 :] + np.uint32(n)
        slot = ((h ^ (h >> np.uint32(15))) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        whole = left[: len(h)] >= n
        flat[row[: len(h)][whole] * SLOTS + slot[whole]] = 1
    return out


def fit(documents: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and folded weights (SLOTS x languages), from documents (doc_id, text, lang) that are not held out."""
    prepare(documents.sparkSession)
    rows = documents.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("draw"))
    # rows that repeat have one draw and count once
    count = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("draw", 0.02).alias("n")).collect()}
    langs = sorted(count)
    if not langs:
        return [], np.zeros((SLOTS, 0), np.float32)
    each = max(1, SAMPLE // len(langs))
    # about SPARE * each rows of a language have a draw below its bound, so ranking takes as many at any size
    spare = SPARE * each
    bound = {lang: 2**63 - 1 if n <= spare else -(2**63) + 2**64 * spare // n for lang, n in count.items()}
    below = F.element_at(F.create_map(*(F.lit(x) for pair in bound.items() for x in (pair[0], np.int64(pair[1])))), F.col("lang"))

    def bits(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, off = text_bytes(pc.utf8_lower(batch.column("text")))
        limits, row = segments(data, off)
        first = np.searchsorted(row, np.arange(batch.num_rows + 1))
        pick = first[:-1] + (batch.column("draw").to_numpy().view(np.uint64) % np.diff(first).astype(np.uint64)).astype(np.int64)
        packed = [np.packbits(presence(data, limits[i : i + 2])[0]).tobytes() for i in pick.tolist()]
        return pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("draw"), pa.array(packed, pa.binary())], names=["lang", "draw", "bits"])

    drawn = arrow_map(rows.where(F.col("draw") <= below), bits, "lang string, draw long, bits binary").groupBy("lang", "draw").agg(F.min("bits").alias("bits"))
    order = Window.partitionBy("lang").orderBy("draw")
    sample = drawn.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= each)
    got = sorted((r["lang"], r["draw"], bytes(r["bits"])) for r in sample.collect())
    if not got:
        return [], np.zeros((SLOTS, 0), np.float32)
    bits_of = lambda rows: np.unpackbits(np.frombuffer(b"".join(got[i][2] for i in rows), np.uint8).reshape(len(rows), -1), axis=1).astype(np.float32)
    langs = sorted({lang for lang, *_ in got})
    y = np.where(np.array([lang for lang, *_ in got])[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    pick = np.random.default_rng(0).permutation(len(got))[:LANDMARKS]
    z = bits_of(pick)
    z /= np.sqrt(z.sum(1, keepdims=True))
    kernel = []
    for at in range(0, len(got), ROWS):
        x = bits_of(range(at, min(at + ROWS, len(got))))
        kernel.append((x @ z.T).astype(np.float64) / np.sqrt(x.sum(1, keepdims=True)))
    kernel = np.concatenate(kernel)
    value, vector = np.linalg.eigh(kernel[pick])
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    feature = kernel @ root
    weight = np.linalg.solve(feature.T @ feature + RIDGE * len(got) / 100 * np.eye(feature.shape[1]), feature.T @ y)
    return langs, z.T @ (root @ weight).astype(np.float32)


def predict(documents: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """documents with lang_pred (string) and score (double, 0 to 1) appended; only text is looked at.

    A text that is null or has no letter, and any text where no language was learned, is `und`, 0.
    The score is the softmax weight of the chosen language; of equal ones the first by name is chosen.
    Texts of any length are looked at as a whole. Columns of these names are replaced.
    """
    langs, weight = model
    documents = documents.drop("lang_pred", "score")
    names = np.array([*langs, "und"], object)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in documents.schema)}, lang_pred string, score double"

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        text, n = batch.column("text"), batch.num_rows
        best, score = np.full(n, len(langs)), np.zeros(n)
        if langs:
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            data, off = text_bytes(pc.utf8_lower(text))
            limits, row = segments(data, off)
            sums = np.zeros((n, len(langs)))
            for at in range(0, len(row), ROWS):
                x = presence(data, limits[at : at + ROWS + 1])
                f = (x.astype(np.float32) @ weight) / np.sqrt(np.maximum(x.sum(1, dtype=np.int64), 1))[:, None]
                np.add.at(sums, row[at : at + ROWS], f)
            f = sums / np.bincount(row, minlength=n)[:, None]
            p = np.exp(SHARP * (f - f.max(1, keepdims=True)))
            best, score = np.where(letters, f.argmax(1), len(langs)), np.where(letters, 1 / p.sum(1), 0.0)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[best], pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    return arrow_map(documents, kernel, schema)


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of documents (doc_id, text, lang).

    Null ids are never held out and never learned from. Repeated rows get equal results, as reruns do;
    other columns are ignored; an empty table gives an empty table.
    """
    model = fit(documents.select("doc_id", "text", "lang"))
    out = predict(documents.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
