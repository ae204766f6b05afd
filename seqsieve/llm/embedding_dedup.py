"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are rotated onto the principal axes of all of them, so leading coordinates carry most of a
dot product. The first AXES coordinates put each vector in a cell as wide as the largest distance
of linked vectors, so only neighbouring cells are compared, and a vector goes only to those its own
place in the cell can reach; a large cell is cut into tiles of about TILE rows. A task compares two
tiles in squares of SIDE rows: dot products are accumulated over leading coordinates, what is left
is bounded by the product of suffix norms, and rows or whole squares that cannot reach the threshold
are left out of the next block. Equal vectors are one class with a multiplicity, and classes are
numbered, so a task returns link counts and spanning edges by class, never pairs.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, components, discard, materialize, prepare

AXES = 3
#: Vectors in one tile, and in the squares in which two tiles are compared.
TILE, SIDE = 4096, 1024
BLOCK = 16
#: Second moments of up to so many dimensions go through the driver (128 MB); wider vectors keep their own axes.
WIDEST = 4096
#: Dot products of rotated vectors this near to the threshold are computed anew from the vectors.
CLOSE = 1e-9

MADE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("class", pa.int64()), ("n", pa.int64())])
MADE_SQL = "a long, b long, class long, n long"


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension d, the d x d rotation, axes by falling variance; second moments are summed over all rows.

    Vectors of over WIDEST components have no rotation: their axes are the components as they are.
    """

    def moments(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            d = batch.column("dim").to_numpy()
            for k in np.unique(d[d <= WIDEST]).tolist():
                x = _matrix(batch.column("embedding").filter(pa.array(d == k)))
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                sums[k] = sums.get(k, 0) + x.T @ x
        for k, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k * k, k), pa.int32()), pa.array(np.arange(k * k), pa.int64()), pa.array(m.ravel())], names=["dim", "at", "value"])

    rows = vectors.mapInArrow(moments, "dim int, at long, value double").groupBy("dim", "at").agg(F.sum("value").alias("value")).collect()
    out = {}
    for k in {r["dim"] for r in rows}:
        m = np.zeros(k * k)
        for r in rows:
            if r["dim"] == k:
                m[r["at"]] = r["value"]
        m = m.reshape(k, k)
        _, axes = np.linalg.eigh((m + m.T) / 2)
        out[k] = np.ascontiguousarray(axes[:, ::-1])
    return out


def rotated(x: np.ndarray, axes: np.ndarray | None) -> np.ndarray:
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    return y if axes is None else y @ axes


def links(a: np.ndarray, b: np.ndarray, axes: np.ndarray | None, threshold: float) -> np.ndarray:
    """Boolean matrix of cosine >= threshold between rows of a and rows of b."""
    ya, yb = rotated(a, axes), rotated(b, axes)
    rest = lambda y: np.sqrt(np.maximum(np.cumsum((y * y)[:, ::-1], 1)[:, ::-1], 0))
    ra, rb = rest(ya), rest(yb)
    out = np.zeros((len(a), len(b)), bool)
    i, j = np.arange(len(a)), np.arange(len(b))
    dot = np.zeros(out.shape)
    d = ya.shape[1]
    for at in range(0, d, BLOCK):
        end = min(d, at + BLOCK)
        dot = dot + ya[i, at:end] @ yb[j, at:end].T
        if end == d:
            break
        alive = dot + ra[i, end][:, None] * rb[j, end][None, :] >= threshold - CLOSE
        rows, cols = alive.any(1), alive.any(0)
        if not rows.any():
            return out
        i, j, dot = i[rows], j[cols], dot[np.ix_(rows, cols)]
    hit = dot >= threshold
    p, q = np.nonzero(np.abs(dot - threshold) <= CLOSE)
    for s in range(0, len(p), 10_000):
        x, y = a[i[p[s : s + 10_000]]], b[j[q[s : s + 10_000]]]
        hit[p[s : s + 10_000], q[s : s + 10_000]] = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))) >= threshold
    out[np.ix_(i, j)] = hit
    return out


def _squares(x: np.ndarray, y: np.ndarray | None, axes: np.ndarray | None, threshold: float):
    """(first row, first column, links) of all squares of x with y, or of x with itself from the diagonal up."""
    for i in range(0, len(x), SIDE):
        for j in range(i if y is None else 0, len(x if y is None else y), SIDE):
            link = links(x[i : i + SIDE], (x if y is None else y)[j : j + SIDE], axes, threshold)
            if y is None and i == j:
                np.fill_diagonal(link, False)
            yield i, j, link


def _roots(link: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest number of each row's and column's component in the bipartite graph of rows numbered a and columns numbered b."""
    big = np.iinfo(np.int64).max
    la, lb = a.copy(), b.copy()
    while True:
        nb = np.minimum(lb, np.where(link, la[:, None], big).min(0))
        na = np.minimum(la, np.where(link, nb[None, :], big).min(1))
        if (na == la).all() and (nb == lb).all():
            return la, lb
        la, lb = na, nb


def near_vectors(embeddings: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of embeddings (vec_id, embedding, label).

    Rows are linked when their labels are equal and not null, their dimensions are equal and their
    cosine in double precision is at least `threshold` (above 0). Vectors that are null, empty, zero
    or hold a null or non-finite component, and rows with a null vec_id, link with nothing. Equal
    rows are linked with each other; rows that share a vec_id count as vectors of their own, with
    counts of their own, and share a component. Cosines that tie with the threshold are links. Other
    columns are ignored. An empty table gives an empty table.
    """
    spark = embeddings.sparkSession
    prepare(spark)
    kind = embeddings.schema["embedding"].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = embeddings.select("vec_id", "label", F.col("embedding").cast(kind).alias("embedding"))
    usable = rows.where(
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.coalesce(F.size("embedding") > 0, F.lit(False))
        & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    ).select("vec_id", F.col("label").cast("string").alias("label"), F.size("embedding").alias("dim"), "embedding", F.xxhash64("embedding").alias("h1"), F.hash("embedding").alias("h2"))
    key = ["label", "dim", "h1", "h2"]
    classes = usable.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    classes = materialize(classes.withColumn("class", F.monotonically_increasing_id()))  # numbers hold once written
    axes = principal_axes(classes.select("dim", "embedding"))
    width = math.sqrt(2 - 2 * threshold) * (1 + 1e-9)

    def place(batches):
        """Cells, and for each of the 3**AXES neighbours whether the vector's place in its cell reaches it."""
        steps = np.stack(np.meshgrid(*[(-1, 0, 1)] * AXES, indexing="ij"), -1).reshape(-1, AXES)
        for batch in batches:
            d = batch.column("dim").to_numpy()
            at = np.zeros((len(d), AXES))
            for k in np.unique(d).tolist():
                own = d == k
                y = rotated(_matrix(batch.column("embedding").filter(pa.array(own))), axes.get(k))[:, :AXES]
                at[own, : y.shape[1]] = y / width
            cell = np.floor(at)
            part = (at - cell)[:, None, :]
            gap = np.where(steps < 0, part, np.where(steps > 0, 1 - part, 0.0))
            row, which = np.nonzero((gap * gap).sum(2) <= 1 + 1e-9)
            cells = cell.astype(np.int32)
            other = cells[row] + steps[which]
            sides = [pa.array(np.ascontiguousarray(x[:, i]), pa.int32()) for x in (cells[row], other.astype(np.int32)) for i in range(AXES)]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in batch.columns), *sides], names=[*batch.schema.names, *own_cell, *other_cell])

    own_cell, other_cell = [f"c{i}" for i in range(AXES)], [f"o{i}" for i in range(AXES)]
    fields = f"label string, dim int, rep long, copies long, class long, embedding {kind}"
    placed = classes.select("label", "dim", "rep", "copies", "class", "embedding").mapInArrow(place, f"{fields}, {', '.join(f'{c} int' for c in own_cell + other_cell)}")
    home = reduce(lambda x, y: x & y, [F.col(c) == F.col(o) for c, o in zip(own_cell, other_cell)])
    # narrow: only cells and their sizes
    tiles = materialize(placed.where(home).groupBy("label", "dim", *own_cell).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")))
    near = placed.join(tiles, ["label", "dim", *own_cell]).withColumn("tile", F.pmod(F.xxhash64("class"), "tiles").cast("int")).drop("tiles")
    others = tiles.select("label", "dim", *(F.col(c).alias(o) for c, o in zip(own_cell, other_cell)), "tiles")
    near = near.join(others, ["label", "dim", *other_cell]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    own = F.struct(*own_cell, "tile")
    far = F.struct(*(F.col(o).alias(c) for c, o in zip(own_cell, other_cell)), F.col("other").alias("tile"))
    near = near.select("label", "dim", "rep", "copies", "class", "embedding", F.least(own, far).alias("left"), F.greatest(own, far).alias("right"), (own <= far).alias("is_left"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        left = table.column("is_left").to_numpy(zero_copy_only=False)
        rep, copies, number = (table.column(c).to_numpy() for c in ("rep", "copies", "class"))
        x = _matrix(table.column("embedding").combine_chunks())
        same = table.column("left")[0] == table.column("right")[0]
        i, j = (np.arange(len(rep)),) * 2 if same else (np.flatnonzero(left), np.flatnonzero(~left))
        if not len(i) or not len(j):
            return MADE.empty_table()
        count, forest = np.zeros(len(rep), np.int64), Forest()
        for p, q, link in _squares(x[i], None if same else x[j], axes.get(x.shape[1]), threshold):
            a, b = i[p : p + len(link)], j[q : q + link.shape[1]]
            count[a] += link @ copies[b]
            if not same or p != q:
                count[b] += copies[a] @ link
            rows, cols = link.any(1), link.any(0)
            if rows.any():
                a, b = a[rows], b[cols]
                la, lb = _roots(link[np.ix_(rows, cols)], a, b)
                for u, v in zip(np.append(la, lb).tolist(), np.append(a, b).tolist()):
                    forest.join(u, v)
        # rows of a component hang on the one with the smallest vec_id
        linked = np.flatnonzero(count)
        root = np.array([forest.find(int(u)) for u in linked], np.int64)
        least = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(least, root, rep[linked])
        return pa.Table.from_arrays([pa.array(least[root], pa.int64()), pa.array(rep[linked]), pa.array(number[linked]), pa.array(count[linked])], schema=MADE)

    made = materialize(near.groupBy("label", "dim", "left", "right").applyInArrow(compare, MADE_SQL))
    degree = made.groupBy("class").agg(F.sum("n").alias("n"))
    members = usable.select("vec_id", *key).join(classes.select(*key, "rep", "copies"), key)
    groups = components(made.where("a <> b").select("a", "b").unionByName(members.where("rep <> vec_id").select(F.col("rep").alias("a"), F.col("vec_id").alias("b"))))
    found = rows.select("vec_id", F.col("label").cast("string").alias("label"), F.size("embedding").alias("dim"), F.xxhash64("embedding").alias("h1"), F.hash("embedding").alias("h2"))
    known = classes.select(*key, "class", "copies").join(degree, "class", "left").select(*key, (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    out = found.join(known, key, "left").join(groups.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    out = out.withColumn("component_id", F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
