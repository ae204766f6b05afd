"""MinHash near-duplicate detection with tensored banding and confirmation on full shingle sets.

Two collections of T sub-keys, each made of R minhashes, replace T*T bands of 2R minhashes: a table
key combines one sub-key of either collection, so 2*T*R minhash functions serve T*T tables. A pair
of Jaccard similarity s meets in some table with probability (1 - (1 - s**R)**T)**2: 0.99993 at 0.85.

Documents with equal shingle sets form one class first, so exact copies never meet in a table.
Within a table key, documents whose one-byte minhash sketches agree are clustered, in a large key
through canopies: each row is compared with pivots, and a row that leaves a canopy takes all with it
that could agree with it, so clusters are a superset of the true groups at any size of a key.

Full sets are compared exactly, as packed shingle hashes. A cluster of one tile is compared as it
is. Of a larger one all sets meet a central one first. What is linked with it is connected and need
not meet itself again; and as 1 - similarity is a metric, only sets within twice the distance can
be linked with those. What remains is compared in pairs of tiles, spread over tasks. Only spanning
edges leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import EDGES, Forest, arrow_map, components, discard, materialize, partitions, release, signed
from .kernels import U, mix, shingles, text_bytes, word_hashes, words

T, R = 8, 2
SKETCH = 16
#: Of SKETCH sketch bytes, so many agree between rows of one cluster, and so many let a row be dropped from a canopy.
CLOSE, SAME = 8, 13
#: What is CLOSE to a dropped row agrees with its pivot in so many bytes at least.
NEAR = CLOSE - (SKETCH - SAME)
#: Rows of one key compared pair by pair; beyond that, with pivots.
PAIRWISE = 16
#: Shingles in one tile, where a document counts as LEAST shingles at least.
TILE, LEAST = 100_000, 200
#: Central sets that a large cluster meets, one after the other, before tiles are paired.
ROUNDS = 2
_ODD = np.random.default_rng(77).integers(1, 2**63, 2 * T * R, dtype=np.uint64) * U(2) + U(1)
_C = U(0x9FB21C651E98DF25)

SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("keys", pa.binary())])


def _sets(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    data, off = text_bytes(batch.column("text"))
    starts, ends, rows = words(data, off)
    return shingles(word_hashes(data, starts, ends), rows, k)


def _sign(k: int):
    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        value, off = _sets(batch, k)
        n = np.diff(off)
        some = np.flatnonzero(n > 0)
        at = off[:-1][some]
        f1, f2, sub = np.zeros(len(n), U), np.zeros(len(n), U), np.zeros((len(n), 2 * T), U)
        sketch = np.zeros((len(n), SKETCH), np.uint8)
        if len(some):
            f1[some] = np.add.reduceat(mix(value), at)
            f2[some] = np.add.reduceat(mix(value ^ _C), at)
            for j in range(2 * T):
                for r in range(R):
                    h = value * _ODD[j * R + r]
                    h ^= h >> U(32)
                    least = np.minimum.reduceat(h, at)
                    sub[some, j] = mix(sub[some, j] * _C + least)
                    if r == 0:
                        sketch[some, j] = mix(least).astype(np.uint8)
        s = sketch.view(np.int64)
        keys = pa.array([x.tobytes() for x in sub], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(signed(f1)), pa.array(signed(f2)), pa.array(s[:, 0].copy()), pa.array(s[:, 1].copy()), keys], schema=SIGNED)

    return kernel


TABLE = pa.schema([("key", pa.int64()), ("rep", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64())])


def _tables(batch: pa.RecordBatch) -> pa.RecordBatch:
    """T*T rows for each class."""
    sub = np.frombuffer(b"".join(batch.column("keys").to_pylist()), U).reshape(-1, 2 * T)
    at = np.arange(T * T, dtype=U).reshape(T, T)
    key = mix(mix(sub[:, :T, None] * _C + sub[:, None, T:]) + at)
    each = lambda c: pa.array(np.repeat(batch.column(c).to_numpy(), T * T))
    return pa.RecordBatch.from_arrays([pa.array(signed(key.ravel())), each("rep"), each("s1"), each("s2")], schema=TABLE)


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.view(np.uint8).reshape(-1, SKETCH) == b.view(np.uint8).reshape(-1, SKETCH)).sum(1)


class _Canopies:
    """Clusters of one key's rows; holds pivots only, so a key of any size passes in blocks."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.sketches: list[np.ndarray] = []

    def add(self, rep: np.ndarray, sketch: np.ndarray, forest: Forest) -> None:
        for pid, p in zip(self.ids, self.sketches):
            if not len(rep):
                return
            rep, sketch = self._against(pid, p, rep, sketch, forest)
        while len(rep):
            pid, p = int(rep[0]), sketch[:1].copy()
            self.ids.append(pid)
            self.sketches.append(p)
            rep, sketch = self._against(pid, p, rep[1:], sketch[1:], forest)

    @staticmethod
    def _against(pid: int, p: np.ndarray, rep: np.ndarray, sketch: np.ndarray, forest: Forest):
        agree = _agree(sketch, np.broadcast_to(p, sketch.shape).copy())
        for x in rep[agree >= NEAR].tolist():
            forest.join(pid, x)
        rest = agree < SAME
        return rep[rest], sketch[rest]


def _cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star edges between classes of one key whose sketches agree; input sorted by key."""
    forest = Forest()
    held: list[np.ndarray] | None = None
    canopies, open_key = _Canopies(), None

    def stars() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in forest.stars()], schema=EDGES)

    def work(key: np.ndarray, rep: np.ndarray, sketch: np.ndarray) -> None:
        edge = np.flatnonzero(key[1:] != key[:-1]) + 1
        first = np.concatenate([[0], edge])
        size = np.diff(np.append(first, len(key)))
        row_size = np.repeat(size, size)
        small = np.flatnonzero((row_size > 1) & (row_size <= PAIRWISE))
        if len(small):
            k, r, s = key[small], rep[small], sketch[small]
            for d in range(1, PAIRWISE):
                pair = np.flatnonzero(k[d:] == k[:-d]) if d < len(k) else small[:0]
                if not len(pair):
                    break
                pair = pair[_agree(s[pair], s[pair + d]) >= CLOSE]
                both = np.unique(np.stack([r[pair], r[pair + d]], 1), axis=0)
                for a, b in both.tolist():
                    forest.join(a, b)
        for g in np.flatnonzero(size > PAIRWISE):
            own = slice(first[g], first[g] + size[g])
            _Canopies().add(rep[own], sketch[own], forest)

    for batch in batches:
        if not batch.num_rows:
            continue
        key, rep, s1, s2 = (batch.column(i).to_numpy() for i in range(4))
        parts = [key, rep, np.stack([s1, s2], 1)]
        if open_key is not None:  # a key with more rows than a batch goes through its canopies block by block
            n = int(np.searchsorted(key != open_key, True)) if (key != open_key).any() else len(key)
            canopies.add(parts[1][:n], parts[2][:n], forest)
            parts = [x[n:] for x in parts]
            if not len(parts[0]):
                continue
            canopies, open_key = _Canopies(), None
        if held is not None:
            parts = [np.concatenate(x) for x in zip(held, parts)]
        cut = int(np.flatnonzero(parts[0] != parts[0][-1])[-1]) + 1 if parts[0][0] != parts[0][-1] else 0
        if cut:
            work(*(x[:cut] for x in parts))
        held = [x[cut:] for x in parts]
        if len(held[0]) > 50_000:
            open_key = held[0][0]
            canopies.add(held[1], held[2], forest)
            held = None
        if len(forest.parent) > 1_000_000:
            yield stars()
            forest = Forest()
    if held is not None:
        work(*held)
    yield stars()
    release()


def _intersections(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Sizes of intersections of sets[:left] with the rest, or of all with all where left is 0."""
    m = len(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    value = np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    count = np.diff(np.append(first, len(value)))
    per = np.repeat(count, count)
    shape = (left, m - left) if left else (m, m)
    out = np.zeros(shape, np.int64)
    light = np.flatnonzero((per > 1) & (per <= 64))
    v, r = value[light], row[light]
    for d in range(1, 64):
        same = np.flatnonzero(v[d:] == v[:-d]) if d < len(v) else light[:0]
        if not len(same):
            break
        a, b = r[same], r[same + d]
        if left:
            across = (a < left) & (b >= left)
            np.add.at(out, (a[across], b[across] - left), 1)
        else:
            np.add.at(out, (a, b), 1)
    heavy = np.flatnonzero(per > 64)
    if len(heavy):
        column = np.cumsum(np.concatenate([[0], (value[heavy][1:] != value[heavy][:-1]).astype(np.int64)]))
        r = row[heavy]
        step = min(1 << 20, max(1, 4_000_000 // m))  # sums of so many ones are exact in single precision
        for at in range(0, int(column[-1]) + 1, step):
            part = slice(*np.searchsorted(column, [at, at + step]))
            dense = np.zeros((m, step), np.float32)
            dense[r[part], column[part] - at] = 1
            out += (dense[:left] @ dense[left:].T if left else dense @ dense.T).astype(np.int64)
    if not left:
        out = np.triu(out, 1)
        out += out.T
    return out


def reaches(inter: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """100 * |A & B| >= percent * |A | B| in integers, of sets with anything in common."""
    inter = inter.astype(np.int64)
    return (100 * inter >= percent * (a.astype(np.int64) + b.astype(np.int64) - inter)) & (inter > 0)


def _linked(ids: list[int], sets: list[np.ndarray], left: int, percent: int, forest: Forest) -> None:
    n = np.array([len(s) for s in sets], np.int64)
    a, b = (n[:left], n[left:]) if left else (n, n)
    link = reaches(_intersections(sets, left), a[:, None], b[None, :], percent)
    rows = np.flatnonzero(link.any(1))
    for i in rows.tolist():
        other = np.flatnonzero(link[i])
        if not left:
            other = other[other > i]
        for j in other.tolist():
            forest.join(ids[i], ids[left + j])


PACKED_SQL = "doc_id long, cluster long, tiles int, s1 long, s2 long, shingles binary"


def _pack(k: int):
    """Sets as sorted hashes; a text is hashed once, however many tiles it meets."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        value, off = _sets(batch, k)
        data = [value[a:b].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "cluster", "tiles", "s1", "s2")), pa.array(data, pa.binary())], names=["doc_id", "cluster", "tiles", "s1", "s2", "shingles"])

    return kernel


#: What a set is to the centre of its cluster: linked, near enough to be linked with what is linked, or neither.
LINKED, WITHIN, BEYOND = 0, 1, 2
MEASURED_SQL = "doc_id long, cluster long, tiles int, s1 long, s2 long, shingles binary, centre long, role int"


def _measure(percent: int):
    """Role of all sets against the centre that comes before them; input sorted by (cluster, tile, follows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, core = 0, np.zeros(0, U)
        for batch in batches:
            if not batch.num_rows:
                continue
            follows = batch.column("follows").to_numpy()
            ids = batch.column("doc_id").to_numpy()
            sets = [np.frombuffer(x, U) for x in batch.column("shingles").to_pylist()]
            role, of = np.full(len(ids), LINKED, np.int32), np.zeros(len(ids), np.int64)
            leads = np.flatnonzero(follows == 0).tolist()
            for a, b in zip([0, *leads], [*leads, len(ids)]):
                if a in leads:
                    centre, core = int(ids[a]), sets[a]
                    a += 1
                if a >= b:
                    continue
                size = np.array([len(x) for x in sets[a:b]], np.int64)
                value = np.concatenate(sets[a:b])
                hit = (core[np.minimum(np.searchsorted(core, value), len(core) - 1)] == value).astype(np.int64)
                inter = np.add.reduceat(hit, np.cumsum(size) - size)
                n = np.int64(len(core))
                near = reaches(inter, size, n, 2 * percent - 100) if percent > 50 else True
                role[a:b] = np.where(reaches(inter, size, n, percent), LINKED, np.where(near, WITHIN, BEYOND))
                of[a:b] = centre
            keep = pa.array(follows > 0)
            out = [batch.column(c).filter(keep) for c in ("doc_id", "cluster", "tiles", "s1", "s2", "shingles")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(of[follows > 0]), pa.array(role[follows > 0], pa.int32())], names=["doc_id", "cluster", "tiles", "s1", "s2", "shingles", "centre", "role"])
        release()

    return run


def _centres(rows: DataFrame) -> DataFrame:
    """cluster, tiles, doc_id, shingles of the most central set of each cluster: it shares most sketch bytes with the most frequent ones."""
    byte = lambda nth: F.shiftright(F.col("s1" if nth < 8 else "s2"), 8 * (nth % 8)).bitwiseAND(255).cast("int")
    sketch = F.array(*map(byte, range(SKETCH)))
    counts = rows.select("cluster", F.posexplode(sketch).alias("place", "byte")).groupBy("cluster", "place", "byte").count()
    modes = counts.groupBy("cluster", "place").agg(F.max(F.struct("count", "byte"))["byte"].alias("byte"))
    modes = modes.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "byte"))), lambda x: x["byte"]).alias("modes"))
    shared = F.aggregate(F.zip_with(sketch, "modes", lambda a, b: (a == b).cast("int")), F.lit(0), lambda a, b: a + b)
    rank = F.struct(shared.alias("shared"), (-F.col("doc_id")).alias("id"), F.xxhash64("shingles").alias("hash"))
    return rows.join(modes, "cluster").groupBy("cluster", "tiles").agg(F.max_by(F.struct("doc_id", "shingles"), rank).alias("top")).select("cluster", "tiles", "top.*")


def _tiles(weight: str = "shingles") -> Column:
    return F.greatest(F.lit(1), F.ceil(F.sum(F.greatest(F.length(weight) / 8, F.lit(LEAST))) / TILE)).cast("int")


MET = ["doc_id", "shingles", "cluster", "nth", "ta", "tb", "side"]


def _own_tile(tiles: str) -> Column:
    return F.pmod(F.xxhash64("doc_id", "shingles"), F.col(tiles)).cast("int")


def _all_pairs(rows: DataFrame, nth: int) -> DataFrame:
    """rows (cluster, doc_id, shingles, tiles) at each pair of their tile with a tile of the cluster."""
    each = rows.withColumn("tile", _own_tile("tiles")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    side = F.when(F.col("tile") == F.col("other"), 0).when(F.col("tile") < F.col("other"), 1).otherwise(2)
    return each.select("doc_id", "shingles", "cluster", F.lit(nth).alias("nth"), F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), side.alias("side"))


def _across(rows: DataFrame, nth: int) -> DataFrame:
    """Sets linked with a centre at each pair of their tile with a tile of the sets within reach, and the other way round."""
    of = lambda role: F.when(F.col("role") == role, F.col("shingles"))
    few = rows.where(F.col("role") != BEYOND)
    weights = few.groupBy("cluster").agg(_tiles_of(of(LINKED)).alias("na"), _tiles_of(of(WITHIN)).alias("nb")).where("na > 0 and nb > 0")
    each = few.join(weights, "cluster").withColumn("tile", F.when(F.col("role") == LINKED, _own_tile("na")).otherwise(_own_tile("nb")))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("role") == LINKED, F.col("nb")).otherwise(F.col("na")) - 1)))
    left = F.col("role") == LINKED
    return each.select("doc_id", "shingles", "cluster", F.lit(nth).alias("nth"), F.when(left, F.col("tile")).otherwise(F.col("other")).alias("ta"), F.when(left, F.col("other")).otherwise(F.col("tile")).alias("tb"), F.when(left, 1).otherwise(2).alias("side"))


def _tiles_of(shingles: Column) -> Column:
    return F.ceil(F.coalesce(F.sum(F.greatest(F.length(shingles) / 8, F.lit(LEAST)) * shingles.isNotNull().cast("int")), F.lit(0)) / TILE).cast("int")


def _verify(percent: int):
    """Spanning edges of exact links in each (cluster, nth, ta, tb), of sides 1 and 2 only across; input sorted by those and side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        now, ids, sides, sets = None, [], [], []

        def close() -> None:
            left = sum(s == 1 for s in sides)
            if len(ids) > 1 and (sides[-1] == 0 or 0 < left < len(ids)):
                _linked(ids, sets, left, percent, forest)

        for batch in batches:
            for doc, packed, *group, side in zip(*(batch.column(c).to_pylist() for c in MET)):
                if group != now:
                    close()
                    now, ids, sides, sets = group, [], [], []
                ids.append(doc)
                sides.append(side)
                sets.append(np.frombuffer(packed, U))
            if len(forest.parent) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in forest.stars()], schema=EDGES)
                forest = Forest()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in forest.stars()], schema=EDGES)
        release()

    return run


def _exact_links(packed: DataFrame, percent: int, parts: int) -> tuple[DataFrame, list[DataFrame]]:
    """Edges (a, b) that connect what exact links connect within clusters, and the tables they are read from."""
    meets = [packed.where("tiles = 1").select("doc_id", "shingles", "cluster", F.lit(-1).alias("nth"), F.lit(0).alias("ta"), F.lit(0).alias("tb"), F.lit(0).alias("side"))]
    edges, tables, left = [], [], packed.where("tiles > 1")
    for nth in range(ROUNDS):
        if left.limit(1).count() == 0:
            break
        centres = _centres(left).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        none = F.lit(0).cast("long")
        lead = centres.select("doc_id", "cluster", "tiles", none.alias("s1"), none.alias("s2"), "shingles", "tile", F.lit(0).alias("follows"))
        rows = left.select("doc_id", "cluster", "tiles", "s1", "s2", "shingles", _own_tile("tiles").alias("tile"), F.lit(1).alias("follows"))
        dealt = rows.unionByName(lead).repartition(parts, "cluster", "tile").sortWithinPartitions("cluster", "tile", "follows")
        told = materialize(dealt.mapInArrow(_measure(percent), MEASURED_SQL))
        tables.append(told)
        edges.append(told.where((F.col("role") == LINKED) & (F.col("centre") != F.col("doc_id"))).select(F.col("centre").alias("a"), F.col("doc_id").alias("b")))
        meets.append(_across(told, nth))
        left = told.where(F.col("role") != LINKED).drop("centre", "role")
    weights = left.groupBy("cluster").agg(_tiles().alias("tiles"))
    meets.append(_all_pairs(left.drop("tiles").join(weights, "cluster"), ROUNDS))
    met = reduce(DataFrame.unionByName, meets).repartition(parts, "cluster", "nth", "ta", "tb").sortWithinPartitions("cluster", "nth", "ta", "tb", "side")
    exact = met.select(*MET).mapInArrow(_verify(percent), "a long, b long")
    return reduce(DataFrame.unionByName, [exact, *edges]), tables


def near_duplicates(documents: DataFrame, percent: int = 85, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of documents (doc_id, text).

    Words are runs of bytes other than the six ASCII spaces, with A-Z lower-cased; a set holds the
    distinct k-word shingles, or the whole sequence of a shorter text. Documents are linked when
    100 * |A & B| >= percent * |A | B|, confirmed on full sets. A null text or one without words
    has an empty set and no links. Rows that share a doc_id are one document with the links of all
    of them; a row with a null doc_id is linked with nothing, has a null component and is kept. A
    very long text is one set of all its shingles. Of equal similarities all are links, so no tie has
    to be broken; the smallest id of a group is kept. Other columns are ignored. An empty table gives
    an empty table.
    """
    spark = documents.sparkSession
    parts = partitions(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = materialize(arrow_map(docs, _sign(k), "doc_id long, n long, f1 long, f2 long, s1 long, s2 long, keys binary"))
    sets = found.where("n > 0 and doc_id is not null")
    classes = sets.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("s1", "s2", "keys")))
    tables = arrow_map(classes.select("rep", "s1", "s2", "keys"), _tables, "key long, rep long, s1 long, s2 long")
    coarse = components(tables.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_cluster, "a long, b long"))
    members = coarse.unionByName(coarse.select(F.col("component").alias("node"), "component").distinct())
    sizes = sets.groupBy(F.col("doc_id").alias("node")).agg(F.max(F.struct("n", "s1", "s2")).alias("top")).select("node", "top.*")
    members = members.join(sizes, "node")
    weight = members.groupBy("component").agg(F.ceil(F.sum(F.greatest("n", F.lit(LEAST))) / TILE).cast("int").alias("tiles"))
    members = materialize(members.join(weight, "component").select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"), "tiles", "s1", "s2"))
    packed = materialize(arrow_map(docs.join(members.hint("shuffle_hash"), "doc_id").select("doc_id", "cluster", "tiles", "s1", "s2", "text"), _pack(k), PACKED_SQL).where(F.length("shingles") > 0))
    exact, measured = _exact_links(packed, percent, parts)
    copies = sets.join(classes.select("f1", "f2", "n", "rep"), ["f1", "f2", "n"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    groups = components(exact.unionByName(copies))
    for done in (members, packed, coarse, *measured):
        discard(done)
    out = found.select("doc_id", F.col("n").alias("n_shingles")).join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
