"""Cropped or edited copies of images by local descriptors.

Corners are found on a small pyramid; around each, brightness comparisons along pairs of points,
turned by the patch's intensity centroid, give 256 bits. Parts of the bits are keys of hash tables.
All rows of a table bucket meet, those of a large bucket in pairs of tiles over many tasks. A pair of close descriptors votes for
the turn, the scale and the shift that take one image to the other; images with VOTES corners that
agree are linked, and links are closed into groups.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import arrow_map, components, materialize, partitions, release

#: Pyramid scales, and the corners kept on each in every CELL x CELL pixels, strongest first: rows grow with the area.
SCALES, CORNERS = (1.0, 0.7071, 0.5), (20, 12, 8)
CELL = 64
TABLES, KEY_BITS = 6, 48
#: Of the first 128 bits of two descriptors, so many may differ.
HAMMING, VOTES = 28, 4
PATCH = 9
#: Rows of a bucket that meet in one task.
TILE = 1024
#: Votes fall into bins of so many pixels, on two grids shifted by half a bin.
SHIFT, TURNS = 8, 12
_rng = np.random.default_rng(11)
_PAIRS = np.clip(_rng.normal(0, PATCH / 2, (256, 4)), -PATCH, PATCH)
_BITS = np.stack([_rng.permutation(256)[:KEY_BITS] for _ in range(TABLES)])
#: The bits of each table's key, packed as descriptors are.
_MASKS = np.packbits((np.arange(256)[None, None, :] == _BITS[:, :, None]).any(1), axis=1).view(np.int64)
WORDS = ("d0", "d1", "d2", "d3")

#: A corner's place is one long: x and y in eighths of a pixel, the angle in 2**14 parts of a turn, the scale's number and,
#: from bit 60 on, the side of a pair of tiles. Rows are shuffled once for each table, so they are kept narrow.
UNIT, PLACE_BITS, ANGLE_BITS = 8, 22, 14
FOUND = pa.schema([("image_id", pa.int64()), ("corner", pa.int32()), ("place", pa.int64()), *[(w, pa.int64()) for w in WORDS], ("keys", pa.list_(pa.int64()))])
FOUND_SQL = "image_id long, corner int, place long, d0 long, d1 long, d2 long, d3 long, keys array<bigint>"
#: A vote is one long: from the low end the shifts in x and y in half bins (16 bits each, farther ones count as the farthest),
#: the turn in half bins (5), the change of scale (3) and the corner. Both grids follow from half bins.
#: Pairs a, b and their votes travel as packed blocks, each of one of the parts that image pairs are dealt to by a hash.
BLOCKS = pa.schema([("part", pa.int32()), ("n", pa.int32()), ("block", pa.binary())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: A part has about so many votes at most (their number is bounded by the counts of the buckets), a block comes from so many.
PART_VOTES, BLOCK_VOTES = 1 << 20, 1 << 21
FARTHEST = 1 << 15
#: So many hot buckets go to the tasks whole; more are joined by a shuffle.
HOT_BUCKETS = 100_000


def read_pnm(data: bytes | None) -> np.ndarray | None:
    """Grey values of a binary PGM or PPM image; None for anything else."""
    if not data or data[:2] not in (b"P5", b"P6"):
        return None
    fields, at = [], 2
    try:
        while len(fields) < 3:
            while data[at : at + 1].isspace():
                at += 1
            if data[at : at + 1] == b"#":
                at = data.index(b"\n", at)
                continue
            end = at
            while data[end : end + 1].isdigit():
                end += 1
            fields.append(int(data[at:end]))
            at = end
        width, height, top = fields
        colours = 1 if data[:2] == b"P5" else 3
        if top > 255:
            return None
        flat = np.frombuffer(data, np.uint8, width * height * colours, at + 1).astype(np.float32)
    except (ValueError, IndexError):
        return None
    return flat.reshape(height, width) if colours == 1 else flat.reshape(height, width, 3) @ np.array([0.299, 0.587, 0.114], np.float32)


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Mean over (2r+1) squares, edges repeated."""
    n = 2 * r + 1
    sums = np.cumsum(np.cumsum(np.pad(x, ((r + 1, r), (r + 1, r)), "edge"), 0, dtype=np.float64), 1)
    return ((sums[n:, n:] - sums[:-n, n:] - sums[n:, :-n] + sums[:-n, :-n]) / (n * n)).astype(np.float32)


def _scaled(x: np.ndarray, s: float) -> np.ndarray:
    if s == 1.0:
        return x
    h, w = max(1, round(x.shape[0] * s)), max(1, round(x.shape[1] * s))
    smooth = _box(x, 1)
    yy, xx = np.linspace(0, x.shape[0] - 1, h), np.linspace(0, x.shape[1] - 1, w)
    y0, x0 = np.floor(yy).astype(int), np.floor(xx).astype(int)
    y1, x1 = np.minimum(y0 + 1, x.shape[0] - 1), np.minimum(x0 + 1, x.shape[1] - 1)
    fy, fx = (yy - y0)[:, None], (xx - x0)[None, :]
    return (smooth[np.ix_(y0, x0)] * (1 - fy) * (1 - fx) + smooth[np.ix_(y0, x1)] * (1 - fy) * fx + smooth[np.ix_(y1, x0)] * fy * (1 - fx) + smooth[np.ix_(y1, x1)] * fy * fx).astype(np.float32)


def describe(image: np.ndarray) -> tuple[np.ndarray, ...]:
    """x, y, angle, scale and 256 bits (bool) of each corner, positions in pixels of the image."""
    out: list[tuple] = []
    margin = PATCH + 3
    for s, most in zip(SCALES, CORNERS):
        g = _scaled(image, s)
        if min(g.shape) <= 2 * margin:
            continue
        smooth = _box(g, 1)
        dy, dx = np.gradient(smooth)
        a, b, c = _box(dx * dx, 2), _box(dx * dy, 2), _box(dy * dy, 2)
        r = a * c - b * b - 0.05 * (a + c) ** 2
        inner = r[margin:-margin, margin:-margin]
        around = np.stack([r[margin + i : r.shape[0] - margin + i, margin + j : r.shape[1] - margin + j] for i in (-1, 0, 1) for j in (-1, 0, 1)]).max(0)
        yy, xx = np.nonzero((inner >= around) & (inner > 1.0))
        if not len(yy):
            continue
        cell = (yy + margin) // CELL * (g.shape[1] // CELL + 1) + (xx + margin) // CELL
        order = np.lexsort((-inner[yy, xx], cell))
        cell = cell[order]
        order = order[np.arange(len(cell)) - np.searchsorted(cell, cell) < most]
        yy, xx = yy[order] + margin, xx[order] + margin
        d = np.arange(-PATCH, PATCH + 1)
        disc = (d[:, None] ** 2 + d[None, :] ** 2) <= PATCH * PATCH
        patch = smooth[yy[:, None, None] + d[None, :, None], xx[:, None, None] + d[None, None, :]] * disc
        patch = patch - (patch.sum((1, 2)) / disc.sum())[:, None, None] * disc
        angle = np.arctan2((patch * d[None, :, None]).sum((1, 2)), (patch * d[None, None, :]).sum((1, 2)))
        cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
        wide = _box(g, 2)

        def at(px: np.ndarray, py: np.ndarray) -> np.ndarray:
            u = np.rint(xx[:, None] + cos * px - sin * py).astype(int)  # noqa: B023
            v = np.rint(yy[:, None] + sin * px + cos * py).astype(int)  # noqa: B023
            return wide[np.clip(v, 0, g.shape[0] - 1), np.clip(u, 0, g.shape[1] - 1)]  # noqa: B023

        bits = at(_PAIRS[:, 0], _PAIRS[:, 1]) < at(_PAIRS[:, 2], _PAIRS[:, 3])
        out.append((xx * (image.shape[1] / g.shape[1]), yy * (image.shape[0] / g.shape[0]), angle, np.full(len(xx), s), bits))
    if not out:
        none = np.zeros(0)
        return none, none, none, none, np.zeros((0, 256), bool)
    return tuple(np.concatenate(x) for x in zip(*out))


def _placed(x: np.ndarray, y: np.ndarray, angle: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """x, y, angle and scale as one long; places beyond 2**22 eighths of a pixel count as there."""
    top, turns = (1 << PLACE_BITS) - 1, 1 << ANGLE_BITS
    px, py = (np.minimum(np.rint(z * UNIT), top).astype(np.int64) for z in (x, y))
    turn = np.rint(angle / (2 * math.pi) * turns).astype(np.int64) % turns
    number = np.abs(np.asarray(SCALES)[None, :] - scale[:, None]).argmin(1)
    return px | py << PLACE_BITS | turn << 2 * PLACE_BITS | number << 2 * PLACE_BITS + ANGLE_BITS


def _place(place: np.ndarray) -> tuple[np.ndarray, ...]:
    """side, x, y, angle and scale of packed places."""
    low, at = (1 << PLACE_BITS) - 1, 2 * PLACE_BITS
    angle = (place >> at & (1 << ANGLE_BITS) - 1) * (2 * math.pi / (1 << ANGLE_BITS))
    return place >> 60, (place & low) / UNIT, (place >> PLACE_BITS & low) / UNIT, angle, np.asarray(SCALES)[place >> at + ANGLE_BITS & 3]


def _describe(batch: pa.RecordBatch) -> pa.RecordBatch:
    parts = []
    for image_id, data in zip(batch.column("image_id").to_pylist(), batch.column("image").to_pylist()):
        image = read_pnm(data)
        if image is not None:
            x, y, angle, scale, bits = describe(image)
            parts.append((np.full(len(x), image_id), np.arange(len(x)), x, y, angle, scale, bits))
    if not parts:
        return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in FOUND], schema=FOUND)
    image_id, corner, x, y, angle, scale, bits = (np.concatenate(z) for z in zip(*parts))
    words = np.ascontiguousarray(np.packbits(bits, axis=1)).view(np.int64)
    keys = np.stack([bits[:, own].astype(np.int64) @ (1 << np.arange(KEY_BITS, dtype=np.int64)) for own in _BITS], 1)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * TABLES, pa.int32()), pa.array(keys.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(image_id, pa.int64()), pa.array(corner, pa.int32()), pa.array(_placed(x, y, angle, scale)), *(pa.array(words[:, i].copy()) for i in range(4)), lists], schema=FOUND)


def _matches(rows: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Close pairs of two images in each bucket of rows, sorted by bucket; of sides 1 and 2 only across.

    A pair whose keys agree in several tables is made by the first of them alone.
    """
    bucket, image_id, slot, place, *words = rows
    corner, table = slot >> 3, slot & 7
    side, x, y, angle, scale = _place(place)
    at, lag = np.arange(len(bucket) - 1), 1
    held, size = [], 0
    while len(at):
        at = at[at + lag < len(bucket)]
        at = at[bucket[at + lag] == bucket[at]]
        i, j = at, at + lag
        far = sum(np.bitwise_count((d[i] ^ d[j]).view(np.uint64)).astype(int) for d in words[:2])
        good = (far <= HAMMING) & (image_id[i] != image_id[j]) & ((side[i] == 0) | (side[i] != side[j]))
        i, j = i[good], j[good]
        differ = np.stack([d[i] ^ d[j] for d in words], 1)
        again = np.zeros(len(i), bool)
        for t, mask in enumerate(_MASKS):
            again |= (t < table[i]) & ~(differ & mask).any(1)
        i, j = i[~again], j[~again]
        swap = image_id[i] > image_id[j]
        a, b = np.where(swap, j, i), np.where(swap, i, j)
        turn, by = angle[b] - angle[a], scale[a] / scale[b]
        cos, sin = np.cos(turn), np.sin(turn)
        dx, dy = x[b] - by * (cos * x[a] - sin * y[a]), y[b] - by * (sin * x[a] + cos * y[a])
        sx, sy = (np.clip(np.floor(z * (2 / SHIFT)), -FARTHEST, FARTHEST - 1).astype(np.int64) + FARTHEST for z in (dx, dy))
        turned = np.floor(turn * (TURNS / math.pi)).astype(np.int64) % (2 * TURNS)
        size_by = np.rint(2 * np.log2(by)).astype(np.int64) + 4
        held.append(np.stack([image_id[a], image_id[b], sx | sy << 16 | turned << 32 | size_by << 37 | corner[b].astype(np.int64) << 40]))
        size += len(a)
        lag += 1
        if size and (size > 50_000 or not len(at)):
            yield np.concatenate(held, 1)
            held, size = [], 0


def _packed(votes: np.ndarray, parts: int) -> pa.RecordBatch:
    """Rows a, b, vote as one block for each part, bytes of equal weight side by side."""
    mixed = (votes[0].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ votes[1].view(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    part = ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)
    order = np.lexsort((votes[1], votes[0], part))
    part, votes = part[order], votes[:, order]
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    codec, blocks = pa.Codec("zstd", 1), []
    for lo, hi in zip(starts, np.r_[starts[1:], len(part)]):
        a, b, vote = votes[:, lo:hi]
        rows = np.stack([np.diff(a, prepend=0), b - a, vote])
        blocks.append(codec.compress(np.ascontiguousarray(rows.reshape(-1).view(np.uint8).reshape(-1, 8).T).tobytes(), asbytes=True))
    sizes = np.diff(np.r_[starts, len(part)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(part[starts]), pa.array(sizes), pa.array(blocks, pa.binary())], schema=BLOCKS)


def _unpacked(n: int, block: bytes) -> np.ndarray:
    plain = pa.Codec("zstd").decompress(block, 24 * n, asbytes=True)
    a, b, vote = np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(8, -1).T).view(np.int64).reshape(3, n)
    a = np.cumsum(a)
    return np.stack([a, a + b, vote])


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Marks the first of equal neighbours."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _agreed(votes: np.ndarray) -> np.ndarray:
    """The pairs a, b for which VOTES corners fall into one bin of some grid, from all their votes."""
    votes = votes[:, np.lexsort(votes[::-1])]
    a, b, vote = votes[:, _starts(*votes)]
    first = _starts(a, b)
    pair = np.cumsum(first) - 1
    a, b = a[first], b[first]
    # most pairs have too few votes to agree
    enough = np.bincount(pair, minlength=len(a))[pair] >= VOTES
    pair, vote = pair[enough], vote[enough]
    part = lambda at, bits: vote >> at & (1 << bits) - 1
    dx, dy, turn, size, corner = part(0, 16), part(16, 16), part(32, 5), part(37, 3), vote >> 40
    linked = np.zeros(len(a), bool)
    for gx, gy, gt in itertools.product((0, 1), repeat=3):
        bin_ = size << 38 | (turn + gt) // 2 % TURNS << 34 | (dy + gy) // 2 << 17 | (dx + gx) // 2
        order = np.lexsort((corner, bin_, pair))
        p, k, c = pair[order], bin_[order], corner[order]
        once = _starts(p, k, c)
        p, k = p[once], k[once]
        starts = np.flatnonzero(_starts(p, k))
        linked[p[starts][np.diff(np.r_[starts, len(p)]) >= VOTES]] = True
    return np.stack([a[linked], b[linked]])


def _meeting(parts: int):
    """All close pairs of each bucket; the last bucket of a batch waits for the next batch."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                rows = [np.concatenate(c) for c in zip(held, rows)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            yield from _matches([c[:cut] for c in rows])
            held = [c[cut:].copy() for c in rows]
        if held is not None:
            yield from _matches(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for votes in found(batches):
            held.append(votes)
            size += votes.shape[1]
            if size >= BLOCK_VOTES:
                yield _packed(np.concatenate(held, 1), parts)
                held, size = [], 0
        if size:
            yield _packed(np.concatenate(held, 1), parts)
        release()

    return meet


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each part, from blocks sorted by part."""

    def links() -> pa.RecordBatch:
        pairs = _agreed(np.concatenate(held, 1))
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], schema=LINKS)

    held: list[np.ndarray] = []
    now = None
    for batch in batches:
        for part, n, block in zip(*(c.to_pylist() for c in batch.columns)):
            if held and part != now:
                yield links()
                held = []
            now = part
            held.append(_unpacked(n, block))
    if held:
        yield links()
    release()


def image_copies(images: DataFrame) -> DataFrame:
    """image_id, n_links, component_id, kept for every row of images (image_id, image: binary PGM or PPM).

    n_links counts the image classes found linked directly plus exact copies; component_id is the
    smallest id reachable and kept marks it. Images that are null, empty, no PNM or without corners
    link with equal bytes only (null images with nothing). Rows that share an id are one image with
    the links of all; a null id links with nothing, has a null component and is kept. Other columns
    are ignored; an empty table gives an empty table.
    """
    rows = images.select(F.col("image_id").cast("long").alias("image_id"), "image").withColumn("sha", F.sha2("image", 256))
    usable = rows.where("image_id is not null and image is not null")
    classes = usable.groupBy("sha").agg(F.min("image_id").alias("rep"), F.count("*").alias("copies"), F.first("image").alias("image"))
    found = materialize(arrow_map(classes.select(F.col("rep").alias("image_id"), "image"), _describe, FOUND_SQL))
    keyed = found.select("*", F.posexplode("keys").alias("table", "key")).drop("keys")
    meetings = Observation()
    counts = keyed.groupBy("table", "key").count().observe(meetings, F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("n"))
    large = materialize(counts.where(F.col("count") > TILE).select("table", "key", F.ceil(F.col("count") / TILE).cast("int").alias("tiles")))
    # rows of a large bucket go to all pairs of their tile with another, so no task holds a bucket
    few = F.broadcast(large) if large.count() <= HOT_BUCKETS else large
    dealt = keyed.join(few, ["table", "key"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("image_id", "corner"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    side = F.when(F.col("tile") == F.col("other"), 0).when(F.col("tile") < F.col("other"), 1).otherwise(2).cast("long")
    tiled = dealt.select(F.xxhash64("table", "key", F.least("tile", "other"), F.greatest("tile", "other")).alias("bucket"), "image_id", (F.col("corner") * 8 + F.col("table")).alias("slot"), F.col("place").bitwiseOR(F.shiftleft(side, 60)).alias("place"), *WORDS)
    tasks = partitions(images.sparkSession)
    parts = int(min(max(4 * tasks, (meetings.get["n"] or 0) // PART_VOTES + 1), 1 << 30))
    met = tiled.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_meeting(parts), "part int, n int, block binary")
    links = materialize(met.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(_tally, "a long, b long"))
    degree = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("rep")).count()
    members = usable.select("image_id", "sha").join(classes.select("sha", "rep", "copies"), "sha")
    groups = components(links.unionByName(members.where("rep <> image_id").select(F.col("rep").alias("a"), F.col("image_id").alias("b"))))
    known = classes.select("sha", "rep", "copies").join(degree, "rep", "left").select("sha", (F.col("copies") - 1 + F.coalesce("count", F.lit(0))).alias("n_links"))
    out = rows.select("image_id", "sha").join(known, "sha", "left").join(groups.withColumnRenamed("node", "image_id"), "image_id", "left")
    out = out.withColumn("component_id", F.coalesce("component", "image_id"))
    return out.select("image_id", F.when(F.col("image_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("image_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def scene(seed: int, size: int = 64) -> np.ndarray:
    """A drawing of overlapping boxes."""
    r = np.random.default_rng(seed)
    out = np.full((size, size), r.uniform(60, 190))
    for x, y, w, h, v in zip(r.integers(0, size, 40), r.integers(0, size, 40), r.integers(4, 22, 40), r.integers(4, 22, 40), r.uniform(0, 255, 40)):
        out[y : y + h, x : x + w] = v
    return out


def edited(image: np.ndarray, kind: int, seed: int) -> np.ndarray:
    """kind 1: a crop of four fifths; 2: other contrast and noise; else unchanged."""
    r = np.random.default_rng(seed)
    if kind == 1:
        n = image.shape[0] * 4 // 5
        y, x = r.integers(0, image.shape[0] - n + 1, 2)
        return image[y : y + n, x : x + n]
    if kind == 2:
        return np.clip((image - 128) * r.uniform(0.7, 0.95) + 128 + r.uniform(-15, 15) + r.normal(0, 2, image.shape), 0, 255)
    return image


def to_pgm(image: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (image.shape[1], image.shape[0]) + image.astype(np.uint8).tobytes()


def rendered(vectors: DataFrame) -> DataFrame:
    """(image_id, image) for each row of vectors (vec_id): a stand-in media column, as the tables hold no images.

    Of 256 ids from a multiple of 256 on, i, i+64 and i+128 show one scene (whole, cropped, other contrast), i+192 one of
    its own, for i below 64: copies are far apart in order of id. A null id has a null image.
    """

    def draw(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_pylist()
        images = [None if i is None else to_pgm(edited(scene((i // 256 * 64 + i % 64) * 2 + (i % 256 // 64 == 3)), i % 256 // 64, i)) for i in ids]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(images, pa.binary())], names=["image_id", "image"])

    return arrow_map(vectors.select(F.abs(F.col("vec_id")).cast("long").alias("image_id")), draw, "image_id long, image binary")
