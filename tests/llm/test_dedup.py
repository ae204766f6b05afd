import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from seqsieve.llm import common, embedding_dedup, image_copies as copies, kernels, minhash_dedup, suffix_dedup
from seqsieve.llm.embedding_dedup import near_vectors
from seqsieve.llm.image_copies import edited, image_copies, read_pnm, rendered, scene, to_pgm
from seqsieve.llm.minhash_dedup import near_duplicates
from seqsieve.llm.suffix_dedup import remove_repeats

R = random.Random(7)
VOCABULARY = ["".join(R.choice("abcdeéß日🙂") for _ in range(R.randrange(1, 9))) for _ in range(400)]
PROSE = lambda n: " ".join(R.choice(VOCABULARY) for _ in range(n))
SCHEMA = "doc_id long, text string, component string, k1 long"


def frame(spark, rows, schema=SCHEMA):
    width = schema.count(",") + 1
    return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema).repartition(3)


def removed(texts, length):
    count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        out.append(cover)
    return out


def spans(cover):
    edge = [i for i in range(len(cover) + 1) if (cover[i] if i < len(cover) else 0) != (cover[i - 1] if i else 0)]
    return list(zip(edge[::2], edge[1::2]))


@pytest.mark.parametrize("length", [200, 40])
def test_suffix_dedup_equals_brute_force(spark, length):
    line, passage, page = PROSE(4), PROSE(60), PROSE(300)
    texts = [None, "", "a", "x" * 5000, "ab" * 900, page, page, page[:700] + "!" + page[700:], PROSE(5) + passage + PROSE(9), passage[:260], passage + passage, (line + "\n") * 80, PROSE(2000)]
    texts += [PROSE(R.randrange(1, 80)) + passage[R.randrange(50) :] + PROSE(R.randrange(20)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "x" * 5000), (None, page)]
    got = collections.defaultdict(list)
    for r in remove_repeats(frame(spark, rows), length).collect():
        got[r.doc_id].append((r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)))
    data = [(i, (t or "").encode()) for i, t in rows]
    want = collections.defaultdict(list)
    for (i, b), cover in zip(data, removed([b for _, b in data], length)):
        want[i].append((len(b), spans(cover), bytes(x for x, c in zip(b, cover) if not c)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_suffix_dedup_over_segments_and_empty(spark, monkeypatch):
    page = PROSE(200).encode()
    text = np.frombuffer(page * 3, np.uint8)
    whole = suffix_dedup.runs(text, 100)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 256)
    parts = suffix_dedup.runs(text, 100)
    covered = lambda x: np.concatenate([np.arange(s, s + n) for s, n in zip(x[0], x[1])])
    assert (covered(whole) == covered(parts)).all() and len(covered(parts)) == len(text) - 99
    assert remove_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("segment", [150, 256, 4096])
def test_runs_do_not_depend_on_segments(monkeypatch, segment):
    text = np.random.default_rng(3).integers(97, 123, 20_000).astype(np.uint8)
    whole = suffix_dedup.runs(text, 100)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    assert all(np.array_equal(a, b) for a, b in zip(whole, suffix_dedup.runs(text, 100)))


def test_suffix_dedup_of_long_texts_equals_brute_force(spark):
    n = 2 * suffix_dedup.SEGMENT + 3000
    first, second = (np.random.default_rng(i).integers(97, 123, n).astype(np.uint8).tobytes() for i in (1, 2))
    at = suffix_dedup.SEGMENT - 300
    second = second[:5000] + first[at : at + 700] + second[5000:]
    texts = [first, second]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in remove_repeats(frame(spark, [(i, t.decode()) for i, t in enumerate(texts)])).collect()}
    assert got == {i: spans(cover) for i, cover in enumerate(removed(texts, 200))} and got[1] == [(5000, 5700)]


def test_suffix_dedup_cuts_a_hot_string_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "partitions", lambda spark: 40)
    passage = PROSE(60).encode()[:230].decode("utf-8", "ignore")
    texts = [PROSE(3) + str(i) + passage[: 100 + i % 9] + "|" + str(i % 50) + passage + str(i) for i in range(150)] + [passage] * 40
    got = {r.doc_id: (r.n_bytes, [tuple(s) for s in r.spans]) for r in remove_repeats(frame(spark, list(enumerate(texts))), 60).collect()}
    data = [t.encode() for t in texts]
    assert got == {i: (len(b), spans(cover)) for i, (b, cover) in enumerate(zip(data, removed(data, 60)))}


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def closed(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def edits(words, n):
    words = list(words)
    for _ in range(n):
        words[R.randrange(len(words))] = R.choice(VOCABULARY)
    return " ".join(words)


@pytest.mark.parametrize("tile,pairwise", [(100_000, 16), (4_000, 2)])
def test_minhash_equals_brute_force(spark, monkeypatch, tile, pairwise):
    monkeypatch.setattr(minhash_dedup, "TILE", tile)
    monkeypatch.setattr(minhash_dedup, "PAIRWISE", pairwise)
    base, other = PROSE(240).split(), PROSE(100).split()
    texts = [None, "", " \n", "one", "One", "two words", "a b c d e", "A B  c d\te", " ".join(base), *[edits(base, R.randrange(1, 9)) for _ in range(60)], *[edits(other, R.randrange(4)) for _ in range(8)], *[PROSE(30) for _ in range(10)], PROSE(9000)]
    rows = [(i * 3 % 997, t) for i, t in enumerate(texts)] + [(500, " ".join(base)), (500, " ".join(base)), (None, " ".join(base))]
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    items = list(sets.items())
    linked = [(a, b) for k, (a, x) in enumerate(items) for b, y in items[k + 1 :] if x and y and 100 * len(x & y) >= 85 * len(x | y)]
    group = closed(sets, linked)
    got = near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), group[r.doc_id], group[r.doc_id] == r.doc_id), r
    assert len(set(group.values())) < len(group) - 20
    assert near_duplicates(frame(spark, [])).count() == 0


def test_canopies_pass_a_large_key_in_blocks():
    forest, canopies = common.Forest(), minhash_dedup._Canopies()
    r = np.random.default_rng(0)
    centre = r.integers(0, 2**62, (3, 2))
    for block in range(4):
        which = r.integers(0, 3, 500)
        canopies.add(np.arange(block * 500, block * 500 + 500), centre[which], forest)
    assert len(canopies.ids) == 3 and len({forest.find(x) for x in forest.parent}) == 3


def test_components(spark):
    n = 300
    chain = [(i, i + 1) for i in range(0, n - 1)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    R.shuffle(chain)
    edges = spark.createDataFrame(chain + star + [(5, 5), (1, 0)], "a long, b long").repartition(5)
    got = {r.node: r.component for r in common.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, n)}, **{1000 + i: 1000 for i in range(1, 50)}}
    assert common.components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [1024, 8])
def test_vectors_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    monkeypatch.setattr(embedding_dedup, "SIDE", max(3, tile // 2))
    r = np.random.default_rng(4)
    centre = r.normal(size=(6, 24))
    rows = []
    for i in range(240):
        v = centre[i % 6] + r.normal(size=24) * r.choice([0.05, 0.25, 0.4])
        rows.append((i, [float(np.float32(x)) for x in v], i % 3))
    rows += [(300 + i, rows[0][1], 0) for i in range(9)] + [(400, [2 * x for x in rows[0][1]], 0), (401, rows[0][1], None), (402, None, 0), (403, [0.0] * 24, 0), (404, [float("nan")] * 24, 0), (405, [None] * 24, 0), (406, [], 0), (407, rows[0][1][:12], 0), (None, rows[0][1], 0), (408, [float("inf")] * 24, 0), (0, rows[0][1], 0)]
    good = [(n, i, np.array(v, float), label) for n, (i, v, label) in enumerate(rows) if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, count = [], collections.Counter()
    for k, (n, i, v, a) in enumerate(good):
        for m, j, u, b in good[k + 1 :]:
            if a == b and len(u) == len(v) and u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= 0.93:
                links.append((i, j))
                count[n] += 1
                count[m] += 1
    group = closed({i for i, *_ in rows if i is not None}, links)
    got = near_vectors(frame(spark, rows, "vec_id long, embedding array<float>, label int, component long")).collect()
    want = sorted(((i, count[n], group.get(i), i is None or group[i] == i) for n, (i, *_) in enumerate(rows)), key=str)
    assert sorted((tuple(x) for x in got), key=str) == want and len(links) > 300
    assert near_vectors(frame(spark, [], "vec_id long, embedding array<float>, label int")).count() == 0


def test_rows_of_one_vector_id_count_their_own_links(spark, monkeypatch):
    rows = [(5, [1.0, 0.0], 0), (5, [0.0, 1.0], 0), (6, [1.0, 0.01], 0), (7, [1.0, 0.0], 1), (5, [1.0, 0.001], 1)]
    for widest in (4096, 1):
        monkeypatch.setattr(embedding_dedup, "WIDEST", widest)
        got = near_vectors(frame(spark, rows, "vec_id long, embedding array<double>, label int")).collect()
        assert sorted(r.n_links for r in got if r.vec_id == 5) == [0, 1, 1] and {r.component_id for r in got} == {5}


def test_bounds_stop_early_and_stay_exact():
    r = np.random.default_rng(2)
    a, b = r.normal(size=(50, 40)), r.normal(size=(60, 40))
    b[:5] = a[:5] + 0.1 * r.normal(size=(5, 40))
    axes = np.linalg.qr(r.normal(size=(40, 40)))[0]
    cos = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    for t in (0.93, 0.2):
        assert (embedding_dedup.links(a, b, axes, t) == (cos >= t)).all()


def test_image_copies(spark):
    images = []
    for s in range(12):
        images += [(10 * s, to_pgm(scene(s))), (10 * s + 1, to_pgm(edited(scene(s), 1, s))), (10 * s + 2, to_pgm(edited(scene(s), 2, s))), (10 * s + 3, to_pgm(scene(s)))]
    flat = to_pgm(np.full((64, 64), 9.0))
    images += [(900, flat), (901, flat), (902, b"junk"), (903, None), (904, b""), (905, b"P5 9"), (None, to_pgm(scene(0))), (906, to_pgm(scene(99)[:12, :12]))]
    got = {r.image_id: r for r in image_copies(spark.createDataFrame(images, "image_id long, image binary")).collect()}
    assert len(got) == len(images)
    right = sum(got[10 * s + k].component_id == 10 * s for s in range(12) for k in range(4))
    assert right >= 46 and all(got[10 * s].kept for s in range(12))
    assert got[901].component_id == 900 and got[901].n_links == 1 and got[None].kept and got[None].component_id is None
    assert all(got[i].component_id == i and got[i].n_links == 0 for i in (902, 903, 904, 905, 906))
    assert read_pnm(b"P6 #c\n1 1 255\n" + bytes([255, 255, 255])).round().tolist() == [[255.0]]
    assert image_copies(rendered(spark.createDataFrame([], "vec_id long"))).count() == 0


def test_image_copies_meet_in_large_buckets(spark, monkeypatch):
    monkeypatch.setattr("seqsieve.llm.image_copies.TILE", 4)
    images = []
    for i in range(24):  # bytes differ, descriptors do not
        image = scene(3)
        image[0, 0] = i
        images.append((i, to_pgm(image)))
    got = {r.image_id: r for r in image_copies(spark.createDataFrame(images, "image_id long, image binary")).collect()}
    assert all((got[i].n_links, got[i].component_id) == (23, 0) for i in range(24)), got


def test_corners_of_a_crop_are_corners_of_a_large_image():
    for s in range(4):
        image = np.zeros((256, 256))
        for k in range(16):
            image[k // 4 * 64 : k // 4 * 64 + 64, k % 4 * 64 : k % 4 * 64 + 64] = 100 + (scene(16 * s + k) - 128) * (1.0 if k == 0 else 0.3)
        image = image.clip(0, 255).astype(np.uint8).astype(float)
        crop = image[100:228, 110:238]
        (ax, ay, *_, a), (bx, by, *_, b) = copies.describe(image), copies.describe(crop)
        close = (a[:, None, :128] != b[None, :, :128]).sum(2) <= copies.HAMMING
        place = (abs(ax[:, None] - bx - 110) < 3) & (abs(ay[:, None] - by - 100) < 3)
        assert (close & place).any(0).sum() >= 2 * copies.VOTES


def test_words_of_two_letters_do_not_collide():
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer(f"{word} {other} {word.upper()} {'é' * 50} b a".encode(), np.uint8)
    starts, ends, _ = kernels.words(data, np.array([0, len(data)]))
    h = kernels.word_hashes(data, starts, ends)
    assert h[0] == h[2] and len(set(h.tolist())) == 5
    assert (kernels.word_hashes(data, starts[2:], ends[2:]) == h[2:]).all()


def test_links_are_confirmed_in_integers():
    union, inter = 1_600_013, 1_360_011
    a = np.array([inter + 1], np.int64)
    assert not minhash_dedup.reaches(np.array([inter]), a, union + inter - a, 85).any()
    assert minhash_dedup.reaches(np.array([inter + 1]), np.array([union]), np.array([inter + 1]), 85).all()


def test_a_key_of_many_rows_loses_no_pair():
    r = np.random.default_rng(5)
    n, groups = 60_000, 40
    which = r.integers(0, groups, n)
    sketch = r.integers(0, 256, (groups, 16)).astype(np.uint8)[which]
    for i in range(n):  # two of a group agree in 8 of 16 bytes at least
        sketch[i, r.integers(0, 16, r.integers(0, 5))] = r.integers(0, 256)
    s = sketch.view(np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(np.ones(len(x), np.int64)), pa.array(x), pa.array(s[x, 0].copy()), pa.array(s[x, 1].copy())], schema=minhash_dedup.TABLE) for x in np.array_split(np.arange(n), 9)]
    forest = common.Forest()
    for batch in minhash_dedup._cluster(iter(batches)):
        for a, b in zip(*(c.to_pylist() for c in batch.columns)):
            forest.join(a, b)
    assert all(len({forest.find(int(i)) for i in np.flatnonzero(which == g)}) == 1 for g in range(groups))


def test_canopies_join_what_is_close_to_a_dropped_row():
    pivot = np.zeros(16, np.uint8)
    x, y = pivot.copy(), pivot.copy()
    x[:3] = 1  # agrees with the pivot in 13 bytes, with y in 8
    y[:3], y[8:] = 1, 2
    assert (x == y).sum() == minhash_dedup.CLOSE and (pivot == y).sum() < minhash_dedup.CLOSE
    forest = common.Forest()
    minhash_dedup._Canopies().add(np.arange(3), np.stack([pivot, x, y]).view(np.int64), forest)
    assert forest.find(1) == forest.find(2)


def test_image_votes_in_blocks_agree_with_brute_force():
    r = np.random.default_rng(5)
    n = 4000
    a = r.integers(-3, 3, n) * 10**12
    votes = np.stack([a, a + 1 + r.integers(0, 5, n), r.integers(0, 8, n) + 32768 | r.integers(0, 8, n) + 32768 << 16 | r.integers(0, 24, n) << 32 | r.integers(3, 5, n) << 37 | r.integers(0, 30, n) << 40])
    votes = np.concatenate([votes, votes[:, :50]], 1)
    parts = [(p, copies._unpacked(m, b)) for p, m, b in zip(*(c.to_pylist() for c in copies._packed(votes, 7).columns))]
    assert sorted(map(tuple, np.concatenate([x for _, x in parts], 1).T.tolist())) == sorted(map(tuple, votes.T.tolist()))
    pairs = [{tuple(x) for x in part[:2].T.tolist()} for _, part in parts]
    assert sum(map(len, pairs)) == len(set().union(*pairs))  # a pair lies in one part
    bins: dict = {}
    for a, b, v in votes.T.tolist():
        for g in range(8):
            x, y, t = ((v & 65535) + (g & 1)) // 2, ((v >> 16 & 65535) + (g >> 1 & 1)) // 2, ((v >> 32 & 31) + (g >> 2)) // 2 % copies.TURNS
            bins.setdefault((a, b, g, x, y, t, v >> 37 & 7), set()).add(v >> 40)
    want = {k[:2] for k, corners in bins.items() if len(corners) >= copies.VOTES}
    got = [tuple(x) for _, part in parts for x in copies._agreed(part).T.tolist()]
    assert len(got) == len(set(got)) and set(got) == want and 0 < len(want) < len(set().union(*pairs))


def test_places_of_corners_survive_packing():
    x, y, angle, scale = np.array([0.0, 12.5, 90000.0]), np.array([3.0, 0.125, 7.0]), np.array([-3.1, 0.0, 3.1]), np.array([1.0, 0.5, 0.7071])
    side, px, py, turn, by = copies._place(copies._placed(x, y, angle, scale) | np.array([0, 1, 2]) << 60)
    assert side.tolist() == [0, 1, 2] and px.tolist() == x.tolist() and py.tolist() == y.tolist() and by.tolist() == scale.tolist()
    assert np.abs(np.sin((turn - angle) / 2)).max() < 2e-4
