import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import minimizers, rc
from seqsieve.functions import canonical, dna, kdust, pack, reverse_complement, shannon, unpack
from seqsieve.operators.index import spelled
from seqsieve.operators.minimizers import arrow_minimizers, sql_minimizers
from seqsieve.params import FilterParams, KmerParams, check_level, split_cores

RANDOM = random.Random(3)
SEQS = ["", "ACGT", "A" * 60, "ACGT" * 30, "acgtn" * 20, "N" * 50] + ["".join(RANDOM.choice("ACGTACGTACGTN" if i % 3 == 0 else "ACGT") for _ in range(RANDOM.randrange(30, 200))) for i in range(40)]


@pytest.mark.parametrize("k,w", [(31, 15), (5, 5), (5, 1), (32, 14), (41, 15), (11, 5), (61, 35), (1, 1)])
def test_engines_equal_brute_force(spark, k, w):
    params = KmerParams(k, w)
    df = spark.createDataFrame(list(enumerate(SEQS)), "record_no long, seq string")
    want = sorted((i, p, m) for i, s in enumerate(SEQS) for p, m in minimizers(s, k, w))
    got = arrow_minimizers(df, params).withColumn("kmer", spelled(params))
    assert sorted(map(tuple, got.collect())) == want
    if k > 1:
        assert sorted(map(tuple, sql_minimizers(df, params).collect())) == want


def test_both_strands_choose_the_same(spark):
    seqs = [s for s in SEQS if s and not set(s) - set("ACGT")]
    for s in seqs:
        assert {m for _, m in minimizers(s, 31, 15)} == {m for _, m in minimizers(rc(s), 31, 15)}
    df = spark.createDataFrame([(i, s, rc(s)) for i, s in enumerate(seqs)], "record_no long, seq string, other string")
    a = arrow_minimizers(df, KmerParams()).select("record_no", "kmer").distinct()
    b = arrow_minimizers(df, KmerParams(), "other").select("record_no", "kmer").distinct()
    assert a.subtract(b).count() == b.subtract(a).count() == 0


def test_long_record_over_several_chunks(spark, monkeypatch):
    from seqsieve.operators import minimizers as m

    monkeypatch.setattr(m, "CHUNK", 300)
    df = spark.createDataFrame(list(enumerate(SEQS)), "record_no long, seq string")
    want = sorted((i, p, x) for i, s in enumerate(SEQS) for p, x in minimizers(s, 11, 5))
    params = KmerParams(11, 5)
    assert sorted(map(tuple, arrow_minimizers(df, params).withColumn("kmer", spelled(params)).collect())) == want


@pytest.mark.parametrize("k,w", [(62, 14), (61, 37), (31, 14), (0, 2), (31, 0)])
def test_invalid_params(k, w):
    with pytest.raises(ValueError):
        KmerParams(k, w)


def test_even_k_with_even_w_is_valid():
    assert KmerParams(32, 14).span == 45


def test_filter_params():
    for bad in ({"abs_threshold": -1}, {"abs_threshold": 70000}, {"rel_threshold": 1.1}, {"prefix_length": -1}):
        with pytest.raises(ValueError):
            FilterParams(**bad)
    for codec, level in (("gzip", 0), ("gzip", 10), ("zstd", 23), ("xz", 10)):
        with pytest.raises(ValueError, match=codec):
            check_level(codec, level)
    check_level("xz", 0)
    assert split_cores(8, 1, True) == (4, 4) and split_cores(1, 1, True) == (1, 1) and split_cores(8, 1, False) == (8, 0)


def test_functions(spark):
    df = spark.createDataFrame([("ACGTTGCA",), ("TTTTTTTT",)], "s string")
    rows = df.select(reverse_complement(F.col("s")), canonical(F.col("s")), unpack(pack(F.col("s")), 8)).collect()
    assert [tuple(r) for r in rows] == [("TGCAACGT", "ACGTTGCA", "ACGTTGCA"), ("AAAAAAAA", "AAAAAAAA", "TTTTTTTT")]
    text = spark.createDataFrame([("Straße, Nina zz!",)], "t string")
    assert text.select(dna(F.col("t"))).first()[0] == text.select(dna(F.col("t"), True)).first()[0].replace("N", "A")


def test_complexity(spark):
    poly, mixed = "A" * 31, "GTCAGCATTGACCGGATACGTTAGCCAAGTG"
    df = spark.createDataFrame([(poly,), (mixed,), ("N" * 31,)], "s string")
    dust = [r[0] for r in df.select(kdust(F.col("s"), 31)).collect()]
    assert dust[0] == 0 and dust[1] > 0.9
    entropy = [r[0] for r in df.select(shannon(F.col("s"), 31)).collect()]
    assert entropy[0] == 0 and entropy[1] > 0.95 and entropy[2] == 1
    assert df.select(shannon(F.col("s"), 9)).first()[0] == 1 and df.select(kdust(F.col("s"), 2)).first()[0] == 1


@pytest.mark.parametrize("piece", [1, 7, 64, 1000])
def test_selection_does_not_depend_on_pieces(monkeypatch, piece):
    from seqsieve.operators import minimizers as M

    r = np.random.default_rng(2)
    data = np.frombuffer(b"ACGTN", np.uint8)[r.choice(5, 3000, p=[0.249, 0.25, 0.25, 0.25, 0.001])]
    offsets = np.array([0, 0, 5, 900, 900, 2500, 2990, 3000])
    for params in (KmerParams(11, 5), KmerParams(31, 15), KmerParams(15, 1)):
        whole = M.select(data, offsets, params)
        monkeypatch.setattr(M, "PIECE", piece)
        parts = M.select(data, offsets, params)
        monkeypatch.undo()
        assert all(np.array_equal(a, b) for a, b in zip(whole, parts)) and len(whole[0]) > 50


def test_kdust_kernel_equals_its_column(spark):
    from seqsieve.functions.sequence import kdust
    from seqsieve.operators import index as ops

    r = np.random.default_rng(3)
    words = ["".join(r.choice(list("ACGT"), 41, p=p)) for p in ([0.25] * 4, [0.9, 0.1, 0, 0], [1, 0, 0, 0]) for _ in range(40)]
    for k in (4, 31, 41):
        df = spark.createDataFrame([(w[:k],) for w in words], "kmer string").distinct()
        params = KmerParams(k, 15 if k % 2 else 14)
        packed = df.select(pack(F.col("kmer")).alias("kmer")) if params.packed else df
        got = {x.kmer: x.value for x in ops.scored(ops.MinimizerIndex(packed, params)).select(ops.spelled(params).alias("kmer"), "value").collect()}
        assert got == {x.kmer: x.value for x in df.select("kmer", kdust(F.col("kmer"), k).alias("value")).collect()}
