"""What a larger table must not do: make a task of every short range, pass through the driver, pile up in a task."""

import random
import re
import time

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brute import minimizers
from seqsieve.operators import index as ops
from seqsieve.operators import minimizers as M
from seqsieve.operators.classify import classify
from seqsieve.operators.frozen import freeze
from seqsieve.params import KmerParams
from seqsieve.sources import fastx
from seqsieve.sources.parser import ChunkParser


def test_short_ranges_share_tasks(tmp_path, monkeypatch):
    path = tmp_path / "q.fq"
    path.write_text("".join(f"@r{i}\n{'ACGT' * (i % 9)}\n+\n{'@' * (4 * (i % 9))}\n" for i in range(3000)))
    monkeypatch.setattr(fastx, "TASKS", 8)
    reader = fastx.FastxReader({"path": str(path), "ordinals": "false", "split": "50"})
    parts = reader.partitions()
    got = [x for p in parts for b in reader.read(p) for x in b.to_pylist()]
    assert 8 <= len(parts) <= 10
    assert [x["header"] for x in got] == [f"r{i}" for i in range(3000)]
    assert all(len(x["seq"]) == len(x["qual"]) == 4 * (i % 9) for i, x in enumerate(got))


@pytest.mark.parametrize("ending", ["", ".gz", ".zst", ".xz"])
def test_one_file_does_not_pass_the_driver(spark, tmp_path, monkeypatch, ending):
    def refused(*_):
        raise AssertionError("rows pass the driver")

    monkeypatch.setattr(DataFrame, "toLocalIterator", refused)
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.toLocalIterator", refused)
    rows = spark.range(5000).repartition(7).select(F.col("id"), F.concat(F.lit(">"), "id", F.lit("\nACGT")).alias("value"))
    path = f"{tmp_path}/x.fa{ending}"
    fastx.write_file(rows.sort("id").select("value"), path)
    with fastx.open_bytes(path) as f:
        assert f.read() == b"".join(b">%d\nACGT\n" % i for i in range(5000))
    fastx.write_file(rows.where("id < 0").select("value"), path)
    with fastx.open_bytes(path) as f:
        assert f.read() == b""
    assert fastx.is_empty(path)


SEQS = ["".join(random.Random(n).choice("ACGT") for _ in range(300)) for n in range(3)]


def records(spark):
    rows = [SEQS[0][:200], SEQS[1], SEQS[0][40:120] + SEQS[2], SEQS[0] + SEQS[0], "", "N" * 90, None, SEQS[0][:200], SEQS[2].lower()]
    return spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "record_no long, seq string")


@pytest.mark.parametrize("k,w,bits", [(31, 15, None), (41, 15, None), (61, 3, None), (31, 15, 16), (32, 14, 32)])
def test_small_indexes_of_any_kind_shuffle_nothing(spark, k, w, bits):
    index = ops.build(spark.createDataFrame([(SEQS[0],)], "seq string"), KmerParams(k, w))
    held = {m for _, m in minimizers(SEQS[0], k, w)}
    index = freeze(index, bits) if bits else index
    small = classify(records(spark), index, names=True)
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    want = {}
    for r in records(spark).collect():
        found = minimizers(r.seq or "", k, w)
        want[r.record_no] = (len(found), list(dict.fromkeys(m for _, m in found if m in held)))
    for rows in (small, classify(records(spark), index, names=True, broadcast_kmers=0)):
        assert {r.record_no: (r.total_minimizers, r.hit_kmers) for r in rows.collect()} == want
        assert all(r.hit_count == len(r.hit_kmers) for r in rows.collect())


def test_difference_drops_others_before_they_travel(spark):
    first, second = (ops.build(spark.createDataFrame([(s,)], "seq string"), KmerParams(31, w)) for s, w in ((SEQS[0], 15), (SEQS[0][:150] + SEQS[1], 1)))
    got = ops.subtract(first, second)
    plan = got.kmers._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[kmer[^\n]*\n[^A-Z]*Join LeftSemi", plan)
    assert got.count() == len({m for _, m in minimizers(SEQS[0], 31, 15)} - {m for _, m in minimizers(SEQS[0][:150], 31, 1)})


def test_parser_keeps_long_lines_in_pieces():
    stream, began = ChunkParser(), time.process_time()
    data = b">a\n" + b"ACGTACG" * 300_000
    for at in range(0, len(data), 7):
        stream.push(data[at : at + 7])
    assert len(stream.finish()[0].seq) == 2_100_000
    assert time.process_time() - began < 10  # copying the line at each piece took minutes


@pytest.mark.parametrize("k,w", [(31, 15), (5, 5), (32, 14), (61, 35)])
def test_sql_engine_cuts_records_and_sorts_no_bases(spark, monkeypatch, k, w):
    monkeypatch.setattr(M, "SQL_PIECE", 64)
    monkeypatch.setattr(M, "SQL_BLOCK", 200)
    r = random.Random(5)
    seqs = ["".join(r.choice("ACGT") for _ in range(1500)), "AC" * 400, "A" * 300, "ACGTTGCA0N-ß" * 40 + SEQS[0] + "nn" + SEQS[1].lower(), "0" * 200, None]
    seqs += [(SEQS[1][:97] * 6)[:n] for n in (k + w - 2, k + w - 1, k + w + 62, k + w + 63, k + w + 64, k + w + 263)]
    rows = M.sql_minimizers(spark.createDataFrame(list(enumerate(seqs)), "record_no long, seq string"), KmerParams(k, w))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Window|Join|Sort", plan) and plan.count("Repartition") == 1
    assert sorted(map(tuple, rows.collect())) == sorted((i, p, m) for i, s in enumerate(seqs) for p, m in minimizers(s or "", k, w))
