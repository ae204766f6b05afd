import gzip
import json
import lzma
import random
import re
import warnings

import pytest
import zstandard

from brute import minimizers, rc, required
from seqsieve.api import Index
from seqsieve.cli import main
from seqsieve.operators import index as ops
from seqsieve.operators.classify import classify
from seqsieve.operators.frozen import freeze
from seqsieve.operators.index import FrozenIndexError
from seqsieve.params import FilterParams, KmerParams
from seqsieve.plans.run import RunConfig, run
from seqsieve.sources import fastx, index_files
from seqsieve.sources.index_files import CorruptIndexError
from seqsieve.sources.parser import ChunkParser, FormatError
from seqsieve.streaming import FilterSession, PairedFilterSession

RANDOM = random.Random(5)
SEQ = lambda n: "".join(RANDOM.choice("ACGT") for _ in range(n))
TARGET, OTHER = SEQ(300), SEQ(300)
VIRUS = "ATTAAAGGTTTATACCTTCCCAGGTAACAAACCAACCAACTTTCGATCTCTTGTAGATCT"


def fastq(path, seqs, opener=open):
    with opener(path, "wt") as f:
        for i, s in enumerate(seqs):
            f.write(f"@r{i} x\n{s}\n+\n{'~' * len(s)}\n")
    return str(path)


def built(spark, seqs, **k):
    return ops.build(spark.createDataFrame([(s,) for s in seqs], "seq string"), KmerParams(**k))


@pytest.fixture(scope="module")
def target(spark):
    return built(spark, [TARGET]).cache()


def frame(spark, seqs):
    return spark.createDataFrame([(i, f"r{i}", s, None) for i, s in enumerate(seqs)], "record_no long, header string, seq string, qual string")


READS = [TARGET[:100], rc(TARGET[50:200]), OTHER, OTHER[:200] + TARGET[:60], "ACGT", "", "N" * 80, TARGET + OTHER]


@pytest.mark.parametrize("params", [FilterParams(), FilterParams(1, 0.0), FilterParams(5, 0.3, 80), FilterParams(2, 0.5, deplete=True), FilterParams(0, 0.0, deplete=True)])
def test_decisions_equal_brute_force(spark, target, params):
    index = {m for _, m in minimizers(TARGET, 31, 15)}
    for joined in (False, True):
        got = {r.record_no: r for r in classify(frame(spark, READS), target, params, names=True, **({"broadcast_kmers": 0} if joined else {})).collect()}
        for i, s in enumerate(READS):
            found = minimizers(s[: params.prefix_length] if params.prefix_length else s, 31, 15)
            hits = list(dict.fromkeys(m for _, m in found if m in index))
            keep = params.deplete if not found else (len(hits) >= required(params.abs_threshold, params.rel_threshold, len(found))) != params.deplete
            assert (got[i].total_minimizers, got[i].hit_count, got[i].keep, got[i].hit_kmers) == (len(found), len(hits), keep, hits), (i, joined)


def test_search_and_deplete_part_the_input(spark, target):
    n = [classify(frame(spark, READS), target, FilterParams(deplete=d)).where("keep").count() for d in (False, True)]
    assert sum(n) == len(READS)


def test_pairs_pool_hits_and_skip_short_mates(spark):
    ref = "ACGT" * 28
    index = built(spark, [ref])
    a = "A" * 10 + "CGT" + "ACGT" * 15 + "A" * 10
    b = rc(a)
    df = spark.createDataFrame([(0, a, b), (1, a, "AC"), (2, "AC", "AC")], "pair_no long, seq1 string, seq2 string")
    rows = {r.pair_no: r for r in classify(df, index, FilterParams(2, 0.01, deplete=True), ("seq1", "seq2")).collect()}
    assert rows[0].hit_count == rows[1].hit_count == 1 and rows[0].keep
    assert rows[0].total_minimizers == 2 * rows[1].total_minimizers and rows[2].total_minimizers == 0 and rows[2].keep


def test_algebra(spark):
    a, b = built(spark, [TARGET, OTHER]), built(spark, [OTHER])
    one = built(spark, [TARGET])
    sets = lambda i: {r[0] for r in i.kmers.collect()}
    assert sets(ops.union(one, b)) == sets(a) and sets(ops.intersect(a, b)) == sets(b)
    assert sets(ops.subtract(a, b)) == sets(a) - sets(b)
    records = spark.createDataFrame([(OTHER,)], "seq string")
    assert sets(ops.subtract_records(a, records)) == sets(a) - sets(b)
    assert sets(ops.subtract_records(a, records, 31, 1)) == sets(ops.subtract(a, built(spark, [OTHER], w=1)))
    assert sets(ops.subtract_records(a, records, k=5)) == sets(a) - sets(b)
    assert not sets(ops.subtract(a, built(spark, [TARGET, OTHER], w=1)))
    for bad in (lambda: ops.union(a, built(spark, [OTHER], w=1)), lambda: ops.intersect(a), lambda: ops.union(), lambda: ops.subtract(a, built(spark, [OTHER], w=21)), lambda: ops.subtract(a, built(spark, [OTHER], k=21))):
        with pytest.raises(ValueError):
            bad()
    poly = built(spark, ["GTCAGCATTGACCGGATACGTTAGCCAAGTGCATCGGATTCAGCTAACGGTCATGC" + "A" * 40])
    for algorithm in ("kdust", "shannon"):
        high, low = ops.retain_complexity(poly, 0.5, algorithm), ops.retain_complexity(poly, 0.5, algorithm, invert=True)
        assert high.count() and low.count() and high.count() + low.count() == poly.count()


def test_dump_is_ordered(spark):
    assert [tuple(r) for r in ops.dump(built(spark, ["A" * 45])).collect()] == [(1, "A" * 31)]
    rows = ops.dump(built(spark, [TARGET, OTHER])).sort("n").collect()
    assert [r.n for r in rows] == list(range(1, len(rows) + 1)) and [r.kmer for r in rows] == sorted(r.kmer for r in rows)


def test_files(spark, target, tmp_path):
    index_files.save(target, f"{tmp_path}/a")
    assert index_files.load(spark, f"{tmp_path}/a").count() == target.count() == index_files.header(spark, f"{tmp_path}/a")["count"]
    for k in (31, 41):
        index = built(spark, [TARGET], k=k)
        path = f"{tmp_path}/{k}.idx"
        assert index_files.export_idx(index, path) == index.count()
        assert {r[0] for r in index_files.load(spark, path).kmers.collect()} == {r[0] for r in index.kmers.collect()}
    data = open(path, "rb").read()
    open(path, "wb").write(data[: len(data) * 9 // 10])
    with pytest.raises(CorruptIndexError):
        index_files.load(spark, path)
    size = -(-41 // 4)
    open(path, "wb").write(data[:-size] + data[-2 * size : -size])
    with pytest.raises(CorruptIndexError):
        index_files.load(spark, path)


@pytest.mark.parametrize("bits", [16, 32])
def test_frozen(spark, target, tmp_path, bits):
    index_files.save(freeze(target, bits), f"{tmp_path}/z")
    z = index_files.load(spark, f"{tmp_path}/z")
    exact, frozen = (sorted((r.record_no, r.hit_count, r.keep) for r in classify(frame(spark, READS), i).collect()) for i in (target, z))
    assert exact == frozen and ops.info(z).first()["count"] == target.count()
    for refused in (lambda: ops.dump(z), lambda: ops.union(z, z), lambda: freeze(z), lambda: ops.retain_complexity(z, 0.5), lambda: index_files.load_exact(spark, f"{tmp_path}/z")):
        with pytest.raises(FrozenIndexError):
            refused()
    with pytest.raises(ValueError, match="k <= 32"):
        freeze(built(spark, [TARGET], k=41))


OPENERS = {"": open, ".gz": gzip.open, ".xz": lzma.open, ".zst": zstandard.open}


@pytest.mark.parametrize("suffix", OPENERS)
def test_run_round_trip(spark, target, tmp_path, suffix):
    source = fastq(tmp_path / f"in.fq{suffix}", READS[:4] + ["ACGT"], OPENERS[suffix])
    out = f"{tmp_path}/out.fq{suffix}"
    summary = run(spark, target, RunConfig(source, output=out, summary=f"{tmp_path}/s.json"))
    with OPENERS[suffix](out, "rt") as f:
        text = f.read()
    assert text.count("@r") == summary["seqs_out"] == 3 and "@r0 x\n" + READS[0] + "\n+\n" in text
    saved = json.load(open(f"{tmp_path}/s.json"))
    assert len(saved) == 29 - 0 and saved["seqs_in"] == 5 and saved["bp_in"] == sum(map(len, READS[:4])) + 4
    assert saved["seqs_out_proportion"] == pytest.approx(0.6)


def test_rename_and_fasta(spark, target, tmp_path):
    source = fastq(tmp_path / "in.fq", [TARGET] * 20)
    out = f"{tmp_path}/o.fa"
    run(spark, target, RunConfig(source, output=out, rename=True, output_fasta=True))
    assert open(out).read() == "".join(f">{i}\n{TARGET}\n" for i in range(1, 21))
    run(spark, target, RunConfig(source, output=out, rename_random=True))
    heads = [x for x in open(out).read().split("\n")[::4] if x]
    assert all(re.fullmatch(rf"@{i}-\d{{1,20}}", h) for i, h in enumerate(heads, 1)) and len(set(heads)) == 20


def test_paired_runs(spark, target, tmp_path):
    a, b = fastq(tmp_path / "1.fq", [TARGET, OTHER]), fastq(tmp_path / "2.fq", [OTHER, OTHER])
    out = [f"{tmp_path}/o{n}.fq" for n in (1, 2)]
    assert run(spark, target, RunConfig(a, b, *out, rename=True))["seqs_out"] == 2
    assert open(out[0]).read().startswith("@1 /1\n" + TARGET) and open(out[1]).read().startswith("@1 /2\n" + OTHER)
    mixed = fastq(tmp_path / "m.fq", [TARGET, OTHER, OTHER, OTHER])
    run(spark, target, RunConfig(mixed, output=out[0], interleaved=True))
    assert open(out[0]).read().count("@r") == 2
    short = fastq(tmp_path / "3.fq", [OTHER])
    with pytest.raises(Exception, match="differ"):
        run(spark, target, RunConfig(a, short, output=out[0]))
    with pytest.raises(Exception, match="odd"):
        run(spark, target, RunConfig(fastq(tmp_path / "5.fq", [TARGET] * 3), output=out[0], interleaved=True))
    with pytest.raises(ValueError, match="exclude"):
        run(spark, target, RunConfig(a, b, interleaved=True))
    (tmp_path / "e.fq").write_text("")
    with pytest.raises(ValueError, match="empty"):
        run(spark, target, RunConfig(a, f"{tmp_path}/e.fq", output=out[0]))
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        run(spark, target, RunConfig(a, output=out[0], output2=out[1]))
    assert any("second output" in str(w.message) for w in seen)


@pytest.mark.parametrize("text,n", [("", 0), ("\n\n\n\n", 0), (">a\nA", 0), (">a\nA\n", 1)])
def test_tiny_inputs(spark, target, tmp_path, text, n):
    (tmp_path / "t.fa").write_text(text)
    out = f"{tmp_path}/o.fa"
    got = run(spark, target, RunConfig(f"{tmp_path}/t.fa", output=out, params=FilterParams(deplete=True)))
    assert got["seqs_in"] == got["seqs_out"] == n and open(out).read() == (text if n else "")
    assert got["seqs_out_proportion"] == (1.0 if n else 0.0)


@pytest.mark.parametrize("suffix", [".gz", ".xz", ".zst"])
def test_empty_compressed(spark, target, tmp_path, suffix):
    OPENERS[suffix](f"{tmp_path}/e.fq{suffix}", "wb").close()
    assert run(spark, target, RunConfig(f"{tmp_path}/e.fq{suffix}", output=f"{tmp_path}/o"))["seqs_in"] == 0


def test_missing_input(spark, target):
    with pytest.raises(FileNotFoundError):
        run(spark, target, RunConfig("/no/such/file.fq"))


def test_multiline_fasta_and_ranges(spark, tmp_path, monkeypatch):
    text = "".join(f">s{i} d\n" + "\n".join(TARGET[j : j + 16] for j in range(0, 100, 16)) + "\n\n" for i in range(50))
    (tmp_path / "m.fa").write_text(text)
    rows = fastx.read_fastx(spark, f"{tmp_path}/m.fa").sort("record_no").collect()
    assert [r.record_no for r in rows] == list(range(50)) and rows[7].header == "s7 d" and rows[7].seq == TARGET[:112] and rows[7].qual is None
    quals = fastq(tmp_path / "q.fq", [TARGET[: 40 + i % 7] for i in range(200)])
    body = open(quals).read().replace("~~~~", "@+@~")
    open(quals, "w").write(body)
    monkeypatch.setattr(fastx, "SPLIT", 1000)
    for path, n in ((f"{tmp_path}/m.fa", 50), (quals, 200)):
        reader = fastx.FastxReader({"path": path, "ordinals": "false"})
        parts = reader.partitions()
        got = [x for p in parts for b in reader.read(p) for x in b.to_pylist()]
        assert len(parts) > 3 and len(got) == n == len({x["record_no"] for x in got})
        assert [x["record_no"] for x in got] == sorted(x["record_no"] for x in got)
        whole = fastx.FastxReader({"path": path})
        assert [x["seq"] for x in got] == [x["seq"] for b in whole.read(whole.partitions()[0]) for x in b.to_pylist()]


FQ = b"@a x\r\nACGT\r\n+\r\n@+@~\r\n@b\nAC\n+b\n+~\n\n@c\n\n+\n\n@d\nA\n+\n~"
FA = b"\n >a x\nAC\nGT\n\n>b\n>c\r\nA\r\n>d"


@pytest.mark.parametrize("size", [1, 2, 3, 7, 137])
def test_parser_in_pieces(size):
    def parse(data):
        p = ChunkParser()
        return [(r.header, r.seq, r.qual) for i in range(0, len(data), size) for r in p.push(data[i : i + size])] + [(r.header, r.seq, r.qual) for r in p.finish()]

    assert parse(FQ) == [("a x", "ACGT", "@+@~"), ("b", "AC", "+~"), ("c", "", ""), ("d", "A", "~")]
    assert parse(FA) == [("a x", "ACGT", None), ("b", "", None), ("c", "A", None), ("d", "", None)]
    for bad in (b"@a\nAC\n+\n", b"@a\nAC\n+\n~\n", b"xyz\n", b"@a\nAC\nAC\n~~\n"):
        with pytest.raises(FormatError):
            parse(bad)


def test_sessions(spark, target, tmp_path):
    data = open(fastq(tmp_path / "i.fq", READS[:4]), "rb").read()
    session = FilterSession(spark, target, rename=True)
    out = b"".join(session.push(data[i : i + 333]) for i in range(0, len(data), 333)) + session.finish()
    assert [x.split(b"\n")[0] for x in out.split(b"@")[1:]] == [b"1", b"2", b"3"] and session.stats["seqs_in"] == 4
    zipped = FilterSession(spark, target, gzip_output=True)
    packed = zipped.push(gzip.compress(data[:500]) + gzip.compress(data[500:])) + zipped.finish()
    assert gzip.decompress(packed).count(b"+\n") == 3
    pair = PairedFilterSession(spark, target)
    first, second = pair.push1(data), pair.push2(data)
    last = pair.finish()
    assert first == (b"", b"") and second[0] + last[0] == second[1] + last[1] and (second[0] + last[0]).count(b"\n+\n") == 3
    odd = PairedFilterSession(spark, target)
    odd.push1(data)
    with pytest.raises(FormatError):
        odd.finish()


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "t.fa").write_text(f">t\n{TARGET}\n")
    (tmp_path / "o.fa").write_text(f">o\n{OTHER}\n")
    t = str(tmp_path)
    main(["index", "build", f"{t}/t.fa", "-o", f"{t}/t"])
    main(["index", "build", f"{t}/o.fa", "-o", f"{t}/o"])
    main(["index", "union", f"{t}/t", f"{t}/o", "-o", f"{t}/u"])
    main(["index", "intersect", f"{t}/u", f"{t}/o", "-o", f"{t}/i"])
    main(["index", "diff", f"{t}/u", f"{t}/o", "-o", f"{t}/d1"])
    main(["index", "diff", f"{t}/u", f"{t}/o.fa", "-o", f"{t}/d2"])
    main(["index", "freeze", f"{t}/t", "-b", "16", "-o", f"{t}/z"])
    main(["index", "filter", f"{t}/t", "-c", "0.0", "-o", f"{t}/f"])
    main(["index", "dump", f"{t}/t", "-o", f"{t}/dump.fa"])
    capsys.readouterr()
    counts = {}
    for name in ("t", "o", "u", "i", "d1", "d2", "z", "f"):
        main(["index", "info", f"{t}/{name}"])
        counts[name] = json.loads(capsys.readouterr().out)["count"]
    assert counts["u"] == counts["t"] + counts["o"] and counts["i"] == counts["o"] and counts["d1"] == counts["d2"] == counts["t"] == counts["z"] == counts["f"]
    assert open(f"{t}/dump.fa").read().count(">") == counts["t"]
    main(["filter", f"{t}/t", f"{t}/o.fa", "-d", "-o", f"{t}/kept.fa", "-q"])
    assert open(f"{t}/kept.fa").read() == f">o\n{OTHER}\n"
    index = Index(f"{t}/t", spark=spark)
    assert index.info()["format"] == "exact-u64" and index.filter(f"{t}/t.fa", output=f"{t}/x.fa")["seqs_out"] == 1
    with pytest.raises(SystemExit):
        main(["filter", f"{t}/t", "-a", "0"])


@pytest.mark.parametrize("query,kept", [(VIRUS, 0), (rc(VIRUS), 0)])
def test_short_target_on_either_strand(spark, query, kept):
    got = classify(frame(spark, [query]), built(spark, [VIRUS]), FilterParams(deplete=True)).first()
    assert got.hit_count == got.total_minimizers == 3 and not got.keep


def test_join_and_broadcast_agree_on_null_and_repeated_ids(spark):
    long_ = (VIRUS * 3)[:150]
    rows = [(1, VIRUS), (1, long_), (None, VIRUS), (None, "ACGT"), (2, VIRUS), (2, VIRUS), (3, None), (4, VIRUS.lower())]
    df = spark.createDataFrame(rows, "record_no long, seq string").repartition(3)
    index = built(spark, [VIRUS])
    small, joined = (sorted(map(str, classify(df, index, FilterParams(), names=True, **o).collect())) for o in ({}, {"broadcast_kmers": 0}))
    assert small == joined and len(small) == len(rows)
