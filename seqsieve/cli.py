"""Command line: python -m seqsieve.cli filter | index ... | server."""

from __future__ import annotations

import argparse
import json
import shlex
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__
from .operators import frozen, index as ops
from .params import FilterParams, KmerParams
from .plans.run import RunConfig, run
from .sources import fastx, index_files


def _bounded(kind, low, high):
    def parse(text: str):
        value = kind(text)
        if not low <= value <= high:
            raise argparse.ArgumentTypeError(f"{value} is not within {low}..{high}")
        return value

    return parse


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="seqsieve", description="Search and deplete sequence collections by minimizers")
    top.add_argument("--version", action="version", version=f"seqsieve {__version__}")
    commands = top.add_subparsers(dest="command", required=True)
    f = commands.add_parser("filter", help="keep or discard records that match an index")
    f.add_argument("index")
    f.add_argument("input", nargs="?", default="-")
    f.add_argument("input2", nargs="?")
    f.add_argument("-o", "--output", default="-")
    f.add_argument("-O", "--output2")
    f.add_argument("-i", "--interleaved", action="store_true")
    f.add_argument("-a", "--abs-threshold", type=_bounded(int, 1, 65535), default=2)
    f.add_argument("-r", "--rel-threshold", type=_bounded(float, 0.0, 1.0), default=0.01)
    f.add_argument("-p", "--prefix-length", type=_bounded(int, 0, 2**63), default=0)
    f.add_argument("-d", "--deplete", action="store_true")
    f.add_argument("-c", "--complexity-threshold", type=_bounded(float, 0.0, 1.0))
    f.add_argument("-R", "--rename", action="store_true")
    f.add_argument("--rename-random", action="store_true")
    f.add_argument("-f", "--output-fasta", action="store_true")
    f.add_argument("--compression-level", type=int)
    f.add_argument("-s", "--summary")
    f.add_argument("-t", "--threads", type=int, default=8)
    f.add_argument("--debug", action="store_true")
    f.add_argument("-q", "--quiet", action="store_true")
    i = commands.add_parser("index", help="build and combine indexes").add_subparsers(dest="action", required=True)
    build = i.add_parser("build")
    build.add_argument("input", nargs="+")
    build.add_argument("-k", type=int, default=31)
    build.add_argument("-w", type=int, default=15)
    for name in ("union", "intersect"):
        i.add_parser(name).add_argument("inputs", nargs="+")
    diff = i.add_parser("diff")
    diff.add_argument("first")
    diff.add_argument("second")
    diff.add_argument("-k", type=_bounded(int, 1, 32))
    diff.add_argument("-w", type=int)
    for name in ("dump", "info", "freeze", "filter"):
        i.add_parser(name).add_argument("input")
    i.choices["freeze"].add_argument("-b", "--bits", type=int, choices=(16, 32), default=32)
    i.choices["filter"].add_argument("-c", "--complexity-threshold", type=_bounded(float, 0.0, 1.0), required=True)
    i.choices["filter"].add_argument("-a", "--algorithm", choices=("kdust", "shannon"), default="kdust")
    i.choices["filter"].add_argument("-v", "--invert", action="store_true")
    for name in ("build", "union", "intersect", "diff", "dump", "freeze", "filter"):
        i.choices[name].add_argument("-o", "--output", required=name != "dump", default="-")
    fetch = i.add_parser("fetch")
    fetch.add_argument("name")
    fetch.add_argument("-k", type=int, default=31)
    fetch.add_argument("-w", type=int, default=15)
    fetch.add_argument("-o", "--output", default=".")
    fetch.add_argument("--base")
    commands.add_parser("server", help="run commands from standard input, one a line, on one session with cached indexes")
    return top


_cached: dict[str, object] = {}


def _load(spark: SparkSession, path: str):
    if path not in _cached:
        index = index_files.load(spark, path)
        _cached[path] = index.cache() if isinstance(index, ops.MinimizerIndex) else index
    return _cached[path]


def _exact(spark: SparkSession, path: str) -> ops.MinimizerIndex:
    return index_files.load_exact(spark, path)


def _difference(spark: SparkSession, args) -> ops.MinimizerIndex:
    first = _exact(spark, args.first)
    if args.k is not None and args.w is not None:
        return ops.subtract_records(first, fastx.read_fastx(spark, fastx.spooled(args.second)), args.k, args.w)
    try:
        second = index_files.load_exact(spark, args.second)
    except ops.FrozenIndexError:
        raise
    except Exception:  # not an index: records, with k and w of the first
        return ops.subtract_records(first, fastx.read_fastx(spark, fastx.spooled(args.second)))
    return ops.subtract(first, second)


def execute(spark: SparkSession, args) -> None:
    note = lambda text: print(text, file=sys.stderr)
    if args.command == "filter":
        params = FilterParams(args.abs_threshold, args.rel_threshold, args.prefix_length, args.deplete)
        config = RunConfig(args.input, args.input2, args.output, args.output2, args.interleaved, params, args.complexity_threshold, args.rename, args.rename_random, args.output_fasta, args.compression_level, args.summary, args.debug, args.quiet)
        out = run(spark, _load(spark, args.index), config, args.index)
        if not args.quiet:
            note(f"kept {out['seqs_out']}/{out['seqs_in']} records ({out['seqs_out_proportion']:.3%}), {out['bp_out']}/{out['bp_in']} bp")
    elif args.action == "build":
        records = fastx.read_fastx(spark, *map(fastx.spooled, args.input), ordinals=False)
        index = ops.build(records, KmerParams(args.k, args.w))
        index_files.save(index, args.output)
        stats = ops.build_stats(records).first()
        note(f"indexed {stats['records']} records, {stats['bp']} bp: {index_files.header(spark, args.output)['count']} minimizers")
    elif args.action in ("union", "intersect"):
        inputs = [_exact(spark, p) for p in args.inputs]
        index_files.save((ops.union if args.action == "union" else ops.intersect)(*inputs), args.output)
        for row in ops.steps(inputs, args.action).sort("step").collect():
            did = "added" if args.action == "union" else "retained"
            note(f"{args.inputs[row['step'] - 1]}: {did} {row['size']} minimizers, {row['total']} in all")
    elif args.action == "diff":
        before = _exact(spark, args.first).count()
        index_files.save(_difference(spark, args), args.output)
        left = index_files.header(spark, args.output)["count"]
        note(f"removed {before - left} minimizers, {left} remaining")
    elif args.action == "dump":
        rows = ops.dump(_exact(spark, args.input)).sort("n").select(F.concat(F.lit(">"), F.col("n").cast("string"), F.lit("\n"), F.col("kmer")).alias("value"))
        fastx.write_file(rows, args.output)
    elif args.action == "info":
        print(json.dumps(ops.info(index_files.load(spark, args.input)).first().asDict()))
    elif args.action == "freeze":
        index_files.save(frozen.freeze(_exact(spark, args.input), args.bits), args.output)
    elif args.action == "filter":
        index_files.save(ops.retain_complexity(_exact(spark, args.input), args.complexity_threshold, args.algorithm, args.invert), args.output)
    elif args.action == "fetch":
        print(index_files.fetch(args.name, args.k, args.w, args.output, args.base))


def serve(spark: SparkSession, lines) -> None:
    """Commands one a line until `stop`; an error ends a command, not the server."""
    for line in lines:
        words = shlex.split(line)
        if not words:
            continue
        if words[0] == "stop":
            return
        if words[0] == "status":
            print(json.dumps({"indexes": sorted(_cached)}), flush=True)
            continue
        try:
            execute(spark, parser().parse_args(words))
            print("ok", flush=True)
        except (Exception, SystemExit) as error:
            print(f"error: {error}", flush=True)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("seqsieve").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if args.command == "server":
        serve(spark, sys.stdin)
    else:
        execute(spark, args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
