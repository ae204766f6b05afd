"""A filter run: scan, classify, keep, rename, write, summarise."""

from __future__ import annotations

import json
import sys
import time
import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .. import __version__
from ..operators.classify import classify
from ..operators.filtering import counters, formatted, rename, summary
from ..operators.frozen import FrozenIndex
from ..operators.index import FrozenIndexError, MinimizerIndex, retain_complexity
from ..params import FilterParams, check_level
from ..sources import fastx


@dataclass
class RunConfig:
    input: str | None = "-"
    input2: str | None = None
    output: str | None = None
    output2: str | None = None
    interleaved: bool = False
    params: FilterParams = field(default_factory=FilterParams)
    complexity_threshold: float | None = None
    rename: bool = False
    rename_random: bool = False
    output_fasta: bool = False
    compression_level: int | None = None
    summary: str | None = None
    debug: bool = False
    quiet: bool = True


def _reads(spark: SparkSession, config: RunConfig) -> tuple[DataFrame, bool]:
    """Records, and whether they are pairs."""
    pipe = config.input in (None, "-") and config.input2 == "-"
    if config.interleaved and config.input2 is not None and not pipe:
        raise ValueError("interleaved input and a second input exclude each other")
    fastx.check_paths(config.input, None if pipe else config.input2)
    first = fastx.spooled(config.input)
    if config.interleaved or pipe:
        return fastx.interleaved(fastx.read_fastx(spark, first)), True
    if config.input2 is not None:
        return fastx.read_paired(spark, first, fastx.spooled(config.input2)), True
    # single records need an order, not ordinals, so plain files are cut over tasks
    return fastx.read_fastx(spark, first, ordinals=False), False


def _write(texts: DataFrame, path: str, level: int | None) -> None:
    """To one file in order, or, where path ends in a slash (or a codec's ending and a slash), to a folder of one file a task."""
    if path.endswith("/"):
        fastx.write_parts(texts, path.rstrip("/"), fastx.codec_of(path.rstrip("/")), level)
    else:
        fastx.write_file(texts, path, level)


def filtered(decisions: DataFrame, paired: bool, config: RunConfig) -> DataFrame:
    """Kept records, in order and renamed where asked for; files in folders need no order."""
    order = ["pair_no"] if paired else ["source", "record_no"]
    kept = decisions.where("keep")
    if config.rename or config.rename_random:
        kept = rename(kept, order, config.rename_random, paired)
    folders = all(p is None or p.endswith("/") for p in (config.output, config.output2))
    return kept if folders else kept.sort(*order)


def run(spark: SparkSession, index: MinimizerIndex | FrozenIndex, config: RunConfig, index_name: str = "") -> dict:
    """Filter inputs into outputs; returns the summary, which is also written as JSON where asked for."""
    began = time.time()
    if config.complexity_threshold is not None:
        if isinstance(index, FrozenIndex):
            raise FrozenIndexError("a frozen index cannot be filtered by complexity")
        index = retain_complexity(index, config.complexity_threshold)
    for path in (config.output, config.output2):
        if path and fastx.codec_of(path.rstrip("/")) and config.compression_level is not None:
            check_level(fastx.codec_of(path.rstrip("/")), config.compression_level)
    loaded = time.time()
    reads, paired = _reads(spark, config)
    if config.output2 and not paired:
        warnings.warn("a second output needs paired input; it is ignored", stacklevel=2)
    seqs = ("seq1", "seq2") if paired else ("seq",)
    decisions = classify(reads, index, config.params, seqs, names=config.debug).persist()
    try:
        if config.debug:
            rows = evidence(decisions, paired).sort(*(["pair_no"] if paired else ["source", "record_no"]))
            print(*rows.drop("source").columns, sep="\t", file=sys.stderr)
            for row in rows.drop("source").toLocalIterator():  # every row, one partition at a time
                print(*row, sep="\t", file=sys.stderr)
        kept = filtered(decisions, paired, config)
        if config.output:
            if paired and config.output2:
                kept = kept.persist()
                for n, path in ((1, config.output), (2, config.output2)):
                    _write(formatted(kept, config.output_fasta, str(n)), path, config.compression_level)
                kept.unpersist()
            else:
                texts = fastx.mates(kept, config.output_fasta) if paired else formatted(kept, config.output_fasta)
                _write(texts, config.output, config.compression_level)
        counts = counters(decisions, seqs).first().asDict()
        if not config.quiet:
            took = time.time() - loaded
            print(f"{counts['seqs_in']} records, {counts['bp_in']} bp in {took:.1f} s ({counts['seqs_in'] / took:.0f} records/s, {counts['bp_in'] / took / 1e6:.1f} Mbp/s)", file=sys.stderr)
    finally:
        decisions.unpersist()
    ended = time.time()
    out = summary(counts, index.params, config.params, version=f"seqsieve {__version__}", index=index_name, input=config.input or "-", input2=config.input2, output=config.output or "-", output2=config.output2, rename=config.rename, rename_random=config.rename_random, time=ended - loaded, time_total=ended - began)
    if config.summary:
        with open(config.summary, "w") as f:
            json.dump(out, f, indent=2)
    return out


def evidence(decisions: DataFrame, paired: bool) -> DataFrame:
    """Why records matched: every single record, but only pairs with a hit."""
    head = ["pair_no", "header1", "header2"] if paired else ["source", "record_no", "header"]
    rows = decisions.where("hit_count > 0") if paired else decisions
    return rows.select(*head, "total_minimizers", "hit_count", "keep", "hit_kmers")
