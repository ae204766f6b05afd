"""Filtering of records, renaming and the run summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import format_record
from ..params import FilterParams, KmerParams
from .index import number_rows


def rename(kept: DataFrame, order: list[str], random: bool = False, pair: bool = False, first: int = 0) -> DataFrame:
    """Headers replaced by the 1-based number of the kept record (after `first` earlier ones), with /1 and /2 for mates.

    `random` appends a dash and 64 random bits, drawn for each mate.
    """
    out = number_rows(kept, order, "n_")
    number = (F.col("n_") + first).cast("string")

    def name(suffix: str) -> Column:
        word = F.concat(number, F.lit("-"), F.conv(F.substring(F.md5(F.concat(F.uuid(), F.lit(suffix))), 1, 16), 16, 10)) if random else number
        return F.concat(word, F.lit(suffix))

    if pair:
        return out.withColumns({"header1": name(" /1"), "header2": name(" /2")}).drop("n_")
    return out.withColumn("header", name("")).drop("n_")


def formatted(records: DataFrame, fasta: bool = False, mate: str = "") -> DataFrame:
    """One column `value` of record texts."""
    return records.select(format_record(F.col(f"header{mate}"), F.col(f"seq{mate}"), F.col(f"qual{mate}"), fasta).alias("value"))


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def counters(decisions: DataFrame, seqs: tuple[str, ...] = ("seq",)) -> DataFrame:
    """One row of sequence and base counts; bases count whole sequences, mates count one by one."""
    bases = sum((F.length(F.coalesce(F.col(c), F.lit(""))) for c in seqs[1:]), F.length(F.coalesce(F.col(seqs[0]), F.lit(""))))
    n = len(seqs)
    kept = F.col("keep")
    sums = decisions.agg(
        (F.count("*") * n).alias("seqs_in"),
        (F.count(F.when(kept, 1)) * n).alias("seqs_out"),
        F.coalesce(F.sum(bases), F.lit(0)).cast("long").alias("bp_in"),
        F.coalesce(F.sum(F.when(kept, bases)), F.lit(0)).cast("long").alias("bp_out"),
    )
    sums = sums.withColumns({"seqs_removed": F.col("seqs_in") - F.col("seqs_out"), "bp_removed": F.col("bp_in") - F.col("bp_out")})
    return sums.select(
        "seqs_in", "seqs_out", _share(F.col("seqs_out"), F.col("seqs_in")).alias("seqs_out_proportion"), "seqs_removed", _share(F.col("seqs_removed"), F.col("seqs_in")).alias("seqs_removed_proportion"),
        "bp_in", "bp_out", _share(F.col("bp_out"), F.col("bp_in")).alias("bp_out_proportion"), "bp_removed", _share(F.col("bp_removed"), F.col("bp_in")).alias("bp_removed_proportion"),
    )


def summary(counts: dict, kmer: KmerParams, params: FilterParams, *, version: str, index: str, input: str, input2: str | None, output: str, output2: str | None, rename: bool, rename_random: bool, time: float, time_total: float) -> dict:
    """The 29 fields of a run, in order."""
    rate = lambda x, t: x / t if t > 0 else 0.0
    head = {"version": version, "index": index, "input": input, "input2": input2, "output": output, "output2": output2, "k": kmer.k, "w": kmer.w, "abs_threshold": params.abs_threshold, "rel_threshold": params.rel_threshold, "prefix_length": params.prefix_length, "deplete": params.deplete, "rename": rename, "rename_random": rename_random}
    tail = {"time": time, "seqs_per_second": rate(counts["seqs_in"], time), "bp_per_second": rate(counts["bp_in"], time), "seqs_per_second_total": rate(counts["seqs_in"], time_total), "bp_per_second_total": rate(counts["bp_in"], time_total)}
    return {**head, **counts, **tail}
