"""Sequence functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 22 letters onto ACGT; N has no target and disappears.
LETTERS, BASES = "BDEFHIJKLMOPQRSUVWXYZN", "CGACTACGTAGTACGTCAGTA"


def dna(text: Column, ambiguous: bool = False) -> Column:
    """Deterministic DNA from prose: ASCII letters only, each mapped to a base; Z becomes N on request."""
    bases = BASES[:-1] + "N" if ambiguous else BASES
    return F.translate(F.regexp_replace(text, "[^A-Za-z]", ""), "ACGTacgt" + LETTERS[:-1] + LETTERS[:-1].lower() + "Nn", "ACGTACGT" + bases + bases)


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


def canonical(kmer: Column) -> Column:
    """The smaller strand."""
    return F.least(kmer, reverse_complement(kmer))


def pack(kmer: Column) -> Column:
    """Two bits a base, first base highest (A C G T = 0 1 2 3): numeric order is string order. Up to 31 bases."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def unpack(value: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(value.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def _log2(p: Column) -> Column:
    return F.when(p > 0, p * F.log2(p)).otherwise(0.0)


def shannon(kmer: Column, k: int) -> Column:
    """Entropy of base frequencies over 2 bits, as float; 1 for k < 10 and where no base is A, C, G or T."""
    if k < 10:
        return F.lit(1.0).cast("float")
    count = [F.length(kmer) - F.length(F.regexp_replace(kmer, f"[{b}{b.lower()}]", "")) for b in "ACGT"]
    total = reduce(lambda a, b: a + b, count)
    bits = reduce(lambda a, b: a + b, [_log2(c / total) for c in count])
    return F.when(total == 0, 1.0).otherwise(F.abs(bits) / 2).cast("float")


def kdust(kmer: Column, k: int) -> Column:
    """1 - sum of c(c-1)/2 over triplets / ((k-2)(k-3)/2), as float; 1 for k < 3; NaN for k = 3, where no pair of triplets exists."""
    if k < 3:
        return F.lit(1.0).cast("float")
    if k == 3:
        return F.lit(float("nan")).cast("float")
    triplets = F.transform(F.sequence(F.lit(1), F.lit(k - 2)), lambda i: kmer.substr(i, F.lit(3)))
    # equal triplets are neighbours after sorting; each run of length c adds 0 + 1 + .. + c-1
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("pairs"))

    def step(acc: Column, t: Column) -> Column:
        run = F.when(t == acc["last"], acc["run"] + 1).otherwise(0)
        return F.struct(t.alias("last"), run.alias("run"), (acc["pairs"] + run).alias("pairs"))

    pairs = F.aggregate(F.array_sort(triplets), start, step, lambda acc: acc["pairs"])
    return (1 - pairs.cast("double") / ((k - 2) * (k - 3) / 2)).cast("float")


def complexity(kmer: Column, k: int, algorithm: str = "kdust") -> Column:
    if algorithm not in ("kdust", "shannon"):
        raise ValueError(f"unknown complexity measure {algorithm!r}")
    return (kdust if algorithm == "kdust" else shannon)(kmer, k)


def format_record(header: Column, seq: Column, qual: Column, fasta: bool = False) -> Column:
    """One record as text, without the last newline: FASTA if asked for or without quality, else FASTQ with a bare plus."""
    as_fasta = F.concat(F.lit(">"), header, F.lit("\n"), seq)
    if fasta:
        return as_fasta
    return F.when(qual.isNull(), as_fasta).otherwise(F.concat(F.lit("@"), header, F.lit("\n"), seq, F.lit("\n+\n"), qual))


def format_count(n: Column) -> Column:
    """Thousands separated by commas."""
    return F.format_number(n, 0)
