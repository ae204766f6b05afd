"""Index objects for interactive use."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .operators.index import MinimizerIndex, retain_complexity
from .params import FilterParams
from .plans.run import RunConfig, run
from .sources import index_files


class Index:
    """A loaded index, kept in memory for any number of filter runs."""

    def __init__(self, path: str, complexity_threshold: float | None = None, spark: SparkSession | None = None) -> None:
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.path = path
        index = index_files.load(self.spark, path)
        if complexity_threshold is not None:
            if not isinstance(index, MinimizerIndex):
                raise ValueError("a frozen index cannot be filtered by complexity")
            index = retain_complexity(index, complexity_threshold)
        self.index = index.cache() if isinstance(index, MinimizerIndex) else index

    @classmethod
    def fetch(cls, name: str = "panhuman-1", k: int = 31, w: int = 15, output: str | None = None, complexity_threshold: float | None = None, base: str | None = None, spark: SparkSession | None = None) -> Index:
        """Download a prebuilt index, then load it; output is the file to write."""
        path = index_files.fetch(name, k, w, base=base, output=output)
        return cls(path, complexity_threshold, spark)

    def info(self) -> dict:
        """k, w, format (exact-u64, exact-u128 or bff) and the number of minimizers."""
        params = self.index.params
        exact = isinstance(self.index, MinimizerIndex)
        return {"k": params.k, "w": params.w, "format": ("exact-u64" if params.k <= 32 else "exact-u128") if exact else "bff", "count": self.index.count() if exact else self.index.key_count}

    def filter(
        self,
        fastq: str,
        fastq2: str | None = None,
        interleaved: bool = False,
        deplete: bool = False,
        rename: bool = False,
        rename_random: bool = False,
        output: str | None = None,
        output2: str | None = None,
        abs_threshold: int = 2,
        rel_threshold: float = 0.01,
        prefix_length: int = 0,
        output_fasta: bool = False,
        threads: int = 8,
        compression_level: int = 2,
        compression_threads: int = 0,
        debug: bool = False,
        quiet: bool = True,
        summary: str | None = None,
    ) -> dict:
        """One run; returns its summary. Spark deals the work, so threads and compression_threads are taken and not used."""
        params = FilterParams(abs_threshold, rel_threshold, prefix_length, deplete)
        config = RunConfig(fastq, fastq2, output, output2, interleaved, params, None, rename, rename_random, output_fasta, compression_level, summary, debug, quiet)
        return run(self.spark, self.index, config, self.path)
