"""Frozen indexes: approximate membership by bucketed fingerprints.

A key's bucket is a hash modulo the number of keys, its fingerprint 16 or 32 further hash bits. A
probe asks for (bucket, fingerprint): no key is missed, and another k-mer passes with a chance of
about 2**-bits, since a bucket holds one key on average. Hashes come from md5 of the bases, so any
SQL engine can replay them.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import md5

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import FORMAT_VERSION, KmerParams
from .index import FrozenIndexError, MinimizerIndex


@dataclass(frozen=True)
class FrozenIndex:
    """table: distinct (bucket long, fp long)."""

    table: DataFrame
    params: KmerParams
    key_count: int
    bits: int = 32
    version: int = FORMAT_VERSION

    def bits_per_key(self) -> float:
        """Of the stored rows, bucket numbers included."""
        return (max(1, self.key_count).bit_length() + self.bits) if self.key_count else 0.0

    def false_positive_rate(self) -> float:
        return 2.0**-self.bits


def slot(kmer: Column, key_count: int, bits: int) -> list[Column]:
    """(bucket, fp) of bases."""
    digest = F.md5(kmer)
    bucket = F.conv(digest.substr(1, 15), 16, 10).cast("long") % max(1, key_count)
    return [bucket.alias("bucket"), F.conv(digest.substr(17, bits // 4), 16, 10).cast("long").alias("fp")]


def slots(kmers: list[bytes], key_count: int, bits: int) -> list[np.ndarray]:
    """As slot, of bases in memory."""
    digest = np.frombuffer(b"".join(md5(x).digest() for x in kmers), ">u8").reshape(-1, 2).astype(np.uint64)
    return [((digest[:, 0] >> np.uint64(4)) % np.uint64(max(1, key_count))).astype(np.int64), (digest[:, 1] >> np.uint64(64 - bits)).astype(np.int64)]


def freeze(index: MinimizerIndex, bits: int = 32) -> FrozenIndex:
    if not isinstance(index, MinimizerIndex):
        raise FrozenIndexError("the index is frozen already")
    if bits not in (16, 32):
        raise ValueError(f"fingerprints have 16 or 32 bits, not {bits}")
    if index.params.k > 32:
        raise ValueError("freezing supports k <= 32")
    keys = index.count()
    return FrozenIndex(index.kmers.select(*slot(index.spelled(), keys, bits)).distinct(), index.params, keys, bits, index.version)
