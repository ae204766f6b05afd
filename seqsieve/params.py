"""Validated parameters."""

from __future__ import annotations

from dataclasses import dataclass

FORMAT_VERSION = 3


@dataclass(frozen=True)
class KmerParams:
    """k-mer length and window size (number of consecutive k-mers)."""

    k: int = 31
    w: int = 15

    def __post_init__(self) -> None:
        if self.k < 1 or self.w < 1:
            raise ValueError(f"k and w must be positive, got k={self.k}, w={self.w}")
        if self.k > 61:
            raise ValueError(f"k must be at most 61, got {self.k}")
        if self.k + self.w > 96:
            raise ValueError(f"k + w must be at most 96, got {self.k + self.w}")
        if (self.k + self.w) % 2:
            raise ValueError(f"k + w must be even, got {self.k + self.w}")

    @property
    def span(self) -> int:
        """Bases in one window; odd, so a strand vote never ties."""
        return self.k + self.w - 1

    @property
    def packed(self) -> bool:
        """k-mers of up to 31 bases are a long, longer ones a string."""
        return self.k <= 31


@dataclass(frozen=True)
class FilterParams:
    """How many distinct index minimizers make a record match, and what happens to matches."""

    abs_threshold: int = 2
    rel_threshold: float = 0.01
    prefix_length: int = 0
    deplete: bool = False

    def __post_init__(self) -> None:
        if not 0 <= self.abs_threshold <= 65535:
            raise ValueError(f"abs_threshold must be within 0..65535, got {self.abs_threshold}")
        if not 0.0 <= self.rel_threshold <= 1.0:
            raise ValueError(f"rel_threshold must be within 0..1, got {self.rel_threshold}")
        if self.prefix_length < 0:
            raise ValueError(f"prefix_length must not be negative, got {self.prefix_length}")


def check_level(codec: str, level: int) -> None:
    """Compression levels: gzip 1-9, zstd 1-22, xz 0-9."""
    low, high = {"gzip": (1, 9), "zstd": (1, 22), "xz": (0, 9)}[codec]
    if not low <= level <= high:
        raise ValueError(f"compression level {level} is outside {low}-{high} for {codec}")


def split_cores(cores: int, outputs: int, gzip: bool) -> tuple[int, int]:
    """(filter, compression) shares of a core budget: half, rounded up, compresses gzip output; at least one filters."""
    if not gzip:
        return cores, 0
    compress = max(1, -(-(cores - cores // 2) // outputs)) * outputs
    return max(1, cores - compress), compress
