"""Scalar functions on sequences, as Column expressions."""

from .sequence import canonical, dna, format_count, format_record, kdust, pack, reverse_complement, shannon, unpack

__all__ = ["canonical", "dna", "format_count", "format_record", "kdust", "pack", "reverse_complement", "shannon", "unpack"]
