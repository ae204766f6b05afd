"""Filtering of streams."""

from .sessions import FilterSession, PairedFilterSession, filter_stream

__all__ = ["FilterSession", "PairedFilterSession", "filter_stream"]
