"""Search and depletion of sequence collections by minimizers, as Spark plans."""

__version__ = "0.1.0"
