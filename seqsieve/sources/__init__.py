"""Readers and writers: FASTA/FASTQ, and minimizer index files."""
