"""Whole runs: what a command does from inputs to outputs."""
