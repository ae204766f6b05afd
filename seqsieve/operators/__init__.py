"""Relational operators over sequence records and minimizer indexes."""
