"""Scalar functions of reads, as Spark columns."""
