"""Trimmed reads as FASTQ."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SUFFIX = re.compile(r"\.(fastq|fq|fasta|fa)$")


def stem(path: str) -> str:
    """Name of a file without .gz and the suffix of its format."""
    name = PurePosixPath(path).name.removesuffix(".gz")
    return _SUFFIX.sub("", name)


def trimmed_name(path: str) -> str:
    return f"{stem(path)}_trimmed.fastq.gz"


def fill_quality(qual, seq):
    """Qualities of a read; as many ``I`` as bases if it has none."""
    return F.coalesce(qual, F.repeat(F.lit("I"), F.length(seq)))


def fastq_lines(reads: DataFrame) -> DataFrame:
    """One row of four lines for each read, in order."""
    return reads.orderBy("ord", "id", "seq", "qual").select(F.concat(F.lit("@"), "id", F.lit("\n"), "seq", F.lit("\n+\n"), fill_quality(F.col("qual"), F.col("seq"))).alias("value"))


def write_fastq(reads: DataFrame, path: str, single: bool = False, compression: str = "gzip") -> None:
    """Write reads in file order; range-partitioned parts whose names sort in that order, or one file if ``single``."""
    lines = fastq_lines(reads)
    (lines.coalesce(1) if single else lines).write.mode("overwrite").option("compression", compression).text(path)
