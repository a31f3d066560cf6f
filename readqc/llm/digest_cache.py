"""Token counts through a digest cache.

The cache is a Parquet table of (version, digest, n_tokens): the digest of the tokenizer's file, and that of the content.
The only normalisation that leaves every count as it is makes a null text empty. Documents are joined to the cache by
digest; of the contents that miss, each task passes on one text for each digest, these meet by digest (so a content that
a third of all rows share is at most one row of each task), and each is encoded once and appended to the cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from readqc.llm.byte_bpe import load
from readqc.llm.common import Workspace, lean, pieces

SCHEMA = "version string, digest binary, n_tokens long"


def file_version(path: str) -> str:
    """Digest of a tokenizer's file."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


class CountCache:
    """Stored counts at a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, version: str) -> DataFrame:
        try:
            rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = self.spark.createDataFrame([], SCHEMA)
        return rows.where(F.col("version") == version).select("digest", "n_tokens")

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    for batch in batches:
        digests = batch.column(0).to_pylist()
        yield batch.filter(pa.array([not (d in seen or seen.add(d)) for d in digests], pa.bool_()))


def fill(docs: DataFrame, tokenizer_path: str, version: str, cache: CountCache) -> None:
    """Encode the contents of ``docs`` that the cache has no count for, each once, and append their counts."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        for batch in _first_of_each(batches):
            for part, texts in pieces(batch):
                counts = bpe.count(texts)
                yield pa.RecordBatch.from_arrays([pa.array([version] * len(counts), pa.string()), part.column(0), pa.array(counts, pa.int64())], names=["version", "digest", "n_tokens"])

    texts = docs.select(digest_of("text").alias("digest"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_first_of_each, "digest binary, text string")
    missing = texts.repartition("digest").join(cache.read(version).select("digest"), "digest", "left_anti")
    cache.append(missing.mapInArrow(lambda batches: lean(encode(batches)), SCHEMA))


def digest_of(text_col: str):
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, cache_path: str | None = None) -> DataFrame:
    """Token counts of every whole text, from the cache at ``cache_path`` (by default a new one in the shared folder).

    One row for each row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit. A null text counts as empty: 0
    bytes, 0 tokens. Repeated rows and null ids pass through; other columns are not read. Counts of another tokenizer
    file in the cache are left alone.
    """
    ws = Workspace(docs.sparkSession, "counts")
    cache, version = CountCache(docs.sparkSession, cache_path or f"{ws.path}/cache"), file_version(tokenizer_path)
    rows = ws.stage(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), digest_of("text").alias("digest")), "rows")
    fill(docs, tokenizer_path, version, cache)
    # Two runs at a time can both append a content: one count of each digest is used.
    # Written first, so that nothing but the join needs the rows of a digest together, and a digest that very many rows
    # share can be split.
    counts = ws.stage(cache.read(version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return rows.join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
