"""Sharding by proportional stratified interleaving.

Rows get a seeded shuffle key (a digest of seed, id and the text's digest, so that rows which share an id, or have none,
don't share a key). Within each source they are ranked by it; rank / size of the
source is a fractional rank that spreads every source evenly over (0, 1). Sorted by it and cut into equal runs, each shard
has each source's share but for a few rows, and shards differ by one row at most.

Both rankings are exact and need no single sorted partition: the keys (then the fractional ranks) are uniform, so they
are cut into equal bins; bins are counted with map-side sums, a running sum over the bins (at most ``max_bins`` for a
source) gives each bin's first rank, and rows are numbered within bins. A hot source has more rows in each of its bins, and
a bin holds at most about ``rows_per_bin`` rows of all sources together until ``max_bins`` is reached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readqc.llm.common import Workspace


def interleave(docs: DataFrame, shards: int = 16, seed: str = "mixture", rows_per_bin: int = 2_000, max_bins: int = 65_536) -> DataFrame:
    """Put all rows into ``shards`` shards whose counts differ by one at most, each with the mixture of sources.

    One row for each row of ``docs``: doc_id, size (UTF-8 bytes of the text, none for a null, plus 1), text_crc32 (0 for
    a null or empty text), law (``rows``), shard, slot (place in the shard, from 0 without gaps), grown_shard (null).
    A null source is a source of its own; null ids, ties and repeated rows are ordered by id, checksum and size, equal
    rows among themselves at will. An empty table gives no rows. Only doc_id, text and source are read; one pass over
    the texts, after which rows are a few numbers.
    """
    ws = Workspace(docs.sparkSession, "interleave")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    digest = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("stratum"),
        F.md5(F.concat_ws(":", F.lit(seed), name, digest).cast("binary")).alias("key"),
    )
    rows = written = ws.stage(rows, "rows")
    n = rows.count()
    bins = max(1, min(max_bins, -(-n // rows_per_bin)))
    rows = rows.withColumn("bin", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * bins, 32))
    counts = rows.groupBy("stratum", "bin").agg(F.count("*").alias("c"))
    of_stratum = Window.partitionBy("stratum")
    before = of_stratum.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("stratum", "bin", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"), F.sum("c").over(of_stratum).alias("total"))
    in_bin = Window.partitionBy("stratum", "bin").orderBy("key", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("r", F.row_number().over(in_bin) - 1).join(counts, ["stratum", "bin"])
    ranked = ranked.withColumn("part", ((F.col("base") + F.col("r")) * 2 + 1).cast("double") / (F.col("total") * 2).cast("double"))
    ranked = ws.stage(ranked.select("doc_id", "size", "text_crc32", "stratum", "key", "part", F.floor(F.col("part") * bins).alias("bin")), "ranked")
    ws.drop(written)

    counts = ranked.groupBy("bin").agg(F.count("*").alias("c"))
    counts = counts.select("bin", F.coalesce(F.sum("c").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    in_bin = Window.partitionBy("bin").orderBy("part", "stratum", "key", "doc_id", "text_crc32", "size")
    placed = ranked.withColumn("r", F.row_number().over(in_bin) - 1).join(counts, "bin").withColumn("at", F.col("base") + F.col("r"))
    small, longer = n // shards, n % shards
    edge = longer * (small + 1)
    inner, rest = F.col("at") < edge, F.col("at") - edge
    shard = F.when(inner, F.expr(f"at div {small + 1}")).otherwise(F.lit(longer) + F.floor(rest / max(small, 1)))
    slot = F.when(inner, F.expr(f"at % {small + 1}")).otherwise(rest % max(small, 1))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
