"""Metrics over kept reads (columns ord, id, seq, qual and, after trimming, len0, adapter, keep).

Metrics by position and k-mer counts share one pass: a kernel turns each Arrow batch's character buffers into histograms
with numpy and passes on, for each task, at most positions x bins partial counts, which are then summed. No base ever
becomes a row. Sums of scores are Arrow kernels over the same buffers. All else is native columns with map-side partial
aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readqc import config as C
from readqc.functions import reads as R
from readqc.functions.arrow import SCORE, flat, places, quality_sum, read_sums

_BASE = np.full(256, 4, np.int8)
for _i, _pair in enumerate(("Aa", "Cc", "Gg", "Tt")):
    for _c in _pair:
        _BASE[ord(_c)] = _i


def percent(part: Column, whole: Column) -> Column:
    """Share in percent; 0 of nothing."""
    return F.coalesce(F.try_divide(part.cast("double") * 100, whole.cast("double")), F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def per_read(reads: DataFrame) -> DataFrame:
    """Numbers of each read that several metrics need: len, gc, qlen, qsum, q10, q20, q30; the sums by one Arrow kernel."""
    rows = reads.withColumn("_sums", read_sums("seq", "qual"))
    rows = rows.withColumns({"len": F.length("seq"), "qlen": F.coalesce(F.length("qual"), F.lit(0))} | {c: F.col(f"_sums.{c}") for c in ("gc", "qsum", "q10", "q20", "q30")})
    return rows.drop("_sums")


def summary(trimmed: DataFrame, *by: str, rollup: bool = False) -> DataFrame:
    """Counts, lengths, composition and quality of the kept reads, and how many were filtered, for each group, and with
    ``rollup`` for all of them (a null group)."""
    rows = per_read(trimmed)
    k = F.col("keep")

    def total(c: str) -> Column:
        return F.coalesce(F.sum(F.when(k, F.col(c))), F.lit(0))

    sums = (rows.rollup(*by) if rollup else rows.groupBy(*by)).agg(
        F.count_if(k).alias("read_count"), F.count_if(~k).alias("filtered_reads"), total("len").alias("total_bases"),
        F.coalesce(F.min(F.when(k & (F.col("len") > 0), F.col("len"))), F.lit(0)).alias("min_length"),
        F.coalesce(F.max(F.when(k, F.col("len"))), F.lit(0)).alias("max_length"),
        total("gc").alias("gc_bases"), total("qsum").alias("quality_sum"), total("qlen").alias("quality_bases"),
        total("q10").alias("q10_bases"), total("q20").alias("q20_bases"), total("q30").alias("q30_bases"), F.count_if(k & F.col("adapter").isNotNull()).alias("adapter_hits"),
    )
    c = F.col
    return sums.withColumns({
        "avg_length": ratio(c("total_bases"), c("read_count")), "gc_percent": percent(c("gc_bases"), c("total_bases")),
        "avg_quality": ratio(c("quality_sum"), c("quality_bases")), "q10_percent": percent(c("q10_bases"), c("quality_bases")), "q20_percent": percent(c("q20_bases"), c("quality_bases")),
        "q30_percent": percent(c("q30_bases"), c("quality_bases")), "adapter_percent": percent(c("adapter_hits"), c("read_count")),
    })


def length_histogram(reads: DataFrame) -> DataFrame:
    return reads.groupBy(F.length("seq").alias("length")).agg(F.count("*").alias("n"))


def n50_n90(reads: DataFrame) -> DataFrame:
    """Lengths at which half, and nine tenths, of all bases are in reads at least as long. Runs over distinct lengths."""
    hist = length_histogram(reads).where("length > 0")
    total = F.sum(F.col("length") * F.col("n")).over(Window.partitionBy())
    cum = F.sum(F.col("length") * F.col("n")).over(Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0))
    marked = hist.select("length", cum.alias("cum"), total.alias("total"))
    return marked.agg(
        F.coalesce(F.max(F.when(F.col("cum") >= F.ceil(F.col("total") / 2), F.col("length"))), F.lit(0)).alias("n50"),
        F.coalesce(F.max(F.when(F.col("cum") >= F.ceil(F.col("total") * 9 / 10), F.col("length"))), F.lit(0)).alias("n90"),
    )


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of one task: kind (b: base, q: score, s: sum of scores, k: 4-mer), pos, code, n."""
    base = np.zeros((C.MAX_POSITION, 5), np.int64)
    score = np.zeros((C.MAX_POSITION, C.PHRED_BINS), np.int64)
    extra = np.zeros(C.MAX_POSITION, np.int64)
    kmers = np.zeros(256, np.int64)

    for batch in batches:
        data, borders = flat(batch.column(0))
        pos, code = places(borders), _BASE[data]
        if len(code) >= 4:
            word = code[:-3].astype(np.int32)
            for k in (1, 2, 3):
                word = word * 4 + code[k : len(code) - 3 + k]
            other = code > 3
            whole = ~(other[:-3] | other[1:-2] | other[2:-1] | other[3:]) & (pos[3:] >= 3)
            kmers += np.bincount(word[whole], minlength=256)
        if len(pos) and pos.max() >= C.MAX_POSITION:
            near = pos < C.MAX_POSITION
            pos, code = pos[near], code[near]
        base += np.bincount(pos * 5 + code, minlength=base.size).reshape(base.shape)
        data, borders = flat(batch.column(1))
        pos, phred = places(borders), SCORE[data]
        if len(pos) and pos.max() >= C.MAX_POSITION:
            near = pos < C.MAX_POSITION
            pos, phred = pos[near], phred[near]
        # Scores by place first; sums follow from them but for scores over the last bin.
        score += np.bincount(pos * C.PHRED_BINS + np.minimum(phred, C.PHRED_BINS - 1), minlength=score.size).reshape(score.shape)
        over = np.flatnonzero(phred >= C.PHRED_BINS)
        extra += np.bincount(pos[over], phred[over] - (C.PHRED_BINS - 1), C.MAX_POSITION).astype(np.int64)
    sums = score @ np.arange(C.PHRED_BINS) + extra
    for kind, table in (("b", base), ("q", score), ("s", sums[:, None]), ("k", kmers[None, :])):
        p, c = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(p), pa.string()), pa.array(p, pa.int32()), pa.array(c, pa.int32()), pa.array(table[p, c], pa.int64())], names=["kind", "pos", "code", "n"])


def position_counts(reads: DataFrame) -> DataFrame:
    """Counts that all metrics by position and the k-mer counts derive from: one pass over the reads."""
    parts = reads.select("seq", "qual").mapInArrow(_positions, "kind string, pos int, code int, n long")
    return parts.groupBy("kind", "pos", "code").agg(F.sum("n").alias("n"))


def quality_by_position(counts: DataFrame) -> DataFrame:
    """pos, quality_sum, n, mean_quality."""
    sums = counts.where("kind in ('q', 's')").groupBy("pos").agg(F.sum(F.when(F.col("kind") == "s", F.col("n")).otherwise(0)).alias("quality_sum"), F.sum(F.when(F.col("kind") == "q", F.col("n")).otherwise(0)).alias("n"))
    return sums.withColumn("mean_quality", ratio(F.col("quality_sum"), F.col("n")))


def quality_percentiles(counts: DataFrame) -> DataFrame:
    """pos, q25, q50, q75: first score at which the running count reaches a quarter, half, three quarters (whole numbers)
    of the position's total; a score of 0 counts as 1."""
    rows = counts.where("kind = 'q'")
    by = Window.partitionBy("pos")
    rows = rows.select("pos", "code", F.sum("n").over(by.orderBy("code").rowsBetween(Window.unboundedPreceding, 0)).alias("cum"), F.sum("n").over(by).alias("t"))
    first = [F.greatest(F.min(F.when(F.expr(f"cum >= {part}"), F.col("code"))), F.lit(1)).cast("int").alias(name) for part, name in (("t div 4", "q25"), ("t div 2", "q50"), ("t * 3 div 4", "q75"))]
    return rows.groupBy("pos").agg(*first)


def base_composition(counts: DataFrame) -> DataFrame:
    """pos, a, c, g, t, other, and the same in percent of the position."""
    rows = counts.where("kind = 'b'")
    names = ("a", "c", "g", "t", "other")
    rows = rows.groupBy("pos").agg(*[F.sum(F.when(F.col("code") == i, F.col("n")).otherwise(0)).alias(x) for i, x in enumerate(names)])
    whole = F.col("a") + F.col("c") + F.col("g") + F.col("t") + F.col("other")
    return rows.withColumns({f"{x}_percent": percent(F.col(x), whole) for x in names})


def n_content(counts: DataFrame) -> DataFrame:
    return base_composition(counts).select("pos", F.col("other_percent").alias("n_percent"))


def kmer_counts(counts: DataFrame) -> DataFrame:
    """kmer, n of all 4-mers that occur."""
    letters = F.array(*[F.lit(x) for x in "ACGT"])
    name = F.concat(*[F.get(letters, (F.shiftright("code", shift) % 4).cast("int")) for shift in (6, 4, 2, 0)])
    return counts.where("kind = 'k'").select(name.alias("kmer"), "n")


def top_kmers(counts: DataFrame, k: int = C.TOP) -> DataFrame:
    return kmer_counts(counts).orderBy(F.desc("n"), "kmer").limit(k)


def first_reads(reads: DataFrame, n: int, bins: int = 4096, enough: int = 20_000) -> DataFrame:
    """The first ``n`` reads in file order; the sample is part of the metrics' definition.

    Reads are counted by ranges of their number, in steps down to a range that few are in, at most ``bins`` counts at a
    time; all before that range are taken as they are, and only those in it are ordered. A small ``n`` is simply ordered."""
    order = ("ord", "id", "seq", "qual")
    if n <= enough:
        return reads.orderBy(*order).limit(n)
    low, high, total = reads.agg(F.min("ord"), F.max("ord"), F.count("*")).first()
    if total <= n:
        return reads
    taken, inside = 0, total
    while inside > enough and high > low:
        width = -(-(high - low + 1) // bins)
        at = F.expr(f"(ord - {low}) div {width}")
        counts = reads.where(F.col("ord").between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n")).collect()
        for r in sorted(counts, key=lambda r: r["bin"]):
            if taken + r["n"] >= n:
                low, inside = low + r["bin"] * width, r["n"]
                high = min(high, low + width - 1)
                break
            taken += r["n"]
    edge = reads.where(F.col("ord").between(low, high)).orderBy(*order).limit(n - taken)
    return reads.where(F.col("ord") < low).unionByName(edge)


def overrepresented(reads: DataFrame, sample: int = C.SAMPLE_READS) -> DataFrame:
    """Sequences (leading 50 bases) that stand out among the first reads of at least 4 bases: sequence, n, percentage,
    possible_source. The least count is the highest of 0.1 % of the sample, the 99th percentile of the counts, and 5."""
    keys = first_reads(reads, sample).where(F.length("seq") >= 4).groupBy(R.key("seq").alias("sequence")).agg(F.count("*").alias("n"))
    per = keys.groupBy(F.col("n").alias("c")).agg(F.count("*").alias("k"))
    cum = F.sum("k").over(Window.orderBy("c").rowsBetween(Window.unboundedPreceding, 0))
    marked = per.select("c", cum.alias("cum"), F.sum("k").over(Window.partitionBy()).alias("total"), F.sum(F.col("c") * F.col("k")).over(Window.partitionBy()).alias("sampled"))
    least = marked.agg(F.min(F.when(F.col("cum") > F.floor(F.col("total") * F.lit(0.99)), F.col("c"))).alias("p99"), F.max("sampled").alias("sampled"))
    least = least.select("sampled", F.greatest(F.ceil(F.col("sampled") * F.lit(0.001)), "p99", F.lit(5)).alias("least"))
    found = keys.join(F.broadcast(least), F.col("n") >= F.col("least"))
    return found.select("sequence", "n", percent(F.col("n"), F.col("sampled")).alias("percentage"), R.adapter_source("sequence").alias("possible_source")).orderBy(F.desc("n"), "sequence").limit(C.TOP)


def duplication_rate(reads: DataFrame, exact: bool = False) -> DataFrame:
    """read_count, distinct_reads, dup_percent, by a HyperLogLog sketch (1 % error) or exactly."""
    distinct = F.count_distinct(R.key("seq")) if exact else F.approx_count_distinct(R.fingerprint("seq"), 0.01)
    sums = reads.agg(F.count("*").alias("read_count"), distinct.alias("distinct_reads"))
    return sums.withColumn("dup_percent", percent(F.greatest(F.col("read_count") - F.col("distinct_reads"), F.lit(0)), F.col("read_count")))


def duplication_sketches(reads: DataFrame, *by: str) -> DataFrame:
    """read_count and a mergeable sketch of the distinct reads, for each group; to be stored and merged later."""
    return reads.groupBy(*by).agg(F.count("*").alias("read_count"), F.hll_sketch_agg(R.key("seq"), F.lit(14)).alias("sketch"))


def merged_duplication(sketches: DataFrame) -> DataFrame:
    """``duplication_rate`` of all reads that went into ``sketches``, without reading them again."""
    sums = sketches.agg(F.coalesce(F.sum("read_count"), F.lit(0)).alias("read_count"), F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias("distinct_reads"))
    return sums.withColumn("dup_percent", percent(F.greatest(F.col("read_count") - F.col("distinct_reads"), F.lit(0)), F.col("read_count")))


def duplication_histogram(reads: DataFrame, sample: int = C.SAMPLE_READS) -> DataFrame:
    """level, label, distinct_keys, percent (of the reads looked at) for the nine levels; empty ones too."""
    counts = first_reads(reads, sample).groupBy(R.key("seq").alias("k")).agg(F.count("*").alias("n"))
    level = F.lit(0)
    for i, floor in enumerate(C.DUPLICATION_FLOORS):
        level = F.when(F.col("n") >= floor, i).otherwise(level)
    binned = counts.groupBy(level.alias("level")).agg(F.count("*").alias("c"), F.sum("n").alias("reads"))
    spine = reads.sparkSession.createDataFrame(list(enumerate(C.DUPLICATION_LEVELS)), "level int, label string")
    total = F.coalesce(F.sum("reads").over(Window.partitionBy()), F.lit(0))
    return spine.join(binned, "level", "left").select("level", "label", F.coalesce("c", F.lit(0)).alias("distinct_keys"), percent(F.coalesce("c", F.lit(0)), total).alias("percent"))


def _spine(reads: DataFrame, name: str, n: int) -> DataFrame:
    return reads.sparkSession.range(n).select(F.col("id").cast("int").alias(name))


def mean_quality_histogram(reads: DataFrame) -> DataFrame:
    """quality (0 to 42), n: reads by their whole mean score."""
    q = R.mean_bin(quality_sum("qual"), F.length("qual"))
    counts = reads.where(F.length("qual") > 0).groupBy(q.alias("quality")).agg(F.count("*").alias("n"))
    return _spine(reads, "quality", C.PHRED_BINS).join(counts, "quality", "left").select("quality", F.coalesce("n", F.lit(0)).alias("n"))


def gc_histogram(reads: DataFrame) -> DataFrame:
    """gc (0 to 100), n: reads by their whole GC percentage."""
    counts = reads.where(F.length("seq") > 0).groupBy(R.gc_bin("seq").alias("gc")).agg(F.count("*").alias("n"))
    return _spine(reads, "gc", 101).join(counts, "gc", "left").select("gc", F.coalesce("n", F.lit(0)).alias("n"))


def gc_overlay(histogram: DataFrame) -> DataFrame:
    """gc, n, expected: the normal curve with the histogram's mean and standard deviation (5 if that is 0)."""
    w = Window.partitionBy()
    total = F.sum("n").over(w)
    mean = ratio(F.sum(F.col("gc") * F.col("n")).over(w), total)
    rows = histogram.withColumns({"total": total, "mean": mean})
    variance = ratio(F.sum(F.col("n") * (F.col("gc") - F.col("mean")) * (F.col("gc") - F.col("mean"))).over(w), F.col("total"))
    rows = rows.withColumn("sd", F.when(F.sqrt(variance) > 0, F.sqrt(variance)).otherwise(5.0))
    z = (F.col("gc") - F.col("mean")) / F.col("sd")
    return rows.select("gc", "n", (F.exp(z * z * -0.5) * F.col("total") / (F.col("sd") * F.sqrt(F.lit(2.0) * F.pi()))).alias("expected"))


def quality_by_length_bin(reads: DataFrame) -> DataFrame:
    """bin (of 100 bases, 20 for all longer), quality_sum, n."""
    rows = reads.where(F.length("qual") > 0).select(R.length_bin("qual").alias("bin"), quality_sum("qual").alias("q"), F.length("qual").alias("m"))
    return rows.groupBy("bin").agg(F.sum("q").alias("quality_sum"), F.sum("m").alias("n"))


def tile_quality(reads: DataFrame) -> DataFrame:
    """tile, quality_sum, n, mean_quality of Illumina reads."""
    rows = reads.where(F.length("qual") > 0).select(R.illumina_tile("id").alias("tile"), quality_sum("qual").alias("q"), F.length("qual").alias("m")).where("tile IS NOT NULL")
    sums = rows.groupBy("tile").agg(F.sum("q").alias("quality_sum"), F.sum("m").alias("n"))
    return sums.withColumn("mean_quality", ratio(F.col("quality_sum"), F.col("n")))


def channel_counts(reads: DataFrame) -> DataFrame:
    return reads.select(R.ont_channel("id").alias("channel")).where("channel IS NOT NULL").groupBy("channel").agg(F.count("*").alias("n"))


def channel_occupancy(channels: DataFrame, bins: int = 20) -> DataFrame:
    """bin, low, high, channels: channels by their count of reads, in ``bins`` equal ranges or fewer, empty ones too."""
    ends = channels.agg(F.min("n").alias("lo"), F.max("n").alias("hi")).where("lo IS NOT NULL")
    ends = ends.withColumn("width", F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo") + 1) / bins)))
    spine = ends.select("lo", "hi", "width", F.explode(F.sequence(F.lit(0), F.expr("(hi - lo) div width"))).alias("bin"))
    counted = channels.join(F.broadcast(ends), F.lit(True)).groupBy(F.expr("(n - lo) div width").alias("bin")).agg(F.count("*").alias("c"))
    return spine.join(counted, "bin", "left").select(F.col("bin").cast("int"), (F.col("lo") + F.col("bin") * F.col("width")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("width") - 1).alias("high"), F.coalesce("c", F.lit(0)).alias("channels"))


def reads_over_time(reads: DataFrame, bucket: int = C.TIME_BUCKET) -> DataFrame:
    """minutes since the first read's bucket, cumulative_reads, for every bucket up to the last."""
    times = reads.select(R.ont_start("id").alias("t")).where("t IS NOT NULL")
    first = times.agg(F.min("t").alias("t0"), F.max("t").alias("t1")).where("t0 IS NOT NULL")
    spine = first.select(F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(t1 - t0) div {bucket}"))).alias("b"))
    counts = times.join(F.broadcast(first), F.lit(True)).groupBy(F.expr(f"(t - t0) div {bucket}").alias("b")).agg(F.count("*").alias("n"))
    cum = F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
    return spine.join(counts, "b", "left").select((F.col("b") * (bucket // 60)).alias("minutes"), cum.alias("cumulative_reads"))


def quality_vs_length(reads: DataFrame, stride: int = C.SCATTER_STRIDE, points: int = C.SCATTER_POINTS) -> DataFrame:
    """ord, length, mean_quality of every 50th read, the first 2000 of them: a sample by definition."""
    rows = reads.where((F.col("ord") % stride == 0) & (F.length("qual") > 0))
    rows = rows.orderBy("ord", "id", "seq", "qual").limit(points)
    return rows.select("ord", F.length("seq").alias("length"), (quality_sum("qual") / F.length("qual")).cast("float").alias("mean_quality"))


def trim_stats(trimmed: DataFrame) -> DataFrame:
    """Among kept reads: trimmed_reads (with an adapter), trimmed_bases (of these, by all steps), trimmed_percent."""
    hit = F.col("keep") & F.col("adapter").isNotNull()
    sums = trimmed.agg(F.count_if(hit).alias("trimmed_reads"), F.coalesce(F.sum(F.when(hit, F.col("len0") - F.length("seq"))), F.lit(0)).alias("trimmed_bases"), F.count_if(F.col("keep")).alias("reads"))
    return sums.withColumn("trimmed_percent", percent(F.col("trimmed_reads"), F.col("reads"))).drop("reads")


def trimmed_by_adapter(trimmed: DataFrame) -> DataFrame:
    return trimmed.where("keep AND adapter IS NOT NULL").groupBy("adapter").agg(F.count("*").alias("n"))


def long_read_mode(reads: DataFrame, forced: bool = False) -> DataFrame:
    """median_length of the first 1000 reads (the whole mean of the middle two), ont, long_read."""
    some = first_reads(reads, C.LONG_SAMPLE).select(F.length("seq").alias("n"), R.is_ont("id").alias("ont"))
    got = some.agg(F.sort_array(F.collect_list("n")).alias("a"), F.coalesce(F.bool_or("ont"), F.lit(False)).alias("ont"))
    size = F.size("a")
    middle = F.when(size == 0, 0).otherwise(F.floor((F.get("a", F.floor((size - 1) / 2).cast("int")) + F.get("a", F.floor(size / 2).cast("int"))) / 2))
    got = got.select(middle.cast("long").alias("median_length"), "ont")
    return got.withColumn("long_read", F.lit(forced) | (F.col("median_length") > C.LONG_MEDIAN) | F.col("ont"))


def batch_summary(trimmed: DataFrame, by: str = "sample") -> DataFrame:
    """One row for each sample, and one (null) for all of them, from one pass."""
    return summary(trimmed, by, rollup=True)


def pair_up(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mates joined by their place (ord) and pooled as reads of their own; a read without a mate goes."""
    a, b = (df.select("ord", F.struct("*", F.lit(k).cast("tinyint").alias("mate")).alias(f"_{k}")) for k, df in ((1, first), (2, second)))
    return a.join(b, "ord").select(F.explode(F.array("_1", "_2")).alias("r")).select("r.*")
