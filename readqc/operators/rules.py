"""Rules over the metrics: module status, card classes, suggestions, comparison, and the browser profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readqc.operators import metrics as M
from readqc.operators.trim import kept as kept_reads

PASS, WARN, FAIL = "pass", "warn", "fail"
# Modules in the order of reports.
MODULES = (
    "Per-base quality", "Per-sequence quality", "Per-base sequence content", "GC content", "N content", "Sequence length",
    "Duplication level", "Overrepresented seqs", "Adapter content",
)


def grade(ok: Column, fair: Column) -> Column:
    return F.when(ok, PASS).when(fair, WARN).otherwise(FAIL)


def at_least(c: Column, ok: float, fair: float) -> Column:
    return grade(c >= ok, c >= fair)


def below(c: Column, ok: float, fair: float) -> Column:
    return grade(c < ok, c < fair)


def between(c: Column, ok: tuple[float, float], fair: tuple[float, float]) -> Column:
    return grade(c.between(*ok), c.between(*fair))


def facts(trimmed: DataFrame, counts: DataFrame, dup_percent: DataFrame, overrepresented: DataFrame, long_read: DataFrame) -> DataFrame:
    """One row with all that the rules look at, joined from one-row frames."""
    by_pos = M.quality_by_position(counts)
    worst = by_pos.where("n > 0").agg(F.min("mean_quality").alias("worst_quality"), F.max("pos").alias("last_quality"))
    drop = by_pos.where("n > 0 AND mean_quality > 0 AND mean_quality < 20").agg(F.min("pos").alias("drop_at"))
    comp = M.base_composition(counts)
    last = comp.agg(F.max("pos").alias("last_base"))
    skew = comp.agg(
        F.max(F.greatest(F.abs(F.col("a_percent") - F.col("t_percent")), F.abs(F.col("c_percent") - F.col("g_percent")))).alias("worst_skew"),
        F.max("other_percent").alias("worst_n"),
    )
    tail = comp.join(F.broadcast(last), F.col("pos") > F.col("last_base") - 10).agg(F.sum("g_percent").alias("tail_g"), F.max("last_base").alias("last_base"))
    over = overrepresented.agg(F.count("*").alias("n_overrepresented"), F.coalesce(F.max("percentage"), F.lit(0.0)).alias("worst_overrepresented"))
    out = M.summary(trimmed)
    for part in (worst, drop, skew, tail, over, dup_percent.select("dup_percent"), long_read.select("long_read"), M.n50_n90(kept_reads(trimmed))):
        out = out.join(F.broadcast(part), F.lit(True))
    return out


def module_status(facts: DataFrame) -> DataFrame:
    """module, status in report order; the two quality modules only if there are qualities."""
    c, long = F.col, F.col("long_read")
    grades = (
        F.when(long, at_least(c("worst_quality"), 10, 8)).otherwise(at_least(c("worst_quality"), 28, 20)),
        F.when(long, at_least(c("avg_quality"), 10, 8)).otherwise(at_least(c("q30_percent"), 80, 60)),
        F.when(F.coalesce("worst_skew", F.lit(0.0)) > 20, FAIL).when(F.coalesce("worst_skew", F.lit(0.0)) > 10, WARN).otherwise(PASS),
        between(c("gc_percent"), (20, 80), (10, 90)),
        below(F.coalesce("worst_n", F.lit(0.0)), 5, 20),
        F.when(long | (c("max_length") == c("min_length")), PASS).otherwise(WARN),
        below(c("dup_percent"), 20, 50),
        F.when(c("n_overrepresented") == 0, PASS).when(c("worst_overrepresented") >= 1, FAIL).otherwise(WARN),
        below(c("adapter_percent"), 5, 20),
    )
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(name).alias("module"), g.alias("status")) for i, (name, g) in enumerate(zip(MODULES, grades, strict=True))])
    return facts.select(F.explode(rows).alias("r"), "quality_bases").where("quality_bases > 0 OR r.place >= 2").select("r.module", "r.status", "r.place").orderBy("place").drop("place")


def browser_status(facts: DataFrame) -> DataFrame:
    """The seven modules and limits of the browser profile."""
    c = F.col
    grades = (
        ("Per-base quality", at_least(c("avg_quality"), 28, 20)), ("Per-read quality", at_least(c("q30_percent"), 70, 50)),
        ("GC content", between(c("gc_percent"), (35, 65), (25, 75))), ("Adapter content", below(c("adapter_percent"), 1, 10)),
        ("Sequence duplication", below(c("dup_percent"), 5, 20)),
        ("Overrepresented seqs", grade(c("n_overrepresented") == 0, c("n_overrepresented") <= 3)),
        ("N content", F.when(F.coalesce("worst_n", F.lit(0.0)) > 5, FAIL).otherwise(PASS)),
    )
    return facts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("module"), g.alias("status")) for n, g in grades])).alias("r")).select("r.*")


def card_classes(facts: DataFrame) -> DataFrame:
    """card, value, class of the overview's cards. Long reads seldom reach a score of 30: theirs are of 10 and 20."""
    c, long = F.col, F.col("long_read")
    ok_or_warn = lambda cond: F.when(cond, PASS).otherwise(WARN)
    cards = (
        ("n50", c("n50"), F.when(long, ok_or_warn(c("n50") > 10_000)).otherwise("")),
        ("gc", c("gc_percent"), between(c("gc_percent"), (35, 65), (25, 75))),
        ("quality", c("avg_quality"), F.when(long, at_least(c("avg_quality"), 10, 8)).otherwise(at_least(c("avg_quality"), 30, 20))),
        (F.when(long, "q10").otherwise("q20"), F.when(long, c("q10_percent")).otherwise(c("q20_percent")), ok_or_warn(F.when(long, c("q10_percent") >= 50).otherwise(c("q20_percent") >= 80))),
        (F.when(long, "q20").otherwise("q30"), F.when(long, c("q20_percent")).otherwise(c("q30_percent")), ok_or_warn(F.when(long, c("q20_percent") >= 30).otherwise(c("q30_percent") >= 70))),
        ("adapter", c("adapter_percent"), below(c("adapter_percent"), 1, 10)),
        ("duplication", c("dup_percent"), below(c("dup_percent"), 5, 20)),
    )
    return facts.select(F.explode(F.array(*[F.struct((F.lit(n) if isinstance(n, str) else n).alias("card"), v.cast("double").alias("value"), k.alias("class")) for n, v, k in cards])).alias("r")).select("r.*")


def suggestions(facts: DataFrame) -> DataFrame:
    """place, option, value, level: options worth trying, with the number that speaks for each; ``strong`` for adapters in
    more than a fifth of the reads."""
    c = F.col
    tail = F.coalesce(c("tail_g"), F.lit(0.0)) / 10
    rules = (
        ("--poly-g 10", tail, (c("last_base") >= 9) & (tail > 40) & (c("gc_percent") < 65)),
        ("--trim", c("adapter_percent"), c("adapter_percent") > 5),
        ("--cut-right --window-quality 20", c("drop_at").cast("double"), c("drop_at") / (c("last_quality") + 1) < 0.9),
        ("--min-quality 20", c("avg_quality"), (c("avg_quality") > 0) & (c("avg_quality") < 25)),
        ("--max-n 5", c("worst_n"), c("worst_n") > 5),
        ("deduplicate", c("dup_percent"), c("dup_percent") > 50),
    )
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(o).alias("option"), v.alias("value"), F.coalesce(k, F.lit(False)).alias("k")) for i, (o, v, k) in enumerate(rules)])
    found = facts.select(F.explode(rows).alias("r")).where("r.k").select("r.place", "r.option", "r.value")
    return found.withColumn("level", F.when((F.col("option") == "--trim") & (F.col("value") > 20), "strong").otherwise(""))


# Metrics of a comparison, in order.
COMPARED = ("read_count", "total_bases", "avg_length", "gc_percent", "avg_quality", "q10_percent", "q20_percent", "q30_percent", "adapter_percent", "dup_percent", "n50")


def compare(first: DataFrame, second: DataFrame) -> DataFrame:
    """place, metric, first, second, delta of two one-row frames."""
    a = first.select(*[F.col(m).cast("double").alias(f"a_{m}") for m in COMPARED])
    b = second.select(*[F.col(m).cast("double").alias(f"b_{m}") for m in COMPARED])
    both = a.join(F.broadcast(b), F.lit(True))
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(m).alias("metric"), F.col(f"a_{m}").alias("first"), F.col(f"b_{m}").alias("second"), (F.col(f"b_{m}") - F.col(f"a_{m}")).alias("delta")) for i, m in enumerate(COMPARED)])
    return both.select(F.explode(rows).alias("r")).select("r.*")


def sample_profile(trimmed: DataFrame) -> DataFrame:
    """The one row of a sample that ``compare`` takes."""
    reads = kept_reads(trimmed)
    return M.summary(trimmed).join(F.broadcast(M.duplication_rate(reads, exact=True).select("dup_percent")), F.lit(True)).join(F.broadcast(M.n50_n90(reads)), F.lit(True))
