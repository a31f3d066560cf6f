"""The trim chain and the read filters.

``trim`` keeps every row and adds ``keep``; metrics look at the kept ones. All steps are native columns but the sliding
windows, whose width is an option, and the least mean quality: one Arrow kernel finds the cuts of all windows by running
sums over a whole batch, another adds up scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readqc.config import ADAPTER_MATCH, ADAPTERS, QCConfig
from readqc.functions import reads as R
from readqc.functions.arrow import SCORE, flat, quality_sum


def _cuts(running: np.ndarray, starts: np.ndarray, lens: np.ndarray, window: int, quality: int, kind: str) -> np.ndarray:
    """``window_cuts`` of parts (``starts``, ``lens``) of one array of scores, given its running sums."""
    full = lens >= window
    count = np.where(full, lens - window + 1, 0)  # windows of each read
    owner = np.repeat(np.arange(len(lens)), count)
    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)  # window's start in its read
    begin = starts[owner] + at
    good = running[begin + window] - running[begin] >= quality * window
    wanted = np.flatnonzero(~good if kind == "right" else good)
    owner, at = owner[wanted], at[wanted]
    fresh = np.r_[True, owner[1:] != owner[:-1]][: len(owner)]
    if kind == "tail":
        cut = np.where(full, 0, lens)
        last = np.r_[fresh[1:], True][: len(owner)]
        cut[owner[last]] = at[last] + window
    else:
        cut = np.where(full, lens - window + 1, 0) if kind == "front" else lens.copy()
        cut[owner[fresh]] = at[fresh]
    return cut


def window_cuts(quals: pa.Array, window: int, quality: int, kind: str) -> np.ndarray:
    """For each quality string the cut of a sliding window of whole mean scores: ``front``: start of the first good
    window; ``right``: start of the first bad one; ``tail``: end of the last good one."""
    data, borders = flat(quals)
    running = np.concatenate([np.zeros(1, np.int64), np.cumsum(SCORE[data], dtype=np.int64)])
    return _cuts(running, borders[:-1], np.diff(borders), window, quality, kind)


def window_cut(qual: Column | str, window: int, quality: int, kind: str) -> Column:
    """``window_cuts`` as a column; null without qualities."""

    @F.arrow_udf("int")
    def cut(q: pa.Array) -> pa.Array:
        return pa.array(window_cuts(q, window, quality, kind), pa.int32(), mask=pc.is_null(q).to_numpy(zero_copy_only=False))

    return cut(F.col(qual) if isinstance(qual, str) else qual)


def windows(cfg: QCConfig, qual: Column, bases: Column) -> Column:
    """All sliding windows asked for, one after another in one pass over the scores: front (bases to drop), left (bases to
    keep after that; null: all) and gone (whether one of them used the read up). Nulls leave a read as it is."""
    wanted = [kind for on, kind in ((cfg.cut_front, "front"), (cfg.cut_right, "right"), (cfg.cut_tail, "tail")) if on]
    width, quality = cfg.window, cfg.window_quality

    @F.arrow_udf("struct<front:int,left:int,gone:boolean>")
    def cut(q: pa.Array, n: pa.Array) -> pa.Array:
        data, borders = flat(q)
        running = np.concatenate([np.zeros(1, np.int64), np.cumsum(SCORE[data], dtype=np.int64)])
        starts, lens = borders[:-1].copy(), np.diff(borders)
        some = pc.is_valid(q).to_numpy(zero_copy_only=False)
        front, gone = np.zeros(len(lens), np.int64), np.zeros(len(lens), bool)
        for kind in wanted:
            at = _cuts(running, starts, lens, width, quality, kind)
            if kind == "front":
                front, gone = at, at >= n.to_numpy(zero_copy_only=False)
                at = np.minimum(at, lens)
                starts, lens = starts + at, lens - at
            else:
                gone |= at == 0
                lens = at
        return pa.StructArray.from_arrays([pa.array(np.where(some, front, 0), pa.int32()), pa.array(lens, pa.int32(), mask=~some | (wanted == ["front"])), pa.array(gone & some)], names=["front", "left", "gone"])

    return cut(qual, bases)


def adapter_leads(cfg: QCConfig) -> tuple[tuple[str, str], ...]:
    """(name, leading bases) of the adapters looked for, in order of precedence."""
    return tuple((name, a[:ADAPTER_MATCH]) for name, a in ADAPTERS) + tuple(("custom", a[:ADAPTER_MATCH]) for a in cfg.custom_adapters if a)


def _first(df: DataFrame, seq: Column, qual: Column | None = None) -> DataFrame:
    """Keep the first ``seq`` bases and ``qual`` (by default as many) qualities; lengths beyond the end change nothing."""
    df = df.withColumns({"_s": seq.cast("int"), "_q": (seq if qual is None else qual).cast("int")})
    df = R.settled(df)
    return df.withColumns({"seq": F.substr("seq", F.lit(1), F.greatest("_s", F.lit(0))), "qual": F.substr("qual", F.lit(1), F.greatest("_q", F.lit(0)))}).drop("_s", "_q")


def _after(df: DataFrame, start: Column) -> DataFrame:
    """Drop the first ``start`` bases and qualities."""
    df = df.withColumn("_s", start.cast("int") + 1)
    rest = F.lit(2**31 - 1)
    return df.withColumns({"seq": F.substr("seq", F.col("_s"), rest), "qual": F.substr("qual", F.col("_s"), rest)}).drop("_s")


def trim(reads: DataFrame, cfg: QCConfig | None = None) -> DataFrame:
    """Apply the chain to ``reads`` (seq, qual and any other columns). Adds len0 (bases before), adapter (name or null) and
    keep; seq and qual are the trimmed ones. A read that a step uses up isn't kept."""
    cfg = cfg or QCConfig()
    df = reads.withColumns({"len0": F.length("seq"), "gone": F.lit(False)})
    n, m = F.length("seq"), F.length("qual")
    if cfg.trim_front:
        df = _after(df.withColumn("gone", n <= cfg.trim_front), F.lit(cfg.trim_front))
    if cfg.trim_tail:
        df = _first(df.withColumn("gone", F.col("gone") | (n <= cfg.trim_tail)), n - cfg.trim_tail)
    if cfg.cut_front or cfg.cut_right or cfg.cut_tail:
        df = R.settled(df.withColumn("_w", windows(cfg, F.col("qual"), n)))
        start, left = F.col("_w.front") + 1, F.coalesce("_w.left", F.lit(2**31 - 1))
        df = df.withColumns({"gone": F.col("gone") | F.col("_w.gone"), "seq": F.substr("seq", start, left), "qual": F.substr("qual", start, left)}).drop("_w")
    if cfg.poly_g:
        df = _first(df, F.length(F.regexp_replace("seq", f"G{{{cfg.poly_g},}}$", "")))
    if cfg.quality_trim:
        good = F.length(F.regexp_replace("qual", f"[\\x00-\\x{32 + cfg.quality_trim:02x}]+$", ""))
        df = _first(df, F.coalesce(good, n))
    if cfg.modules.adapter:
        named = adapter_leads(cfg)
        built_in = named[: len(ADAPTERS)]
        # Of a known and a custom adapter at one place the known one counts.
        df = R.settled(df.withColumn("_at", R.adapter_position("seq", tuple(a for _, a in named))))
        df = df.withColumn("adapter", F.when(F.col("_at").isNotNull(), F.coalesce(R.adapter_at("seq", F.col("_at"), built_in), F.lit("custom"))))
        df = _first(df, F.coalesce(F.col("_at") - 1, n), F.coalesce(F.col("_at") - 1, m)).drop("_at")
    else:
        df = df.withColumn("adapter", F.lit(None).cast("string"))
    if cfg.poly_x:
        skip = F.col("seq").endswith("G") if cfg.poly_g else F.lit(False)
        left = F.length(F.regexp_replace("seq", f"(.)\\1{{{max(cfg.poly_x - 1, 0)},}}$", ""))
        df = _first(df, F.when(skip, n).otherwise(left), F.when(skip, m).otherwise(left))
    return R.settled(R.settled(df).withColumn("keep", ~F.col("gone") & passes(cfg)).drop("gone"))


def passes(cfg: QCConfig) -> Column:
    """Whether a read (columns seq, qual) passes the filters."""
    ok = F.length("seq") >= cfg.min_length
    if cfg.max_n is not None:
        ok &= R.n_count("seq") <= cfg.max_n
    if cfg.min_quality:
        mean = F.when(F.length("qual") > 0, F.floor(quality_sum("qual") / F.length("qual"))).otherwise(0)
        ok &= F.col("qual").isNull() | ((F.length("qual") > 0) & (mean >= cfg.min_quality))
    return ok


def kept(trimmed: DataFrame) -> DataFrame:
    return trimmed.where("keep")
