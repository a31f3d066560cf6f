"""Functions of one read: its bases, qualities and header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readqc.config import ADAPTER_MATCH, ADAPTERS, KEY_BASES, LENGTH_BIN, LENGTH_BINS, PHRED_BINS


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def settled(df: DataFrame) -> DataFrame:
    """The same rows, with their columns computed once: the optimizer neither pushes filters below nor repeats an
    expression above for each of its uses, as it would for long chains of string expressions."""
    return df.withColumn("_settled", F.monotonically_increasing_id()).where("_settled >= 0").drop("_settled")


def phred(char: Column | str) -> Column:
    """Score of a quality character."""
    return F.greatest(F.ascii(_col(char)) - 33, F.lit(0))


def count_of(seq: Column | str, letters: str) -> Column:
    """How many of a sequence's characters are among ``letters``."""
    seq = _col(seq)
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def gc_count(seq: Column | str) -> Column:
    return count_of(seq, "GCgc")


def n_count(seq: Column | str) -> Column:
    return count_of(seq, "Nn")


def gc_bin(seq: Column | str) -> Column:
    """GC share in whole percent, cut off; null without bases."""
    seq = _col(seq)
    return F.when(F.length(seq) > 0, F.least(F.floor(gc_count(seq) * 100 / F.length(seq)), F.lit(100)).cast("int"))


def mean_bin(total: Column, length: Column) -> Column:
    """Whole mean score, at most the highest bin; null without qualities."""
    return F.when(length > 0, F.least(F.floor(total / length), F.lit(PHRED_BINS - 1)).cast("int"))


def length_bin(qual: Column | str) -> Column:
    size = F.length(_col(qual))
    return F.when(size.isNotNull(), F.least(F.floor(size / LENGTH_BIN), F.lit(LENGTH_BINS)).cast("int"))


def key(seq: Column | str) -> Column:
    """The leading bases that tell sequences apart."""
    return F.substring(_col(seq), 1, KEY_BASES)


def fingerprint(seq: Column | str) -> Column:
    return F.xxhash64(key(seq))


def kmers(seq: Column | str, k: int = 4) -> Column:
    """All windows of ``k`` bases that are A, C, G or T, in upper case."""
    upper = F.upper(_col(seq))
    windows = F.when(F.length(upper) >= k, F.transform(F.sequence(F.lit(1), F.length(upper) - (k - 1)), lambda i: F.substr(upper, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.filter(windows, lambda w: w.rlike(f"^[ACGT]{{{k}}}$"))


def illumina_tile(header: Column | str) -> Column:
    """Field 5 of the colon-separated first word of a header that has at least 6; null if it is no number."""
    fields = F.split(F.get(F.split(F.ltrim(_col(header)), "\\s+"), F.lit(0)), ":")
    return F.when((F.size(fields) >= 6) & F.get(fields, F.lit(4)).rlike("^\\+?[0-9]+$"), F.get(fields, F.lit(4)).try_cast("long"))


def ont_channel(header: Column | str) -> Column:
    """Digits after the first ``ch=`` word of a nanopore header."""
    return F.nullif(F.regexp_extract(_col(header), "(?:^| )ch=([0-9]+)", 1), F.lit("")).try_cast("long")


def ont_start(header: Column | str) -> Column:
    """Unix seconds of the ``start_time=`` of a nanopore header; zone and fraction aren't read."""
    text = F.regexp_extract(_col(header), "start_time=(.{19})", 1)
    iso = F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}$"), text)
    seconds = F.unix_seconds(F.try_to_timestamp(F.concat(iso, F.lit("Z")), F.lit("yyyy-MM-dd'T'HH:mm:ssX")))
    return F.when(seconds >= 0, seconds)


def is_ont(header: Column | str) -> Column:
    header = _col(header)
    return (header.contains(" ch=") | header.startswith("ch=")) & header.contains("start_time=")


def adapter_position(seq: Column | str, adapters: tuple[str, ...]) -> Column:
    """First position (from 1) at which the leading bases of one of ``adapters`` stand; null if none does."""
    seq = _col(seq)
    found = [F.nullif(F.instr(seq, a), F.lit(0)) for a in dict.fromkeys(adapters)]
    return F.least(*found) if len(found) > 1 else found[0]


def adapter_at(seq: Column | str, position: Column, named: tuple[tuple[str, str], ...]) -> Column:
    """Name of the first of ``named`` adapters whose leading bases stand at ``position``."""
    seq, out = _col(seq), None
    for name, lead in named:
        here = F.substr(seq, position, F.lit(len(lead))) == lead
        out = F.when(here, name) if out is None else out.when(here, name)
    return out


def adapter_source(seq: Column | str) -> Column:
    """Name of the first known adapter whose leading bases stand anywhere in a sequence, or ``No hit``."""
    seq, out = _col(seq), None
    for name, adapter in ADAPTERS:
        here = seq.contains(adapter[:ADAPTER_MATCH])
        out = F.when(here, name) if out is None else out.when(here, name)
    return out.otherwise("No hit")
