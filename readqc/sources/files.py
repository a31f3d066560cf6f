"""FASTQ and FASTA files, plain or compressed, as reads (sample, ord, id, seq, qual).

Files are read as text by Spark, so any store and codec that Spark knows will do, and large plain files are split. A first
cheap pass counts the lines (FASTA: headers) of each split, so that each split knows the exact number of its first line:
record borders never have to be guessed from ``@`` or ``+``, which quality lines may hold too. Files of a codec that can't
be split need no such pass. A FASTQ record is every fourth line and its next three, taken by Arrow for whole batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from readqc.session import written

SCHEMA = "sample string, ord long, id string, seq string, qual string"


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(paths)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _whole_files(paths: list[str]) -> bool:
    """Whether each file is one split, as its codec can't be split."""
    return all(p.lower().endswith((".gz", ".gzip")) for p in paths)


def _before(counts: list) -> dict[tuple[str, int], int]:
    """From rows (file, start, n) of all splits, the sum of n over the splits before each."""
    out: dict[tuple[str, int], int] = {}
    before: dict[str, int] = {}
    for r in sorted(counts, key=lambda r: (r["file"], r["start"])):
        out[r["file"], r["start"]] = before.get(r["file"], 0)
        before[r["file"]] = before.get(r["file"], 0) + r["n"]
    return out


def _first_of(firsts: dict, split: tuple[str, int]) -> int:
    """What stands before a split; nothing before the first one of a file."""
    if split[1] == 0:
        return 0
    if split not in firsts:
        raise RuntimeError(f"the splits of {split[0]} aren't those that were counted, as settings of the session have changed since; read it again")
    return firsts[split]


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """The lines of each split in a batch."""
    if not batch.num_rows:
        return
    file, start = batch.column(1).dictionary_encode(), batch.column(2).to_numpy()
    name = file.indices.to_numpy()
    cuts = np.r_[0, np.flatnonzero((np.diff(start) != 0) | (np.diff(name) != 0)) + 1, batch.num_rows].tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield (file.dictionary[int(name[a])].as_py(), int(start[a])), batch.column(0).slice(a, b - a)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split the number of its lines, and the first and last three of them."""
    at, n, head, tail = None, 0, [], []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]], pa.int64()), pa.array([n], pa.int64()), pa.array([head], pa.list_(pa.string())), pa.array([tail], pa.list_(pa.string()))], names=["file", "start", "n", "head", "tail"])

    for batch in batches:
        for split, lines in _runs(batch):
            if split != at:
                if at is not None:
                    yield row()
                at, n, head, tail = split, 0, [], []
            if n < 3:
                head = head + lines.slice(0, 3 - n).to_pylist()
            n += len(lines)
            tail = (tail + lines.slice(max(0, len(lines) - 3)).to_pylist())[-3:]
    if at is not None:
        yield row()


def _records(batches: Iterator[pa.RecordBatch], firsts: dict) -> Iterator[pa.RecordBatch]:
    """The records that lie whole in a split: every fourth line from the first header on."""
    at, n, rest = None, 0, None
    for batch in batches:
        for split, lines in _runs(batch):
            if split != at:
                at, n, rest = split, _first_of(firsts, split), None
                skip = min(-n % 4, len(lines))
                lines, n = lines.slice(skip), n + skip
            elif n % 4 and rest is None:  # a split of fewer lines than are left of a record
                skip = min(-n % 4, len(lines))
                lines, n = lines.slice(skip), n + skip
            if rest is not None and len(rest):
                lines = pa.concat_arrays([rest, lines])
            if n % 4 and not len(lines):
                continue
            whole = len(lines) // 4
            rest = lines.slice(4 * whole)
            place = 4 * np.arange(whole)
            head, seq, plus, qual = (lines.take(pa.array(place + k)) for k in range(4))
            bad = pc.invert(pc.and_(pc.starts_with(head, "@"), pc.starts_with(plus, "+")))
            yield pa.RecordBatch.from_arrays([pa.array([at[0]] * whole, pa.string()), pa.array(n // 4 + np.arange(whole)), head, seq, qual, bad], names=["file", "ord", "id", "seq", "qual", "bad"])
            n += 4 * whole


def _fastq(lines: DataFrame, whole_files: bool) -> DataFrame:
    """Records in one pass. Files that can be split are first counted, line by line; the same pass keeps the lines at the
    borders of splits, of which the few records across borders are made."""
    spark = lines.sparkSession
    ends = None if whole_files else written(lines.mapInArrow(_ends, "file string, start long, n long, head array<string>, tail array<string>"), "splits")
    first = spark.sparkContext.broadcast({} if ends is None else _before(ends.select("file", "start", "n").collect()))
    every = lines.mapInArrow(lambda batches: _records(batches, first.value), "file string, ord long, id string, seq string, qual string, bad boolean")
    if ends is not None:
        before = spark.createDataFrame([(f, s, n) for (f, s), n in first.value.items()], "file string, start long, first long")
        rows = ends.join(F.broadcast(before), ["file", "start"]).withColumn("end", F.col("first") + F.col("n"))
        head = rows.select("file", "first", "end", F.posexplode("head").alias("i", "value")).select("file", (F.col("first") + F.col("i")).alias("line"), "first", "end", "value")
        tail = rows.select("file", "first", "end", F.size("tail").alias("k"), F.posexplode("tail").alias("i", "value")).select("file", (F.col("end") - F.col("k") + F.col("i")).alias("line"), "first", "end", "value")
        record = F.expr("line div 4")
        torn = head.union(tail).where((record * 4 < F.col("first")) | (record * 4 + 4 > F.col("end")))
        parts = torn.groupBy("file", record.alias("ord")).agg(*[F.max(F.when(F.col("line") % 4 == k, F.col("value"))).alias(c) for k, c in enumerate(("id", "seq", "plus", "qual"))])
        # A record that ends the file before its quality line isn't one.
        parts = parts.where("qual IS NOT NULL").select("file", "ord", "id", "seq", "qual", (~F.col("id").startswith("@") | ~F.col("plus").startswith("+")).alias("bad"))
        every = every.unionByName(parts)
    clean = lambda c: F.regexp_replace(c, "\r$", "")
    return every.select("file", "ord", F.substr("id", F.lit(2)).alias("id"), clean("seq").alias("seq"), clean("qual").alias("qual"), "bad")


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["file", "ord", "place", "id", "seq", "whole"])


def _fasta(lines: DataFrame, whole_files: bool) -> DataFrame:
    """Records of any number of lines. Files that can be split are first counted by headers; the parts of records across
    splits are joined by their place."""
    counts = [] if whole_files else lines.groupBy("file", "start").agg(F.count_if(F.col("value").startswith(">")).alias("n")).collect()
    first = lines.sparkSession.sparkContext.broadcast(_before(counts))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, at, n, head, seq = first.value, None, -1, None, []

        def part(ended: bool) -> list[tuple]:
            if at is None or (head is None and not seq):
                return []
            return [(at[0], n, at[1], head, "".join(seq), ended and head is not None)]

        for batch in batches:
            rows = []
            for split, own in _runs(batch):
                if at != split:
                    rows += part(whole_files)
                    at, head, seq, n = split, None, [], _first_of(firsts, split) - 1
                own = pc.utf8_rtrim(own, "\r")
                values, marks = own.to_pylist(), np.flatnonzero(pc.starts_with(own, ">").to_numpy(zero_copy_only=False)).tolist()
                for a, b in zip([-1, *marks], [*marks, len(values)], strict=True):
                    if a >= 0:
                        rows += part(True)
                        n, head, seq = n + 1, values[a][1:], []
                    seq += [x.strip() for x in values[a + 1 : b]]
            yield _emit(rows)
        yield _emit(part(whole_files))

    parts = lines.mapInArrow(parse, "file string, ord long, place long, id string, seq string, whole boolean")
    every = parts.where("whole").select("file", "ord", "id", "seq")
    if not whole_files:
        torn = parts.where("NOT whole AND ord >= 0").groupBy("file", "ord").agg(F.max("id").alias("id"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "seq"))), lambda p: p["seq"]), "").alias("seq"))
        every = every.unionByName(torn)
    return every.select("file", "ord", "id", "seq", F.lit(None).cast("string").alias("qual"), F.lit(False).alias("bad"))


def normalise(seq):
    """Upper case, U as T, other letters than A, C, G, T and gaps as N."""
    upper = F.translate(F.upper(seq), "U", "T")
    return F.regexp_replace(upper, "[^ACGTN-]", "N")


def read_format(spark: SparkSession, path: str) -> str:
    """``fasta`` if the first character of the first line is ``>``, else ``fastq``."""
    row = spark.read.option("lineSep", "\n").text(path).where("value <> ''").first()
    return "fasta" if row is not None and row["value"].startswith(">") else "fastq"


def read_reads(spark: SparkSession, paths: str | list[str] | tuple[str, ...], fmt: str = "auto", mode: str = "PERMISSIVE", normalised: bool = True, watch: Observation | None = None, flagged: bool = False) -> DataFrame:
    """Reads of the files: sample (name of the file), ord (0-based number of the record in its file), id, seq, qual (null
    in FASTA). ``mode``: PERMISSIVE takes records whose header lacks ``@`` or third line ``+`` as they are, DROPMALFORMED
    leaves them out (``watch`` then observes their number as ``malformed``), FAILFAST raises an error. Sequence and quality
    may differ in length. ``normalised`` folds case and rare letters, whatever the kind of file; ``flagged`` adds whether a
    record is malformed (bad)."""
    if mode not in ("PERMISSIVE", "DROPMALFORMED", "FAILFAST"):
        raise ValueError(f"unknown mode {mode}")
    out = None
    by_kind: dict[tuple[str, bool], list[str]] = {}
    for path in [paths] if isinstance(paths, str) else list(paths):
        by_kind.setdefault((read_format(spark, path) if fmt == "auto" else fmt, _whole_files([path])), []).append(path)
    for (kind, whole_files), own in by_kind.items():
        rows = (_fasta if kind == "fasta" else _fastq)(_lines(spark, own), whole_files)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], SCHEMA)
    if mode == "DROPMALFORMED":
        out = (out.observe(watch, F.count_if("bad").alias("malformed")) if watch else out).where("NOT bad")
    elif mode == "FAILFAST":
        wrong = F.raise_error(F.concat(F.lit("malformed record "), F.col("ord").cast("string"), F.lit(" of "), F.col("file")))
        out = out.withColumn("id", F.when(F.col("bad"), wrong).otherwise(F.col("id")))
    seq = normalise(F.col("seq")) if normalised else F.col("seq")
    return out.select(F.element_at(F.split("file", "/"), -1).alias("sample"), "ord", "id", seq.alias("seq"), "qual", *["bad"] * flagged)


def read_mate(spark: SparkSession, path: str, strict: bool = False, most_bad: int = 5_000_000) -> tuple[DataFrame, int]:
    """One file of a pair, written to the shared folder, and how many malformed records it has. These are left out and
    the others numbered without them, so that mates meet by their place among good records. The numbers of malformed records
    are broadcast; more than ``most_bad`` of them are an error."""
    rows = written(read_reads(spark, path, mode="FAILFAST" if strict else "PERMISSIVE", flagged=True), "mate")
    bad = rows.where("bad")
    if not (n := bad.count()):
        return rows.drop("bad"), 0
    if n > most_bad:
        raise ValueError(f"{n} malformed records in {path}: too many to pair its reads")
    gone = spark.sparkContext.broadcast(np.sort(np.array([r["ord"] for r in bad.select("ord").toLocalIterator()], np.int64)))

    @F.arrow_udf(LongType())
    def place(ord_: pa.Array) -> pa.Array:
        own = ord_.to_numpy()
        return pa.array(own - np.searchsorted(gone.value, own))

    return rows.where("NOT bad").drop("bad").withColumn("ord", place("ord")), n
