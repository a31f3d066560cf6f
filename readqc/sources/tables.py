"""Reads derived from the driver's tables by SQL that Spark and DuckDB evaluate alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from readqc.functions.reads import settled

READS = """
SELECT l_orderkey*8+l_linenumber AS ord,
 concat('SIM:1:FC:1:',cast(1101+l_suppkey % 8 AS string),':',cast(l_partkey AS string),':',cast(l_orderkey AS string),' 1:N:0:ATCG') AS id,
 seq,
 CASE WHEN l_linenumber=5 THEN concat(substr(q4,1,length(seq)-12),'############') ELSE substr(q4,1,length(seq)) END AS qual,
 l_linestatus AS sample, l_suppkey % 8 AS lane
FROM (SELECT *, CASE l_linenumber
   WHEN 1 THEN concat(substr(body,1,30),'AGATCGGAAGAGCACACGTCT',substr(body,31,20))
   WHEN 2 THEN concat(body,'GGGGGGGGGGGGGG')
   WHEN 3 THEN concat(substr(body,1,10),'NNNNNNNN',substr(body,19))
   WHEN 4 THEN concat(substr(body,1,8),'CTGTCTCTTATACACATCT',substr(body,9,30))
   ELSE body END AS seq
 FROM (SELECT *, substr(concat({seeds}),1,want) AS body,
   concat({quals}) AS q4
  FROM (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_linestatus, 41 + cast(floor(l_quantity) AS int) % 50 AS want,
    concat(cast(l_orderkey AS string),'-',cast(l_linenumber AS string)) AS rk,
    CASE WHEN l_returnflag='R' THEN concat('dup',cast(l_partkey % 200 AS string))
         ELSE concat(cast(l_orderkey AS string),'-',cast(l_linenumber AS string)) END AS sk
   FROM {lineitem}) k) b) s
"""
ONT = """
SELECT event_id AS ord, concat(cast(event_id AS string),' runid=r1 read=',cast(event_id AS string),' ch=',cast(1+user_id % 512 AS string),
 ' start_time=',{time}) AS id, repeat(seq, 8 + cast(event_id % 40 AS int)) AS seq, repeat(qual, 8 + cast(event_id % 40 AS int)) AS qual
FROM (SELECT event_id, user_id, ts, translate(md5(concat('o',cast(event_id AS string))),'0123456789abcdef','ACGTACGTACGTACGT') AS seq,
  translate(md5(concat('q',cast(event_id AS string))),'0123456789abcdef','%&()*+,-./012345') AS qual FROM {events}) e
"""


def _parts(letters: str, key: str, alphabet: str) -> str:
    return ",".join(f"translate(md5(concat('{x}',{key})),'0123456789abcdef','{alphabet}')" for x in letters)


def reads_sql(lineitem: str = "lineitem", mate: int = 1) -> str:
    """SQL of the reads; the second mate has other bodies."""
    return READS.format(seeds=_parts("abc" if mate == 1 else "pqr", "sk", "ACGTACGTACGTACGT"), quals=_parts("defg", "rk", "5:>?@ABCDEFGHIII"), lineitem=lineitem)


def ont_sql(events: str = "events", duckdb: bool = True) -> str:
    time = "strftime(ts,'%Y-%m-%dT%H:%M:%SZ')" if duckdb else "date_format(ts,\"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
    return ONT.format(time=time, events=events)


def _spread(rows: DataFrame, *key: str) -> DataFrame:
    """A table of few large row groups is dealt out, while its rows are still a few numbers; one that the scan splits
    already stays where it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if len(rows.inputFiles()) >= 2 * cores else rows.repartition(2 * cores, *key)


def derived_reads(spark: SparkSession, sf_dir: str, mate: int = 1) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_linestatus", "l_quantity", "l_returnflag")
    return settled(spark.sql(reads_sql("{lineitem}", mate), lineitem=_spread(rows, "l_orderkey", "l_linenumber")))


def derived_ont(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts")
    return settled(spark.sql(ont_sql("{events}", duckdb=False), events=_spread(rows, "event_id")))
