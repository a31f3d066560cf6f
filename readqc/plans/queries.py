"""The registered queries over the driver's tables, each with SQL that DuckDB runs to the same result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readqc.config import ADAPTER_MATCH, ADAPTERS, DUPLICATION_FLOORS, DUPLICATION_LEVELS, QCConfig
from readqc.functions import reads as R
from readqc.operators import metrics as M
from readqc.operators import rules
from readqc.operators.trim import kept, passes, trim, window_cut
from readqc.session import shared_root, written
from readqc.sources.files import read_reads
from readqc.sources.sinks import fill_quality, write_fastq
from readqc.sources.tables import derived_ont, derived_reads, ont_sql, reads_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# ---------------------------------------------------------------------------------------------------------------- SQL

_LEADS = list(dict.fromkeys(a[:ADAPTER_MATCH] for _, a in ADAPTERS))


def _at(seq: str = "seq") -> str:
    return "least(" + ", ".join(f"nullif(instr({seq},'{a}'),0)" for a in _LEADS) + ")"


def _name(seq: str = "seq", p: str = "p") -> str:
    return "CASE " + " ".join(f"WHEN substr({seq},{p},{ADAPTER_MATCH})='{a[:ADAPTER_MATCH]}' THEN '{n}'" for n, a in ADAPTERS) + " END"


def _trimmed(source: str, name: str = "t", extra: str = "sample, lane") -> str:
    """CTEs of the default trim: adapters cut, len0 and adapter added."""
    return f"""{name}_a AS (SELECT *, {_at()} AS p FROM {source}),
{name} AS (SELECT ord, id, {extra}, length(seq) AS len0, {_name()} AS adapter, CASE WHEN p IS NULL THEN seq ELSE substr(seq,1,p-1) END AS seq,
  CASE WHEN p IS NULL THEN qual ELSE substr(qual,1,p-1) END AS qual FROM {name}_a)"""


_READS = f"reads AS ({reads_sql()})"
_KEPT = f"{_READS}, {_trimmed('reads')}, k AS (SELECT * FROM t WHERE length(seq) >= 20)"
_QSUM = "coalesce(list_sum([greatest(ascii(c)-33,0) for c in string_split(qual,'') if c <> '']),0)"
_BASES = "b AS (SELECT pos-1 AS pos, upper(substr(seq,pos,1)) AS c FROM (SELECT seq, unnest(range(1,length(seq)+1)) AS pos FROM k) WHERE pos <= 2000)"
_SCORES = "q AS (SELECT pos-1 AS pos, greatest(ascii(substr(qual,pos,1))-33,0) AS s FROM (SELECT qual, unnest(range(1,length(qual)+1)) AS pos FROM k) WHERE pos <= 2000)"
_ONT = f"ont AS ({ont_sql()})"


def _pct(a: str, b: str) -> str:
    return f"round(coalesce({a}*100.0::double/nullif({b},0),0),6)"


def _rat(a: str, b: str) -> str:
    return f"round(coalesce(({a})::double/nullif({b},0),0),6)"


def _summary_sql(source: str = "t", by: str = "", where: str = "") -> str:
    """SQL of ``metrics.summary`` over CTE ``source`` (all reads, trimmed)."""
    group = f" GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}count(*) FILTER (f) AS read_count, count(*) FILTER (NOT f) AS filtered_reads, coalesce(sum(n) FILTER (f),0)::bigint AS total_bases,
 coalesce(min(n) FILTER (f),0)::bigint AS min_length, coalesce(max(n) FILTER (f),0)::bigint AS max_length, coalesce(sum(gc) FILTER (f),0)::bigint AS gc_bases,
 coalesce(sum(qs) FILTER (f),0)::bigint AS quality_sum, coalesce(sum(m) FILTER (f),0)::bigint AS quality_bases,
 coalesce(sum(q1) FILTER (f),0)::bigint AS q10_bases, coalesce(sum(q2) FILTER (f),0)::bigint AS q20_bases, coalesce(sum(q3) FILTER (f),0)::bigint AS q30_bases, count(*) FILTER (f AND adapter IS NOT NULL) AS adapter_hits
 FROM (SELECT *, length(seq) >= 20 AS f, length(seq) AS n, length(seq)-length(translate(seq,'GCgc','')) AS gc, length(qual) AS m, {_QSUM} AS qs,
  len([1 for c in string_split(qual,'') if ascii(c) >= 43]) AS q1, len([1 for c in string_split(qual,'') if ascii(c) >= 53]) AS q2, len([1 for c in string_split(qual,'') if ascii(c) >= 63]) AS q3 FROM {source}{where}) x{group}"""


_SUMMARY_COLUMNS = f"""read_count, filtered_reads, total_bases, min_length, max_length, gc_bases, quality_sum, quality_bases, q10_bases, q20_bases, q30_bases, adapter_hits,
 {_rat('total_bases', 'read_count')} AS avg_length, {_pct('gc_bases', 'total_bases')} AS gc_percent, {_rat('quality_sum', 'quality_bases')} AS avg_quality,
 {_pct('q10_bases', 'quality_bases')} AS q10_percent, {_pct('q20_bases', 'quality_bases')} AS q20_percent, {_pct('q30_bases', 'quality_bases')} AS q30_percent, {_pct('adapter_hits', 'read_count')} AS adapter_percent"""

# ------------------------------------------------------------------------------------------------------------ queries


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, integers as long: what two engines can agree on to the last bit."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, 6).alias(c) if k in ("double", "float") else F.col(c).cast("long").alias(c) if k in ("int", "tinyint", "smallint", "bigint") else F.col(c) for c, k in kinds.items()])


def _trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trim(derived_reads(spark, sf_dir))


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(_trim(spark, sf_dir))


def _sampled(reads: DataFrame) -> DataFrame:
    """Reads for a metric of the first ones, which looks for their end before it reads them."""
    return written(reads.select("ord", "id", "seq", "qual"))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.position_counts(_kept(spark, sf_dir))


@query(f"WITH {_KEPT}, s AS ({_summary_sql()}) SELECT {_SUMMARY_COLUMNS} FROM s")
def qc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.summary(_trim(spark, sf_dir)))


@query(f"WITH {_KEPT} SELECT length(seq) AS length, count(*) AS n FROM k GROUP BY 1")
def length_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.length_histogram(_kept(spark, sf_dir)))


_N50 = """SELECT coalesce(max(length) FILTER (cum >= ceil(total/2.0)),0)::bigint AS n50, coalesce(max(length) FILTER (cum >= ceil(total*9/10.0)),0)::bigint AS n90
 FROM (SELECT length, sum(length*n) OVER (ORDER BY length DESC) AS cum, sum(length*n) OVER () AS total FROM (SELECT length(seq) AS length, count(*) AS n FROM {source} GROUP BY 1))"""


@query(f"WITH {_KEPT} {_N50.format(source='k')}")
def n50_n90(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.n50_n90(_kept(spark, sf_dir)))


@query(f"WITH {_KEPT}, {_SCORES} SELECT pos, sum(s)::bigint AS quality_sum, count(*) AS n, {_rat('sum(s)', 'count(*)')} AS mean_quality FROM q GROUP BY pos")
def qual_by_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.quality_by_position(_counts(spark, sf_dir)))


@query(f"""WITH {_KEPT}, {_SCORES}, h AS (SELECT pos, least(s,42) AS s, count(*) AS n FROM q GROUP BY 1,2),
 c AS (SELECT pos, s, sum(n) OVER (PARTITION BY pos ORDER BY s) AS cum, sum(n) OVER (PARTITION BY pos) AS t FROM h)
 SELECT pos, greatest(min(s) FILTER (cum >= t//4),1) AS q25, greatest(min(s) FILTER (cum >= t//2),1) AS q50, greatest(min(s) FILTER (cum >= (t*3)//4),1) AS q75 FROM c GROUP BY pos""")
def qual_percentiles_by_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.quality_percentiles(_counts(spark, sf_dir)))


_COMP = f"""comp AS (SELECT pos, {", ".join(f"count(*) FILTER (c='{x}') AS {x.lower()}" for x in "ACGT")}, count(*) FILTER (c NOT IN ('A','C','G','T')) AS other, count(*) AS w FROM b GROUP BY pos)"""


@query(f"WITH {_KEPT}, {_BASES}, {_COMP} SELECT pos, a, c, g, t, other, " + ", ".join(f"{_pct(x, 'w')} AS {x}_percent" for x in ("a", "c", "g", "t", "other")) + " FROM comp")
def base_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.base_composition(_counts(spark, sf_dir)))


@query(f"WITH {_KEPT}, {_BASES}, {_COMP} SELECT pos, {_pct('other', 'w')} AS n_percent FROM comp")
def n_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.n_content(_counts(spark, sf_dir)))


_KMERS = f"WITH {_KEPT}, m AS (SELECT upper(substr(seq,pos,4)) AS kmer FROM (SELECT seq, unnest(range(1,length(seq)-2)) AS pos FROM k)) SELECT kmer, count(*) AS n FROM m WHERE regexp_full_match(kmer,'[ACGT]{{4}}') GROUP BY 1"


@query(_KMERS)
def kmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.kmer_counts(_counts(spark, sf_dir)))


@query(f"{_KMERS} ORDER BY n DESC, kmer LIMIT 20")
def kmer_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.top_kmers(_counts(spark, sf_dir)))


_SAMPLE = "first AS (SELECT * FROM k ORDER BY ord, id, seq, qual LIMIT 200000)"
_SOURCE = "CASE " + " ".join(f"WHEN contains(sequence,'{a[:ADAPTER_MATCH]}') THEN '{n}'" for n, a in ADAPTERS) + " ELSE 'No hit' END"


def _over_sql(ctes: str) -> str:
    return f"""WITH {ctes}, {_SAMPLE}, g AS (SELECT substr(seq,1,50) AS sequence, count(*) AS n FROM first WHERE length(seq) >= 4 GROUP BY 1),
 o AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS kk, sum(n) OVER () AS sampled FROM g),
 l AS (SELECT greatest(ceil(max(sampled)*0.001::double), max(n) FILTER (i = floor(kk*0.99::double)), 5) AS least, max(sampled) AS sampled FROM o)
 SELECT sequence, n, {_pct('n', 'sampled')} AS percentage, {_SOURCE} AS possible_source FROM g, l WHERE n >= least ORDER BY n DESC, sequence LIMIT 20"""


@query(_over_sql(_KEPT))
def overrepresented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.overrepresented(_sampled(_kept(spark, sf_dir))))


@query(_over_sql(f"{_READS}, k AS (SELECT * FROM reads WHERE length(seq) >= 20)"))
def overrepresented_untrimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the adapter module off, so that sources are found."""
    return rounded(M.overrepresented(_sampled(derived_reads(spark, sf_dir).where("length(seq) >= 20"))))


@query(f"WITH {_KEPT}, d AS (SELECT count(*) AS read_count, count(DISTINCT substr(seq,1,50)) AS distinct_reads FROM k) SELECT *, {_pct('(read_count-distinct_reads)', 'read_count')} AS dup_percent FROM d")
def dup_rate_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.duplication_rate(_kept(spark, sf_dir), exact=True))


@query()
def dup_rate_hll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.duplication_rate(_kept(spark, sf_dir)))


def _close(rate: DataFrame, reads: DataFrame) -> DataFrame:
    """read_count, and whether the estimate of distinct reads is off by 4 % (four standard errors) at most."""
    exact = M.duplication_rate(reads, exact=True).select(F.col("distinct_reads").alias("d"))
    return rate.join(F.broadcast(exact), F.lit(True)).select("read_count", (F.abs(F.col("distinct_reads") - F.col("d")) <= F.col("d") * 0.04).alias("close"))


@query(f"WITH {_KEPT} SELECT count(*) AS read_count, true AS close FROM k")
def dup_rate_hll_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = _sampled(_kept(spark, sf_dir))
    return rounded(_close(M.duplication_rate(reads), reads))


@query(f"WITH {_KEPT} SELECT count(*) AS read_count, true AS close FROM k")
def dup_rate_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a sketch for each sample, merged."""
    reads = written(_kept(spark, sf_dir).select("sample", "ord", "id", "seq", "qual"))
    return rounded(_close(M.merged_duplication(written(M.duplication_sketches(reads, "sample"))), reads))


_LEVEL = "CASE " + " ".join(f"WHEN n >= {floor} THEN {i}" for i, floor in reversed(list(enumerate(DUPLICATION_FLOORS)))) + " END"
_LABELS = ", ".join(f"({i},'{x}')" for i, x in enumerate(DUPLICATION_LEVELS))


@query(f"""WITH {_KEPT}, {_SAMPLE}, g AS (SELECT substr(seq,1,50) AS s, count(*) AS n FROM first GROUP BY 1), l AS (SELECT {_LEVEL} AS level, count(*) AS c, sum(n) AS r FROM g GROUP BY 1)
 SELECT v.level, v.label, coalesce(c,0) AS distinct_keys, {_pct('coalesce(c,0)', '(SELECT sum(r) FROM l)')} AS percent FROM (VALUES {_LABELS}) v(level,label) LEFT JOIN l ON l.level=v.level""")
def dup_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.duplication_histogram(_sampled(_kept(spark, sf_dir))))


@query(f"WITH {_KEPT}, h AS (SELECT least({_QSUM}//length(qual),42) AS quality, count(*) AS n FROM k WHERE length(qual)>0 GROUP BY 1) SELECT s.i AS quality, coalesce(n,0) AS n FROM range(43) s(i) LEFT JOIN h ON quality=s.i")
def mean_quality_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.mean_quality_histogram(_kept(spark, sf_dir)))


_GC = "h AS (SELECT least((length(seq)-length(translate(seq,'GCgc','')))*100//length(seq),100) AS gc, count(*) AS n FROM k WHERE length(seq)>0 GROUP BY 1), gch AS (SELECT s.i AS gc, coalesce(n,0) AS n FROM range(101) s(i) LEFT JOIN h ON gc=s.i)"


@query(f"WITH {_KEPT}, {_GC} SELECT gc, n FROM gch")
def gc_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.gc_histogram(_kept(spark, sf_dir)))


@query(f"""WITH {_KEPT}, {_GC}, m AS (SELECT sum(n)::double AS w, sum(gc*n)::double/sum(n) AS mean FROM gch),
 v AS (SELECT w, mean, sqrt((SELECT sum(n*(gc-mean)*(gc-mean)) FROM gch)/w) AS sd0 FROM m)
 SELECT gc, n, round(exp(-0.5*pow((gc-mean)/CASE WHEN sd0>0 THEN sd0 ELSE 5 END,2))*w/(CASE WHEN sd0>0 THEN sd0 ELSE 5 END*sqrt(2.0*pi())),6) AS expected FROM gch, v""")
def gc_normal_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.gc_overlay(M.gc_histogram(_kept(spark, sf_dir))))


@query(f"WITH {_KEPT} SELECT least(length(qual)//100,20) AS bin, sum({_QSUM})::bigint AS quality_sum, sum(length(qual))::bigint AS n FROM k WHERE length(qual)>0 GROUP BY 1")
def quality_by_length_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.quality_by_length_bin(_kept(spark, sf_dir)))


_TILE = "split_part(split_part(id,' ',1),':',5)::bigint"


@query(f"WITH {_KEPT} SELECT {_TILE} AS tile, sum({_QSUM})::bigint AS quality_sum, sum(length(qual))::bigint AS n, {_rat(f'sum({_QSUM})', 'sum(length(qual))')} AS mean_quality FROM k WHERE length(qual)>0 GROUP BY 1")
def tile_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.tile_quality(_kept(spark, sf_dir)))


_CHANNEL = "regexp_extract(id,' ch=([0-9]+)',1)::bigint"
_CHANNELS = f"ch AS (SELECT {_CHANNEL} AS channel, count(*) AS n FROM ont GROUP BY 1)"


@query(f"WITH {_ONT}, {_CHANNELS} SELECT * FROM ch")
def channel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.channel_counts(derived_ont(spark, sf_dir)))


@query(f"""WITH {_ONT}, {_CHANNELS}, e AS (SELECT min(n) AS lo, max(n) AS hi, greatest(1,ceil((max(n)-min(n)+1)/20.0))::bigint AS width FROM ch), s AS (SELECT lo, width, unnest(range(0,(hi-lo)//width+1)) AS bin FROM e)
 SELECT bin, lo+bin*width AS low, lo+(bin+1)*width-1 AS high, (SELECT count(*) FROM ch WHERE (n-lo)//width=bin) AS channels FROM s""")
def channel_occupancy_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.channel_occupancy(M.channel_counts(derived_ont(spark, sf_dir))))


_START = "epoch(strptime(regexp_extract(id,'start_time=(.{19})',1),'%Y-%m-%dT%H:%M:%S'))::bigint"


@query(f"""WITH {_ONT}, x AS (SELECT {_START} AS t FROM ont), e AS (SELECT min(t) AS t0, max(t) AS t1 FROM x), s AS (SELECT unnest(range(0,(t1-t0)//300+1)) AS b FROM e),
 c AS (SELECT (t-t0)//300 AS b, count(*) AS n FROM x, e GROUP BY 1) SELECT s.b*5 AS minutes, sum(coalesce(n,0)) OVER (ORDER BY s.b)::bigint AS cumulative_reads FROM s LEFT JOIN c ON c.b=s.b""")
def reads_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.reads_over_time(derived_ont(spark, sf_dir)))


@query(f"""WITH {_ONT}, {_trimmed('ont', 'u', '1 AS sample, 1 AS lane')}, f AS (SELECT * FROM u WHERE length(seq) >= 20 AND ord % 50 = 0 AND length(qual)>0 ORDER BY ord, id, seq, qual LIMIT 2000)
 SELECT ord, length(seq) AS length, round(({_QSUM}::double/length(qual))::float::double,6) AS mean_quality FROM f""")
def qual_vs_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.quality_vs_length(kept(trim(derived_ont(spark, sf_dir))))
    return rounded(found.withColumn("mean_quality", F.col("mean_quality").cast("double")))


@query(f"WITH {_KEPT}, s AS (SELECT count(*) FILTER (adapter IS NOT NULL) AS trimmed_reads, coalesce(sum(len0-length(seq)) FILTER (adapter IS NOT NULL),0)::bigint AS trimmed_bases, count(*) AS r FROM k) SELECT trimmed_reads, trimmed_bases, {_pct('trimmed_reads', 'r')} AS trimmed_percent FROM s")
def trim_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.trim_stats(_trim(spark, sf_dir)))


@query(f"WITH {_KEPT} SELECT adapter, count(*) AS n FROM k WHERE adapter IS NOT NULL GROUP BY 1")
def trimmed_by_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.trimmed_by_adapter(_trim(spark, sf_dir)))


@query(f"WITH {_READS}, a AS (SELECT *, {_at()} AS p FROM reads) SELECT {_name()} AS adapter, count(*) AS n, sum(p)::bigint AS positions FROM a WHERE p IS NOT NULL GROUP BY 1")
def adapter_hits_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _trim(spark, sf_dir).where("adapter IS NOT NULL")
    return rounded(rows.groupBy("adapter").agg(F.count("*").alias("n"), F.sum(F.length("seq") + 1).alias("positions")))


@query(f"WITH {_KEPT} SELECT length(seq) AS length, count(*) AS n FROM t GROUP BY 1")
def adapter_trimmed_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_trim(spark, sf_dir).groupBy(F.length("seq").alias("length")).agg(F.count("*").alias("n")))


# -------------------------------------------------------------------------------------------------------- trim steps

_OFF = QCConfig(min_length=0)


def _digest(df: DataFrame) -> DataFrame:
    """Reads by length, with sums that show each base and quality kept."""
    rows = M.per_read(df)
    return rounded(rows.groupBy(F.col("len").alias("length"), "keep").agg(F.count("*").alias("n"), F.sum("gc").alias("gc"), F.sum("qlen").alias("qualities"), F.sum("qsum").alias("quality_sum")))


def _digest_sql(source: str, keep: str = "true") -> str:
    return f"SELECT length(seq) AS length, keep, count(*) AS n, sum(length(seq)-length(translate(seq,'GCgc','')))::bigint AS gc, sum(length(qual))::bigint AS qualities, sum({_QSUM})::bigint AS quality_sum FROM (SELECT *, {keep} AS keep FROM {source}) z GROUP BY 1, 2"


def _step(**options) -> QCConfig:
    """A chain of the given steps alone: no adapters, no least length."""
    from readqc.config import Modules

    return QCConfig(min_length=0, modules=Modules(adapter=False), **options)


@query(f"WITH {_READS}, s AS (SELECT substr(substr(seq,6),1,greatest(length(seq)-12,0)) AS seq, substr(substr(qual,6),1,greatest(length(seq)-12,0)) AS qual, length(seq) > 12 AS ok FROM reads) {_digest_sql('s', 'ok')}")
def hard_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(trim(derived_reads(spark, sf_dir), _step(trim_front=5, trim_tail=7)))


_SLIDE = """w AS (SELECT *, length(qual) AS m, [greatest(ascii(c)-33,0) for c in string_split(qual,'') if c <> ''] AS ph FROM reads),
 g AS (SELECT * EXCLUDE (ph), [list_sum(ph[i:i+3])//4 >= 30 for i in range(1,m-2)] AS good FROM w)"""
_CUTS = {
    "front": "CASE WHEN m < 4 THEN 0 ELSE coalesce(nullif(list_position(good,true),0)-1, m-3) END",
    "right": "CASE WHEN m < 4 THEN m ELSE coalesce(nullif(list_position(good,false),0)-1, m) END",
    "tail": "CASE WHEN m < 4 THEN m ELSE coalesce(len(good)-nullif(list_position(list_reverse(good),true),0)+4, 0) END",
}


def _window_sql(kind: str) -> str:
    part = "substr({0},cut+1)" if kind == "front" else "substr({0},1,cut)"
    keep = "cut < length(seq)" if kind == "front" else "cut > 0"
    return f"WITH {_READS}, {_SLIDE}, c AS (SELECT *, ({_CUTS[kind]})::bigint AS cut FROM g), s AS (SELECT {part.format('seq')} AS seq, {part.format('qual')} AS qual, {keep} AS ok FROM c) {_digest_sql('s', 'ok')}"


@query(_window_sql("front"))
def cut_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(trim(derived_reads(spark, sf_dir), _step(cut_front=True, window_quality=30)))


@query(_window_sql("right"))
def cut_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(trim(derived_reads(spark, sf_dir), _step(cut_right=True, window_quality=30)))


@query(_window_sql("tail"))
def cut_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(trim(derived_reads(spark, sf_dir), _step(cut_tail=True, window_quality=30)))


@query(f"WITH {_READS}, {_SLIDE}, c AS (SELECT ({_CUTS['front']})::bigint AS front, ({_CUTS['right']})::bigint AS right_, ({_CUTS['tail']})::bigint AS tail FROM g) SELECT front, right_ AS \"right\", tail, count(*) AS n FROM c GROUP BY ALL")
def window_cut_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = derived_reads(spark, sf_dir).select(*[window_cut("qual", 4, 30, kind).alias(kind) for kind in ("front", "right", "tail")])
    return rounded(reads.groupBy("front", "right", "tail").agg(F.count("*").alias("n")))


def _tail_sql(cut: str) -> str:
    return f"WITH {_READS}, c AS (SELECT *, {cut} AS cut FROM reads), s AS (SELECT substr(seq,1,cut) AS seq, substr(qual,1,cut) AS qual FROM c) {_digest_sql('s')}"


@query(_tail_sql("length(regexp_replace(seq,'G{10,}$',''))"))
def poly_g_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(trim(derived_reads(spark, sf_dir), _step(poly_g=10)))


@query(_tail_sql("length(regexp_replace(seq,'(A{5,}|C{5,}|G{5,}|T{5,}|N{5,})$',''))"))
def poly_x_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(trim(derived_reads(spark, sf_dir), _step(poly_x=5)))


@query(_tail_sql("length(regexp_replace(qual,'[\\x00-\\x34]+$',''))"))
def quality_trim_3p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(trim(derived_reads(spark, sf_dir), _step(quality_trim=20)))


_FULL = QCConfig(min_length=30, trim_front=3, trim_tail=2, cut_front=True, cut_right=True, cut_tail=True, window=4, window_quality=20, poly_g=10, poly_x=6, quality_trim=21, min_quality=25, max_n=6)


def _slide_sql(source: str, kind: str, q: int) -> str:
    good = f"[list_sum(ph[i:i+3])//4 >= {q} for i in range(1,m-2)]"
    part = "substr({0},cut+1)" if kind == "front" else "substr({0},1,cut)"
    keep = "cut < length(seq)" if kind == "front" else "cut > 0"
    return f"""{kind}_1 AS (SELECT *, length(qual) AS m, [greatest(ascii(c)-33,0) for c in string_split(qual,'') if c <> ''] AS ph FROM {source}), {kind}_2 AS (SELECT * EXCLUDE (ph), {good} AS good FROM {kind}_1),
 {kind}_3 AS (SELECT *, ({_CUTS[kind]})::bigint AS cut FROM {kind}_2), {kind}_4 AS (SELECT ord, id, len0, {part.format('seq')} AS seq, {part.format('qual')} AS qual, ok AND {keep} AS ok FROM {kind}_3)"""


@query(f"""WITH {_READS}, s0 AS (SELECT ord, id, length(seq) AS len0, substr(substr(seq,4),1,greatest(length(seq)-5,0)) AS seq, substr(substr(qual,4),1,greatest(length(seq)-5,0)) AS qual, length(seq) > 5 AS ok FROM reads),
 {_slide_sql('s0', 'front', 20)}, {_slide_sql('front_4', 'right', 20)}, {_slide_sql('right_4', 'tail', 20)},
 p1 AS (SELECT *, length(regexp_replace(seq,'G{{10,}}$','')) AS cut FROM tail_4), p2 AS (SELECT ord, id, len0, ok, substr(seq,1,cut) AS seq, substr(qual,1,cut) AS qual FROM p1),
 q1 AS (SELECT *, length(regexp_replace(qual,'[\\x00-\\x35]+$','')) AS cut FROM p2), q2 AS (SELECT ord, id, len0, ok, substr(seq,1,cut) AS seq, substr(qual,1,cut) AS qual FROM q1),
 a1 AS (SELECT *, {_at()} AS p FROM q2), a2 AS (SELECT ord, id, len0, ok, {_name()} AS adapter, CASE WHEN p IS NULL THEN seq ELSE substr(seq,1,p-1) END AS seq, CASE WHEN p IS NULL THEN qual ELSE substr(qual,1,p-1) END AS qual FROM a1),
 x1 AS (SELECT *, length(regexp_replace(seq,'(A{{6,}}|C{{6,}}|T{{6,}}|N{{6,}})$','')) AS cut FROM a2), x2 AS (SELECT ok, len0, adapter, substr(seq,1,cut) AS seq, substr(qual,1,cut) AS qual FROM x1),
 z AS (SELECT *, ok AND length(seq) >= 30 AND length(seq)-length(translate(seq,'Nn','')) <= 6 AND (length(qual) > 0 AND {_QSUM}//greatest(length(qual),1) >= 25) AS keep FROM x2)
 SELECT length(seq) AS length, adapter, count(*) AS n, sum(len0-length(seq))::bigint AS removed, sum({_QSUM})::bigint AS quality_sum FROM z WHERE keep GROUP BY 1, 2""")
def full_trim_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.per_read(kept(trim(derived_reads(spark, sf_dir), _FULL)))
    return rounded(rows.groupBy(F.col("len").alias("length"), "adapter").agg(F.count("*").alias("n"), F.sum(F.col("len0") - F.col("len")).alias("removed"), F.sum("qsum").alias("quality_sum")))


@query(f"WITH {_READS} SELECT length(seq)-length(translate(seq,'Nn','')) AS n_bases, length(seq)-length(translate(seq,'Nn','')) <= 5 AS keep, count(*) AS n FROM reads GROUP BY 1, 2")
def filter_max_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = derived_reads(spark, sf_dir)
    return rounded(reads.groupBy(R.n_count("seq").alias("n_bases"), passes(QCConfig(min_length=0, max_n=5)).alias("keep")).agg(F.count("*").alias("n")))


@query(f"WITH {_READS}, s AS (SELECT {_QSUM}//length(qual) AS mean_quality FROM reads) SELECT mean_quality, mean_quality >= 32 AS keep, count(*) AS n FROM s GROUP BY 1, 2")
def filter_min_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = derived_reads(spark, sf_dir)
    mean = F.floor(M.quality_sum("qual") / F.length("qual"))
    return rounded(reads.groupBy(mean.alias("mean_quality"), passes(QCConfig(min_length=0, min_quality=32)).alias("keep")).agg(F.count("*").alias("n")))


@query(f"WITH {_KEPT} SELECT length(seq) >= 20 AS keep, count(*) AS n, sum(length(seq))::bigint AS bases FROM t GROUP BY 1")
def filter_min_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_trim(spark, sf_dir).groupBy("keep").agg(F.count("*").alias("n"), F.sum(F.length("seq")).alias("bases")))


@query(f"WITH {_KEPT} SELECT count(*) AS reads, count(*) FILTER (length(seq) < 20) AS filtered FROM t")
def filtered_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_trim(spark, sf_dir).agg(F.count("*").alias("reads"), F.count_if(~F.col("keep")).alias("filtered")))


# ------------------------------------------------------------------------------------------- samples, mates, headers


def _numbered(spark: SparkSession, sf_dir: str, mate: int) -> DataFrame:
    """Reads of one mate under a record number that both mates share: the rank of what names the record."""
    reads = derived_reads(spark, sf_dir, mate).select(F.xxhash64("ord", "id", "qual").alias("ord"), "id", "seq", "qual")
    return reads.groupBy("ord").agg(F.min(F.struct("id", "seq", "qual")).alias("r")).select("ord", "r.*")


_MATE = "SELECT ord AS o, id, qual AS q0, min(seq) AS seq FROM ({0}) GROUP BY 1, 2, 3"


@query(f"""WITH m AS ({_MATE.format(reads_sql())} UNION ALL {_MATE.format(reads_sql(mate=2))}), reads AS (SELECT o AS ord, id, seq, q0 AS qual, 1 AS sample, 1 AS lane FROM m), {_trimmed('reads')}, s AS ({_summary_sql()}) SELECT {_SUMMARY_COLUMNS} FROM s""")
def paired_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.summary(trim(M.pair_up(_numbered(spark, sf_dir, 1), _numbered(spark, sf_dir, 2)))))


def _profile_sql(name: str, where: str) -> str:
    return f"""{name}_s AS ({_summary_sql(where=where)}), {name}_k AS (SELECT * FROM k{where}), {name}_d AS (SELECT {_pct('(count(*)-count(DISTINCT substr(seq,1,50)))', 'count(*)')} AS dup_percent FROM {name}_k),
 {name}_n AS ({_N50.format(source=f'{name}_k')}), {name} AS (SELECT {_SUMMARY_COLUMNS}, dup_percent, n50 FROM {name}_s, {name}_d, {name}_n)"""


_COMPARE = " UNION ALL ".join(f"SELECT {i} AS place, '{m}' AS metric, round(f.{m}::double,6) AS first, round(o.{m}::double,6) AS second, round(o.{m}::double-f.{m}::double,6) AS delta FROM f, o" for i, m in enumerate(rules.COMPARED))


@query(f"WITH {_KEPT}, " + _profile_sql("f", " WHERE sample='F'") + ", " + _profile_sql("o", " WHERE sample='O'") + f" SELECT place, metric, round(first,4) AS first, round(second,4) AS second, round(delta,4) AS delta FROM ({_COMPARE})")
def two_sample_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    trimmed = written(_trim(spark, sf_dir))
    found = rules.compare(*[rules.sample_profile(trimmed.where(F.col("sample") == s)) for s in ("F", "O")])
    return rounded(found.withColumns({c: F.round(c, 4) for c in ("first", "second", "delta")}))


@query(f"WITH {_KEPT}, s AS ({_summary_sql(by='sample')} UNION ALL SELECT NULL, * FROM ({_summary_sql()})) SELECT sample, {_SUMMARY_COLUMNS} FROM s")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.batch_summary(_trim(spark, sf_dir)))


_FACTS_FORM = f"""{{kept}}, {_BASES}, {_COMP}, {_SCORES}, su0 AS ({_summary_sql()}), su AS (SELECT {_SUMMARY_COLUMNS} FROM su0),
 qp AS (SELECT pos, avg(s) AS mq FROM q GROUP BY pos),
 sk AS (SELECT max(greatest(abs(a-t),abs(c-g))*100.0::double/w) AS skew, max(other*100.0::double/w) AS worst_n, max(pos) AS last_base FROM comp),
 tg AS (SELECT sum(g*100.0::double/w)/10 AS tail FROM comp, sk WHERE pos > last_base-10),
 du AS (SELECT {_pct('(count(*)-count(DISTINCT substr(seq,1,50)))', 'count(*)')} AS dup FROM k), ov AS ({{over}}),
 fa AS (SELECT su.*, (SELECT min(mq) FROM qp) AS worst_quality, (SELECT max(pos) FROM qp) AS last_quality, (SELECT min(pos) FROM qp WHERE mq > 0 AND mq < 20) AS drop_at, sk.*, tail, dup,
  (SELECT count(*) FROM ov) AS n_over, (SELECT coalesce(max(percentage),0) FROM ov) AS worst_over FROM su, sk, tg, du)"""
_OVER = _over_sql(_KEPT).split(f"{_SAMPLE}, ", 1)[1].join(["WITH " + _SAMPLE + ", ", ""])
_FACTS = _FACTS_FORM.replace("{over}", _OVER).replace("{kept}", _KEPT)
_ONT_KEPT = f"{_ONT}, {_trimmed('ont', extra='1 AS sample, 1 AS lane')}, k AS (SELECT * FROM t WHERE length(seq) >= 20)"
_ONT_FACTS = _FACTS_FORM.replace("{over}", _OVER).replace("{kept}", _ONT_KEPT)


def _grade_sql(ok: str, fair: str) -> str:
    return f"CASE WHEN {ok} THEN 'pass' WHEN {fair} THEN 'warn' ELSE 'fail' END"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts_of(trim(derived_reads(spark, sf_dir)))


def _facts_of(trimmed: DataFrame) -> DataFrame:
    trimmed = written(trimmed)
    reads = kept(trimmed)
    return rules.facts(trimmed, written(M.position_counts(reads)), M.duplication_rate(reads, exact=True), M.overrepresented(reads), M.long_read_mode(reads))


_STATUS = (
    _grade_sql("worst_quality>=28", "worst_quality>=20"), _grade_sql("q30_percent>=80", "q30_percent>=60"), _grade_sql("skew<=10", "skew<=20"),
    _grade_sql("gc_percent BETWEEN 20 AND 80", "gc_percent BETWEEN 10 AND 90"), _grade_sql("worst_n<5", "worst_n<20"),
    "CASE WHEN max_length=min_length THEN 'pass' ELSE 'warn' END", _grade_sql("dup<20", "dup<50"),
    "CASE WHEN n_over=0 THEN 'pass' WHEN worst_over>=1 THEN 'fail' ELSE 'warn' END", _grade_sql("adapter_percent<5", "adapter_percent<20"),
)


@query(f"WITH {_FACTS} " + " UNION ALL ".join(f"SELECT '{m}' AS module, {g} AS status FROM fa" for m, g in zip(rules.MODULES, _STATUS, strict=True)))
def module_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.module_status(_facts(spark, sf_dir))


@query(f"""WITH {_FACTS}, r AS (SELECT 0 AS place, '--poly-g 10' AS option, tail AS value, last_base>=9 AND tail>40 AND gc_percent<65 AS k FROM fa
 UNION ALL SELECT 1, '--trim', adapter_percent, adapter_percent>5 FROM fa UNION ALL SELECT 2, '--cut-right --window-quality 20', drop_at, drop_at::double/(last_quality+1)<0.9 FROM fa
 UNION ALL SELECT 3, '--min-quality 20', avg_quality, avg_quality>0 AND avg_quality<25 FROM fa UNION ALL SELECT 4, '--max-n 5', worst_n, worst_n>5 FROM fa UNION ALL SELECT 5, 'deduplicate', dup, dup>50 FROM fa)
 SELECT place, option, round(value,4) AS value, CASE WHEN option='--trim' AND value > 20 THEN 'strong' ELSE '' END AS level FROM r WHERE k""")
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rules.suggestions(_facts(spark, sf_dir)).withColumn("value", F.round("value", 4)))


@query(f"""WITH {_FACTS} """ + " UNION ALL ".join(f"SELECT '{m}' AS module, {g} AS status FROM fa" for m, g in (
    ("Per-base quality", _grade_sql("avg_quality>=28", "avg_quality>=20")), ("Per-read quality", _grade_sql("q30_percent>=70", "q30_percent>=50")),
    ("GC content", _grade_sql("gc_percent BETWEEN 35 AND 65", "gc_percent BETWEEN 25 AND 75")), ("Adapter content", _grade_sql("adapter_percent<1", "adapter_percent<10")),
    ("Sequence duplication", _grade_sql("dup<5", "dup<20")), ("Overrepresented seqs", _grade_sql("n_over=0", "n_over<=3")), ("N content", "CASE WHEN worst_n>5 THEN 'fail' ELSE 'pass' END"))))
def browser_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.browser_status(_facts(spark, sf_dir))


@query(f"""WITH {_FACTS}, n AS ({_N50.format(source='k')}) SELECT 'n50' AS card, round(n50::double,4) AS value, '' AS class FROM n
 UNION ALL SELECT 'gc', round(gc_percent,4), {_grade_sql('gc_percent BETWEEN 35 AND 65', 'gc_percent BETWEEN 25 AND 75')} FROM fa UNION ALL SELECT 'quality', round(avg_quality,4), {_grade_sql('avg_quality>=30', 'avg_quality>=20')} FROM fa
 UNION ALL SELECT 'q20', round(q20_percent,4), CASE WHEN q20_percent>=80 THEN 'pass' ELSE 'warn' END FROM fa UNION ALL SELECT 'q30', round(q30_percent,4), CASE WHEN q30_percent>=70 THEN 'pass' ELSE 'warn' END FROM fa
 UNION ALL SELECT 'adapter', round(adapter_percent,4), {_grade_sql('adapter_percent<1', 'adapter_percent<10')} FROM fa UNION ALL SELECT 'duplication', round(dup,4), {_grade_sql('dup<5', 'dup<20')} FROM fa""")
def card_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rules.card_classes(_facts(spark, sf_dir)).withColumn("value", F.round("value", 4)))


_LONG_STATUS = (_grade_sql("worst_quality>=10", "worst_quality>=8"), _grade_sql("avg_quality>=10", "avg_quality>=8"), *_STATUS[2:5], "'pass'", *_STATUS[6:])


@query(f"WITH {_ONT_FACTS} " + " UNION ALL ".join(f"SELECT '{m}' AS module, {g} AS status FROM fa" for m, g in zip(rules.MODULES, _LONG_STATUS, strict=True)))
def module_status_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limits of long reads."""
    return rules.module_status(_facts_of(trim(derived_ont(spark, sf_dir))))


@query(f"""WITH {_ONT_FACTS}, n AS ({_N50.format(source='k')}) SELECT 'n50' AS card, round(n50::double,4) AS value, CASE WHEN n50 > 10000 THEN 'pass' ELSE 'warn' END AS class FROM n
 UNION ALL SELECT 'gc', round(gc_percent,4), {_grade_sql('gc_percent BETWEEN 35 AND 65', 'gc_percent BETWEEN 25 AND 75')} FROM fa UNION ALL SELECT 'quality', round(avg_quality,4), {_grade_sql('avg_quality>=10', 'avg_quality>=8')} FROM fa
 UNION ALL SELECT 'q10', round(q10_percent,4), CASE WHEN q10_percent>=50 THEN 'pass' ELSE 'warn' END FROM fa UNION ALL SELECT 'q20', round(q20_percent,4), CASE WHEN q20_percent>=30 THEN 'pass' ELSE 'warn' END FROM fa
 UNION ALL SELECT 'adapter', round(adapter_percent,4), {_grade_sql('adapter_percent<1', 'adapter_percent<10')} FROM fa UNION ALL SELECT 'duplication', round(dup,4), {_grade_sql('dup<5', 'dup<20')} FROM fa""")
def card_classes_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rules.card_classes(_facts_of(trim(derived_ont(spark, sf_dir)))).withColumn("value", F.round("value", 4)))


@query(f"""WITH {_ONT}, f AS (SELECT * FROM ont ORDER BY ord, id, seq, qual LIMIT 1000), s AS (SELECT list_sort(list(length(seq))) AS a, bool_or((contains(id,' ch=') OR starts_with(id,'ch=')) AND contains(id,'start_time=')) AS ont FROM f),
 m AS (SELECT floor((a[(len(a)-1)//2+1]+a[len(a)//2+1])/2.0)::bigint AS median_length, ont FROM s) SELECT median_length, ont, median_length > 1000 OR ont AS long_read FROM m""")
def long_read_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.long_read_mode(derived_ont(spark, sf_dir)))


@query(f"WITH {_READS} SELECT {_TILE} AS tile, count(*) AS n FROM reads GROUP BY 1")
def illumina_tile_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(derived_reads(spark, sf_dir).groupBy(R.illumina_tile("id").alias("tile")).agg(F.count("*").alias("n")))


@query(f"WITH {_ONT} SELECT ord, {_CHANNEL} AS channel, {_START} AS start, contains(id,' ch=') AND contains(id,'start_time=') AS ont FROM ont")
def ont_header_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(derived_ont(spark, sf_dir).select("ord", R.ont_channel("id").alias("channel"), R.ont_start("id").alias("start"), R.is_ont("id").alias("ont")))


@query(f"WITH {_READS}, s AS (SELECT CASE WHEN ord % 2 = 0 THEN qual ELSE repeat('I',length(seq)) END AS qual FROM reads) SELECT md5(qual) AS digest, count(*) AS n FROM s GROUP BY 1")
def fasta_quality_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = fill_quality(F.when(F.col("ord") % 2 == 0, F.col("qual")), F.col("seq"))
    return rounded(derived_reads(spark, sf_dir).groupBy(F.md5(filled.cast("binary")).alias("digest")).agg(F.count("*").alias("n")))


@query(f"WITH {_READS}, s AS (SELECT least((length(seq)-length(translate(seq,'GCgc','')))*100//length(seq),100) AS gc_bin, {_QSUM} AS quality_sum, least({_QSUM}//length(qual),42) AS quality_bin, least(length(qual)//100,20) AS length_bin, substr(seq,1,50) AS key FROM reads) SELECT gc_bin, quality_bin, length_bin, count(*) AS n, sum(quality_sum)::bigint AS quality_sum, count(DISTINCT key) AS keys FROM s GROUP BY 1, 2, 3")
def scalar_read_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    qsum = M.quality_sum("qual")
    rows = derived_reads(spark, sf_dir).select(R.gc_bin("seq").alias("gc_bin"), qsum.alias("q"), R.mean_bin(qsum, F.length("qual")).alias("quality_bin"), R.length_bin("qual").alias("length_bin"), R.key("seq").alias("k"))
    return rounded(rows.groupBy("gc_bin", "quality_bin", "length_bin").agg(F.count("*").alias("n"), F.sum("q").alias("quality_sum"), F.count_distinct("k").alias("keys")))


# -------------------------------------------------------------------------------------------------------- file scans


def _as_lines(reads: DataFrame, fmt: str) -> DataFrame:
    """FASTQ records, or FASTA ones with lines of 60 bases; every 97th FASTQ header lacks its mark."""
    if fmt == "fasta":
        return reads.select(F.concat(F.lit(">"), "id", F.lit("\n"), F.regexp_replace("seq", "(.{60})(?=.)", "$1\n")).alias("value"))
    mark = F.when(F.lit(fmt == "bad") & (F.col("ord") % 97 == 0), "").otherwise("@")
    return reads.select(F.concat(mark, "id", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value"))


def _scan(spark: SparkSession, sf_dir: str, fmt: str, compression: str = "none", mode: str = "PERMISSIVE") -> DataFrame:
    """Write the reads as files and read them back."""
    path = f"{shared_root(spark)}/{fmt}-{uuid.uuid4().hex}"
    _as_lines(derived_reads(spark, sf_dir), fmt).coalesce(3).write.option("compression", compression).text(path)
    return read_reads(spark, path, mode=mode)


def _read_digest(reads: DataFrame) -> DataFrame:
    rows = reads.groupBy(F.md5(F.concat_ws("|", "id", "seq", "qual").cast("binary")).alias("digest"))
    return rounded(rows.agg(F.count("*").alias("n")))


_DIGEST = "SELECT md5(concat_ws('|',id,seq,qual)) AS digest, count(*) AS n FROM reads"


@query(f"WITH {_READS} {_DIGEST} GROUP BY 1")
def fastq_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_digest(_scan(spark, sf_dir, "fastq"))


@query(f"WITH {_READS} {_DIGEST} GROUP BY 1")
def fastq_gzip_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_digest(_scan(spark, sf_dir, "fastq", "gzip"))


@query(f"WITH {_READS} SELECT md5(concat_ws('|',id,seq)) AS digest, count(*) AS n FROM reads GROUP BY 1")
def fasta_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_digest(_scan(spark, sf_dir, "fasta"))


@query(f"WITH {_READS} {_DIGEST} WHERE ord % 97 <> 0 GROUP BY 1")
def fastq_malformed_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_digest(_scan(spark, sf_dir, "bad", mode="DROPMALFORMED"))


@query(f"WITH {_READS} {_DIGEST} GROUP BY 1")
def fastq_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered sink, read back."""
    path = f"{shared_root(spark)}/sink-{uuid.uuid4().hex}.fastq.gz"
    write_fastq(derived_reads(spark, sf_dir), path)
    return _read_digest(read_reads(spark, path))
