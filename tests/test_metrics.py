import random
from collections import Counter

import pytest

from readqc.config import QCConfig
from readqc.functions import reads as R
from readqc.functions import text as X
from readqc.operators import metrics as M
from readqc.operators.trim import kept, trim
from readqc.plans.report import analyse
from tests.test_trim import some_reads

SCHEMA = "ord long, id string, seq string, qual string"


@pytest.fixture(scope="module")
def reads(spark):
    return kept(trim(spark.createDataFrame(some_reads(600, 9), SCHEMA), QCConfig(min_length=1))).cache()


def test_positions_and_kmers(reads):
    rows = [(r.seq, r.qual or "") for r in reads.collect()]
    counts = M.position_counts(reads).cache()
    base, score, kmers = Counter(), {}, Counter()
    for seq, qual in rows:
        for i, c in enumerate(seq[:2000]):
            base[i, c.upper() if c.upper() in "ACGT" else "N"] += 1
        for i, c in enumerate(qual[:2000]):
            score.setdefault(i, []).append(max(ord(c) - 33, 0))
        kmers.update(w for i in range(len(seq) - 3) if set(w := seq[i : i + 4].upper()) <= set("ACGT"))
    for r in M.base_composition(counts).collect():
        assert (r.a, r.c, r.g, r.t, r.other) == tuple(base[r.pos, x] for x in "ACGTN")
    got = {r.pos: r for r in M.quality_by_position(counts).collect()}
    assert {i: (sum(s), len(s)) for i, s in score.items()} == {i: (r.quality_sum, r.n) for i, r in got.items()}
    for r in M.quality_percentiles(counts).collect():
        s = sorted(min(x, 42) for x in score[r.pos])
        t = len(s)
        want = [max(1, next(v for v in range(43) if sum(x <= v for x in s) >= part)) if t else 0 for part in (t // 4, t // 2, t * 3 // 4)]
        first = [max(1, min(v for v in set(s) if sum(x <= v for x in s) >= part)) for part in (t // 4, t // 2, t * 3 // 4)]
        assert [r.q25, r.q50, r.q75] in (want, first)
    assert {r.kmer: r.n for r in M.kmer_counts(counts).collect()} == kmers
    assert [r.n for r in M.top_kmers(counts).collect()] == [n for _, n in sorted(kmers.items(), key=lambda x: (-x[1], x[0]))[:20]]


def test_any_partitioning_gives_the_same(reads):
    for f in (lambda df: M.position_counts(df), M.length_histogram, M.tile_quality, M.mean_quality_histogram):
        results = [sorted(map(str, f(reads.repartition(n)).collect())) for n in (1, 4, 17)]
        assert results[0] == results[1] == results[2]


def test_n50(spark):
    rows = [(i, "r", "A" * n, None) for i, n in enumerate((100, 100, 100, 50))]
    assert tuple(M.n50_n90(spark.createDataFrame(rows, SCHEMA)).first()) == (100, 50)
    assert tuple(M.n50_n90(spark.createDataFrame([], SCHEMA)).first()) == (0, 0)


def test_headers(spark):
    rows = ["SIM:1:FC:1:1101:5:6 1:N:0:A", "a:b:c", "u runid=1 read=2 ch=37 start_time=2024-01-15T10:30:00Z", "ch=4 x", "x start_time=2024-02-31T00:00:00Z ch=9", "x start_time=2024", "x start_time=1969-12-31T23:59:59Z", ""]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(rows)], "ord int, id string")
    got = [tuple(r)[1:] for r in df.select("ord", R.illumina_tile("id"), R.ont_channel("id"), R.ont_start("id"), R.is_ont("id")).orderBy("ord").collect()]
    assert got == [(1101, None, None, False), (None, None, None, False), (None, 37, 1705314600, True), (None, 4, None, False), (None, 9, None, True), (None, None, None, False), (None, None, None, False), (None, None, None, False)]


def test_scalars(spark):
    df = spark.createDataFrame([("ACGTNacgtn", "!+5?I"), ("", ""), ("GC", None)], "seq string, qual string")
    got = df.select(R.gc_count("seq"), R.n_count("seq"), R.gc_bin("seq"), R.length_bin("qual"), M.quality_sum("qual"), R.kmers("seq")).collect()
    assert tuple(got[0])[:5] == (4, 2, 40, 0, 0 + 10 + 20 + 30 + 40)
    assert got[0][5] == ["ACGT", "ACGT"]
    assert tuple(got[1]) == (0, 0, None, 0, 0, [])
    assert tuple(got[2])[3:5] == (None, None)
    sums = [tuple(r) for r in M.per_read(df).select("len", "gc", "qlen", "qsum", "q20", "q30").collect()]
    assert sums == [(10, 4, 5, 100, 3, 2), (0, 0, 0, 0, 0, 0), (2, 2, 0, 0, 0, 0)]


def test_characters_beyond_ascii(spark):
    """One place for each character, whatever its bytes, beside nulls and in slices of a batch."""
    rows = [("é", "é"), (None, None), ("ACé日GT", "Iééé!"), ("GG", "5")]
    df = spark.createDataFrame(rows, "seq string, qual string").coalesce(1)
    want = [sum(max((ord(c) if ord(c) < 256 else 63) - 33, 0) for c in q or "") for _, q in rows]
    assert [r.qsum for r in M.per_read(df).collect()] == want
    got = {(r.pos, r.code): r.n for r in M.position_counts(df).where("kind = 'b'").collect()}
    assert got == {(0, 4): 1, (0, 0): 1, (1, 1): 1, (2, 4): 1, (3, 4): 1, (4, 2): 1, (5, 3): 1, (0, 2): 1, (1, 2): 1}


def test_first_reads_are_the_first(spark):
    """However reads lie and repeat numbers, and however many steps the search takes."""
    rng = random.Random(6)
    rows = [(rng.choice((rng.randint(0, 50), rng.randint(0, 10**9), 7, 10**12)), str(i), "A", "I") for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for n in (0, 1, 50, 700, 1500, 2999, 3000, 9000):
        for bins, enough in ((3, 0), (4, 10), (4096, 100)):
            got = sorted((r.ord, r.id) for r in M.first_reads(df, n, bins, enough).collect())
            assert got == sorted((o, i) for o, i, _, _ in rows)[:n]
    assert M.first_reads(df.where("false"), 5, enough=0).count() == 0
    assert df.select(R.adapter_source("seq")).first()[0] == "No hit"


def test_text():
    assert (X.number(1234567), X.bases(999), X.bases(1500), X.bases(2_000_000), X.bases(3_100_000_000)) == ("1,234,567", "999 bp", "1.50 Kb", "2.00 Mb", "3.10 Gb")
    assert (X.duration(3725.9), X.percent_delta(1, 1.005), X.percent_delta(1, 2), X.delta(2, 1, " bp")) == ("01:02:05", "±0", "+1.00", "-1.0 bp")
    assert X.escape('<a & "b">') == "&lt;a &amp; &quot;b&quot;&gt;"


def test_duplicates_and_overrepresented(spark):
    seqs = ["ACGTTGCA" * 4] * 30 + ["CCGTTGCA" * 4] * 3 + [f"{i:04d}".translate(str.maketrans("0123456789", "ACGTACGTAC")) * 8 for i in range(60)]
    df = spark.createDataFrame([(i, "r", s, "I" * 32) for i, s in enumerate(seqs)], SCHEMA)
    counts = Counter(seqs)
    exact = M.duplication_rate(df, exact=True).first()
    assert (exact.read_count, exact.distinct_reads) == (len(seqs), len(counts))
    levels = {r.label: r.distinct_keys for r in M.duplication_histogram(df).collect()}
    assert levels["1x"] == sum(n == 1 for n in counts.values()) and levels["10-49x"] == sum(10 <= n < 50 for n in counts.values()) and len(levels) == 9
    top = M.overrepresented(df).collect()
    assert top[0].sequence == seqs[0] and top[0].n == 30 and top[0].possible_source == "No hit"


def test_empty_input(spark):
    report = analyse(spark, spark.createDataFrame([], SCHEMA), QCConfig())
    assert report.facts["read_count"] == 0 and report.overrepresented == []


def test_pairs(spark):
    a = spark.createDataFrame([(0, "x", "A", "I"), (1, "y", "C", "I"), (3, "z", "G", "I")], SCHEMA)
    b = spark.createDataFrame([(0, "x", "T", "I"), (1, "y", "G", "I")], SCHEMA)
    assert sorted((r.ord, r.mate, r.seq) for r in M.pair_up(a, b).collect()) == [(0, 1, "A"), (0, 2, "T"), (1, 1, "C"), (1, 2, "G")]
