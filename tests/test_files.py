import gzip
import json
import random

import pytest

from readqc.__main__ import config
from readqc.config import Modules, QCConfig
from readqc.plans import report
from readqc.sources.files import read_reads
from readqc.sources.sinks import stem, trimmed_name, write_fastq


def fastq(rows, end="\n", last=True):
    text = "".join(f"@{i}{end}{s}{end}+{end}{q}{end}" for i, s, q in rows)
    return text if last else text.rstrip("\r\n")


def rows_of(df):
    return [(r.id, r.seq, r.qual) for r in df.orderBy("ord").collect()]


def some(n=500, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        k = rng.randint(1, 80)
        out.append((f"r{i} x", "".join(rng.choice("ACGTN") for _ in range(k)), "".join(rng.choice("@+!I5>") for _ in range(k + rng.choice((0, 0, 3))))))
    return out


def test_plain_gzip_and_line_ends(spark, tmp_path):
    rows = some()
    (tmp_path / "a.fastq").write_text(fastq(rows, last=False))
    (tmp_path / "c.fastq").write_bytes(fastq(rows, "\r\n").encode())
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write(fastq(rows))
    for name in ("a.fastq", "b.fastq.gz"):
        df = read_reads(spark, str(tmp_path / name))
        assert rows_of(df) == rows
        assert [r.ord for r in df.orderBy("ord").collect()] == list(range(len(rows)))
    # Headers keep their carriage return; sequence and quality lose it.
    assert rows_of(read_reads(spark, str(tmp_path / "c.fastq"))) == [(f"{i}\r", s, q) for i, s, q in rows]


@pytest.mark.parametrize("size", [997, 4096, 20_000])
def test_records_across_splits(spark, tmp_path, size):
    rows = some(800, 4)
    (tmp_path / "a.fastq").write_text(fastq(rows))
    fasta = [(f"s{i}", "".join(random.Random(i).choice("ACGT") for _ in range(300))) for i in range(200)]
    (tmp_path / "a.fa").write_text("".join(f">{i}\n" + "".join(f"{s[k : k + 60]}\n" for k in range(0, 300, 60)) for i, s in fasta))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        assert rows_of(read_reads(spark, str(tmp_path / "a.fastq"))) == rows
        assert rows_of(read_reads(spark, str(tmp_path / "a.fa"))) == [(i, s, None) for i, s in fasta]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_modes(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@a\nAC\n+\nII\nb\nGT\n+\nII\n@c\nGG\n?\nII\n@d\nTT\n+\nII\n@e\nAA\n")
    path = str(tmp_path / "a.fastq")
    assert len(rows_of(read_reads(spark, path))) == 4
    assert [r[0] for r in rows_of(read_reads(spark, path, mode="DROPMALFORMED"))] == ["a", "d"]
    with pytest.raises(Exception, match="malformed record"):
        rows_of(read_reads(spark, path, mode="FAILFAST"))
    with pytest.raises(ValueError):
        read_reads(spark, path, mode="x")


def test_normalised(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x\nacguRYn-\n")
    assert rows_of(read_reads(spark, str(tmp_path / "a.fa"), normalised=True)) == [("x", "ACGTNNN-", None)]


def test_sink_round_trip(spark, tmp_path):
    rows = some(50)
    (tmp_path / "a.fastq").write_text(fastq(rows))
    df = read_reads(spark, str(tmp_path / "a.fastq"))
    write_fastq(df, str(tmp_path / "out.fastq.gz"), single=True)
    assert rows_of(read_reads(spark, str(tmp_path / "out.fastq.gz"))) == rows
    write_fastq(df.withColumn("qual", df["qual"].substr(1, 0).cast("string")).selectExpr("ord", "id", "seq", "nullif(qual, '') AS qual"), str(tmp_path / "filled"), single=True)
    assert all(q == "I" * len(s) for _, s, q in rows_of(read_reads(spark, str(tmp_path / "filled"))))


def test_names():
    assert (stem("/x/a.fastq.gz"), stem("b.fa"), stem("c.txt"), trimmed_name("d/e.fq")) == ("a", "b", "c.txt", "e_trimmed.fastq.gz")


def test_four_reads(spark, tmp_path):
    """Poly-A goes as an adapter; without that module it stays."""
    rows = [("read1", "ACGT" * 5, "I" * 20), ("read2", "GC" * 10, "5" * 20), ("read3", "N" * 20, "I" * 20), ("read4", "A" * 20, "!" * 20)]
    (tmp_path / "x.fastq").write_text(fastq(rows))
    reads = read_reads(spark, str(tmp_path / "x.fastq"))
    f = report.analyse(spark, reads, QCConfig()).facts
    assert (f["read_count"], f["total_bases"], f["gc_percent"], round(f["avg_quality"], 2), f["filtered_reads"]) == (3, 60, 50.0, 33.33, 1)
    f = report.analyse(spark, reads, QCConfig(modules=Modules(adapter=False))).facts
    assert (f["read_count"], f["total_bases"], f["gc_percent"], f["avg_quality"]) == (4, 80, 37.5, 25.0)


def test_reports(spark, tmp_path):
    for name, seed in (("one.fastq", 1), ("two.fastq", 2)):
        rng = random.Random(seed)
        rows = [(f"SIM:1:FC:1:{1101 + i % 3}:{i}:7 1:N:0:A", "".join(rng.choice("ACGT") for _ in range(60)) + ("AGATCGGAAGAGCACACGTCT" if i % 5 == 0 else ""), "I" * 60 + ("I" * 21 if i % 5 == 0 else "")) for i in range(100)]
        (tmp_path / name).write_text(fastq(rows))
    out = tmp_path / "out"
    cfg = QCConfig(paths=(str(tmp_path / "one.fastq"), str(tmp_path / "two.fastq")), output_dir=str(out), trim_output=True, compare=True, modules=Modules(multiqc=True))
    reports = report.run(spark, cfg)
    assert {p.name for p in out.iterdir()} == {"batch_report_report.json", "batch_report_mqc.json", "batch_report_report.html", "one_vs_two_comparison.html", "one_trimmed.fastq.gz", "two_trimmed.fastq.gz"}
    data = json.loads((out / "batch_report_report.json").read_text())
    assert data["files"][0]["read_count"] == 100 and data["files"][0]["trimmed_reads"] == 20 and data["files"][0]["adapter_contamination_percent"] == 20.0
    assert set(json.loads((out / "batch_report_mqc.json").read_text())["data"]) == {"one", "two"}
    assert set(reports[0].charts) == {"qual", "qual_pct", "len", "kmers", "tiles", "basecomp", "qualdist", "gc_dist", "dup_hist", "n_content", "qvl", "rot", "chann", "long_read"}
    assert "Illumina tiles:  3" in report.console(reports[0])
    assert read_reads(spark, str(out / "one_trimmed.fastq.gz")).count() == 100
    html = (out / "batch_report_report.html").read_text()
    for title in ("Quality by position", "Reads by GC share", "Reads by length", "Quality by tile"):
        assert f'aria-label="{title}"' in html
    assert ">normal</text>" in html and ">1,102</text>" in html and "Switched off" not in html
    assert len(reports[0].gc_expected) == 101 and abs(sum(reports[0].gc_expected) - 100) < 1
    (fast,) = report.run(spark, QCConfig(paths=cfg.paths[:1], output_dir=str(out), modules=Modules.fast()))
    html = (out / "one_report.html").read_text()
    assert fast.skipped == ["4-mers", "duplication", "quality by tile", "overrepresented sequences"]
    assert "Switched off and not computed: 4-mers, duplication, quality by tile, overrepresented sequences." in html and "duplication level" not in html


def test_charts():
    """Axes have round numbers, values stand at their places, and odd series don't break a chart."""
    assert report._ticks(0, 97, 4) == [0, 50] and report._ticks(3, 21) == [5, 10, 15, 20] and report._ticks(7, 7) == [7]
    one = report._chart("a < b", "x", {"y": [0.0, 5.0, 10.0]}, x=[100, 150, 200])
    assert 'points="58.0,172.0 254.0,97.0 450.0,22.0"' in one and "a &lt; b" in one and ">160</text>" in one and ">10</text>" in one
    assert report._chart("none", "x", {"y": []}) == ""
    assert "<circle" in report._chart("single", "x", {"y": [0]}) and ">two</text>" in report._chart("named", "x", {"y": [1, 2]}, labels=["one", "two"])


def test_pairs(spark, tmp_path):
    """A malformed record of one mate is skipped by itself; the shorter file ends the pairs; each mate gets its file."""
    rng = random.Random(5)
    rows = [[(f"p{i}/{m}", "".join(rng.choice("ACGT") for _ in range(50)), "I" * 50) for i in range(30)] for m in (1, 2)]
    for name, own, broken in (("a_1.fastq", rows[0], {4, 9}), ("a_2.fastq", rows[1][:25], {0})):
        (tmp_path / name).write_text("".join(("" if i in broken else "@") + fastq([r])[1:] for i, r in enumerate(own)))
    out = tmp_path / "out"
    cfg = QCConfig(paths=(str(tmp_path / "a_1.fastq"),), r2=str(tmp_path / "a_2.fastq"), output_dir=str(out), trim_output=True)
    (one,) = report.run(spark, cfg)
    good = [[r for i, r in enumerate(own) if i not in broken] for own, broken in ((rows[0], {4, 9}), (rows[1][:25], {0}))]
    assert one.facts["read_count"] == 2 * 24
    for name, own in zip(("a_1_trimmed.fastq.gz", "a_2_trimmed.fastq.gz"), good, strict=True):
        assert [r[0] for r in rows_of(read_reads(spark, str(out / name)))] == [i for i, _, _ in own[:24]]
    with pytest.raises(Exception, match="malformed record"):
        report.run(spark, QCConfig(paths=cfg.paths, r2=cfg.r2, output_dir=str(out), strict=True))


def test_malformed_records_are_left_out(spark, tmp_path, capsys):
    (tmp_path / "a.fastq").write_text("@a\n" + "AC" * 20 + "\n+\n" + "II" * 20 + "\nb\nGT\n+\nII\n@c\n" + "gu" * 20 + "\n+\n" + "II" * 20 + "\n")
    (one,) = report.run(spark, QCConfig(paths=(str(tmp_path / "a.fastq"),), output_dir=str(tmp_path / "out")))
    assert one.facts["read_count"] == 2 and one.facts["gc_percent"] == 50.0
    assert "1 malformed" in capsys.readouterr().err


def test_options():
    cfg, args = config(["a.fq", "--poly-g", "b.fq", "--poly-x", "0", "--fast", "--adapter", "acgt", "--max-n", "3", "--cut-right"])
    assert cfg.paths == ("a.fq", "b.fq") and (cfg.poly_g, cfg.poly_x, cfg.max_n, cfg.cut_right) == (10, 10, 3, True)
    assert cfg.custom_adapters == ("ACGT",) and not cfg.modules.kmer and cfg.modules.adapter
    with pytest.raises(SystemExit):
        config(["a.fq", "--what"])
