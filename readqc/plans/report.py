"""One run over files: read, trim once, compute the metrics that the modules ask for, and write reports.

Metrics stay DataFrames until here; what is collected for a report are frames of a fixed or small size (positions, bins,
tiles, the top twenty). The trimmed reads are persisted for the run, so that files are read and trimmed once.
"""

from __future__ import annotations

import json
import math
import sys
import time
from dataclasses import dataclass, field
from datetime import datetime
from pathlib import Path, PurePosixPath

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from readqc.config import DUPLICATION_LEVELS, QCConfig
from readqc.functions import text as X
from readqc.operators import metrics as M
from readqc.operators import rules
from readqc.operators.trim import kept, trim
from readqc.sources.files import read_mate, read_reads
from readqc.sources.sinks import stem, trimmed_name, write_fastq

TOOL, VERSION = "readqc", "1.0.0"
_MODULES = (("kmer", "4-mers"), ("duplication", "duplication"), ("per_tile", "quality by tile"), ("overrepresented", "overrepresented sequences"), ("adapter", "adapters"))


@dataclass
class FileReport:
    """Everything that reports show of one file."""

    path: str
    facts: dict
    modules: list[tuple[str, str]]
    cards: list[tuple[str, float, str]]
    suggestions: list[tuple[str, float]]
    charts: dict
    trimmed_reads: int = 0
    trimmed_percent: float = 0.0
    trimmed_bases: int = 0
    trim_output: str | None = None
    top_kmers: list = field(default_factory=list)
    overrepresented: list = field(default_factory=list)
    gc_expected: list = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)

    @property
    def name(self) -> str:
        return PurePosixPath(self.path).name

    @property
    def sample(self) -> str:
        return stem(self.path)


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def analyse(spark: SparkSession, reads: DataFrame, cfg: QCConfig, path: str = "reads", mates: tuple[str, str] | None = None) -> FileReport:
    """Metrics, rules and chart data of ``reads``. With ``mates`` (the files of a pair) the trimmed reads of each mate
    (column mate) are written by themselves."""
    on = cfg.modules
    trimmed, held_too = trim(reads, cfg).persist(StorageLevel.MEMORY_AND_DISK), []
    try:
        good = kept(trimmed)
        counts = M.position_counts(good).persist()
        held_too.append(counts)
        long_read = M.long_read_mode(good, cfg.long_read)
        is_long = long_read.first()["long_read"]
        dup = M.duplication_rate(good) if on.duplication else spark.sql("SELECT 0D AS dup_percent")
        over = M.overrepresented(good) if on.overrepresented else _empty(spark, "sequence string, n long, percentage double, possible_source string")
        over = over.persist()
        held_too.append(over)
        facts = rules.facts(trimmed, counts, dup, over, spark.createDataFrame([(is_long,)], "long_read boolean")).persist()
        held_too.append(facts)
        gc = M.gc_histogram(good)
        rows = lambda df, *order: [list(r) for r in (df.orderBy(*order) if order else df).collect()]
        comp = rows(M.base_composition(counts).select("pos", "a_percent", "c_percent", "g_percent", "t_percent", "other_percent"), "pos")
        dup_hist = rows(M.duplication_histogram(good).select("label", "percent", "level"), "level") if on.duplication else []
        kmers = rows(M.top_kmers(counts)) if on.kmer else []
        charts = {
            "qual": [r[0] for r in rows(M.quality_by_position(counts).where("n > 0").orderBy("pos").select("mean_quality"))],
            "qual_pct": [r[1:] for r in rows(M.quality_percentiles(counts).select("pos", "q25", "q50", "q75"), "pos")],
            "len": rows(M.length_histogram(good), "length"),
            "kmers": kmers,
            "tiles": rows(M.tile_quality(good).select("tile", "mean_quality"), "tile") if on.per_tile else [],
            "basecomp": [r[1:] for r in comp],
            "qualdist": [r[1] for r in rows(M.mean_quality_histogram(good), "quality")],
            "gc_dist": [r[1] for r in rows(gc, "gc")],
            "dup_hist": [r[:2] for r in dup_hist] or [[label, 0.0] for label in DUPLICATION_LEVELS],
            "n_content": [r[5] for r in comp],
            "qvl": rows(M.quality_vs_length(good).select("length", "mean_quality")) if is_long else [],
            "rot": rows(M.reads_over_time(good), "minutes") if is_long else [],
            "chann": rows(M.channel_counts(good), "channel") if is_long else [],
            "long_read": is_long,
        }
        report = FileReport(
            path=path,
            facts=facts.first().asDict(),
            modules=[tuple(r) for r in rules.module_status(facts).collect()],
            cards=[tuple(r) for r in rules.card_classes(facts).collect()],
            suggestions=[(r["option"] + (" (strongly)" if r["level"] else ""), r["value"]) for r in rules.suggestions(facts).orderBy("place").collect()],
            charts=charts,
            top_kmers=kmers,
            overrepresented=rows(over),
            gc_expected=[r[2] for r in rows(M.gc_overlay(gc), "gc")],
            skipped=[name for option, name in _MODULES if not getattr(on, option)],
        )
        if cfg.trim_output:
            stats = M.trim_stats(trimmed).first()
            report.trimmed_reads, report.trimmed_percent, report.trimmed_bases = stats["trimmed_reads"], stats["trimmed_percent"], stats["trimmed_bases"]
            report.trim_output = f"{cfg.output_dir}/{trimmed_name(path)}"
            for k, own in enumerate(mates or (path,), 1):
                write_fastq(good.where(F.col("mate") == k) if mates else good, f"{cfg.output_dir}/{trimmed_name(own)}")
        return report
    finally:
        for held in (trimmed, *held_too):
            held.unpersist()


def run(spark: SparkSession, cfg: QCConfig) -> list[FileReport]:
    """Analyse the files of ``cfg`` one by one (with a second mate file: both mates pooled) and write its reports."""
    if not cfg.paths:
        raise ValueError("no input files")
    began, mode = time.time(), "FAILFAST" if cfg.strict else "DROPMALFORMED"
    reports = []

    def read(path: str, watch: Observation) -> DataFrame:
        return read_reads(spark, path, mode=mode, watch=None if cfg.strict else watch)

    def warn(path: str, bad: int) -> None:
        if bad:
            print(f"warning: {bad} malformed records of {path} were left out", file=sys.stderr)

    if cfg.r2:
        pair = (cfg.paths[0], cfg.r2)
        mates = [read_mate(spark, path, cfg.strict) for path in pair]
        for path, (_, bad) in zip(pair, mates, strict=True):
            warn(path, bad)
        reports.append(analyse(spark, M.pair_up(mates[0][0], mates[1][0]), cfg, pair[0], mates=pair))
    else:
        for path in cfg.paths:
            watch = Observation()
            reports.append(analyse(spark, read(path, watch), cfg, path))
            warn(path, 0 if cfg.strict else watch.get["malformed"])
    out, seconds = Path(cfg.output_dir), time.time() - began
    out.mkdir(parents=True, exist_ok=True)
    name = report_stem(reports)
    if cfg.modules.json:
        (out / f"{name}_report.json").write_text(to_json(reports, seconds))
    if cfg.modules.multiqc:
        (out / f"{name}_mqc.json").write_text(to_multiqc(reports))
    if cfg.modules.html:
        (out / f"{name}_report.html").write_text(to_html(reports, seconds))
    if cfg.compare and len(reports) > 1:
        (out / f"{reports[0].sample}_vs_{reports[1].sample}_comparison.html").write_text(to_comparison(*reports[:2]))
    return reports


def report_stem(reports: list[FileReport]) -> str:
    return reports[0].sample if len(reports) == 1 else "batch_report"


def to_json(reports: list[FileReport], seconds: float) -> str:
    files = [
        {
            "file_name": r.name, "file_path": r.path, "read_count": r.facts["read_count"], "total_bases": r.facts["total_bases"],
            "average_read_length": r.facts["avg_length"], "min_read_length": r.facts["min_length"], "max_read_length": r.facts["max_length"],
            "n50": r.facts["n50"], "n90": r.facts["n90"], "gc_content_percent": r.facts["gc_percent"], "average_phred_quality": r.facts["avg_quality"],
            "q20_reads_percent": r.facts["q20_percent"], "q30_reads_percent": r.facts["q30_percent"], "adapter_contamination_percent": r.facts["adapter_percent"],
            "duplication_rate_estimate_percent": r.facts["dup_percent"], "trimmed_reads": r.trimmed_reads, "trimmed_reads_percent": r.trimmed_percent,
            "trim_output_path": r.trim_output, "top_kmers": r.top_kmers,
        }
        for r in reports
    ]
    return json.dumps({"tool": TOOL, "version": VERSION, "generated": datetime.now().strftime("%Y-%m-%d %H:%M:%S"), "processing_time_seconds": seconds, "files": files}, indent=2)


# Key (fixed by those who read the table), fact, title, what it says, settings of the column.
_SHARE = {"suffix": "%", "min": 0, "max": 100}
_MULTIQC = (
    ("total_sequences", "read_count", "Reads", "Reads that trimming and filters kept", {"format": "{:,d}", "shared_key": "read_count"}),
    ("percent_gc", "gc_percent", "GC", "Share of G and C among all bases kept", _SHARE | {"format": "{:.1f}"}),
    ("avg_sequence_length", "avg_length", "Length", "Mean bases of a read after trimming", {"suffix": " bp", "format": "{:.0f}"}),
    ("mean_quality", "avg_quality", "Quality", "Mean score over all bases that have one", {"min": 0, "max": 42, "format": "{:.1f}"}),
    ("percent_q30", "q30_percent", "Q30", "Share of bases with a score of 30 or more", _SHARE | {"format": "{:.1f}"}),
    ("percent_adapter", "adapter_percent", "Adapters", "Share of reads in which a known adapter was cut", _SHARE | {"format": "{:.2f}"}),
    ("percent_duplicates", "dup_percent", "Copies", "Share of reads whose leading bases another read has too, by a sketch", _SHARE | {"format": "{:.1f}"}),
    ("total_bases", "total_bases", "Bases", "All bases of the reads kept", {"format": "{:,d}", "shared_key": "base_count"}),
    ("n50", "n50", "N50", "Half of all bases lie in reads of at least this length", {"suffix": " bp", "format": "{:,d}"}),
)


def to_multiqc(reports: list[FileReport]) -> str:
    if not reports:
        raise ValueError("no files")
    data = {r.sample: {key: r.facts[fact] for key, fact, *_ in _MULTIQC} for r in reports}
    columns = [{key: {"title": title, "description": about, **more}} for key, _, title, about, more in _MULTIQC]
    return json.dumps({"id": TOOL, "section_name": TOOL, "description": "Quality of sequencing reads, a row for each file", "plot_type": "generalstats", "pconfig": columns, "data": data}, indent=2)


def console(r: FileReport) -> str:
    """The summary that a terminal shows."""
    f = r.facts
    rows = [
        ("File", r.name), ("Reads", X.number(f["read_count"])), ("Total bases", X.bases(f["total_bases"])), ("Avg length", f"{f['avg_length']:.1f} bp"),
        ("Min / Max", f"{f['min_length']} / {f['max_length']} bp"), ("N50 / N90", f"{f['n50']} / {f['n90']} bp"), ("GC content", f"{f['gc_percent']:.2f}%"),
        ("Avg quality", f"Q{f['avg_quality']:.1f}"), ("Q20 bases", f"{f['q20_percent']:.1f}%"), ("Q30 bases", f"{f['q30_percent']:.1f}%"),
        ("Adapters", f"{f['adapter_percent']:.2f}%"), ("Copies", f"{f['dup_percent']:.1f}%"),
    ]
    if r.trimmed_reads:
        rows.append(("Trimmed reads", f"{X.number(r.trimmed_reads)} ({r.trimmed_percent:.1f}%)"))
        rows.append(("Trim output", r.trim_output))
    if r.charts["tiles"]:
        rows.append(("Illumina tiles", str(len(r.charts["tiles"]))))
    return "\n".join(f"  {label + ':':<17}{value}" for label, value in rows)


_STYLE = """body{font:14px system-ui,sans-serif;margin:2em auto;max-width:70em;color:#1f2937}h1,h2{font-weight:600}table{border-collapse:collapse;margin:1em 0}
td,th{border:1px solid #d1d5db;padding:4px 10px;text-align:right}td:first-child,th:first-child{text-align:left}.pass{color:#15803d}.warn{color:#b45309}.fail{color:#b91c1c}
.cards{display:flex;flex-wrap:wrap;gap:12px}.card{border:1px solid #d1d5db;border-radius:6px;padding:8px 14px}.card b{display:block;font-size:1.3em}figure{display:inline-block;margin:8px}figcaption{color:#6b7280}
svg text{font:11px system-ui,sans-serif}.axis{stroke:#6b7280}.grid{stroke:#e5e7eb}.none{color:#6b7280}"""


_COLOURS = ("#2563eb", "#dc2626", "#16a34a", "#9333ea", "#6b7280")


def _ticks(low: float, high: float, about: int = 5) -> list[float]:
    """Round numbers from ``low`` to ``high``, in steps of 1, 2 or 5 times a power of ten."""
    if not high > low:
        return [low]
    rough = (high - low) / about
    power = 10.0 ** math.floor(math.log10(rough))
    step = next(k * power for k in (1, 2, 5, 10) if k * power >= rough * (1 - 1e-9))
    return [i * step for i in range(math.ceil(low / step - 1e-9), math.floor(high / step + 1e-9) + 1)]


def _chart(title: str, across: str, series: dict[str, list[float]], x: list[float] | None = None, labels: list[str] | None = None, points: bool = False, width: int = 460, height: int = 210) -> str:
    """Lines (or points) with axes as inline SVG; nothing without values. ``x`` are the places of the values (from 0 by
    default), ``labels`` what stands at them instead of numbers."""
    series = {name: v for name, v in series.items() if v}
    if not series:
        return ""
    x = x or list(range(max(map(len, series.values()))))
    low, high, top = min(x), max(x), max(max(v) for v in series.values()) or 1
    left, right, over, under = 58, 10, 22, 38
    across_of = lambda a: left + (width - left - right) * ((a - low) / (high - low) if high > low else 0.5)
    up_of = lambda b: height - under - (height - over - under) * b / top
    out = [f'<line class="axis" x1="{left}" y1="{height - under}" x2="{width - right}" y2="{height - under}"/>']
    for t in _ticks(0, top, 4):
        out.append(f'<line class="grid" x1="{left}" y1="{up_of(t):.1f}" x2="{width - right}" y2="{up_of(t):.1f}"/><text x="{left - 5}" y="{up_of(t) + 4:.1f}" text-anchor="end">{t:,.6g}</text>')
    marks = list(zip(x, labels, strict=True)) if labels else [(t, f"{t:,.6g}") for t in _ticks(low, high)]
    out += [f'<text x="{across_of(a):.1f}" y="{height - under + 14}" text-anchor="middle">{X.escape(name)}</text>' for a, name in marks]
    out.append(f'<text x="{(left + width - right) / 2:.1f}" y="{height - 6}" text-anchor="middle">{X.escape(across)}</text>')
    for k, (name, v) in enumerate(series.items()):
        colour = _COLOURS[k % len(_COLOURS)]
        places = [(f"{across_of(a):.1f}", f"{up_of(b):.1f}") for a, b in zip(x, v, strict=False)]
        if points or len(places) == 1:
            out += [f'<circle cx="{a}" cy="{b}" r="2" fill="{colour}"/>' for a, b in places]
        else:
            out.append(f'<polyline fill="none" stroke="{colour}" stroke-width="1.5" points="{" ".join(f"{a},{b}" for a, b in places)}"/>')
        if len(series) > 1:
            out.append(f'<text x="{left + 90 * k}" y="12" fill="{colour}">{X.escape(name)}</text>')
    return f'<figure><svg width="{width}" height="{height}" viewBox="0 0 {width} {height}" role="img" aria-label="{X.escape(title)}">{"".join(out)}</svg><figcaption>{X.escape(title)}</figcaption></figure>'


def _table(head: tuple[str, ...], rows: list) -> str:
    cell = lambda x: f"{x:.2f}" if isinstance(x, float) else X.escape(str(x))
    return "<table><tr>" + "".join(f"<th>{X.escape(h)}</th>" for h in head) + "</tr>" + "".join("<tr>" + "".join(f"<td>{cell(x)}</td>" for x in r) + "</tr>" for r in rows) + "</table>"


def _section(r: FileReport) -> str:
    f, c = r.facts, r.charts
    cards = [("Reads", X.number(f["read_count"]), ""), ("Total bases", X.bases(f["total_bases"]), ""), ("Avg length", f"{f['avg_length']:.1f} bp", ""), ("N90", f"{f['n90']} bp", "")]
    cards += [(name, f"{value:.2f}", cls) for name, value, cls in r.cards]
    status = "".join(f'<li class="{s}">{X.escape(m)}: {s}</li>' for m, s in r.modules)
    parts = [f"<h2>{X.escape(r.name)}</h2><div class=cards>" + "".join(f'<div class=card>{X.escape(a)}<b class="{k}">{X.escape(b)}</b></div>' for a, b, k in cards) + f"</div><ul>{status}</ul>"]
    if r.suggestions:
        parts.append("<p>Worth trying:</p><ul>" + "".join(f"<li><code>{X.escape(o)}</code> ({v:.1f})</li>" for o, v in r.suggestions) + "</ul>")
    if r.skipped:
        parts.append(f"<p class=none>Switched off and not computed: {X.escape(', '.join(r.skipped))}.</p>")
    quartiles = [list(x) for x in zip(*c["qual_pct"], strict=True)]
    columns = lambda pairs: {"x": [a for a, _ in pairs]}
    values = lambda name, pairs: {name: [b for _, b in pairs]}
    parts += [
        _chart("Quality by position", "position", {"mean": c["qual"]} | dict(zip(("lower quartile", "median", "upper quartile"), quartiles, strict=False))),
        _chart("Bases by position, %", "position", dict(zip("ACGT", [list(x) for x in zip(*c["basecomp"], strict=True)], strict=False))),
        _chart("Bases that are none of A, C, G, T by position, %", "position", {"other": c["n_content"]}),
        _chart("Reads by mean quality", "mean quality", {"reads": c["qualdist"]}),
        _chart("Reads by GC share", "GC, %", {"reads": c["gc_dist"], "normal": r.gc_expected}),
        _chart("Reads by length", "length", values("reads", c["len"]), **columns(c["len"])),
        _chart("Distinct sequences by duplication level, %", "copies", values("share", c["dup_hist"]), labels=[name for name, _ in c["dup_hist"]]) if c["dup_hist"] and "duplication" not in r.skipped else "",
        _chart("Quality by tile", "tile", values("mean quality", c["tiles"]), **columns(c["tiles"])),
        _chart("Mean quality by length of a sample of reads", "length", values("reads", c["qvl"]), **columns(c["qvl"]), points=True),
        _chart("Reads over time", "minutes", values("reads", c["rot"]), **columns(c["rot"])),
        _chart("Reads by channel", "channel", values("reads", c["chann"]), **columns(c["chann"]), points=True),
    ]
    if r.top_kmers:
        parts.append(_table(("4-mer", "Count"), r.top_kmers))
    if r.overrepresented:
        parts.append(_table(("Sequence", "Count", "%", "Possible source"), r.overrepresented))
    return "".join(parts)


def to_html(reports: list[FileReport], seconds: float) -> str:
    head = ("File", "Reads", "Bases", "Avg length", "N50", "GC %", "Avg Q", "Q30 %", "Adapter %", "Dup %")
    facts = ("read_count", "total_bases", "avg_length", "n50", "gc_percent", "avg_quality", "q30_percent", "adapter_percent", "dup_percent")
    summary = _table(head, [[r.name, *(r.facts[x] for x in facts)] for r in reports]) if len(reports) > 1 else ""
    data = json.dumps({r.name: r.charts for r in reports}).replace("</", "<\\/")
    return f'<!doctype html><meta charset="utf-8"><title>{TOOL}</title><style>{_STYLE}</style><h1>Read quality</h1><p>{len(reports)} file(s), {X.duration(seconds)}</p>{summary}{"".join(map(_section, reports))}<script type="application/json" id="charts">{data}</script>'


def to_comparison(a: FileReport, b: FileReport) -> str:
    """Two files side by side."""
    rows = []
    for metric in rules.COMPARED:
        x, y = a.facts[metric], b.facts[metric]
        rows.append((metric, x, y, X.percent_delta(x, y) + "%" if metric.endswith("percent") else X.delta(x, y)))
    mixed = "<p class=warn>One file has long reads, the other short ones: limits differ.</p>" if a.facts["long_read"] != b.facts["long_read"] else ""
    names = (a.name, b.name) if a.name != b.name else (a.path, b.path)
    charts = _chart("Quality by position", "position", dict(zip(names, (a.charts["qual"], b.charts["qual"]), strict=True))) + _chart("Reads by GC share", "GC, %", dict(zip(names, (a.charts["gc_dist"], b.charts["gc_dist"]), strict=True)))
    return f'<!doctype html><meta charset="utf-8"><title>{TOOL}</title><style>{_STYLE}</style><h1>{X.escape(a.name)} and {X.escape(b.name)}</h1>{mixed}{_table(("Metric", a.name, b.name, "Δ"), rows)}{charts}'


def batch_totals(reports: list[FileReport], seconds: float, size: int) -> dict:
    """Totals and rates of a run."""
    reads = sum(r.facts["read_count"] for r in reports)
    return {"reads": reads, "bytes": size, "reads_per_second": reads / seconds if seconds else 0.0, "mb_per_second": size / 1e6 / seconds if seconds else 0.0}
