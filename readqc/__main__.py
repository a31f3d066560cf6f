"""Command line: ``python -m readqc FILES [OPTIONS]``."""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from readqc.config import Modules, QCConfig
from readqc.plans import report
from readqc.session import local_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="readqc", description="Quality control, trimming and filtering of sequencing reads.")
    p.add_argument("files", nargs="+")
    p.add_argument("--headless", action="store_true", help="no progress line")
    p.add_argument("--output-dir", default=".")
    p.add_argument("--threads", type=int)
    p.add_argument("--trim", action="store_true", help="write the trimmed reads")
    p.add_argument("--min-length", type=int, default=20)
    p.add_argument("--adapter", action="append", default=[])
    p.add_argument("--quality-trim", type=int, default=0)
    p.add_argument("--strict", action="store_true")
    p.add_argument("--in2")
    p.add_argument("--poly-g", type=int, nargs="?", const=10, default=0)
    p.add_argument("--poly-x", type=int, nargs="?", const=10, default=0)
    for kind in ("front", "right", "tail"):
        p.add_argument(f"--cut-{kind}", action="store_true")
    p.add_argument("--window-size", type=int, default=4)
    p.add_argument("--window-quality", type=int, default=20)
    p.add_argument("--trim-front", type=int, default=0)
    p.add_argument("--trim-tail", type=int, default=0)
    p.add_argument("--min-quality", type=int, default=0)
    p.add_argument("--max-n", type=int)
    for module in ("kmer", "duplication", "per-tile", "overrep", "adapter", "html", "json"):
        p.add_argument(f"--no-{module}", action="store_true")
    for flag in ("fast", "multiqc", "compare", "long-read"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--version", "-V", action="version", version=f"{report.TOOL} {report.VERSION}")
    return p


def config(argv: list[str]) -> tuple[QCConfig, argparse.Namespace]:
    # A lone --poly-g or --poly-x must not take the next file for its number.
    args = parser().parse_intermixed_args([f"{a}=10" if a in ("--poly-g", "--poly-x") and not (argv[i + 1 : i + 2] and argv[i + 1].isdigit()) else a for i, a in enumerate(argv)])
    if args.threads is not None and args.threads < 1:
        raise SystemExit("--threads must be at least 1")
    slow = not args.fast
    modules = Modules(
        kmer=slow and not args.no_kmer, duplication=slow and not args.no_duplication, per_tile=slow and not args.no_per_tile,
        overrepresented=slow and not args.no_overrep, adapter=not args.no_adapter, html=not args.no_html, json=not args.no_json, multiqc=args.multiqc,
    )
    cfg = QCConfig(
        paths=tuple(args.files), r2=args.in2, output_dir=args.output_dir, trim_output=args.trim, min_length=args.min_length, custom_adapters=tuple(args.adapter),
        quality_trim=args.quality_trim, poly_g=args.poly_g if "--poly-g" not in argv or args.poly_g else 10, poly_x=args.poly_x if "--poly-x" not in argv or args.poly_x else 10,
        cut_front=args.cut_front, cut_right=args.cut_right, cut_tail=args.cut_tail, window=args.window_size, window_quality=args.window_quality,
        trim_front=args.trim_front, trim_tail=args.trim_tail, min_quality=args.min_quality, max_n=args.max_n, strict=args.strict,
        long_read=args.long_read, compare=args.compare, modules=modules,
    )
    return cfg, args


def main(argv: list[str] | None = None) -> int:
    cfg, args = config(sys.argv[1:] if argv is None else argv)
    for path in (*cfg.paths, *([cfg.r2] if cfg.r2 else [])):
        if "://" not in path and not Path(path).is_file():
            print(f"not a file: {path}", file=sys.stderr)
            return 1
    spark, began = local_session(args.threads or "*"), time.time()
    reports = report.run(spark, cfg)
    for r in reports:
        print(report.console(r) + "\n")
    size = sum(Path(p).stat().st_size for p in cfg.paths if "://" not in p)
    totals = report.batch_totals(reports, time.time() - began, size)
    print(f"  {totals['reads']:,} reads, {totals['reads_per_second']:,.0f} reads/s, {totals['mb_per_second']:.1f} MB/s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
