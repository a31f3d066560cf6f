"""Options and constants of a quality-control run."""

from __future__ import annotations

from dataclasses import dataclass, field

# Known adapters, name and sequence, in order of precedence.
ADAPTERS = (
    ("TruSeq Read 1", "AGATCGGAAGAGCACACGTCT"),
    ("TruSeq Read 2", "AGATCGGAAGAGCGTCGTGTA"),
    ("Nextera Read 1", "CTGTCTCTTATACACATCT"),
    ("Nextera Read 2", "CTGTCTCTTATACACATCT"),
    ("Small RNA 3-prime", "TGGAATTCTCGGGTGCCAAGG"),
    ("Poly-A", "AAAAAAAAAAAAAAAAAAAAAA"),
    ("Poly-T", "TTTTTTTTTTTTTTTTTTTTTT"),
    ("ONT Ligation (SQK-LSK)", "AATGTACTTCGTTCAGTTACGTATTGCT"),
    ("ONT PCR (SQK-PCS)", "ACTTGCCTGTCGCTCTATCTTC"),
    ("ONT Rapid (SQK-RAD)", "GCTTGGGTGTTTAACCTTTTTTCGCAACGGGT"),
)
# Limits that are part of the metrics' definitions.
ADAPTER_MATCH = 11  # bases of an adapter that must match
MAX_POSITION = 2000  # positions tracked one by one
PHRED_BINS = 43  # scores 0 to 42; higher ones count as 42 in histograms
SAMPLE_READS = 200_000  # reads looked at for over-representation and duplication levels
KEY_BASES = 50  # leading bases that tell sequences apart
TOP = 20
LENGTH_BIN, LENGTH_BINS = 100, 20
TIME_BUCKET = 300  # seconds
SCATTER_STRIDE, SCATTER_POINTS = 50, 2000
LONG_MEDIAN, LONG_SAMPLE = 1000, 1000
DUPLICATION_LEVELS = ("1x", "2x", "3-4x", "5-9x", "10-49x", "50-99x", "100-499x", "500-999x", ">=1000x")
DUPLICATION_FLOORS = (1, 2, 3, 5, 10, 50, 100, 500, 1000)


@dataclass(frozen=True)
class Modules:
    """Which parts of a report are made."""

    kmer: bool = True
    duplication: bool = True
    per_tile: bool = True
    overrepresented: bool = True
    adapter: bool = True
    html: bool = True
    json: bool = True
    multiqc: bool = False

    @classmethod
    def fast(cls, **others: bool) -> Modules:
        return cls(**{"kmer": False, "duplication": False, "per_tile": False, "overrepresented": False} | others)


@dataclass(frozen=True)
class QCConfig:
    """Options of a run; defaults are those of a plain quality-control run, which cuts adapters and drops short reads."""

    paths: tuple[str, ...] = ()
    r2: str | None = None
    output_dir: str = "."
    trim_output: bool = False
    min_length: int = 20
    custom_adapters: tuple[str, ...] = ()
    quality_trim: int = 0
    poly_g: int = 0
    poly_x: int = 0
    cut_front: bool = False
    cut_right: bool = False
    cut_tail: bool = False
    window: int = 4
    window_quality: int = 20
    trim_front: int = 0
    trim_tail: int = 0
    min_quality: int = 0
    max_n: int | None = None
    strict: bool = False
    long_read: bool = False
    compare: bool = False
    modules: Modules = field(default_factory=Modules)

    def __post_init__(self):
        for name in ("min_length", "quality_trim", "poly_g", "poly_x", "trim_front", "trim_tail", "min_quality"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} can't be negative")
        if self.window < 1:
            raise ValueError("window must be at least 1")
        if self.max_n is not None and self.max_n < 0:
            raise ValueError("max_n can't be negative")
        if self.r2 is not None and len(self.paths) != 1:
            raise ValueError("a second mate file needs exactly one first")
        object.__setattr__(self, "custom_adapters", tuple(a.upper() for a in self.custom_adapters))
