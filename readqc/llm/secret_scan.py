"""Secret scans: known forms by pattern, and unknown ones by sliding-window Shannon entropy.

A candidate is a run of 16 or more characters that keys are written in. It belongs to the first class that holds all its
characters (digits, lower or upper hex, letters of one case, letters with digits, base64). A window of 24 characters, of 16
over runs of under 24, slides over it; the counts of its characters and the sum of c * log2(c) are kept up to date as one
character enters and one leaves, so that the entropy log2(w) - sum / w costs the same for each step. Windows at or over the
class's limit are merged to one span. Candidates on the allow-list are left alone.

Where a class has no limit, entropy can't tell keys from what is written every day: runs of 24 digits or lower hex are known
forms already, shorter ones are numbers and short checksums, and short runs of letters are words. A run of under 24 is looked
at only if letters and digits change places in it four times. Letters of one case have the highest limit: 24 random ones
hold 3.8 bits in the median, words glued together 3.3 to 3.6, so that about half of the random runs of 40 letters are found
and one in fifty of glued ones.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from readqc.llm.common import lean, pieces

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, as shorter ones don't count
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
KINDS = ("assign", "access", "hex", "entropy")
WINDOW, SHORT = 24, 16
#: Class, its characters, the least entropy in bits of a window of 24 characters (of 4.58 possible) and of 16 in
#: shorter runs (of 4); None: never a secret.
CLASSES = (
    ("digits", re.compile(r"[0-9]+"), None, None),
    ("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), 2.9, None),
    ("letters", re.compile(r"[a-z]+|[A-Z]?[a-z]+|[A-Z]+"), 4.0, None),
    ("alphanumeric", re.compile(r"[A-Za-z0-9]+"), 3.7, 3.5),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 3.9, 3.5),
)
#: What is no secret though it looks like one.
ALLOWED = (
    re.compile(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"),  # UUID
    re.compile(r"(?i).*([a-z0-9+]example|example[a-z0-9+]).*"),  # written into the key; a name between signs says nothing of the rest
    re.compile(r"(?i)sha(1|224|256|384|512)-.*"),
    re.compile(r"(.{1,12}?)\1+.{0,11}"),  # a short string again and again
    re.compile(r"(?i)(0123456789|abcdefghijklmnopqrstuvwxyz|[+/])+"),
)
SIGNS = re.compile(r"[_/=-]+")
MIXED = re.compile(r"(?:.*?(?:[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z]))){4}")
_XLOG = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def worded(run: str) -> bool:
    """Words and numbers joined by signs: each part is digits alone (under 16), or letters alone that are few (under 16), of one
    case and under 24, or with three capitals in ten at most, as names made of words have."""

    def word(part: str) -> bool:
        capitals = sum(c <= "Z" for c in part)
        few = len(part) < 16 or (len(part) < WINDOW and (capitals == len(part) or part[1:].islower()))
        return (part.isdigit() and len(part) < 16) or (part.isalpha() and (few or (not part[1:].islower() and 10 * capitals <= 3 * len(part))))

    return all(word(part) for part in SIGNS.split(run) if part)


def entropy_spans(text: str, limit: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Merged ranges of the windows whose entropy in bits is at least ``limit``."""
    counts: dict[str, int] = {}
    total, out, most = 0.0, [], math.log2(window)
    for i, c in enumerate(text):
        k = counts.get(c, 0)
        total += _XLOG[k + 1] - _XLOG[k]
        counts[c] = k + 1
        if i >= window:
            k = counts[old := text[i - window]]
            total += _XLOG[k - 1] - _XLOG[k]
            counts[old] = k - 1
        if i >= window - 1 and most - total / window >= limit - 1e-9:
            start = i + 1 - window
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the known forms."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def added_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of high-entropy ranges that no known form covers."""
    out = []
    for m in CANDIDATE.finditer(text):
        run = m[0]
        short = len(run) < WINDOW
        limit = next(x[2 + short] for x in CLASSES if x[1].fullmatch(run))
        if limit is None or (short and not MIXED.match(run)) or worded(run) or any(form.fullmatch(run) for form in ALLOWED):
            continue
        for a, b in entropy_spans(run, limit, SHORT if short else WINDOW):
            a, b = a + m.start(), b + m.start()
            if not any(s <= a and b <= e for s, _, e in base):
                out.append((a, 3, b))
    return out


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans of known forms, and all spans, as (start, kind, end) in code points."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, sorted(base + added_spans(text, base))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


def find_secrets(docs: DataFrame) -> DataFrame:
    """Secrets in every whole text.

    One row for each row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans. A null or empty text has
    none (the digest is of the empty string). Repeated rows and null ids pass through; other columns are not read.
    No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch):
                counts, digest, spans = [[], [], []], [], []
                for text in texts:
                    base, every = scan(text)
                    for k in range(3):
                        counts[k].append(sum(x[1] == k for x in base))
                    digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    spans.append(joined(every))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda batches: lean(run(batches)), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, last = [], 0
    for a, _, b in spans:
        if b > last:
            out.append(text[last : max(a, last)])
            if a >= last:
                out.append(mark)
            last = b
    return "".join([*out, text[last:]])


def redact_secrets(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """The documents with each secret span (overlapping ones as one) replaced by ``mark``; n_chars is set anew where a
    text changes. All rows and columns stay, null and empty texts, repeated rows and null ids as they are. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for part, texts in pieces(batch):
                new = [redact(t, s, mark) if (s := scan(t)[1]) else t for t in texts]
                cols = list(part.columns)
                cols[names.index("text")] = pa.array(new, pa.string())
                if "n_chars" in names:
                    k = names.index("n_chars")
                    cols[k] = pa.array([len(b) if a != b else n for a, b, n in zip(texts, new, cols[k].to_pylist(), strict=True)], cols[k].type)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(lambda batches: lean(run(batches)), docs.schema)
