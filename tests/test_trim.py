import random

import pyarrow as pa
import pytest

from readqc.config import ADAPTERS, Modules, QCConfig
from readqc.operators.trim import trim, window_cuts
from tests import oracle

OFF = Modules(adapter=False)
CONFIGS = [
    QCConfig(),
    QCConfig(min_length=0),
    QCConfig(min_length=0, modules=OFF, trim_front=3, trim_tail=4),
    QCConfig(min_length=0, modules=OFF, cut_front=True),
    QCConfig(min_length=0, modules=OFF, cut_right=True, window=5, window_quality=15),
    QCConfig(min_length=0, modules=OFF, cut_tail=True, window=7),
    QCConfig(min_length=0, modules=OFF, poly_g=4),
    QCConfig(min_length=0, modules=OFF, poly_x=3),
    QCConfig(min_length=0, modules=OFF, poly_g=3, poly_x=3),
    QCConfig(min_length=0, modules=OFF, quality_trim=20),
    QCConfig(min_length=0, custom_adapters=("ACGTACGTACGTAA", "ccc")),
    QCConfig(min_length=5, modules=OFF, max_n=2, min_quality=18),
    QCConfig(min_length=10, trim_front=2, trim_tail=1, cut_front=True, cut_right=True, cut_tail=True, poly_g=5, poly_x=4, quality_trim=10, max_n=5, min_quality=12, custom_adapters=("GATTACA",)),
]


def some_reads(n=400, seed=5):
    rng = random.Random(seed)
    rows = [(0, "r", "", ""), (1, "r", "A" * 25, None), (2, "r", "ACGTN" * 30, "I" * 150), (3, "r", "acgt" * 8, "!" * 32), (4, "r", "ACGTACGTAC" * 220, "5" * 2200), (5, "r", "ACGT" * 6, "I" * 40), (6, "r", "ACGT" * 6, "5" * 9)]
    for i in range(len(rows), n):
        k = rng.randint(0, 60)
        seq = "".join(rng.choice("ACGTN" if rng.random() < 0.9 else "acgtnR") for _ in range(k))
        if rng.random() < 0.4:
            at = rng.randint(0, k)
            seq = seq[:at] + rng.choice(ADAPTERS)[1] + seq[at:]
        if rng.random() < 0.3:
            seq += rng.choice("ACGTN") * rng.randint(1, 12)
        m = len(seq) + (rng.randint(-3, 5) if rng.random() < 0.1 else 0)
        level = rng.choice((2, 15, 25, 40))
        qual = None if rng.random() < 0.05 else "".join(chr(33 + max(0, min(60, int(rng.gauss(level, 12))))) for _ in range(max(m, 0)))
        rows.append((i, f"r{i}", seq, qual))
    return rows


@pytest.mark.parametrize("cfg", CONFIGS)
def test_chain_against_plain_python(spark, cfg):
    rows = some_reads()
    got = {r.ord: r for r in trim(spark.createDataFrame(rows, "ord long, id string, seq string, qual string"), cfg).collect()}
    for ord_, _, seq, qual in rows:
        want, r = oracle.trim(seq, qual, cfg), got[ord_]
        assert r.keep == (want is not None), (seq, qual)
        assert r.len0 == len(seq)
        if want:
            assert (r.seq, r.qual, r.adapter) == want, (seq, qual)


@pytest.mark.parametrize("kind", ["front", "right", "tail"])
def test_window_cuts(kind):
    rng = random.Random(1)
    quals = ["", "I", "III", "!!!!", "IIII"] + ["".join(rng.choice("!+5?I") for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    for w, q in ((1, 20), (4, 20), (5, 31), (40, 3)):
        want = [getattr(oracle, f"cut_{kind}")(x, w, q) for x in quals]
        assert window_cuts(pa.array(quals), w, q, kind).tolist() == want


def test_known_vectors(spark):
    rows = [(0, "a", "ACGTACGTACAGATCGGAAGAGCACACGTCT", "I" * 31), (1, "b", "ACGTA", "???++")]
    got = {r.ord: r for r in trim(spark.createDataFrame(rows, "ord long, id string, seq string, qual string"), QCConfig(min_length=0, quality_trim=20)).collect()}
    assert (got[0].seq, got[0].adapter) == ("ACGTACGTAC", "TruSeq Read 1")
    assert got[1].qual == "???"


def test_bad_options():
    for options in ({"window": 0}, {"min_length": -1}, {"max_n": -1}, {"r2": "x"}):
        with pytest.raises(ValueError):
            QCConfig(**options)
