"""Each registered query of the reads against its SQL in DuckDB, and the driver's contract."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from readqc.plans import queries as reads


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(reads.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = reads.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert rows
    if name in reads.ORACLE_SQL:
        want = duck.execute(reads.ORACLE_SQL[name])
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert normal(map(tuple, rows), df.columns) == normal(want.fetchall(), columns)


def test_sketch_is_near(spark, sf_dir):
    exact, sketch = (reads.QUERIES[q](spark, sf_dir).first()["distinct_reads"] for q in ("dup_rate_exact", "dup_rate_hll"))
    assert abs(exact - sketch) < 0.05 * exact


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1


def test_streaming(spark, sf_dir, tmp_path):
    from readqc.sources.tables import derived_ont
    from readqc.streaming.over_time import Progress, reads_per_bucket

    ont = derived_ont(spark, sf_dir).select("ord", "id").orderBy("ord")
    ont.coalesce(1).write.parquet(str(tmp_path / "in"))
    progress = Progress()
    spark.streams.addListener(progress)
    query = reads_per_bucket(spark.readStream.schema(ont.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("buckets").start()
    query.processAllAvailable()
    query.stop()
    spark.streams.removeListener(progress)
    total = spark.sql("SELECT sum(n) AS n FROM buckets").first()["n"]
    assert total == ont.count()
