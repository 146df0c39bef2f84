"""Every query that has SQL against DuckDB on the smallest tables, and the contract of the entry module."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from reelspark import catalog

REPO = Path(entry.__file__).parent
FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool) or not isinstance(v, int | float):
        return str(v)
    return f"{v:.10g}"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    rel = duck.sql(catalog.SQL[name])
    assert sorted(rel.columns) == columns
    expected = sorted(tuple(map(plain, r)) for r in rel.select(*(duckdb.ColumnExpression(c) for c in columns)).fetchall())
    assert found == expected


def test_queries_without_sql_give_rows(spark):
    for name in set(catalog.QUERIES) - set(catalog.SQL):
        assert catalog.QUERIES[name](spark, FOLDER).count() > 0, name


def test_entry_is_the_packet_report(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"stream", "n_packets", "p50", "p99"} <= set(rows[0].asDict())


@pytest.mark.parametrize("name", ["packet_report", "asof_join", "interval_join", "running_offsets", "ema_smoothing", "first_pending", "dedup_owner"])
def test_result_does_not_depend_on_partitions(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in (1, 4, 50):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = catalog.QUERIES[name](spark, FOLDER)
            seen.append(sorted(map(str, df.select(*sorted(df.columns)).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]


def test_entry_works_without_the_optional_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and e.oracle_sql(); assert not [k for k in q if k.startswith('op') and k[2].isdigit()], q"
    env = os.environ | {"PYTHONPATH": str(copy)}
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, check=True, timeout=120)


def test_nothing_else_imports_the_optional_subpackage():
    for p in (REPO / "reelspark").rglob("*.py"):
        if "llm" not in p.relative_to(REPO).parts:
            assert "reelspark.llm" not in p.read_text(), p


def test_stream_windows_count_all_events_of_files_in_mixed_order(spark, tmp_path):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    events.orderBy("ts", ascending=False).repartition(9).write.parquet(str(tmp_path / "events.parquet"))
    found = {(r.start, r.key): (r.n, r.total) for r in catalog.QUERIES["stream_windows"](spark, str(tmp_path)).collect()}
    expected = {(r[0], r[2]): (r[3], r[4]) for r in duckdb.sql(catalog.SQL["stream_windows"].replace("FROM events", f"FROM '{FOLDER}/events.parquet'")).fetchall()}
    assert found.keys() == expected.keys() and sum(n for n, _ in found.values()) == events.count()
    assert all(found[k][0] == expected[k][0] and math.isclose(found[k][1], expected[k][1], abs_tol=1e-3) for k in found)
