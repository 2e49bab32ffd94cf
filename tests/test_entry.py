"""Every registered query against its SQL, on the smallest tables."""

import glob
import math
import os
import re
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from lumisift.operators import topk
from lumisift.plans import running, size, skew

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, float) or type(value).__name__ == "Decimal":
        value = float(value)
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    got = table(df.columns, df.collect())
    if name not in entry.oracle_sql():
        assert got
        return
    result = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == table(columns, result.fetchall())


LARGE = [
    "apply_cutoff_auto", "embedding_lookup", "ingest", "order_all", "search_auto", "skip_seen_content",
    "softmax_scores",
]


@pytest.mark.parametrize("name", LARGE)
def test_query_as_for_large_inputs(spark, duck, monkeypatch, name):
    """The plans that only large inputs get, forced on small ones."""
    monkeypatch.setattr(skew, "ONE_TASK_BYTES", 0)
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(running, "ONE_TASK_BYTES", 0)
    monkeypatch.setattr(topk, "ONE_TASK_BYTES", 0)
    monkeypatch.setattr(size, "SPLIT_BYTES", 0)
    test_query(spark, duck, name)


@pytest.mark.parametrize("scale, expected", [
    ("0.001", {"new": 20, "changed": 19, "seen": 21, "unchanged": 140, "stale": 10}),
    ("0.01", {"new": 90, "changed": 87, "seen": 123, "unchanged": 700, "stale": 10}),
])
def test_known_counts(spark, scale, expected):
    counts = entry.queries()["ingest_counts"](spark, f"/root/testdata/sf{scale}").collect()
    assert {r.action: r.files for r in counts} == expected


def test_flagship(spark):
    assert entry.entry(spark).columns == ["query_id", "rank", "path", "score"]
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_training_data_part(tmp_path):
    """The entry file and the queries of the library stand without that folder, pipeline or not."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(os.path.join(root, "lumisift"), tmp_path / "lumisift", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(root, name)):
            shutil.copy(os.path.join(root, name), tmp_path)
    said = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print(*sorted(e.queries()))"],
        cwd=tmp_path, capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}).stdout.split()
    rest = [n for n in entry.queries() if n != "pipeline" and not re.match(r"op\d+_", n)]
    assert said == sorted(rest) and len(said) >= 69
