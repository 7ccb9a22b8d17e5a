import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from spatialpanel import schema
from spatialpanel.sources import tables

ROOT = Path(__file__).parent.parent


def test_registry_is_consistent():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50
    assert all(callable(f) for f in queries.values())


def test_nothing_outside_imports_the_subpackage():
    for p in (ROOT / "spatialpanel").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"(from|import) .*\bllm\b", p.read_text()), p


def test_rest_works_without_the_subpackage(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name.startswith('spatialpanel.llm'):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as e
assert 'p1_found' in e.queries() and 'p6_found' not in e.queries() and 'p6_found' not in e.oracle_sql()
"""
    subprocess.run([sys.executable, "-c", code], check=True)


def test_a_copy_without_both_folders_runs(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda at, names: [n for n in names if n in ("llm", ".git", "__pycache__")])
    assert not (copy / "spatialpanel" / "llm").exists() and not (copy / "tests" / "llm").exists()
    code = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
q = e.queries()
assert 'p1_found' in q and not any(n.startswith(('p6_', 'p7_', 'p8_', 'p9_', 'p10_')) for n in [*q, *e.oracle_sql()])
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()
assert e.entry(spark).count() > 0 and q['label_counts'](spark, '/root/testdata/sf0.001').count() > 0
"""
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_"))}
    subprocess.run([sys.executable, "-c", code], check=True, cwd=copy, env=env)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "e.csv").write_text("weight,src_zip,dst_zip\n1.5,02139,00501\nx,A,B\n,C,\n")
    rows = [tuple(r) for r in tables.edges_csv(spark, str(tmp_path / "e.csv")).collect()]
    assert rows == [("02139", "00501", 1.5), ("A", "B", None), ("C", None, None)]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        tables.edges_csv(spark, str(tmp_path / "bad.csv"))
    df = spark.createDataFrame([("a", [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}]), ("b", [])], "zip string, ring array<struct<x:double,y:double>>")
    tables.write(df, str(tmp_path / "p"), "json")
    assert [r.zip for r in tables.polygons(spark, str(tmp_path / "p"), "json").collect()] == ["a"]
    tables.write(df.select("zip"), str(tmp_path / "q"), "csv")
    assert spark.read.csv(str(tmp_path / "q"), header=True).count() == 2


def test_schema_helpers(spark):
    df = spark.createDataFrame([("a", 1.0, 2, "t")], "zip string, e10 double, e2 int, ex string")
    assert schema.embedding_columns(df) == ["e2", "e10"]
    wide = schema.from_wide(df)
    assert wide.first().embedding == [2.0, 1.0] and schema.to_wide(wide, 2).columns == ["zip", "e0", "e1"]
    for bad in (lambda: schema.embedding_columns(df, "q"), lambda: schema.require_columns(df, "nope"), lambda: schema.require_numeric(df, "ex"), lambda: schema.require_unique(df.union(df), "zip"), lambda: schema.feature_columns(df)):
        with pytest.raises(ValueError):
            bad()
