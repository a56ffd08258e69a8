"""Every catalogued query against its SQL on the smallest tables, and the entry module with and without the corpus part."""

import os
import subprocess
import sys

import duckdb
import pytest

from quern.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cursor = duck.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(plain(x) for x in r) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want


def test_orphan_chunks_of_repeated_names(spark, tmp_path):
    """Two unsplit entries of one name in the second volume aren't pieces of one entry; one that begins before it is incomplete."""
    rows = [(0, "a" * 4096, "en", "s"), (1, "b" * 100, "en", "s"), (1, "b" * 100, "en", "s"), (1000, "c" * 9000, "en", "s"), (1001, "d", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.archive_id: r.incomplete for r in catalogue.QUERIES["orphan_chunks"](spark, str(tmp_path)).collect()}
    assert got == {"s-0": 0, "s-1": 1}


def test_names_of_any_length(spark, tmp_path):
    spark.createDataFrame([(1, "ab" * 50)], "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    assert {r.symbol: r.n for r in catalogue.QUERIES["symbol_histogram"](spark, str(tmp_path)).collect()} == {97: 50, 98: 50}
    assert catalogue.QUERIES["delta_filter"](spark, str(tmp_path)).count() == 100


def test_entry_without_the_corpus_part(tmp_path):
    """The entry module imports, and keeps the other queries, where that part was taken out."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in os.listdir(root):
        if name not in ("quern", "corpus_pipeline.py", "tests", ".git"):
            os.symlink(os.path.join(root, name), tmp_path / name)
    os.mkdir(tmp_path / "quern")
    for name in os.listdir(os.path.join(root, "quern")):
        if name != "llm":
            os.symlink(os.path.join(root, "quern", name), tmp_path / "quern" / name)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert said.stdout.split() == [str(len(catalogue.QUERIES)), str(len(catalogue.ORACLES)), "False"]


def test_volume_sets_are_made_once(spark):
    """The three kinds of sets that validate_volumes judges come from one reading of the documents."""
    plan = catalogue.QUERIES["validate_volumes"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_extracted_files_are_not_listed(spark):
    """Reading a folder's files through a source lists every one of them on the driver."""
    plan = catalogue.QUERIES["extract_tree"](spark, DATA)._jdf.queryExecution().toString()
    assert "binaryFile" not in plan and "modificationTime" not in plan
