"""The driver's entry points, with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from weftline.plans import books

TABLES = "/root/testdata/sf0.001"
ROOT = Path(__file__).parent.parent


def test_nothing_else_imports_the_subpackage():
    code = "import sys; sys.modules['weftline.llm'] = None; import __spark_entry__ as e; assert e.llm is None and 'availability_ids' in e.queries() and set(e.oracle_sql()) <= set(e.queries()); print('fine')"
    assert "fine" in subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True).stdout


def test_flagship(spark):
    assert entry.entry(spark).columns == ["title_id"] and entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(books.SQL))
def test_queries_equal_their_oracle(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(TABLES).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = books.QUERIES[name](spark, TABLES)
    columns = sorted(got.columns)
    clean = lambda v: round(v, 4) if isinstance(v, float) else v
    mine = sorted((tuple(clean(v) for v in r) for r in got.select(*columns).collect()), key=str)
    theirs = con.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({books.SQL[name]})").fetchall()
    assert mine == sorted((tuple(clean(v) for v in r) for r in theirs), key=str)
