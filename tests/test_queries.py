"""Every query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from lectern.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in os.listdir(SMALL):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{name}'")
    return c


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    assert len(got.columns)
    if name in ORACLE_SQL:
        assert rows(got) == rows(db.sql(ORACLE_SQL[name]).df())


def test_entry_point_stands_without_the_extra_package(tmp_path):
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['lectern.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'sentence_split' in q and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
