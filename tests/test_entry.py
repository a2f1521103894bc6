from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from sparkloom.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _rows(pdf):
    columns = sorted(pdf.columns)
    return columns, sorted((tuple(r) for r in pdf[columns].astype(object).where(pdf[columns].notna(), None).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_and_sql_agree(spark, duck, name):
    assert _rows(plans.QUERIES[name](spark, SF).toPandas()) == _rows(duck.execute(plans.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_needs_the_training_data_operators():
    root = Path(__spark_entry__.__file__).parent
    code = "import sys; sys.modules['sparkloom.llm'] = None; sys.path.insert(0, sys.argv[1]); import __spark_entry__ as e; assert len(e.queries()) > 50 and not any(n.startswith('op') for n in e.queries())"
    done = subprocess.run([sys.executable, "-c", code, str(root)], capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
