import hashlib
import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as E
from postscope.catalog import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["date", "like", "comment", "error"]
    assert df.count() > 0


PLAIN_SESSION = """
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
import __spark_entry__ as E
print("entry", E.entry(spark).count())
for key in ("action_history", "not_yet_commented", "seeded_order", "title_match", "append_roundtrip"):
    print(key, E.queries()[key](spark, SF).count())
"""


def test_session_that_the_library_did_not_build():
    """Only the caller's own options are set, as on a cluster or in a notebook."""
    code = PLAIN_SESSION.replace("SF)", f"{SF!r})")
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1],
                         capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-3000:]
    counts = dict(line.split() for line in out.stdout.splitlines() if len(line.split()) == 2)
    assert len(counts) == 6 and all(int(n) > 0 for n in counts.values())


def test_every_query_has_oracle():
    assert set(QUERIES) <= set(E.queries()) and set(QUERIES) <= set(E.oracle_sql())


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return f"{round(v, 6):.6f}"
    return str(v)


def _digest(cols, rs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.sha256("\n".join(sorted("|".join(_norm(r[i]) for i in order) for r in rs)).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle_sf0001(spark, duck, key):
    df = E.queries()[key](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _digest(df.columns, srows) == _digest(dcols, drows)
