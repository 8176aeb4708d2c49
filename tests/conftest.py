import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(small):
    """Rows of a DuckDB query on the small tables, as dicts."""
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{small}/{f}')")

    def run(sql):
        r = con.execute(sql)
        names = [x[0] for x in r.description]
        return names, r.fetchall()

    return run


@pytest.fixture(scope="session")
def same_rows(duck):
    def check(df, sql):
        names, rows = duck(sql)
        assert sorted(df.columns) == sorted(names)
        order = sorted(names)
        key = lambda t: tuple((x is None, str(x)) for x in t)
        got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=key)
        want = sorted((tuple(r[names.index(c)] for c in order) for r in rows), key=key)
        assert got == want

    return check
