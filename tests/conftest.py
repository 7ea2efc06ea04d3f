import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    scratch = tempfile.mkdtemp(prefix="spark-")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.local.dir", scratch).config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .config("spark.checkpoint.dir", f"file://{scratch}/shared").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(v):
    """A value in a form that both engines share."""
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, list):
        return [plain(x) for x in v]
    if hasattr(v, "replace") and hasattr(v, "tzinfo"):
        return str(v.replace(tzinfo=None))
    return v


def rows_of(found, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in found), key=repr)


@pytest.fixture(scope="session")
def same(spark, duck):
    """Asserts that a query gives the rows of its SQL."""

    def check(query, sql):
        df = query(spark, DATA)
        columns = sorted(df.columns)
        cursor = duck.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        expected = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
        assert rows_of([r.asDict() for r in df.collect()], columns) == rows_of(expected, columns)

    return check
