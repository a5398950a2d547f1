import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    work = tempfile.mkdtemp(prefix="tests-")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{work}/shared").config("spark.sql.warehouse.dir", f"{work}/warehouse").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def canonical(value):
    """A value in a form that both engines share."""
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return "{" + ",".join(str(canonical(v)) for v in value.values()) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(str(canonical(v)) for v in value) + "]"
    if type(value).__name__ == "Decimal":
        value = float(value)
    if isinstance(value, float):
        return None if value != value else round(value, 9)
    return value


def compare(spark, duck, query, sql):
    """The rows of a query and of its SQL, sorted, columns by name."""
    frame = query(spark, SF)
    columns = sorted(frame.columns)
    ours = sorted(repr([canonical(row[c]) for c in columns]) for row in frame.collect())
    relation = duck.sql(sql)
    names = [d[0] for d in relation.description]
    assert sorted(names) == columns
    theirs = sorted(repr([canonical(row[names.index(c)]) for c in columns]) for row in relation.fetchall())
    return ours, theirs
