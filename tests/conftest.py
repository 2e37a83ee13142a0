import duckdb
import pytest
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    made = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same_rows(a, b) -> bool:
    """Whether two pandas frames hold the same rows and columns, in any order."""
    assert sorted(a.columns) == sorted(b.columns)
    show = lambda x: "" if x is None or x != x else f"{float(x) + 0.0:.5f}".replace("-0.00000", "0.00000") if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    rows = lambda f: sorted(tuple(show(x) for x in r) for r in f.astype(object).where(f.notna(), None)[sorted(f.columns)].itertuples(index=False))
    return rows(a) == rows(b)
