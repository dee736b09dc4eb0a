import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compares a query with its SQL twin."""

    def check(query, sql):
        df = query(spark, SF)
        names = sorted(df.columns)
        mine = [tuple(r) for r in df.select(*names).collect()]
        twin = duck.sql(sql)
        assert sorted(twin.columns) == names
        other = [tuple(r) for r in twin.select(*[f'"{n}"' for n in names]).fetchall()]

        def key(row):
            return tuple((x is None, str(x)) for x in row)

        assert sorted(mine, key=key) == sorted(other, key=key)

    return check
