import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def against_sql(spark):
    """Compare a query with its SQL on DuckDB over the same Parquet tables."""
    import duckdb

    def rows(found, names):
        return sorted(repr(tuple(float(x) if isinstance(x, float) else x for x in r)) for r in found)

    def check(query, sql, sf_dir="/root/testdata/sf0.001"):
        df = query(spark, sf_dir)
        names = sorted(df.columns)
        con = duckdb.connect()
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        want = con.sql(f"SELECT {', '.join(f'\"{n}\"' for n in names)} FROM ({sql}) q").fetchall()
        got = [tuple(r) for r in df.select(names).collect()]
        assert rows(got, names) == rows(want, names)

    return check
