import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

from logtide.plans import catalog, sql, stored

QUERIES, SQL = catalog.QUERIES | sql.QUERIES | stored.QUERIES, catalog.ORACLE_SQL | sql.ORACLE_SQL | stored.ORACLE_SQL

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    db = duckdb.connect()
    for t in ("events", "orders", "customer", "lineitem", "nation", "region", "supplier", "part"):
        db.execute(f"CREATE VIEW {t} AS FROM '{D}/{t}.parquet'")
    want = db.execute(SQL[name]).df()
    df = QUERIES[name](spark, D)
    assert sorted(df.columns) == sorted(want.columns)
    text = lambda x: "" if pd.isna(x) else str(float(x)) if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x)
    rows = lambda it: sorted(tuple(map(text, r)) for r in it)
    got = df.toPandas()[list(want.columns)]
    assert rows(got.itertuples(index=False)) == rows(want.itertuples(index=False))
