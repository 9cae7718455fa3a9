"""Each registered query against its SQL twin in DuckDB."""

import duckdb
import pandas as pd
import pytest

from lexloom.plans import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(df: pd.DataFrame) -> list[str]:
    def cell(v):
        if hasattr(v, "tolist"):
            return str(v.tolist())
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        return repr(round(v, 9)) if isinstance(v, float) else str(v)

    return sorted("|".join(map(cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLES:
        assert canon(got) == canon(duck.sql(ORACLES[name]).df())
    else:
        assert len(got)


def test_fine_match_on_both_sides_of_its_borders(spark, tmp_path):
    """All customers' keys up to 1100 for even and odd orders, negative and missing keys; sf0.001 has none at a border."""
    rows = [(i, k) for k in range(-2, 1101) for i in (2 * k, 2 * k + 1)] + [(None, 460), (None, 575), (7, None), (-4, 575), (-4, 576), (-3, 460), (-3, 461)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    own = duckdb.connect()
    own.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = sorted(own.execute(ORACLES["fine_match"]).fetchall(), key=str)
    assert (921, True) in want and (923, False) in want  # 460 and 461 against 400 x 1.15
    assert sorted(map(tuple, QUERIES["fine_match"](spark, str(tmp_path)).select("id", "hit").collect()), key=str) == want
