import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from linkatlas.session import session

    s = session("local[4]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.default.parallelism": "4"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def same_rows(spark_df, duck_rel):
    """Compare a DataFrame with an oracle's rows, columns by name, order aside."""
    cols = sorted(spark_df.columns)
    assert cols == sorted(duck_rel.columns)
    plain = lambda v: tuple(v) if isinstance(v, list) else v
    a = sorted((tuple(plain(r[c]) for c in cols) for r in spark_df.collect()), key=repr)
    at = [duck_rel.columns.index(c) for c in cols]
    b = sorted((tuple(plain(r[i]) for i in at) for r in duck_rel.fetchall()), key=repr)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or isinstance(p, float) and q is not None and abs(p - q) <= 1e-9 * max(1, abs(q)) for p, q in zip(x, y)), (x, y)
