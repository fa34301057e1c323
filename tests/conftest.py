import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@pytest.fixture(scope="session")
def spark():
    from hubcast.session import get_session
    yield get_session("local[4]", app="hubcast-tests", shuffle_partitions=4,
                      spark_checkpoint_dir=tempfile.mkdtemp(prefix="hubcast-test-ckpt-"))


@pytest.fixture(scope="session")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def canon(rows):
    """Order-insensitive comparison form of a result."""
    import math
    out = []
    for r in rows:
        vals = []
        for v in r:
            if isinstance(v, float):
                vals.append(None if math.isnan(v) else round(v, 9))
            elif hasattr(v, "isoformat"):
                vals.append(str(v).replace("T", " "))
            else:
                vals.append(v)
        out.append(tuple("" if v is None else str(v) for v in vals))
    return sorted(out)
