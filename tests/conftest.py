"""One local session for all tests."""

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings sections structured_json node_attributes eval_items documents_index heldout_items mix_targets split_limits".split()
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01"))
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from dossierflow.session import build_session

    s = build_session("local[8]", "tests", 8, spark__driver__memory="4g", spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def normal(v):
    import math

    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v.isoformat() if hasattr(v, "isoformat") else v


def same_rows(df, con, sql):
    """Whether a query and its SQL twin give the same rows, order aside."""
    columns = sorted(df.columns)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((repr(tuple(normal(r[i]) for i in at)) for r in cur.fetchall()))
    got = sorted(repr(tuple(normal(x) for x in r)) for r in df.select(*columns).collect())
    return got == want
