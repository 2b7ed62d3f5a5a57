import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quillon.session import local_session

    conf = {
        "spark.driver.memory": "4g", "spark.checkpoint.dir": "file://" + str(tmp_path_factory.mktemp("shared")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    session = local_session(8, 8, **conf)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            con.execute(f"create view {name[:-8]} as select * from '{sf_dir}/{name}'")
    return con


@pytest.fixture
def same(duck, tmp_path):
    """Compares a DataFrame with the rows of a SQL query, as multisets, by column name and type."""

    def compare(df, sql):
        df.write.parquet(path := str(tmp_path / "got"))
        duck.execute(f"create or replace temp view got as select * from '{path}/*.parquet'")
        duck.execute(f"create or replace temp table want as {sql}")
        got, want = (sorted(r[:2] for r in duck.execute(f"describe {t}").fetchall()) for t in ("got", "want"))
        assert got == want
        cols = ", ".join(f'"{c}"' for c, _ in want)
        for a, b in (("got", "want"), ("want", "got")):
            assert not duck.execute(f"select {cols} from {a} except all select {cols} from {b} limit 3").fetchall(), f"rows of {a} only"

    return compare
