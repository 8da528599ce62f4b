import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from fluxmill.session import build

    s = build("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")), "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(SF).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.fixture(scope="session")
def make_flows(spark):
    """Flow records from dicts; fields that a dict does not name are null."""
    from fluxmill.functions.addresses import v4_number
    from fluxmill.sources.formats import FLOW_SCHEMA
    from pyspark.sql import functions as F

    def make(rows):
        full = []
        for i, r in enumerate(rows):
            r = {"autoid": i, "seq": i, "sid": "p", "trans": 1, "status": 0, **r}
            full.append(tuple(r.get(f.name) for f in FLOW_SCHEMA))
        df = spark.createDataFrame(full, FLOW_SCHEMA)
        return df.withColumns({"saddr_i": v4_number("saddr"), "daddr_i": v4_number("daddr"), "stime": F.timestamp_micros("stime_us"), "ltime": F.timestamp_micros("ltime_us")})

    return make
