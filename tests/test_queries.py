"""Every query with SQL gives the rows of its SQL on the smallest tables; the others run."""

import sys
from pathlib import Path

import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
from compare import canon  # noqa: E402
from fluxmill.plans.catalog import core  # noqa: E402


@pytest.mark.parametrize("name", sorted(core.queries))
def test_query(spark, sf, duck, name):
    df = core.queries[name](spark, sf)
    got = pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns, dtype=object)
    if name in core.sql:
        cur = duck.execute(core.sql[name])
        want = pd.DataFrame(cur.fetchall(), columns=[d[0] for d in cur.description], dtype=object)
        assert sorted(got.columns) == sorted(want.columns)
        assert canon(got) == canon(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
