"""Queries against their SQL on events with equal times and equal contributions."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from rivulet.plans.catalogue import QUERIES, SQL


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """Events of a few users with equal times, and of all remainders of the user's number."""
    folder = tmp_path_factory.mktemp("tied")
    n = 3000
    at = pd.Timestamp("2024-01-01") + pd.to_timedelta((np.arange(n) // 60) * 977, unit="s")
    made = {"event_id": np.arange(n)[::-1].copy(), "ts": at.astype("datetime64[us]"), "user_id": np.arange(n) % 21, "event_type": np.where(np.arange(n) % 5 == 0, "error", "view"), "value": (np.arange(n) * 7 % 400) * 1.0, "props": [f'{{"k": {i % 100}}}' for i in range(n)]}
    pd.DataFrame(made).to_parquet(folder / "events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["additive_attr", "phi_accrual", "exceedance_rate"])
def test_ties_as_in_sql(spark, tied, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tied}/events.parquet'")
    theirs = sorted(con.execute(SQL[name]).df()[QUERIES[name](spark, tied).columns].itertuples(index=False, name=None))
    ours = sorted(tuple(r) for r in QUERIES[name](spark, tied).collect())
    assert len(ours) == len(theirs) == 3000
    same = lambda a, b: all(abs(x - y) < 1e-9 if isinstance(x, float) else x == y for x, y in zip(a, b, strict=True))
    assert [(a, b) for a, b in zip(ours, theirs, strict=True) if not same(a, b)] == []
