"""Queries through the whole engine, held to their SQL on tables of few books with long lives."""

from __future__ import annotations

import duckdb
import pytest

from tickloom.plans import tapes  # noqa: F401
from tickloom.plans.registry import QUERIES, SQL


@pytest.mark.parametrize("name", ["book_after_reset_mbp", "book_with_skipped_eras"])
def test_lives_longer_than_the_default_journal(spark, tmp_path, name):
    """Each life of instrument 2 has 4,500 changes between two groups, more than ``Settings.journal`` by default."""
    n = 9_000 if name == "book_after_reset_mbp" else 13_500
    con = duckdb.connect()
    con.execute(f"create table events as select i as event_id, 2::bigint as user_id, case when i % 9 = 0 then 'error' else 'view' end as event_type, (i % 31)::double as value from range({n}) t(i)")
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    rows = QUERIES[name](spark, str(tmp_path)).select("rule_id", "status", "reason", "n").collect()
    want = con.execute(f"select rule_id, status, reason, n from ({SQL[name]})").fetchall()
    assert sorted(map(tuple, rows)) == sorted(want)
