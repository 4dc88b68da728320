"""Registered queries against DuckDB on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
#: Populations are shared, so these cost few runs of the engine.
NAMES = (
    "join_full_merge", "counters", "completion", "run_status", "fanout_zero_joined", "end_branch", "complete_branch", "fail_invocation", "join_by_edge", "wait_pending", "snapshot_order", "fork", "join_nested", "budget_steps", "ready_set",
    "store_durable_roundtrip", "load_header", "cas_conflict", "resume_stale", "pending_list", "resume_valid", "resume_decode_gate", "resume_apply", "resume_prefix", "resume_skip", "advance", "delta_diff", "delta_apply", "change_invalid",
    "validate_ok", "validate_bad", "stuck_runs", "codec_json_roundtrip", "corrupt_detect", "effect_receipts", "assignment_validation", "edge_list", "subgraph_flatten", "subgraph_scope", "join_can_merge", "illegal_transition", "counter_limit", "effect_graph", "events_log",
)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    import duckdb

    from braidwork.queries import QUERIES, SQL

    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in frame.collect())
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = db.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(str(row[names.index(c)]) for c in columns) for row in result.fetchall())


def test_entry_registers_everything():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 80
