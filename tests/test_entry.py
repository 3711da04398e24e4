"""Driver contract: entry runs; every query has a name; oracle keys are queries."""

import __spark_entry__ as E


def test_entry_flagship(spark):
    rows = E.entry(spark).collect()
    assert [r["attack_type"] for r in sorted(rows, key=lambda r: r["type_order"])] == \
        ["DDoS", "PortScan", "BruteForce", "SQLInject", "Other"]
    assert sum(r["n"] for r in rows) == 558


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.oracle_sql()) >= 25


def test_small_queries_run(spark):
    qs = E.queries()
    for name in ["session_counters", "score_bands", "timeline", "attack_breakdown"]:
        assert qs[name](spark, "/root/testdata/sf0.001").count() >= 1
