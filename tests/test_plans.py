"""Plan assertions (survey §4): shuffles, limits before shuffles, no cross joins, pushdown."""

from packetlens.plans import queries as Q
from packetlens.plans.checks import physical_plan, summary

SF = "/root/testdata/sf0.001"


def run(df):
    df.write.format("noop").mode("overwrite").save()
    return physical_plan(df)


def test_retention_limits_before_shuffle(spark):
    Q.CHECK = False
    try:
        plan = run(Q.QUERIES["keep_last_200"](spark, SF))
    finally:
        Q.CHECK = True
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_no_cross_or_nested_loop_joins(spark):
    Q.CHECK = False
    try:
        for name in ["ensemble_batch", "timeline", "standardise", "attack_breakdown", "flow_features"]:
            plan = run(Q.QUERIES[name](spark, SF))
            assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan, name
    finally:
        Q.CHECK = True


def test_flow_features_single_exchange(spark):
    Q.CHECK = False
    try:
        s = summary(Q.QUERIES["flow_features"](spark, SF))
    finally:
        Q.CHECK = True
    assert s["hash_exchanges"] == 1 and s["sort_merge_joins"] == 0
