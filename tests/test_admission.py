"""The contract query checks the rules of admission; a door on unsafe ground is the router's business."""

from __future__ import annotations

from concourse.plans.registry import load_all

NATIONS = "/root/testdata/sf0.001"


def test_contract_leaves_endpoints_to_the_router(spark, tmp_path):
    for name in ("nation", "region"):
        spark.read.parquet(f"{NATIONS}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    # Place 1 has supplier 1 as its door, which stands left of every area.
    spark.createDataFrame([(1, "one", 0, 700.0, "HOUSEHOLD")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(
        f"{tmp_path}/customer.parquet"
    )
    spark.createDataFrame([(1, "door", 0, -500.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    queries = load_all()
    assert [r.path for r in queries["dq_r40"].build(spark, str(tmp_path)).collect()] == ["S1"]
    rules = {r.rule_id for r in queries["dq_contract"].build(spark, str(tmp_path)).collect()}
    assert "R24" in rules and "R40" not in rules
