"""Model queries that read whole tables."""

import os

import pytest

from vitalframe.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are absent")


@pytest.mark.parametrize("name", ["group_kfold", "principal_components", "personalised_loso"])
def test_no_participant_is_left_out(spark, name):
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet").selectExpr("l_orderkey AS o_orderkey").distinct()
    if name == "principal_components":
        want = orders.join(lines, "o_orderkey").select("o_orderkey")
    elif name == "group_kfold":
        want = orders.select("o_custkey")
    else:
        both = orders.join(lines, "o_orderkey")
        want = both.where("o_orderstatus = 'F'").select("o_custkey").intersect(both.where("o_orderstatus = 'O'").select("o_custkey"))
    got = catalog.queries()[name](spark, FOLDER)
    assert {r[0] for r in got.select(want.columns[0]).collect()} == {r[0] for r in want.collect()}
