"""Profile of advertisers that left, on small tables."""

from spendlens.plans import churn_profile

SCHEMA = ("idadvertiser int, adv_change_type string, campaign_budget double, spend double, "
          "advertiser_state string, business_category string")


def profile(spark, rows):
    return {(r["section"], r["item"]): r["keys"] for r in churn_profile(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_sections(spark):
    got = profile(spark, [
        (1, "Churn", 1.0, 1.0, "A", None), (1, "Idle up", 1.0, None, "B", None), (1, "Idle down", 0.0, 1.0, "A", "x"),
        (2, "churn", 1.0, 1.0, "A", "x"), (3, "Idle up", 1.0, 1.0, "A", "x"), (None, "Churn", 1.0, 1.0, "A", "x"),
    ])
    assert got["ever", "Churn"] == 1 and got["ever", "Idle up"] == 1 and got["ever", "Idle down"] == 0
    assert got["both", "Idle down + Idle up"] == 0 and got["either", "Idle down + Idle up"] == 1
    assert got["advertiser_state", "A"] == 2 and got["advertiser_state", "B"] == 1
    assert got["business_category", "Other"] == 1 and got["business_category", "x"] == 1
    assert got["ambiguous", "advertiser_state"] == 1 and got["ambiguous", "business_category"] == 0


def test_no_rows(spark):
    got = profile(spark, [])
    assert got["ever", "New"] == 0 and got["ambiguous", "advertiser_state"] == 0
