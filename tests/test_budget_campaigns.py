import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from adperf.operators import budget, campaigns

T0 = dt.datetime(2024, 1, 1)


def test_budget_status_edges(spark):
    budgets = spark.createDataFrame(
        [("a", Decimal("100.00")), ("b", Decimal("50.00")), ("c", Decimal("10.00")),
         ("d", Decimal("20.00"))], "id string, budget decimal(12,2)")
    inc = spark.createDataFrame(
        [("a", 30.0), ("a", 20.0), ("b", 50.0), ("c", 15.0), ("x", 5.0), ("a", 0.0),
         ("a", -4.0), (None, 3.0), ("a", None)], "campaign_id string, spend double")
    valid, rejects = budget.split_increments(inc)
    assert rejects.count() == 4
    assert {r.reason for r in rejects.collect()} == {
        "spend is required", "spend amount cannot be negative", "campaign ID is required"}
    status = {r.campaign_id: r for r in
              budget.budget_status(budgets, budget.spend_totals(valid)).collect()}
    assert (status["a"].remaining, status["a"].status) == (50.0, "Active")
    assert (status["b"].remaining, status["b"].status) == (0.0, "Overspent")
    assert (status["c"].remaining, status["c"].status) == (-5.0, "Overspent")
    assert (status["d"].spend, status["d"].status) == (0.0, "Active")
    assert "x" not in status
    orphans = campaigns.orphans(valid, budgets)
    assert [r.campaign_id for r in orphans.collect()] == ["x"]
    one_pass = [(r.campaign_id, r.reason) for r in budget.increment_rejects(inc, budgets).collect()]
    assert ("x", "campaign not found") in one_pass and len(one_pass) == 5


def test_stored_spend_is_added(spark):
    budgets = spark.createDataFrame([("a", Decimal("10.00"), 4.0)],
                                    "id string, budget decimal(12,2), spend double")
    inc = spark.createDataFrame([("a", 6.0)], "campaign_id string, spend double")
    r = budget.budget_status(budgets, budget.spend_totals(inc)).first()
    assert (r.spend, r.remaining, r.status) == (10.0, 0.0, "Overspent")


def _camps(spark):
    return spark.createDataFrame(
        [(1, 7, "google", Decimal("10.00"), "active", T0, T0),
         (2, 7, "meta", Decimal("20.00"), "paused", T0 + dt.timedelta(1), T0),
         (3, 8, "google", Decimal("30.00"), "active", T0 + dt.timedelta(2), T0)],
        "id long, user_id long, platform string, budget decimal(12,2), status string, "
        "created_at timestamp_ntz, updated_at timestamp_ntz")


def test_list_and_lookup(spark):
    cs = _camps(spark)
    assert [r.id for r in campaigns.list_campaigns(cs, user_id=7).collect()] == [2, 1]
    assert [r.id for r in campaigns.list_campaigns(cs, user_id=7, platform="google")
            .collect()] == [1]
    assert [r.id for r in campaigns.list_campaigns(cs, status="active").collect()] == [1, 3]
    req = spark.createDataFrame([(1,), (9,), (1,)], "id long")
    got = {r.id: r.found for r in campaigns.lookup_campaigns(cs, req).collect()}
    assert got == {1: True, 9: False}


def test_updates_latest_change_wins_and_orphans(spark):
    cs = _camps(spark)
    changes = spark.createDataFrame(
        [(1, "paused", Decimal("11.00"), T0 + dt.timedelta(5)),
         (1, "done", Decimal("12.00"), T0 + dt.timedelta(6)),
         (9, "active", Decimal("1.00"), T0 + dt.timedelta(5))],
        "id long, status string, budget decimal(12,2), updated_at timestamp_ntz")
    new, orphans = campaigns.apply_updates(cs, changes)
    rows = {r.id: r for r in new.collect()}
    assert (rows[1].status, rows[1].budget, rows[1].user_id) == ("done", Decimal("12.00"), 7)
    assert rows[1].created_at == T0
    assert rows[1].platform is None  # field missing from the change -> zero value
    assert rows[2].status == "paused"
    assert [r.id for r in orphans.collect()] == [9]


def test_insert_if_absent(spark):
    cs = _camps(spark)
    incoming = spark.createDataFrame(
        [(3, 9, "meta", Decimal("1.00"), "active", T0, T0),
         (4, 9, "meta", Decimal("2.00"), "active", T0, T0),
         (4, 9, "tiktok", Decimal("3.00"), "active", T0 + dt.timedelta(1), T0)],
        cs.schema)
    table, inserted, conflicts = campaigns.insert_if_absent(cs, incoming)
    assert [r.platform for r in inserted.collect()] == ["meta"]
    assert sorted(r.reason for r in conflicts.collect()) == ["already exists",
                                                             "duplicate in batch"]
    assert table.count() == 4
    assert table.filter(F.col("id") == 3).first().user_id == 8
