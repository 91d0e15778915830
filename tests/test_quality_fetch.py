import datetime as dt

from adperf.operators import quality
from adperf.plans import fetch


def test_audits(spark):
    child = spark.createDataFrame([(1, 10), (2, 11), (3, None), (3, 10)], "id long, p long")
    parent = spark.createDataFrame([(10,)], "pk long")
    assert [r.n for r in quality.duplicate_keys(child, ["id"]).collect()] == [2]
    assert [r.id for r in quality.missing_references(child, "p", parent, "pk").collect()] == [2]
    summ = quality.reference_summary({"c.p->parent": (child, "p", parent, "pk")}).first()
    assert (summ.checked_rows, summ.violations) == (4, 1)
    nulls = {r.column_name: r.null_count for r in quality.null_counts(child).collect()}
    assert nulls == {"id": 0, "p": 1}
    camp = spark.createDataFrame(
        [("meta", "x" * 51, 1e11, dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 1)),
         ("bing", "ok", 5.0, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2))],
        "platform string, status string, budget double, start_date timestamp_ntz, "
        "end_date timestamp_ntz")
    got = {r.check_name: r.violations for r in
           quality.domain_checks(quality.campaign_domain_checks(), camp).collect()}
    assert got == {"budget_decimal_12_2": 1, "platform_enum": 1, "platform_length": 0,
                   "status_length": 1, "end_before_start": 1}


def test_fetch_plan_window(spark):
    camps = spark.createDataFrame(
        [(1, "google", dt.datetime(2023, 1, 1)), (2, "meta", dt.datetime(2024, 1, 25, 15)),
         (3, "tiktok", dt.datetime(2024, 3, 1))], "id long, platform string, "
                                                    "start_date timestamp_ntz")
    plan = fetch.fetch_plan(camps, dt.date(2024, 1, 31))
    days = {}
    for r in plan.collect():
        days.setdefault(r.campaign_id, []).append(r.day)
    assert len(days[1]) == 31 and min(days[1]) == dt.date(2024, 1, 1)
    assert days[2] == [dt.date(2024, 1, d) for d in range(25, 32)]
    assert 3 not in days
    stored = spark.createDataFrame([(2, dt.date(2024, 1, 26))], "campaign_id long, date date")
    missing = fetch.missing_days(plan.filter("campaign_id = 2"), stored)
    assert missing.count() == 6
