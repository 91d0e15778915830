import datetime as dt

import pytest

from adperf.operators import insights, rollup
from helpers import event, events_df


def _facts(spark, rows):
    return events_df(spark, rows)


def test_golden_day(spark):
    row = event(campaign_id=1, impressions=640, clicks=32, conversions=8, spend="12.80",
                revenue="51.20", event_time=dt.datetime(2024, 1, 17), event_type="daily_stats",
                region="all")
    r = rollup.daily_insights(_facts(spark, [row])).first()
    assert (r.impressions, r.clicks, r.conversions, r.spend, r.revenue) == \
        (640, 32, 8, 12.8, 51.2)
    assert r.ctr == pytest.approx(0.05) and r.cpc == pytest.approx(0.4)
    assert r.cpa == pytest.approx(1.6) and r.roas == pytest.approx(4.0)
    assert r.conversion_rate == pytest.approx(0.25)


def test_redelivered_facts_count_once(spark):
    rows = [event(id=1, key="a"), event(id=1, key="a"), event(id=2, key="b")]
    facts = _facts(spark, rows)
    for insights_table in (rollup.insights_of(facts), rollup.apply_increment(None, facts, facts)):
        assert [r.impressions for r in insights_table.collect()] == [20]


def test_reaggregate_drops_keys_that_the_facts_left(spark):
    t = dt.datetime(2024, 1, 2, 5)
    stale = rollup.daily_insights(_facts(spark, [event(id=1, region="EU", event_time=t),
                                                 event(id=2, campaign_id=11, event_time=t)]))
    facts = _facts(spark, [event(id=1, region="US", event_time=t)])
    day = dt.date(2024, 1, 2)
    got = rollup.reaggregate(stale, facts, day, day, facts.select("campaign_id")).collect()
    assert sorted((r.campaign_id, r.region) for r in got) == [(10, "US"), (11, "EU")]
    assert [r.region for r in rollup.reaggregate(stale, facts, day, day).collect()] == ["US"]


def test_zero_denominators(spark):
    rows = [event(impressions=0, clicks=0, conversions=0, spend="0.00", revenue="5.00")]
    r = rollup.daily_insights(_facts(spark, rows)).first()
    assert (r.ctr, r.cpc, r.cpa, r.roas, r.conversion_rate) == (0.0, 0.0, 0.0, 0.0, 0.0)


def test_week_and_month_across_year_end(spark):
    rows = [event(id=1, event_time=dt.datetime(2024, 12, 30, 8)),
            event(id=2, event_time=dt.datetime(2025, 1, 1, 8))]
    daily = rollup.daily_insights(_facts(spark, rows))
    weekly = rollup.regroup_insights(daily, "weekly").collect()
    monthly = rollup.regroup_insights(daily, "monthly").collect()
    assert [r.date for r in weekly] == [dt.date(2024, 12, 30)]
    assert sorted(r.date for r in monthly) == [dt.date(2024, 12, 1), dt.date(2025, 1, 1)]
    assert weekly[0].impressions == 20


def test_unknown_granularity_rejected(spark):
    with pytest.raises(ValueError):
        rollup.regroup_insights(rollup.daily_insights(_facts(spark, [event()])), "hourly")


def test_monthly_sums_equal_daily_sums(spark):
    rows = [event(id=i, campaign_id=i % 3, spend=f"{i}.25", clicks=i,
                  event_time=dt.datetime(2024, 1 + i % 2, 1 + i % 27, i % 24)) for i in range(60)]
    daily = rollup.daily_insights(_facts(spark, rows))
    monthly = rollup.regroup_insights(daily, "monthly")
    s_d = daily.agg({"spend": "sum", "clicks": "sum"}).first()
    s_m = monthly.agg({"spend": "sum", "clicks": "sum"}).first()
    assert s_d[0] == pytest.approx(s_m[0]) and s_d[1] == s_m[1]


def test_reaggregate_whole_last_day(spark):
    first, last = dt.date(2024, 1, 1), dt.date(2024, 1, 3)
    rows = [event(id=1, event_time=dt.datetime(2024, 1, 1, 0, 0, 0)),
            event(id=2, event_time=dt.datetime(2024, 1, 1, 23, 59, 59)),
            event(id=3, event_time=dt.datetime(2024, 1, 3, 0, 0, 0)),
            event(id=4, event_time=dt.datetime(2024, 1, 3, 23, 59, 59)),
            event(id=5, event_time=dt.datetime(2024, 1, 4, 0, 0, 0))]
    facts = _facts(spark, rows)
    stale = rollup.daily_insights(facts.filter("id = 1"))
    out = {r.date: r.impressions for r in
           rollup.reaggregate(stale, facts, first, last).collect()}
    assert out == {dt.date(2024, 1, 1): 20, dt.date(2024, 1, 3): 20}


def test_reaggregate_unchanged_is_noop(spark):
    rows = [event(id=i, event_time=dt.datetime(2024, 1, 1 + i % 5, i)) for i in range(20)]
    facts = _facts(spark, rows)
    full = rollup.daily_insights(facts)
    again = rollup.reaggregate(full, facts, dt.date(2024, 1, 2), dt.date(2024, 1, 4))
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, again.collect()))


def test_reaggregate_uses_last_version_of_a_fact(spark):
    t = dt.datetime(2024, 1, 2, 5)
    rows = [event(id=1, key="k", event_time=t, clicks=1, processed_at=t),
            event(id=2, key="k", event_time=t, clicks=7, processed_at=t + dt.timedelta(1))]
    out = rollup.reaggregate(rollup.daily_insights(_facts(spark, rows[:1])), _facts(spark, rows),
                             dt.date(2024, 1, 2), dt.date(2024, 1, 2)).collect()
    assert [r.clicks for r in out] == [7]


def test_increment_recomputes_late_days(spark):
    rows = [event(id=i, key=f"k{i}", event_time=dt.datetime(2024, 1, 1 + i % 4, 3))
            for i in range(12)]
    facts = _facts(spark, rows)
    b1, b2 = facts.filter("id < 6"), facts.filter("id >= 6")
    cur = rollup.apply_increment(None, b1, b1)
    cur = rollup.apply_increment(cur, b2, facts)
    cur = rollup.apply_increment(cur, b2, facts)  # replay changes nothing
    assert sorted(map(tuple, cur.collect())) == \
        sorted(map(tuple, rollup.daily_insights(facts).collect()))


def test_insight_filters_and_default_range(spark):
    rows = [event(id=1, platform="google", region="EU", event_time=dt.datetime(2024, 1, 5)),
            event(id=2, platform="meta", region="EU", event_time=dt.datetime(2024, 1, 6)),
            event(id=3, platform="google", region="US", event_time=dt.datetime(2023, 12, 1))]
    daily = rollup.daily_insights(_facts(spark, rows))
    got = insights.query_insights(daily, platform="google", region="").collect()
    assert [r.date for r in got] == [dt.date(2023, 12, 1), dt.date(2024, 1, 5)]
    got = insights.query_insights(daily, as_of=dt.date(2024, 1, 5)).collect()
    assert [r.date for r in got] == [dt.date(2024, 1, 5)]
    got = insights.query_insights(daily, start="2024-01-06", end="2024-01-06").collect()
    assert [r.platform for r in got] == ["meta"]
    with pytest.raises(ValueError):
        insights.query_insights(daily, start="2024/01/06")


def test_owner_access_check(spark):
    camps = spark.createDataFrame([(1, 100), (2, 200)], "id long, user_id long")
    req = spark.createDataFrame([(100, 1), (100, 2), (100, 3)], "user_id long, campaign_id long")
    got = {r.campaign_id: r.access for r in insights.authorized_requests(req, camps).collect()}
    assert got == {1: "ok", 2: "forbidden", 3: "not_found"}


def test_owner_insights_end_to_end(spark):
    rows = [event(id=1, campaign_id=1, event_time=dt.datetime(2024, 1, 1, 5)),
            event(id=2, campaign_id=1, event_time=dt.datetime(2024, 1, 3, 5)),
            event(id=3, campaign_id=2, event_time=dt.datetime(2024, 1, 2, 5))]
    daily = rollup.daily_insights(_facts(spark, rows))
    camps = spark.createDataFrame([(1, 100), (2, 200)], "id long, user_id long")
    req = spark.createDataFrame([(100, 1), (100, 2), (100, 9)], "user_id long, campaign_id long")
    got = insights.owner_insights(daily, camps, req, granularity="weekly").collect()
    assert [(r.user_id, r.campaign_id, r.date, r.impressions) for r in got] == \
        [(100, 1, dt.date(2024, 1, 1), 20)]
