"""Property tests: generated inputs against a sequential reference."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from adperf.operators import dedup, rollup
from helpers import event, events_df

T0 = dt.datetime(2024, 1, 1)
SETTINGS = settings(max_examples=6, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture,
                                           HealthCheck.too_slow])

rows_strategy = st.lists(
    st.tuples(st.sampled_from(["a", "b", "c"]),            # few keys: long chains, hot keys
              st.integers(min_value=0, max_value=60 * 24 * 40)),  # minutes within 40 days
    min_size=1, max_size=120)


def _fold(rows, ttl=dt.timedelta(days=7)):
    out, last = set(), {}
    for i, (k, t) in sorted(enumerate(rows), key=lambda x: (x[1][0], x[1][1], x[0])):
        if k not in last or T0 + dt.timedelta(minutes=t) >= last[k] + ttl:
            out.add(i)
            last[k] = T0 + dt.timedelta(minutes=t)
    return out


@SETTINGS
@given(rows=rows_strategy, light=st.sampled_from([0, 5, 10_000]))
def test_ttl_dedup_equals_sequential_fold(spark, rows, light):
    df = events_df(spark, [event(id=i, key=k, received_at=T0 + dt.timedelta(minutes=t),
                                 event_time=T0 + dt.timedelta(minutes=t))
                           for i, (k, t) in enumerate(rows)])
    got = {r.id for r in dedup.first_wins_ttl(df, light_limit=light, bucket_hours=12).collect()}
    assert got == _fold(rows)


@SETTINGS
@given(rows=st.lists(st.tuples(st.integers(0, 3), st.integers(0, 400), st.integers(0, 50),
                               st.integers(-500, 5000)), min_size=1, max_size=60))
def test_period_sums_equal_daily_sums(spark, rows):
    df = events_df(spark, [event(id=i, campaign_id=c, clicks=k, spend=f"{s / 100:.2f}",
                                 event_time=T0 + dt.timedelta(days=d % 120, hours=d % 24))
                           for i, (c, d, k, s) in enumerate(rows)])
    daily = rollup.daily_insights(df)
    for g in ("weekly", "monthly"):
        per = rollup.regroup_insights(daily, g)
        a = daily.groupBy("campaign_id").agg({"clicks": "sum", "spend": "sum"}).collect()
        b = per.groupBy("campaign_id").agg({"clicks": "sum", "spend": "sum"}).collect()
        norm = lambda rs: sorted((r[0], r["sum(clicks)"], round(r["sum(spend)"], 2)) for r in rs)
        assert norm(a) == norm(b)
