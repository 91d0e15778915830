import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from adperf.operators import budget, campaigns
from adperf.operators.running import in_order, running_sum
from adperf.plans.fetch import owned_fetch_plan

T0 = dt.datetime(2024, 1, 1)


def test_running_sum_of_a_hot_key_with_ties_and_nulls(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"k{i % 40}", rng.choice([1, 2, 2, 5, None]),
             None if i % 50 == 0 else rng.randint(1, 9), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, t int, v long, n int").repartition(6)
    got = running_sum(df, "key", ["t", "n"], "v", "total").collect()
    want, seen = {}, {}
    for key, t, v, n in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[3])):
        seen[key] = seen.get(key, 0) + (v or 0)
        want[n] = seen[key]
    assert {r.n: r.total for r in got} == want and len(got) == len(rows)


def test_copies_of_one_row_are_spread_over_partitions(spark):
    df = spark.createDataFrame([("a", 1)] * 2000, "key string, t int").repartition(8)
    sizes = (in_order(df, ["key", "t"]).groupBy(F.shiftright("_at", 33)).count()
             .select("count").collect())
    assert len(sizes) > 1 and max(r[0] for r in sizes) < 1500


def test_spend_after_each_update_and_the_one_that_overspends(spark):
    updates = spark.createDataFrame(
        [(1, Decimal("4.00"), T0, 1), (1, Decimal("6.00"), T0, 2), (1, Decimal("1.00"), T0, 3),
         (1, None, T0, 4), (1, Decimal("-1.00"), T0, 5), (2, Decimal("1.00"), T0, 1),
         (3, Decimal("1.00"), T0, 1), (None, Decimal("1.00"), T0, 1), (4, Decimal("5.00"), T0, 1)],
        "campaign_id long, spend decimal(12,2), at timestamp_ntz, seq int")
    budgets = spark.createDataFrame(
        [(1, Decimal("12.00"), Decimal("2.00")), (2, Decimal("0.00"), None),
         (4, Decimal("5.01"), Decimal("0"))],
        "id long, budget decimal(12,2), spend decimal(12,2)")
    got = {(r.campaign_id, r.seq): (float(r.new_spend), float(r.remaining), r.status,
                                    r.became_overspent)
           for r in budget.running_spend(updates, budgets, ["at", "seq"]).collect()}
    assert got == {(1, 1): (6.0, 6.0, "Active", False), (1, 2): (12.0, 0.0, "Overspent", True),
                   (1, 3): (13.0, -1.0, "Overspent", False), (2, 1): (1.0, -1.0, "Overspent", False),
                   (4, 1): (5.0, 0.01, "Active", False)}
    assert budget.running_spend(updates.limit(0), budgets, ["at"]).collect() == []


def test_a_strangers_later_change_does_not_hide_the_owners(spark):
    target = spark.createDataFrame([(1, 10, "old", T0), (2, 20, "old", T0)],
                                   "id long, user_id long, name string, updated_at timestamp_ntz")
    changes = spark.createDataFrame(
        [(1, 10, "mine", T0), (1, 20, "theirs", T0 + dt.timedelta(1)), (3, 10, "none", T0),
         (2, None, "nobody", T0)],
        "id long, user_id long, name string, updated_at timestamp_ntz")
    table, refused = campaigns.apply_owned_updates(target, changes)
    assert {(r.id, r.user_id, r.name) for r in table.collect()} == {(1, 10, "mine"), (2, 20, "old")}
    assert {(r.id, r.access) for r in refused.collect()} == {(1, "forbidden"), (3, "not_found"),
                                                            (2, "forbidden")}


def test_fetch_requests_are_judged(spark):
    camps = spark.createDataFrame([(1, 10, "meta", T0), (2, 20, "google", T0 + dt.timedelta(9))],
                                  "id long, user_id long, platform string, start_date timestamp_ntz")
    asked = spark.createDataFrame([(10, 1), (10, 1), (20, 1), (20, 2), (10, 9)],
                                  "user_id long, campaign_id long")
    plan = owned_fetch_plan(asked, camps, dt.date(2024, 1, 2))
    got = sorted((r.user_id, r.campaign_id, r.access, str(r.day)) for r in plan.collect())
    assert got == [(10, 1, "ok", "2024-01-01"), (10, 1, "ok", "2024-01-02"),
                   (10, 9, "not_found", "None"), (20, 1, "forbidden", "None")]
