import datetime as dt
import glob
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from adperf import schemas as S
from adperf.plans import cluster
from adperf.sources import storage

DAY = dt.date(2024, 1, 1)


def insights(spark, campaigns=64, days=64, hot=0, clicks=1):
    rows = spark.range(campaigns * days + hot).select(
        F.when(F.col("id") < campaigns * days, F.concat(F.lit("c"), F.col("id") % campaigns))
        .otherwise("hot").alias("campaign_id"),
        F.date_add(F.lit(DAY), (F.floor(F.col("id") / campaigns) % days).cast("int")).alias("date"),
        F.lit("meta").alias("platform"), F.col("id").cast("string").alias("region"))
    return rows.select(*[F.col(f.name) if f.name in rows.columns
                         else F.lit(None if "Timestamp" in str(f.dataType) else clicks)
                         .cast(f.dataType).alias(f.name)
                         for f in S.INSIGHT_SCHEMA.fields])


def seen(df):
    return sorted(tuple(r) for r in df.select(*S.INSIGHT_KEY, "clicks").collect())


def test_place_interleaves_equal_cells(spark):
    df = spark.range(256).select((F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).alias("y"))
    out = cluster.space_filling(df, F.col("x"), F.col("y"), bits=2).collect()
    for r in out:
        # cells of 16 values in 4 parts; a quantile itself opens the next cell
        x, y = min(3, (r.x + 1) // 4), min(3, (r.y + 1) // 4)
        spread = lambda v: (v & 1) | (v & 2) << 1
        assert r.place == spread(x) * 2 + spread(y)


def test_one_campaign_opens_few_files(spark, tmp_root):
    storage.write_insights(insights(spark), tmp_root)
    opened = []
    for rows_per_file in (256, 64):  # 16 and 64 files
        made = cluster.cluster_insights(spark, tmp_root, rows_per_file)
        found, total = cluster.files_for(spark, tmp_root, ["c5"])
        assert total == made["files"] and made["rows"] == 64 * 64
        opened.append((len(found), total))
    assert opened[0][1] >= 12 and opened[1][1] >= 48
    # a column of the square: about the root of the number of files
    assert all(n <= 3 * total ** 0.5 for n, total in opened)
    both, total = cluster.files_for(spark, tmp_root, ["c5"], DAY, DAY + dt.timedelta(6))
    assert 1 <= len(both) <= opened[1][0] / 2
    assert len(glob.glob(os.path.join(tmp_root, cluster.CLUSTERED, "version=*"))) == 1
    schema = pq.ParquetFile(both[0].removeprefix("file:")).metadata.schema.names
    assert "place" not in schema and "campaign_id" in schema


def test_same_rows_as_the_day_table(spark, tmp_root):
    storage.write_insights(insights(spark, 20, 12, hot=500), tmp_root)
    cluster.cluster_insights(spark, tmp_root, 60)
    start, end = DAY + dt.timedelta(2), DAY + dt.timedelta(8)
    for asked in (["c3", "hot", "unknown"], ["hot"], ["unknown"], None):
        plain = storage.read_insights(spark, tmp_root, start, end)
        plain = plain if asked is None else plain.filter(F.col("campaign_id").isin(asked))
        assert seen(cluster.read_clustered(spark, tmp_root, asked, start, end)) == seen(plain)
    _, total = cluster.files_for(spark, tmp_root)
    assert len(cluster.files_for(spark, tmp_root, ["hot"])[0]) > 1 and total > 6


def test_days_written_or_deleted_since(spark, tmp_root):
    storage.write_insights(insights(spark, 10, 6), tmp_root)
    cluster.cluster_insights(spark, tmp_root, 20)
    newer = insights(spark, 10, 8, clicks=9).filter(F.col("date") >= DAY + dt.timedelta(4))
    storage.write_insights(newer, tmp_root)  # two days again, two new ones
    storage.empty_insights(spark, tmp_root, [DAY])
    plain = storage.read_insights(spark, tmp_root)
    assert plain.filter("clicks = 9").count() == 40 and plain.count() == 70
    assert seen(cluster.read_clustered(spark, tmp_root)) == seen(plain)
    one = cluster.read_clustered(spark, tmp_root, ["c1"])
    assert seen(one) == seen(plain.filter("campaign_id = 'c1'"))


@pytest.mark.parametrize("made", [False, True])
def test_without_rows_or_copy(spark, tmp_root, made):
    if made:
        assert cluster.cluster_insights(spark, tmp_root)["rows"] == 0
    assert cluster.read_clustered(spark, tmp_root, ["a"]).collect() == []
    storage.write_insights(insights(spark, 3, 2), tmp_root)
    assert cluster.read_clustered(spark, tmp_root, ["c1"]).count() == 2


def test_null_campaigns_and_days(spark, tmp_root):
    df = insights(spark, 6, 4)
    df = df.withColumn("campaign_id", F.when(F.col("campaign_id") != "c2", F.col("campaign_id")))
    df = df.withColumn("date", F.when(F.col("region") != "7", F.col("date")))
    storage.write_insights(df, tmp_root)
    cluster.cluster_insights(spark, tmp_root, 4)
    assert cluster.read_clustered(spark, tmp_root).count() == 24
    assert cluster.read_clustered(spark, tmp_root, ["c1"]).count() == 4


def test_a_table_of_campaigns_is_joined(spark, tmp_root, monkeypatch):
    storage.write_insights(insights(spark, 20, 12, hot=500), tmp_root)
    monkeypatch.setattr(cluster, "ROWS_PER_TASK", 200)
    made = cluster.cluster_insights(spark, tmp_root, 20)
    assert made["rows"] == 740 and made["files"] >= 37  # several a task, none of more rows
    start, end = DAY + dt.timedelta(2), DAY + dt.timedelta(8)
    plain = storage.read_insights(spark, tmp_root, start, end)
    for asked in (["c3", "hot", "unknown", "c3", None], ["unknown"], []):
        table = spark.createDataFrame([(c,) for c in asked], "campaign_id string")
        got = cluster.read_clustered(spark, tmp_root, table, start, end)
        assert seen(got) == seen(plain.filter(F.col("campaign_id").isin(asked)))
        by_list, total = cluster.files_for(spark, tmp_root, [c for c in asked if c], start, end)
        found, _ = cluster.files_for(spark, tmp_root, table, start, end)
        assert set(by_list) <= set(found) and len(found) < total


def test_small_files_need_no_task_each(spark, tmp_root):
    storage.write_insights(insights(spark), tmp_root)
    cluster.cluster_insights(spark, tmp_root, 64)
    files = cluster.files_for(spark, tmp_root)[0]
    sizes = [pq.ParquetFile(f.removeprefix("file:")).metadata.num_rows for f in files]
    assert len(sizes) == 64 and max(sizes) == 64
    # one task wrote them all: part-<task>-...
    assert len({os.path.basename(f).split("-")[1] for f in files}) == 1
