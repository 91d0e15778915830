import hashlib
import random
import time
from pathlib import Path

import numpy as np
import pytest

from adperf.llm import suffix_dedup as X
from adperf.llm.tables import tidy

SCHEMA = "doc_id long, text string, ranges string"


def brute(rows, length=X.LENGTH):
    texts = [(d, (t or "").encode()) for d, t, *_ in rows]
    least = {}
    for d, raw in texts:
        for i in range(len(raw) - length + 1):
            s = raw[i:i + length]
            least[s] = min(least.get(s, d), d)
    out = []
    for d, raw in texts:
        gone = np.zeros(len(raw) + 1, np.int8)
        for i in range(len(raw) - length + 1):
            if least[raw[i:i + length]] < d:
                gone[i:i + length] = 1
        runs = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        left = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((d, len(raw), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                  for r in df.collect())


def corpus(seed, n=40):
    rng = random.Random(seed)
    letters = "abcdé \n"

    def text(k):
        return "".join(rng.choice(letters) for _ in range(k))

    passages = [text(k) for k in (49, 50, 60, 130, 400)]
    rows = []
    for i in range(n):
        parts = [text(rng.randrange(0, 120))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 3)
            parts += [p[a:len(p) - rng.randrange(len(p) // 3)], text(rng.randrange(40))]
        rows.append((rng.randrange(10**6), "".join(parts), "r"))
    rows = list({r[0]: r for r in rows}.values())
    return rows + [(10**6, None, "r"), (10**6 + 1, "", "r"), (10**6 + 2, rows[0][1], "r"),
                   (10**6 + 3, rows[0][1], "r"), (10**6 + 4, "the " * 300, "r"),
                   (10**6 + 5, "x the the " + "the " * 200 + "y", "r"), (10**6 + 6, "short", "r"),
                   (10**6 + 7, "short", "r"), (10**6 + 8, passages[4] * 3, "r")]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    assert result(X.report(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_hot_anchors_and_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(X, "HOT", 3)
    monkeypatch.setattr(X, "BUCKET_RECORDS", 10)
    rows = corpus(3)
    assert result(X.report(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_anchors_settle_across_batches(spark, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = corpus(4)
        assert result(X.report(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_table_repeated_rows_and_long_text(spark):
    assert X.report(spark.createDataFrame([], SCHEMA)).collect() == []
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh ") for _ in range(150_000))
    rows = [(1, long, "r"), (2, "start " + long[70_000:70_300] + " end", "r")]
    got = result(X.report(spark.createDataFrame([*rows, rows[1]], SCHEMA)))
    assert got == sorted([*brute(rows), brute(rows)[1]])


def test_intervals_equal_all_pairs():
    rng = random.Random(6)
    base = bytes(rng.choice(b"ab") for _ in range(90))
    records = [base[a:a + X.LENGTH + rng.randrange(20)] for a in range(0, 20, 3)] * 2
    rec, at, length, lcp = X.sorted_suffixes(records)
    suffixes = [records[r][a:] for r, a in zip(rec, at)]
    assert suffixes == sorted(suffixes)
    for i in range(1, len(suffixes)):
        a, b = suffixes[i - 1], suffixes[i]
        n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert lcp[i] == n
    doc = np.arange(len(records))
    found = X.maximal_intervals(lcp, np.zeros(len(rec), np.int64), at >= 0, doc[rec])
    assert found == []  # one left byte everywhere: no maximal repeat
    found = X.maximal_intervals(lcp, np.zeros(len(rec), np.int64), at < 0, doc[rec])
    for first, end, depth, least in found:
        group = suffixes[first:end]
        assert len({s[:depth] for s in group}) == 1 and least == min(doc[rec[first:end]])


def test_slices_of_anchors(spark, monkeypatch):
    monkeypatch.setattr(X, "SLICES", 12)
    monkeypatch.setattr(X, "HOT", 3)
    kept = []
    of_cut = X.cut
    monkeypatch.setattr(X, "cut", lambda df, name, **k: kept.append(
        (name, set(df.columns))) or of_cut(df, name, **k))
    rows = corpus(5)
    assert result(X.report(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    # records overlap: their places are kept for all of them, their bytes are not
    records = [columns for name, columns in kept if name == "op6-records"]
    assert len(records) > 1 and not any("bytes" in columns for columns in records)


def test_shuffle_files_go_with_their_step(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()

    def files():
        return {f for d in dirs for f in Path(str(d)).rglob("shuffle_*.data")}

    tidy(spark)
    before = files()
    df = spark.range(100_000).repartition("id")
    out = X.cut(df.groupBy((df.id % 1000).alias("k")).count(), "test-tidy", heavy=True)
    until = time.time() + 5
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    X.discard(out)
