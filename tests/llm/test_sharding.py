import zlib

from adperf.llm import sharding


def jump(key, shards):
    key, at, to = key % 2**64, -1, 0
    while to < shards:
        at = to
        key = (key * 2862933555777941757 + 1) % 2**64
        to = int((at + 1) * (2.0**31 / ((key >> 33) + 1)))
    return at


IDS = [*range(300), -1, -7, 2**63 - 1, 10**15, None, 5, 5]


def test_matches_the_published_walk_and_slots_are_gapless(spark):
    rows = [(i, None if n % 7 == 0 else "é" * (n % 5), n) for n, i in enumerate(IDS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = sharding.assign(docs, 24, cells=3).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        key = r.doc_id or 0
        assert (r.shard, r.grown_shard) == (jump(key, 24), jump(key, 25))
        assert r.grown_shard in (r.shard, 24)
        slots.setdefault(r.shard, []).append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    expected = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
                      for _, t, _ in rows)
    assert sorted((r.size, r.text_crc32) for r in got) == expected


def test_empty_table_and_long_text(spark):
    schema = "doc_id long, text string"
    assert sharding.assign(spark.createDataFrame([], schema)).collect() == []
    row = sharding.assign(spark.createDataFrame([(1, "x" * 300_000)], schema)).first()
    assert (row["size"], row.slot) == (300_008, 0)


def test_write_shards_keeps_every_row(spark, tmp_root):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(100)], "doc_id long, text string")
    sharding.write_shards(docs, sharding.assign(docs, 4), f"{tmp_root}/out")
    back = spark.read.parquet(f"{tmp_root}/out")
    assert back.count() == 100 and back.select("shard").distinct().count() == 4
