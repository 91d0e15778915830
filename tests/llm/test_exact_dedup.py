import numpy as np

from adperf.llm import exact_dedup as E

ROWS = [(1, "a", "x"), (2, "a", "y"), (3, "b", None), (4, None, "z"), (5, "", "z"), (5, "", "z"),
        (6, "long " * 50_000, "q"), (7, "long " * 50_000, "q"), (8, "A", "q")]
SCHEMA = "doc_id long, text string, digest string"


def _brute(rows):
    best, size = {}, {}
    for i, t, *_ in rows:
        t = t or ""
        best[t] = max(best.get(t, i), i)
        size[t] = size.get(t, 0) + 1
    return sorted((i, best[t or ""], size[t or ""], i == best[t or ""]) for i, t, *_ in rows)


def _result(df):
    return sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect())


def test_matches_brute_force_with_nulls_ties_and_clashing_names(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert _result(E.dedup(E.digests(docs))) == _brute(ROWS)


def test_empty_table(spark):
    assert E.dedup(E.digests(spark.createDataFrame([], SCHEMA))).collect() == []


def test_hot_text_is_looked_up_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(E, "PART_ROWS", 50)
    monkeypatch.setattr(E, "BUCKET_KEYS", 20)
    rows = [(i, "hot" if i % 3 == 0 else f"t{i // 4}", "") for i in range(900)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert _result(E.dedup(E.digests(docs))) == _brute(rows)


def test_history_repeats_are_dropped_and_new_rows_group_apart(spark):
    old = spark.createDataFrame([(1, "a", ""), (2, "b", "")], SCHEMA)
    new = spark.createDataFrame([(10, "a", ""), (11, "c", ""), (12, "c", "")], SCHEMA)
    got = _result(E.dedup(E.digests(new), E.digests(old)))
    assert got == [(10, 1, 1, False), (11, 12, 2, False), (12, 12, 2, True)]


def test_perfect_hash_is_minimal_and_rejects_by_bytes():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 256, (3000, 32), dtype=np.uint8)
    levels = E._unpack(E._pack(E.build_levels(keys)))
    slots = E.slots_of(levels, keys)
    assert sorted(slots) == list(range(3000))


def test_ids_beyond_a_double_beside_null_ids(spark):
    big = 2**53 + 1
    rows = [(big, "a", ""), (big + 2, "a", ""), (None, "b", ""), (None, "a", ""), (big + 4, "c", ""),
            (None, None, ""), (None, "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in E.dedup(E.digests(docs)).collect()}
    assert got == {(big, big + 2, 3, False), (big + 2, big + 2, 3, True), (None, big + 2, 3, False),
                   (None, None, 1, True), (big + 4, big + 4, 1, True), (None, None, 2, True)}


def test_one_id_on_many_rows_is_looked_up_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(E, "PART_ROWS", 100)
    rows = [(7, "same", "")] * 2000 + [(8, "other", "")]
    index, buckets = E.build_index(E.digests(spark.createDataFrame(rows, SCHEMA)))
    got = E.dedup(E.digests(spark.createDataFrame(rows, SCHEMA))).groupBy(
        "doc_id", "keep_id", "group_size", "kept").count().collect()
    assert sorted(map(tuple, got)) == [(7, 7, 2000, True, 2000), (8, 8, 1, True, 1)]


def test_history_and_recent_rows_both_have_members_and_others(spark):
    rows = [(1, "a", ""), (2, "b", ""), (3, "a", ""), (97, "a", ""), (98, "c", ""), (99, "c", ""),
            (100, "d", "")]
    docs = E.older_half(E.digests(spark.createDataFrame(rows, SCHEMA)))
    index, buckets = E.build_index(docs.where("NOT recent"))
    found = {r.doc_id: (r.winner, r.size) for r in E.look_up(docs, index, buckets).collect()}
    assert found == {1: (3, 2), 2: (2, 1), 3: (3, 2), 97: (3, 2), 98: (None, 0), 99: (None, 0),
                     100: (None, 0)}
    assert _result(E.dedup(E.digests(spark.createDataFrame(rows, SCHEMA)))) == _brute(rows)
