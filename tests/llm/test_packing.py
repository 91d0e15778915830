import random
import re

from adperf.llm import packing as P

SCHEMA = "doc_id long, text string, source string, bin string, size string"


def corpus(seed=1, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", None])
        text = "Copy  text here" if i % 6 == 1 else " ".join(["w"] * rng.randrange(1, 60) + [str(i)])
        rows.append((i, text, source, "x", "y"))
    return rows + [(n, None, "a", "x", "y"), (n + 1, "", "a", "x", "y"), (n + 2, " \n", "a", "x", "y"),
                   (n + 3, "long " * 100_001, "a", "x", "y"), (n + 4, "copy text HERE", "b", "x", "y"),
                   (5, rows[5][1], rows[5][2], "x", "y")]


def naive(sizes, sources, clusters, capacity):
    """Best fit by trying every bin."""
    bins = []
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [(b["free"], n) for n, b in enumerate(bins) if b["free"] >= sizes[i]
                and sources[i] not in b["s"] and clusters[i] not in b["c"]]
        if not fits:
            bins.append({"free": capacity, "s": set(), "c": set()})
            fits = [(capacity, len(bins) - 1)]
        n = min(fits)[1]
        bins[n]["free"] -= sizes[i]
        bins[n]["s"].add(sources[i])
        bins[n]["c"].add(clusters[i])
        out[i] = n
    return out


def test_successor_search_equals_trying_every_bin():
    rng = random.Random(5)
    for _ in range(30):
        n = rng.randrange(1, 120)
        sizes = [rng.randrange(1, 100) for _ in range(n)]
        sources = [rng.randrange(6) for _ in range(n)]
        clusters = [rng.randrange(40) for _ in range(n)]
        assert P.best_fit(sizes, sources, clusters, 100)[0] == naive(sizes, sources, clusters, 100)


def test_every_token_is_packed_once_without_conflicts(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = P.pack(docs, capacity=64, group=100).collect()
    expected = sum(len(re.findall(r"[^\x09-\x0d ]+", r[1] or "")) for r in rows)
    assert sum(r.size for r in got) == expected
    texts = {r[0]: " ".join((r[1] or "").lower().split()) for r in rows}
    bins = {}
    for r in got:
        if r.bin is None:
            assert r.doc_id in (300, 301, 302) and r.size == 0
        else:
            bins.setdefault(r.bin, []).append(r)
    for members in bins.values():
        assert sum(r.size for r in members) <= 64
        assert len({r.source for r in members}) == len(members)
        assert len({texts[r.doc_id] for r in members}) == len(members)
        spans = sorted((r.bin_offset, r.bin_offset + r.size) for r in members)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    long = sorted(r.piece for r in got if r.doc_id == 303)
    assert long == list(range(-(-100_001 // 64)))


def test_empty_table_and_fill(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert P.pack(docs).collect() == []
    r = P.fill(P.pack(spark.createDataFrame(corpus(), SCHEMA), capacity=64), 64).first()
    assert 0 < r.fill <= 1


def test_ids_beyond_a_double_beside_null_ids_and_a_hot_id(spark):
    big = [2**53 + 1, 2**53 + 3, 2**53 + 5, None]
    docs = spark.createDataFrame([(i, "some words", "a", "", "") for i in big], SCHEMA)
    assert {r.doc_id for r in P.pack(docs).collect()} == set(big)
    hot = [(None if i % 2 else 7, f"text {i}", f"s{i % 50}", "", "") for i in range(6000)]
    got = P.pack(spark.createDataFrame(hot, SCHEMA), group=500).collect()
    groups = {}
    for r in got:
        groups[r.bin.split("-")[0]] = groups.get(r.bin.split("-")[0], 0) + 1
    assert len(got) == 6000 and len(groups) >= 10 and max(groups.values()) < 750
