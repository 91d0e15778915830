import random
import re

import pytest

from adperf.llm import near_dedup as N
from adperf.llm.components import connected_components

SPACE_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, label string, size int"


def sets_of(rows, k):
    out = []
    for i, t, *_ in rows:
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode())
        w = SPACE_WORD.findall(low)
        s = {tuple(w[a:a + k]) for a in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
        out.append((i, frozenset(s)))
    return out


def components(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def brute(rows, k, percent):
    sets = sets_of(rows, k)
    links = [(i, j) for x, (i, s) in enumerate(sets) for j, t in sets[:x]
             if s and t and 100 * len(s & t) >= percent * len(s | t)]
    part = components([i for i, _ in sets], links)
    return sorted((i, len(s), part[i], part[i] == i) for i, s in sets)


def result(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def corpus(seed, families, copies, words=60, edits=3):
    rng, rows = random.Random(seed), []
    for _ in range(families):
        base = [f"w{rng.randrange(400)}" for _ in range(words)]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randrange(edits + 1)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(t))
    rng.shuffle(rows)
    return [(i, t, "l", 1) for i, t in enumerate(rows)]


EDGES = [(1000, None, None, None), (1001, "", "a", 1), (1002, " \t\n", "a", 1),
         (1003, "One two", "a", 1), (1004, "one\ttwo", "a", 1), (1005, "one", "a", 1),
         (1006, "a b c " * 20_000, "a", 1), (1007, "A B C " * 20_000, "a", 1),
         (1003, "One two", "a", 1)]


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_matches_brute_force(spark, k, percent):
    rows = corpus(k, 40, 4) + EDGES
    docs = spark.createDataFrame(rows, SCHEMA)
    assert result(N.near_duplicates(docs, k, percent)) == brute(rows, k, percent)


def test_large_families_branch_and_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(N, "SMALL", 4)
    rows = corpus(9, 6, 40, words=80, edits=5)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert result(N.near_duplicates(docs, 3, 85)) == brute(rows, 3, 85)


def test_what_is_left_large_is_compared_exhaustively(spark, monkeypatch):
    monkeypatch.setattr(N, "SMALL", 2)
    monkeypatch.setattr(N, "MAX_DEPTH", 1)
    rows = corpus(5, 4, 25, words=80, edits=6)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert result(N.near_duplicates(docs, 3, 85)) == brute(rows, 3, 85)


def test_empty_table_and_keep_one(spark):
    rows = corpus(2, 5, 3) + EDGES
    docs = spark.createDataFrame(rows, SCHEMA)
    assert N.near_duplicates(docs.limit(0)).collect() == []
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    expected = {i for i, _, _, k in brute(rows, 5, 80) if k}
    assert {r.doc_id for r in kept.collect()} == expected


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == components({n for e in links for n in e}, links)


def test_only_texts_that_are_compared_are_gathered(spark, monkeypatch):
    rng, made = random.Random(4), []
    intro = [f"i{n}" for n in range(12)]  # its shingles make large nodes of unlike documents
    rows = [(i, " ".join(intro + [f"w{rng.randrange(10**6)}" for _ in range(48)]), "l", 1)
            for i in range(160)]
    rows += [(200, rows[0][1] + " x", "l", 1), (201, rows[9][1] + " y", "l", 1),
             (None, rows[0][1], "l", 1)]

    def cut(df, name, heavy=False):
        out = real(df, name, heavy)
        made.append((name, out.count()))
        return out

    real = N.cut
    monkeypatch.setattr(N, "cut", cut)
    got = N.near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, 85)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()
                 if r.doc_id is not None)
    assert got == brute(rows[:-1], 3, 85)
    assert dict(made)["near-nodes"] > 160
    assert sum(n for name, n in made if name == "near-sets") == 4


def test_marks_leave_few_texts_and_lose_none(spark):
    rows = [(i, "t", "l", 1) for i in [*range(-500, 500), 2**62, -2**62]] + [(None, "t", "l", 1)]
    ids = [-500, -1, 0, 1, 77, 2**62, -2**62]
    docs = spark.createDataFrame(rows + rows[:1], SCHEMA)
    marks = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    got = [r.doc_id for r in N._marked(docs, marks).collect()]
    assert set(ids) <= set(got) and got.count(-500) == 2 and len(got) < 20
