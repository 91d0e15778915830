import hashlib
import re

from adperf.llm import decontaminate as D

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PASSAGE = "the quick brown fox jumps over one lazy dog near Ünïcode river banks today"
BENCH = [(1, PASSAGE), (2, "short item"), (10, "short, ITEM!"), (3, None), (4, "--- ..."),
         (5, " ".join(f"w{i}" for i in range(25)))]
DOCS = [
    (0, "Intro. " + PASSAGE.upper().replace("Ü", "ü").replace("Ï", "ï").replace(" ", " - ") + " end", "x"),
    (1, "a Short\nitem and short  item again", "x"), (2, None, "x"), (3, "", "x"),
    (4, "shortitem w1 w2 w3", "x"), (5, "x " * 70_000 + "short item", "x"),
    (6, " ".join(f"w{i}" for i in range(5, 20)) + " w3 w4", "x"),
    (7, "short", "x"), (8, "item", "x"), (9, "!!!", "x"),
    (11, " ".join(f"W{i}" for i in range(9)), None),
]


def _words(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return WORD.findall(low)


def brute(docs, bench, window=10):
    wins = {}
    for i, t in bench:
        w = _words(t)
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[a:a + n]), set()).add(str(i))
    out = []
    for d, t, *_ in docs:
        w, hit, items = _words(t), set(), set()
        for n in {len(k) for k in wins}:
            for a in range(len(w) - n + 1):
                if tuple(w[a:a + n]) in wins:
                    hit |= set(range(a, a + n))
                    items |= wins[tuple(w[a:a + n])]
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(items), digest, bool(hit)))
    return sorted(out)


def _tables(spark):
    return (spark.createDataFrame(DOCS, "doc_id long, text string, hits string"),
            spark.createDataFrame(BENCH, "item_id long, text string"))


def _rows(df):
    return sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
                  for r in df.collect())


def test_matches_brute_force(spark):
    docs, bench = _tables(spark)
    assert _rows(D.report(docs, bench)) == brute(DOCS, BENCH)


def test_blocks_give_the_same_result(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_WINDOWS", 5)
    docs, bench = _tables(spark)
    assert _rows(D.report(docs, bench)) == brute(DOCS, BENCH)


def test_hash_hits_are_verified_by_words(spark, monkeypatch):
    """With every window hashed alike, only equal words count."""
    docs, bench = _tables(spark)
    hits = D._scan_chunk
    import numpy as np

    from adperf.llm import bytescan as B
    data = np.frombuffer(b"short item other item", np.uint8)
    known = {"items": {b"short item": ["2"]}, "filters": {2: (
        np.sort(B.as_long(B.runs_hash(B.words(data, np.array([0, len(data)]), B.ALNUM_WORDS)[2], 2))),
        np.ones(1 << D.FILTER_BITS, bool))}}
    assert hits(data, np.array([0, len(data)]), known)[1] == [[(0, 2)]]


def test_empty_tables(spark):
    docs, bench = _tables(spark)
    assert D.report(docs.limit(0), bench).collect() == []
    assert {r.contaminated for r in D.report(docs, bench.limit(0)).collect()} == {False}


def test_remove_cuts_spans_drops_covered_documents_and_keeps_columns(spark):
    docs, bench = _tables(spark)
    got = {r.doc_id: r for r in D.remove(docs, bench).collect()}
    assert 0 not in got and 6 not in got  # mostly benchmark words
    assert got[5].text == "x " * 70_000
    assert got[4].text == "shortitem w1 w2 w3" and got[2].text is None and got[4].hits == "x"
    assert set(got) == {2, 3, 4, 5, 7, 8, 9, 11}
