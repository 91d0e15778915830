import random
import re

import numpy as np

from adperf.llm import bytescan as B
from adperf.llm import substring_dedup as S

SCHEMA = "doc_id long, text string, ranges int"


def _sentence(rng, n):
    return " ".join(f"W{rng.randrange(10**6)}" for _ in range(n)) + rng.choice([". ", "! ", "?\n"])


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    passage = "".join(_sentence(rng, rng.randrange(6, 14)) for _ in range(8))
    rows = []
    for i in range(n):
        own = [_sentence(rng, rng.randrange(1, 15)) for _ in range(rng.randrange(1, 12))]
        if i % 4 == 0:
            own.insert(rng.randrange(len(own) + 1), "no stop before " + passage + "tail ")
        rows.append((i, "".join(own), 7))
    rows += [(n, rows[4][1], 7), (n + 1, None, 7), (n + 2, "", 7), (n + 3, "One. Two. Three.", 7),
             (n + 4, "One. Two. Three.", 7), (n + 5, passage * 2, 7),
             (n + 6, "same words here. " * 9_000, 7), (n + 6, "same words here. " * 9_000, 7)]
    return rows, passage


def brute(rows):
    """Ranges from spans of whole word tuples, sentences cut by the documented rules."""
    found, first = [], {}
    for d, text in sorted({(r[0], r[1] or "") for r in rows}):
        raw = text.encode()
        data = np.frombuffer(raw, np.uint8)
        words = [(m.start(), m.end()) for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw)]
        sentences, cur = [], []
        for n, (a, b) in enumerate(words):
            if cur and re.search(rb"[.!?\n]", raw[cur[-1][1]:a]):
                sentences.append(cur)
                cur = []
            cur.append((a, b))
            word = data[a:b]
            h = B.words(word, np.array([0, b - a]), B.ALNUM_WORDS)[2][0]
            if int(h) % S.SOFT_CUT == 0:
                sentences.append(cur)
                cur = []
        if cur:
            sentences.append(cur)
        for i in range(len(sentences)):
            j = i
            while j < len(sentences) and (j - i + 1 < S.SENTENCES or sum(
                    map(len, sentences[i:j + 1])) < S.WORDS):
                j += 1
            if j < len(sentences):
                run = [w for s in sentences[i:j + 1] for w in s]
                key = tuple(raw[a:b].lower() for a, b in run)
                at = (d, run[0][0])
                first[key] = min(first.get(key, at), at)
                found.append((key, at, run[-1][1]))
    out = {}
    for key, (d, lo), hi in found:
        if first[key] != (d, lo):
            out.setdefault(d, set()).update(range(lo, hi))
    return out


def test_matches_brute_force(spark):
    rows, passage = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = S.report(docs).collect()
    expected = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        covered = {p for x in r.removed for p in range(x.lo, x.hi)}
        assert covered == expected.get(r.doc_id, set()), r.doc_id
        assert r.n_bytes_removed == len(covered) and r.n_removed == len(r.removed)
    removed = {r.doc_id for r in got if r.n_removed}
    assert set(range(4, 60, 4)) <= removed and 0 not in removed  # the first copy stays
    assert not removed & {i for i in range(60) if i % 4}


def test_remove_repeats_keeps_columns_and_clean_rows(spark):
    rows, passage = corpus(3)
    docs = spark.createDataFrame(rows, SCHEMA)
    out = S.remove_repeats(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    texts = {r[0]: r[1] for r in rows}
    for i in range(60):
        if i % 4 or i == 0:
            assert got[i].text == texts[i]
        else:
            assert len(got[i].text) < len(texts[i]) - len(passage) * 0.6
    assert got[61].text is None and got[62].text == "" and got[63].text == "One. Two. Three."


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert S.report(docs).collect() == [] and S.remove_repeats(docs).collect() == []


def all_runs(rows):
    """Bytes that repeated runs of any length cover: runs of equal words cut alike, and runs of
    equal words however they are cut."""
    out = []
    for cut_alike in (True, False):
        found, first = [], {}
        for d, text in sorted({(r[0], r[1]) for r in rows}):
            raw = text.encode()
            lo, hi, *_ = S.sentence_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            words = [tuple(re.findall(rb"[0-9a-z\x80-\xff]+", raw[a:b].lower()))
                     for a, b in zip(lo, hi)]
            for i in range(len(words)):
                for j in range(i + S.SENTENCES, len(words) + 1):
                    if sum(map(len, words[i:j])) >= S.WORDS:
                        key = tuple(words[i:j]) if cut_alike else sum(words[i:j], ())
                        at = (d, int(lo[i]))
                        first[key] = min(first.get(key, at), at)
                        found.append((key, at, int(hi[j - 1])))
        covered = {}
        for key, (d, a), b in found:
            if first[key] != (d, a):
                covered.setdefault(d, set()).update(range(a, b))
        out.append(covered)
    return out


def plain_words(rng, n):
    """Words that end no sentence by their hash."""
    out = []
    while len(out) < n:
        word = f"w{rng.randrange(10**6)}"
        raw = np.frombuffer(word.encode(), np.uint8)
        if int(B.words(raw, np.array([0, len(raw)]), B.ALNUM_WORDS)[2][0]) % S.SOFT_CUT:
            out.append(word)
    return " ".join(out)


def covered_bytes(docs):
    return {r.doc_id: {p for x in r.removed for p in range(x.lo, x.hi)}
            for r in S.report(docs).collect()}


def test_short_sentences_at_the_end_of_a_repeated_passage_go(spark):
    rng = random.Random(5)
    passage = "".join(plain_words(rng, n) + ". " for n in (10, 3, 3, 2, 2))
    own = [plain_words(rng, 9) + ". " for _ in range(4)]
    rows = [(1, own[0] + passage + own[1], 7), (2, own[2] + passage + own[3], 7)]
    got = covered_bytes(spark.createDataFrame(rows, SCHEMA))
    lo = len(own[2])
    assert got == {1: set(), 2: set(range(lo, lo + len(passage) - 2))}


def test_every_repeated_run_is_covered(spark):
    rng = random.Random(9)
    pool = ["".join(plain_words(rng, rng.choice([1, 2, 3, 9, 17])) + ". "
                    for _ in range(rng.randrange(4, 12))) for _ in range(8)]
    rows = [(i, "".join(rng.choice(pool) if rng.random() < 0.4 else _sentence(
        rng, rng.randrange(1, 40)) for _ in range(rng.randrange(2, 8))), 7) for i in range(60)]
    got = covered_bytes(spark.createDataFrame(rows, SCHEMA))
    least, most = all_runs(rows)
    for d, _, _ in rows:
        assert least.get(d, set()) <= got[d] <= most.get(d, set()), d
    assert sum(map(len, least.values())) > 1000


def test_smallest_of_windows_matches_its_rule():
    rng = np.random.default_rng(3)
    for n in (0, 1, S.GAP - 1, S.GAP, S.GAP + 1, 200):
        h = rng.integers(0, 9 if n == 200 else 2**63, n, dtype=np.uint64)
        heads = rng.random(n) < 0.05
        expected = np.zeros(n, bool)
        for i in range(n - S.GAP + 1):
            if not heads[i + 1:i + S.GAP].any():
                window = np.maximum(h[i:i + S.GAP], 1)
                expected[i:i + S.GAP] |= window == window.min()
        assert (S.smallest_of_windows(h, heads) == expected).all(), n


def test_passages_of_50_words_without_a_stop_or_cut_word_go(spark):
    rng = random.Random(11)
    rows, inside = [], {}
    for k in range(120):
        n = 50 + k % 11
        passage = plain_words(rng, n) if k % 2 else " ".join(
            f"w{rng.randrange(10**6)}" for _ in range(n))
        stop = ". " if k % 3 == 0 else " "
        for copy in range(2):
            before = plain_words(rng, rng.randrange(1, 20)) + stop
            rows.append((2 * k + copy, before + passage + stop + plain_words(rng, 15), 7))
        inside[2 * k + 1] = range(len(before), len(before) + len(passage))
    got = covered_bytes(spark.createDataFrame(rows, SCHEMA))
    for d, at in inside.items():
        text = rows[d][1]
        assert not got[d - 1] and got[d] <= set(at)
        # all but what stands before the first and after the last end that the passage makes sure
        assert len(text[at.start:min(got[d])].split()) <= S.GAP
        assert len(text[max(got[d]) + 1:at.stop].split()) < S.GAP
    one_word = next(w for w in ("aa", "bb", "cc") if int(B.words(np.frombuffer(
        w.encode(), np.uint8), np.array([0, 2]), B.ALNUM_WORDS)[2][0]) % S.SOFT_CUT)
    got = covered_bytes(spark.createDataFrame([(1, f"{one_word} " * 500, 7)], SCHEMA))
    assert len(got[1]) > 1400
