import zlib

import numpy as np
import pyarrow as pa
import pytest

from adperf.llm import bytescan as B
from adperf.llm import toxicity as T

INSULTS = ["idiot", "scumbag", "pathetic", "worthless"]


def _corpus(seed=4, n=600):
    rng = np.random.default_rng(seed)
    syllables = ["th", "er", "on", "an", "re", "ha", "le", "si", "to", "ne", "va", "mi"]
    vocabulary = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(500)]
    docs, labels = [], []
    for i in range(n):
        words = list(rng.choice(vocabulary, rng.integers(10, 60)))
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(2):
                words.insert(int(rng.integers(len(words))), str(rng.choice(INSULTS)))
        docs.append((i, " ".join(words), "en", 0.5))
        labels.append((i, 1, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = _corpus()
    extra = [(9000, None, None, 0.0), (9001, "", None, 0.0), (9002, "a b", None, 0.0),
             (9003, "there " * 40_000, None, 0.0),
             (9004, "the one id.iot and that scum-bag here", None, 0.0),
             (9005, "the one i d i o t and pa-thetic here", None, 0.0),
             (9006, "there", None, 0.0), (9006, "there", None, 0.0)]
    return (spark.createDataFrame(docs + extra, "doc_id long, text string, lang string, score double"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels)


def test_held_out_accuracy_and_edges(tables):
    docs, labels, truth = tables
    got = T.report(docs, labels).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r for r in got}
    wrong = [i for i, _, toxic in truth if by_id[i].predicted != toxic]
    held = {i for i, _, _ in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert held == {i for i in by_id if i < 9000 and by_id[i].held_out}
    assert len(held.intersection(wrong)) <= 0.03 * len(held)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    assert all(by_id[i].predicted == 0 for i in (9000, 9001, 9002, 9003, 9006))
    assert by_id[9004].predicted == 1 and by_id[9005].predicted == 1  # gaps and insertions


def test_nothing_to_learn_and_empty_table(tables):
    docs, labels, _ = tables
    clean = labels.where("toxic = 0")
    assert {r.score for r in T.report(docs, clean).collect()} == {0.0}
    assert T.report(docs.limit(0), labels).collect() == []


def test_table_scores_equal_the_kernel_features():
    rng = np.random.default_rng(2)
    weights = rng.normal(size=T.TABLE).astype(np.float32)
    words = ["idiot", "über", "a", "moron", "i.d.i.o.t", "ñandú"]
    for _, _, data, off in B.chunks(pa.array([" ".join(words), "!!moron--"], pa.large_string())):
        codes, start, end, first, _, _ = T.spans(data, off)
        got = T.word_scores(codes, start, end, weights)
    expected = [sum(weights[g] * x for g, x in f.items()) for f in T.features([*words, "moron"])]
    assert first.tolist() == [0, 6, 7]
    assert np.allclose(got, expected, atol=1e-4)


def test_spelled_out_word_is_one_word():
    for _, _, data, off in B.chunks(pa.array(["so i d i o t !"], pa.large_string())):
        codes, start, end, _, _, _ = T.spans(data, off)
    assert [int(e - s) - 2 for s, e in zip(start, end)] == [2, 5]
