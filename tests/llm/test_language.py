import zlib

import numpy as np

from adperf.llm import language as L

EN = "the quick brown fox and the lazy dog are in the house with that thing "
FR = "le chat noir est dans la maison avec une belle fenêtre très été où "
SCHEMA = "doc_id long, text string, lang string, score string"


def _docs(spark, extra=()):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        words = (EN if i % 2 else FR).split()
        rows.append((i, " ".join(rng.choice(words, 12)), "en" if i % 2 else "fr", "s"))
    return spark.createDataFrame(rows + list(extra), SCHEMA), rows


def test_held_out_accuracy_and_fold(spark):
    docs, rows = _docs(spark)
    truth = {i: lang for i, _, lang, _ in rows}
    got = L.report(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.lang_pred == truth[r.doc_id] and 0 <= r.score <= 1 and not r.rejected


def test_edge_texts(spark):
    extra = [(900, None, None, None), (901, "", "en", None), (902, "123 !!!", "fr", None),
             (903, EN * 3000, None, None), (904, "Ж", None, None), (904, "Ж", None, None)]
    docs, _ = _docs(spark, extra)
    got = {r.doc_id: r for r in L.report(docs).collect()}
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert [got[i].score for i in (900, 901, 902)] == [0.0] * 3
    assert got[903].lang_pred == "en" and not got[903].rejected
    assert got[904].lang_pred in ("en", "fr")
    kept = L.keep_known(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {900, 901, 902}.isdisjoint(ids) and set(range(120)) <= ids and 903 in ids


def test_a_long_text_far_from_every_language_is_rejected(spark):
    odd = "Ж҂Ѫ Ѯѱ Ѿ҈ " * 40
    docs, _ = _docs(spark, [(910, odd, None, None), (911, "Ж", None, None)])
    got = {r.doc_id: r.rejected for r in L.report(docs).collect()}
    assert got[910] and not any(got[i] for i in range(120))
    assert 910 not in {r.doc_id for r in L.keep_known(docs).collect()}


def test_nothing_to_learn_and_empty(spark):
    docs = spark.createDataFrame([(1, "abc", None, None)], SCHEMA)
    assert [(r.lang_pred, r.score) for r in L.report(docs).collect()] == [("und", 0.0)]
    assert L.report(docs.limit(0)).collect() == []


def test_nearest_centroid_matches_plain_cosines(spark):
    docs, rows = _docs(spark)
    model = L.fit(docs)
    import pyarrow as pa
    texts = [t for _, t, _, _ in rows[:10]]
    langs, score, _ = L._predict(pa.array(texts), model)
    for t, lang, s in zip(texts, langs, score):
        data = np.frombuffer(t.lower().encode(), np.uint8)
        x = L.term_counts(data, np.array([0, len(data)]))[0] * model["idf"]
        cos = [float(x @ c / np.linalg.norm(x)) for c in model["centroids"]]
        assert model["langs"][int(np.argmax(cos))] == lang and abs(max(cos) - s) < 1e-5


def test_a_language_of_long_texts_only_is_learned(spark):
    es = "el perro y la casa con una ventana muy grande donde los niños juegan "
    extra = [(i, f"{es * 400}{i}", "es", "s") for i in range(2000, 2012)]
    docs, _ = _docs(spark, extra)
    assert min(len(r[1]) for r in extra) > 25_000
    got = {r.doc_id: r for r in L.report(docs).collect()}
    assert all(got[r[0]].lang_pred == "es" and not got[r[0]].rejected for r in extra)
    assert all(got[i].lang_pred == ("en" if i % 2 else "fr") for i in range(120))


def test_one_row_of_a_repeated_id_is_learned(spark):
    docs, _ = _docs(spark, [(1, f"{EN}{i}", "en", "s") for i in range(500)])
    rows = L.sample(docs.select("doc_id", "lang", "text")).collect()
    assert len(rows) == 120 and len({r.doc_id for r in rows}) == 120
