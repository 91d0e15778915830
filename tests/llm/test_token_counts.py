import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from adperf.llm import token_counts as T

JSON = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def _whole(path, text):
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        return len(Tokenizer.from_file(path).encode(text or "", add_special_tokens=False))
    from sentencepiece import SentencePieceProcessor

    return len(SentencePieceProcessor(model_file=path).encode(text or ""))


def _load(path):
    with open(path, "rb") as f:
        return T.load(f.read(), path.rsplit(".", 1)[-1])


TEXTS = [None, "", " ", "one", "<|endoftext|> a<|endoftext|>b <|endoftext|>", "it's  we'll\n\n\tdon't",
         "été ça 12 345,6", "東京。大阪、京都!", "x" * 3000, "a b " * 5000, "。日本語" * 3000,
         "caf́e 　x ́y", "line\r\n\r\n  next'  's", "🙂 👩‍👩‍👧 x"]


@pytest.mark.parametrize("path", [JSON, MODEL, WORDS])
def test_counts_equal_the_library_on_whole_texts(spark, path):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "null id", "x"), (0, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit)
                 for r in T.count_tokens(docs, path, 1024).collect())
    want = sorted((i is None, i or 0, len((t or "").encode()), n := _whole(path, t), n > 1024)
                  for i, t, _ in rows)
    assert got == want


def test_empty_table_and_ids_beyond_a_double(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert T.count_tokens(docs, JSON, 5).collect() == []
    big = [(2**53 + 1, "a"), (None, "b"), (2**53 + 3, None)]
    got = T.count_tokens(spark.createDataFrame(big, "doc_id long, text string"), JSON, 5).collect()
    assert {r.doc_id for r in got} == {2**53 + 1, None, 2**53 + 3}


@pytest.mark.parametrize("path", [JSON, MODEL])
@settings(max_examples=400, deadline=None)
@given(texts=st.lists(st.none() | st.text(
    st.sampled_from("aZ09'sldre.!?<|endoftext|> \n\t\r、。日本カéß\u0301\u00a0\u3000🙂-"),
    max_size=60), max_size=6), window=st.integers(1, 40))
def test_pieces_at_safe_boundaries_sum_to_the_whole(path, texts, window):
    tokenizer = _load(path)
    tokenizer = tokenizer._replace(known=tokenizer.known if window % 2 else {})
    assert tokenizer.cut is not None
    got = T.lengths(pa.array(texts, pa.string()), tokenizer, window).tolist()
    assert got == tokenizer.encode([t or "" for t in texts])


def test_windows_bound_what_is_encoded_at_once():
    held = []
    tokenizer = _load(JSON)

    def noted(texts):
        held.append(sum(len(t.encode()) for t in texts))
        return tokenizer.encode(texts)

    texts = [" ".join(f"word{i}" for i in range(40_000)), *["short"] * 200, None, "wörter " * 9]
    got = T.lengths(pa.array(texts).slice(1), tokenizer._replace(encode=noted, known={}), 20_000)
    assert got.tolist() == tokenizer.encode([t or "" for t in texts[1:]])
    got = T.lengths(pa.array(texts), tokenizer._replace(encode=noted, known={}), 20_000)
    assert got.tolist() == tokenizer.encode([t or "" for t in texts])
    assert max(held) <= 20_000 and len(held) > 15


def test_remembered_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(T, "KNOWN", 50)
    tokenizer = _load(JSON)._replace(known={})
    texts = [f"w{i} w{i % 7} " + "x" * 50 for i in range(2000)]
    got = T.lengths(pa.array(texts), tokenizer, 300)
    assert got.tolist() == tokenizer.encode(texts)
    assert len(tokenizer.known) < 200 and max(map(len, tokenizer.known)) <= T.SHORT


def test_other_file_kinds_are_refused(spark):
    with pytest.raises(ValueError):
        T.count_tokens(spark.createDataFrame([], "doc_id long, text string"), "x.tiktoken", 1)


def test_a_tokenizer_of_unknown_make_is_given_whole_texts():
    assert _load(WORDS).cut is None
