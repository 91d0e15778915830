"""Token counts by a public tokenizer: batch encoding in Arrow tasks that returns lengths only.

Each task keeps one tokenizer. The bytes of its texts are taken in windows of about ``WINDOW``
bytes, however long or short the texts are, so working memory follows the window and no text or
token id leaves the task. In a window the texts are cut into pieces at every safe boundary;
equal pieces are encoded once, all in one call, and the count of a text is the sum over its
pieces. A process remembers the lengths of up to about ``KNOWN`` short pieces it met before.

A boundary is safe where the tokenizer itself always cuts, whatever stands around it:

* byte-level BPE (``.json``): before ASCII white space that follows a visible ASCII character or
  a letter or sign of U+00C0 to U+07FF, and between CJK punctuation and a kana or ideograph. Its
  splitting pattern takes a run of letters, digits or signs up to there in every case and looks
  behind nowhere;
* SentencePiece (``.model``): at a single space between visible ASCII characters, which is
  left out, as the model puts one before every text; only where no piece of the vocabulary
  holds a space after another character.

A tokenizer of another make is given whole texts. An endless word without a safe boundary is
one piece, and so is counted whole. The tokenizer file goes to the tasks as a broadcast of at
most ``MAX_FILE`` bytes, so executors need no copy of it.

Edge cases: a null text counts as empty, which has no token and no byte; strings of special
tokens inside texts are taken as the library takes them by default; repeated rows and null ids
are returned one by one; very long texts are counted piece by piece; an empty table gives no
rows; there are no ties to break; other columns are not read, so clashing names do not matter.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 1 << 21
KNOWN, SHORT = 400_000, 32  # pieces whose lengths a task's process remembers, and their size
MAX_FILE = 1 << 26


class Tokenizer(NamedTuple):
    """``encode`` gives the lengths of a batch of texts, ``cut`` the safe boundaries in some
    bytes (None: unknown); ``drops``: the space at a boundary is left out; ``known``: lengths of
    short pieces that were encoded before."""

    encode: Callable[[list[str]], list[int]]
    cut: Callable[[np.ndarray], np.ndarray] | None
    known: dict[str, int]
    drops: bool = False


# fixed values: UTF-8 of 、 。 ！ ， ： ； ？ and of the first and last kana and ideographs
CJK_SIGNS = [0xE38081, 0xE38082, 0xEFBC81, 0xEFBC8C, 0xEFBC9A, 0xEFBC9B, 0xEFBC9F]
CJK_LETTERS = [(0xE38181, 0xE38296), (0xE382A1, 0xE383BA), (0xE4B880, 0xE9BFBF)]


def _visible(data: np.ndarray) -> np.ndarray:
    return (data >= 0x21) & (data <= 0x7E)


def byte_level_cut(data: np.ndarray) -> np.ndarray:
    white = (data == 0x20) | (data == 0x0A) | (data == 0x0D) | (data == 0x09)
    letter = _visible(data)
    # the second byte of a two-byte character from U+00C0 on; white space among them is below
    letter[1:] |= (data[1:] >= 0x80) & (data[1:] <= 0xBF) & (data[:-1] >= 0xC3) & (
        data[:-1] <= 0xDF)
    at = np.flatnonzero(white[1:] & letter[:-1]) + 1
    lead = np.flatnonzero((data[:-5] == 0xE3) | (data[:-5] == 0xEF)) if len(data) > 5 else at[:0]
    if len(lead):
        def code(i: np.ndarray) -> np.ndarray:
            return (data[i].astype(np.int64) << 16) | (data[i + 1].astype(np.int64) << 8) | data[
                i + 2]

        after = code(lead + 3)
        letters = np.logical_or.reduce([(after >= lo) & (after <= hi) for lo, hi in CJK_LETTERS])
        lead = lead[letters & np.isin(code(lead), CJK_SIGNS)]
        at = np.union1d(at, lead + 3)
    return at


def one_space_cut(data: np.ndarray) -> np.ndarray:
    seen = _visible(data)
    return np.flatnonzero((data[1:-1] == 0x20) & seen[:-2] & seen[2:]) + 1


def _is_byte_level(config: dict) -> bool:
    """Whether the boundaries of :func:`byte_level_cut` are safe for a ``.json`` tokenizer."""
    pre = config.get("pre_tokenizer") or {}
    plain = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
             and not pre.get("add_prefix_space") and not config.get("normalizer"))
    added = config.get("added_tokens") or []
    inside = any(t["lstrip"] or t["rstrip"] or t["single_word"] or len(byte_level_cut(
        np.frombuffer(f"x{t['content']}x".encode(), np.uint8))) for t in added)
    post = (config.get("post_processor") or {}).get("type")
    return plain and not inside and post in (None, "ByteLevel")


@lru_cache(maxsize=2)
def load(blob: bytes, kind: str) -> Tokenizer:
    """The tokenizer of a file's bytes."""
    if kind == "json":
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        import tokenizers

        own = tokenizers.Tokenizer.from_str(blob.decode())
        own.no_truncation()
        own.no_padding()
        return Tokenizer(
            lambda texts: [len(e) for e in own.encode_batch_fast(texts, add_special_tokens=False)],
            byte_level_cut if _is_byte_level(json.loads(blob)) else None, {})
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_proto=blob)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    apart = (model.encode("x", out_type=str)[:1] == ["▁x"]
             and not any("▁" in p.lstrip("▁") for p in pieces))
    return Tokenizer(lambda texts: [len(x) for x in model.encode(texts, num_threads=1)],
                     one_space_cut if apart else None, {}, drops=apart)


def lengths(texts: pa.Array, tokenizer: Tokenizer, window: int = WINDOW) -> np.ndarray:
    """Tokens of each text of an Arrow array, window by window."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:][:len(texts) + 1]
    out = np.zeros(len(texts), np.int64)
    lo, end = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if lo < end else None
    size, after_cut = window, False
    while lo < end:
        hi = min(lo + size, end)
        part = data[lo:hi]
        first, last = np.searchsorted(offsets, [lo + 1, hi])
        own = np.unique(offsets[first:last]) - lo  # where texts start
        at = own[:0] if tokenizer.cut is None else tokenizer.cut(part)
        if tokenizer.drops:  # never the first or last space of a text
            at = at[~(np.isin(at, own) | np.isin(at + 1, own))]
        bounds = np.union1d(at, own)
        if hi < end and not len(bounds):
            size *= 2  # an endless word
            continue
        starts = np.concatenate([[0], bounds])
        ends = np.concatenate([bounds, [len(part)]])
        if hi < end:  # the last piece goes on in the next window
            starts, ends = starts[:-1], ends[:-1]
        owner = np.searchsorted(offsets, starts + lo, side="right") - 1
        if tokenizer.drops:
            dropped = np.isin(starts, at)
            dropped[0] = after_cut
            starts = starts + dropped
            after_cut = bool(len(at)) and at[-1] == ends[-1]
        sizes = _piece_lengths(part, starts, ends, tokenizer)
        base = int(owner[0])
        found = np.bincount(owner - base, weights=sizes).astype(np.int64)
        out[base:base + len(found)] += found
        lo, size = lo + int(ends[-1]), window
    return out


def _piece_lengths(part: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                   tokenizer: Tokenizer) -> np.ndarray:
    """Tokens of the pieces ``starts[i]:ends[i]``; equal ones are encoded once, in one call."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    if tokenizer.drops:
        part = part[np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])]
    raw = pa.Array.from_buffers(pa.large_binary(), len(size), [
        None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(part))])
    coded = raw.dictionary_encode()
    texts = coded.dictionary.cast(pa.large_string()).to_pylist()
    known = tokenizer.known
    new = [t for t in texts if t not in known]
    fresh = dict(zip(new, tokenizer.encode(new)))
    counts = np.array([known[t] if t in known else fresh[t] for t in texts], np.int64)
    if len(known) > KNOWN:
        known.clear()
    known.update((t, n) for t, n in fresh.items() if len(t) <= SHORT)
    return counts[coded.indices.to_numpy()]


def count_tokens(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row.

    ``path`` names a ``.json`` file (tokenizers) or a ``.model`` file (SentencePiece).
    """
    kind = path.rsplit(".", 1)[-1]
    if kind not in ("json", "model"):
        raise ValueError(f"no library for {path}: .json or .model")
    with open(path, "rb") as file:
        blob = file.read(MAX_FILE + 1)
    if len(blob) > MAX_FILE:
        raise ValueError(f"{path} is larger than {MAX_FILE} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(blob)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(shared.value, kind)
        for batch in batches:
            counts = pa.array(lengths(batch.column(2), tokenizer))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    n_bytes = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), n_bytes.alias("n_bytes"),
                       F.col(text_col).alias("text"))
    return (rows.mapInArrow(scan, "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > F.lit(limit)))
