"""Toxicity by a support vector machine over a subsequence string kernel.

The kernel compares two strings by their common subsequences of ``ORDER`` (three) characters; a
subsequence that spans s characters weighs ``DECAY ** s`` and may span ``SPAN`` at most, so an
insult with gaps or inserted characters still shares most of its subsequences with the plain
one. Kernel values are divided by the norm that a string of that length has without repeated
subsequences.

A sentence is scored by its words (runs of single characters count as one word, so spelled-out
insults meet), and a text by its worst words: a logistic curve over its ``TOP`` largest word
scores and its length. The machine is trained on labelled sentences:
only the text carries the label, so the words that toxic texts have far more often than clean
ones are the first positive examples and the machine's own findings in toxic texts join them;
words of clean texts are the negatives, the worst ones added in each round. Nyström: kernel
values against ``LANDMARKS`` words are whitened, and a squared-hinge SVM is solved in that
space. As the kernel is an inner product of subsequence weights, the trained machine collapses to one weight per
subsequence, and scoring a text is a sum of table look-ups.

The model is fitted on a bounded sample: about ``PER_CLASS`` labelled texts of each class, of at
most ``MAX_FIT_BYTES`` bytes, picked by a hash of the id. Scoring reads whole texts.

Edge cases: null, empty and wordless texts score as a text whose words share nothing with the
landmarks; without training rows of both classes every score is 0; repeated rows are scored one
by one; labels other than 0 and 1 are ignored; texts of any length are scored whole; of words with
equal evidence the first in name order is learned; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as B
from .language import bounded_sample, held_out
from .tables import bounded_batches

ORDER = 3
SPAN = 5
DECAY = 0.8
PER_CLASS = 3000
MAX_FIT_BYTES = 20_000
LANDMARKS = 128
ROUNDS = 3
TOP = 3
NEGATIVES = 12_000
LEAST_TEXTS = 3
LEAST_ODDS = 3.5
RIDGE = 1e-3
CUT = 0.7  # score from which a text is predicted toxic

# characters: a-z, one code for any other ASCII, one for each UTF-8 continuation byte
CODE_BITS = 7
TABLE = 1 << (CODE_BITS * ORDER)
CODES = np.full(256, 27, np.int32)
CODES[97:123] = np.arange(1, 27)
CODES[65:91] = np.arange(1, 27)
CODES[0x80:0xC0] = np.arange(32, 96)
BOUNDARY = 28
_ENDS = re.compile(r"^[\x00-/:-`{-\x7f]+|[\x00-/:-`{-\x7f]+$")
GAPS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]


def _norms(longest: int) -> np.ndarray:
    """Norm of a string of each length whose subsequences are all different."""
    total = np.zeros(longest + 1)
    for _, k in GAPS:
        total += np.maximum(0, np.arange(longest + 1) - k) * DECAY ** (2 * (k + 1))
    return np.sqrt(np.maximum(total, 1e-12))


NORMS = _norms(4096)


def _norm(length: np.ndarray) -> np.ndarray:
    return NORMS[np.minimum(length, 4096)]


def spans(data: np.ndarray, off: np.ndarray):
    """Codes of a chunk's words laid out one after the other, their spans, and each text's
    first word.

    A word is a run between spaces without the punctuation at its ends, framed by boundary
    codes. Lead bytes of longer UTF-8 characters are left out, so an accented letter is one
    code.
    """
    solid = data < 0xC0
    at = np.concatenate([[0], np.cumsum(solid)])
    data, off = data[solid], at[off]
    start, end, _, first = B.words(data, off, B.SPACE_WORDS)
    letters = np.flatnonzero(B.ALNUM_WORDS[data])
    a, b = np.searchsorted(letters, start), np.searchsorted(letters, end)
    some = b > a
    first = np.concatenate([[0], np.cumsum(some)])[first]
    start, end = letters[a[some]], letters[b[some] - 1] + 1
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    single = end - start == 1
    # a single character continues the run of single characters before it
    joins = np.zeros(len(start), bool)
    joins[1:] = single[1:] & single[:-1] & (doc[1:] == doc[:-1])
    length = end - start
    head = np.flatnonzero(~joins)
    sizes = np.add.reduceat(length, head) if len(head) else length
    new_start = np.cumsum(sizes + 2) - sizes - 2
    codes = np.full(int((sizes + 2).sum()), BOUNDARY, np.int32)
    # every kept byte moves to its word's place: words keep their order, so bytes do too
    skip = np.repeat(start - np.cumsum(length) + length, length)
    old = np.arange(len(skip)) + skip
    word = np.cumsum(~joins) - 1
    codes[np.arange(len(skip)) + np.repeat(2 * word + 1, length)] = CODES[data[old]]
    return codes, new_start, new_start + sizes + 2, np.searchsorted(head, first), old, at


def _grams(codes: np.ndarray, j: int, k: int) -> np.ndarray:
    n = len(codes) - k
    return (codes[:n] << (2 * CODE_BITS)) | (codes[j:j + n] << CODE_BITS) | codes[k:k + n]


def word_scores(codes, start, end, weights: np.ndarray) -> np.ndarray:
    """Inner product of each word's normalised subsequence vector with ``weights``."""
    total = np.zeros(len(start))
    for j, k in GAPS:
        n = len(codes) - k
        if n <= 0:
            continue
        sums = np.concatenate([[0.0], np.cumsum(weights[_grams(codes, j, k)], dtype=np.float64)])
        last = np.maximum(end - k, start)  # first characters whose subsequence stays in the word
        total += DECAY ** (k + 1) * (sums[np.minimum(last, n)] - sums[np.minimum(start, n)])
    return total / _norm(end - start)


def features(words: list[str]) -> list[dict[int, float]]:
    """Normalised subsequence weights of single words."""
    out = []
    for w in words:
        data = np.frombuffer(w.encode(), np.uint8)
        codes = np.concatenate([[BOUNDARY], CODES[data[data < 0xC0]], [BOUNDARY]])
        f: Counter = Counter()
        for j, k in GAPS:
            if len(codes) > k:
                for g in _grams(codes, j, k).tolist():
                    f[g] += DECAY ** (k + 1)
        norm = float(_norm(np.array([len(codes)]))[0])
        out.append({g: x / norm for g, x in f.items()})
    return out


def _kernel(a: list[dict], b: list[dict]) -> np.ndarray:
    """Kernel matrix between words a and landmarks b."""
    posting: dict[int, list] = {}
    for n, f in enumerate(b):
        for g, x in f.items():
            posting.setdefault(g, []).append((n, x))
    out = np.zeros((len(a), len(b)))
    for i, f in enumerate(a):
        row = out[i]
        for g, x in f.items():
            for n, y in posting.get(g, ()):
                row[n] += x * y
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared-hinge SVM by Newton steps on the examples inside the margin."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    reg = RIDGE * np.eye(z.shape[1])
    for _ in range(30):
        inside = y * (z @ w) < 1
        zi = z[inside] * weight[inside, None]
        new = np.linalg.solve(zi.T @ z[inside] / len(z) + reg, zi.T @ y[inside] / len(z))
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def _texts_of(rows: list) -> Iterator[tuple]:
    return B.chunks(pa.array([r.text for r in rows], pa.large_string()))


def _worst_words(rows: list, weights: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Largest word score of each text and that word."""
    best, words = np.zeros(len(rows)), [""] * len(rows)
    for a, b, data, off in _texts_of(rows):
        codes, start, end, first, old, at = spans(data, off)
        s = word_scores(codes, start, end, weights)
        kept = np.cumsum(codes != BOUNDARY)  # letters laid out up to each place
        for i in range(b - a):
            lo, hi = int(first[i]), int(first[i + 1])
            if hi > lo:
                m = lo + int(np.argmax(s[lo:hi]))
                best[a + i] = s[m]
                n = old[kept[start[m]]:kept[end[m] - 1]]
                x = int(np.searchsorted(at, n[0], "left"))
                while x and data[x - 1] >= 0xC0:  # the word's own lead byte
                    x -= 1
                y = int(np.searchsorted(at, n[-1] + 1, "left"))
                text = data[x:y].tobytes().decode("utf-8", "ignore").lower()
                words[a + i] = text if len(n) == n[-1] - n[0] + 1 else text.replace(" ", "")
    return best, words


def _tokens(text: str) -> set[str]:
    words = (_ENDS.sub("", w) for w in text.lower().split())
    return {w for w in words if 3 <= len(w) <= 60}


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """About ``PER_CLASS`` (doc_id, toxic, text) rows of each label, picked by the id's hash."""
    marks = (labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
             .where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()))
    ids = bounded_sample(marks, "toxic", PER_CLASS, 2)
    usable = docs.select("doc_id", "text").where(F.octet_length("text") <= MAX_FIT_BYTES)
    return usable.join(F.broadcast(ids), "doc_id")  # bounded by the sample's parameters


def fit(docs: DataFrame, labels: DataFrame) -> dict | None:
    """Subsequence weights and calibration; None without rows of both classes."""
    rows = sorted(sample(docs, labels).collect(), key=lambda r: (r.toxic, r.doc_id, r.text))
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    if not toxic or not clean:
        return None
    seen = [Counter(w for r in part for w in _tokens(r.text)) for part in (clean, toxic)]

    def odds(w: str) -> float:
        return np.log((seen[1][w] + 0.5) / (len(toxic) + 1)) - np.log(
            (seen[0][w] + 0.5) / (len(clean) + 1))

    # words of several toxic texts that clean texts hardly have, once for each such text
    telling = {w: n for w, n in seen[1].items() if n >= LEAST_TEXTS and odds(w) > LEAST_ODDS}
    if not telling:  # few texts: each one's most telling word
        best = (max(sorted(_tokens(r.text)), key=odds, default="") for r in toxic)
        telling = Counter(w for w in best if w and odds(w) > 0)
    if not telling:
        return None
    rng = np.random.default_rng(17)
    plain = sorted(set(seen[0]) - set(telling))
    negative = [plain[i] for i in rng.permutation(len(plain))[:NEGATIVES]]
    positive = [w for w, n in sorted(telling.items()) for _ in range(n)]
    near = negative  # the clean words that serve as landmarks
    for _ in range(ROUNDS):
        half = LANDMARKS // 2
        marks = [w for w, _ in sorted(Counter(positive).items(), key=lambda x: (-x[1], x[0]))]
        mark_f = features(marks[:half] + near[:half])
        values, vectors = np.linalg.eigh(_kernel(mark_f, mark_f))
        good = values > 1e-6 * values.max()
        whiten = vectors[:, good] / np.sqrt(values[good])
        words = positive + negative
        x = _kernel(features(words), mark_f) @ whiten
        y = np.repeat([1.0, -1.0], [len(positive), len(negative)])
        weight = np.where(y > 0, 0.5 * len(y) / len(positive), 0.5 * len(y) / len(negative))
        w, bias = _svm(x, y, weight)
        weights = np.zeros(TABLE, np.float32)
        for f, c in zip(mark_f, whiten @ w):
            for g, v in f.items():
                weights[g] += c * v
        high, worst = _worst_words(toxic, weights)
        low, hard = _worst_words(clean, weights)
        positive += [t for t, s in zip(worst, high) if t and s + bias > 0 and t not in telling]
        hardest = Counter()
        for t, s in zip(hard, low):
            if t and t not in telling:
                hardest[t] = max(hardest[t], s) if t in hardest else s
        near = [t for t, _ in sorted(hardest.items(), key=lambda x: (-x[1], x[0]))]
        known = set(negative)
        negative = negative + [t for t in near if t not in known]
    coefficients, at = _calibrate(_features_of(toxic, weights), _features_of(clean, weights))
    return {"weights": weights, "coefficients": coefficients, "at": at}


def _text_features(word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The ``TOP`` largest word scores of each text (0 where it has fewer) and its length."""
    out = np.zeros((len(first) - 1, TOP + 1))
    for i in np.flatnonzero(np.diff(first)):
        s = word[first[i]:first[i + 1]]
        top = np.sort(s if len(s) <= TOP else np.partition(s, len(s) - TOP)[-TOP:])[::-1]
        out[i, :len(top)] = top
        out[i, TOP] = np.log1p(len(s)) / 10
    return out


def _features_of(rows: list, weights: np.ndarray) -> np.ndarray:
    parts = []
    for _, _, data, off in _texts_of(rows):
        codes, start, end, first, _, _ = spans(data, off)
        parts.append(_text_features(word_scores(codes, start, end, weights), first))
    return np.concatenate(parts)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last coefficient is the bias."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - y)) / len(z) + RIDGE * w
        hess = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z / len(z)
        w = w - np.linalg.solve(hess + RIDGE * np.eye(len(w)), grad)
    return w


def _calibrate(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, float]:
    """Text-level coefficients, and the margin with the fewest class-balanced errors."""
    x, y = np.vstack([high, low]), np.repeat([1.0, 0.0], [len(high), len(low)])
    weight = np.where(y > 0, 0.5 * len(y) / len(high), 0.5 * len(y) / len(low))
    w = _logistic(x, y, weight)
    high, low = np.sort(high @ w[:-1] + w[-1]), np.sort(low @ w[:-1] + w[-1])
    points = np.unique(np.concatenate([high, low]))
    middle = np.concatenate([[points[0] - 1], (points[1:] + points[:-1]) / 2, [points[-1] + 1]])
    errors = (np.searchsorted(high, middle) / len(high)
              + 1 - np.searchsorted(low, middle) / len(low))
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    widths = np.append(np.diff(points), 0.0)[np.clip(best - 1, 0, len(points) - 1)]
    return w, float(middle[best[int(np.argmax(widths))]])


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of each row."""
    rows = bounded_batches(docs).select(F.col(id_col).alias("doc_id"),
                                        F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            if m is not None:
                for a, b, data, off in B.chunks(batch.column(1)):
                    codes, start, end, first, _, _ = spans(data, off)
                    s = word_scores(codes, start, end, m["weights"])
                    x = _text_features(s, first)
                    w = m["coefficients"]
                    margin = x @ w[:-1] + w[-1] - m["at"] + np.log(CUT / (1 - CUT))
                    out[a:b] = 1 / (1 + np.exp(-np.clip(margin, -60, 60)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)],
                                             names=["doc_id", "score"])

    return rows.mapInArrow(scan, f"doc_id {kind}, score double")


def report(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """held_out, score and prediction of every row; the held-out fold's labels are not read."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"), folds, fold)))
    return score(docs, model).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id"), folds, fold), F.lit(False))
        .alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
