"""A quality classifier by Bradley-Terry pairwise ranking.

A document's quality is a linear score of text statistics.  Preference pairs (a
document labelled 1 over one labelled 0) are fitted by logistic loss on the
differences of their features, with Newton steps on the driver.  The threshold
is the quantile of the fitted documents' scores at the share of label 0, and a
slope fitted by logistic loss turns the distance from it into a score from 0
to 1.

The fit uses a bounded sample: the ``FIT_ROWS`` labelled documents that a hash
of their ids puts first, and ``FIT_PAIRS`` pairs of them.  Scoring covers every
document whole.

Defined cases: a null text is an empty text and gets a score like any other; null
labels aren't learned from; without pairs (no labels, or one class only) every
score is the share of label 1, or 0.5; an id that is labelled twice is learned
from twice; repeated rows are scored each and equal texts alike, so ties need no
order, and one at the threshold is kept; a very long text is scored whole, in one
batch; other columns, whatever they are called, play no part and keep_good
returns them; an empty table gives an empty result.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, documents_only, materialize, slices, small_batches, unboxed, utf8

FIT_ROWS = 20_000
FIT_PAIRS = 100_000
RIDGE = 1e-2

_LOWER = bytes(range(97, 123))
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_HIGH = bytes(range(128, 256))
_BLANK = b" \t\n\r\x0b\x0c"
_PLAIN = b".,;:'\"-?()"
_LINE_END = (b".", b"!", b"?", b":", b'"')
NAMES = ("words", "word_length", "distinct", "adjacent", "top_word", "short", "long", "upper", "digit", "high", "plain", "bang", "pipe", "mark", "odd_mark", "lines", "distinct_lines", "line_ends", "capital_words", "marked_words")


def statistics(text: bytes) -> list[float]:
    """The features, in the order of NAMES; each from 0 to about 1."""
    words = text.split()
    n, size = len(words) or 1, len(text) or 1
    counts = Counter(words)
    lengths = list(map(len, words))
    share = lambda drop: (len(text) - len(text.translate(None, drop))) / size
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = len(lines) or 1
    upper, digit, high, plain = share(_UPPER), share(_DIGIT), share(_HIGH), share(_PLAIN)
    bang, pipe = text.count(b"!") / size, text.count(b"|") / size
    mark = max(0.0, 1 - share(_LOWER) - upper - digit - high - plain - share(_BLANK))
    ends = Counter(map(operator.itemgetter(slice(-1, None)), words))
    return [
        min(1.0, np.log1p(len(words)) / 10),
        min(1.0, sum(lengths) / n / 12),
        len(counts) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        (max(counts.values()) if counts else 0) / n,
        sum(map((3).__gt__, lengths)) / n,
        sum(map((14).__lt__, lengths)) / n,
        upper,
        digit,
        high,
        plain,
        bang,
        pipe,
        mark,
        mark - bang - pipe,
        min(1.0, m / n),
        len(set(lines)) / m,
        sum(x.rstrip().endswith(_LINE_END) for x in lines) / m,
        sum(map(bytes.isupper, words)) / n,
        1 - sum(v for k, v in ends.items() if k.isalnum() or k in (b".", b",") or k >= b"\x80") / n,
    ]


def features(text: bytes) -> list[float]:
    """The statistics and, for those that are rare in clean text, their roots."""
    x = statistics(text)
    return [*x, *(max(0.0, v) ** 0.5 for v in x[3:])]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * len(x) * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * len(x) * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Ranking:
    """Weights, threshold and slope; ``__call__`` scores feature rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        self.share = float(len(good) / len(y)) if len(y) else 0.5
        self.fitted = bool(len(good) and len(bad))
        if not self.fitted:
            return
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z, rng = self.standard(x), np.random.default_rng(seed)
        a, b = rng.choice(good, FIT_PAIRS), rng.choice(bad, FIT_PAIRS)
        # each pair once, the preferred first or second by turns
        turn = np.where(np.arange(FIT_PAIRS) % 2 == 0, 1.0, -1.0)
        self.weights = _logistic((z[a] - z[b]) * turn[:, None], (turn > 0).astype(float), RIDGE)
        s = z @ self.weights
        cut = int(round(len(bad) / len(y) * len(s)))
        low, high = np.partition(s, [max(cut - 1, 0), min(cut, len(s) - 1)])[[max(cut - 1, 0), min(cut, len(s) - 1)]]
        self.threshold = float((low + high) / 2)
        self.slope = max(1e-3, float(_logistic((s - self.threshold)[:, None], y.astype(float), 1e-4)[0]))

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip((self.standard(x) @ self.weights - self.threshold) * self.slope, -50, 50)))


def learned_from(id_col: Column) -> Column:
    """The contract's fold: a third of all ids is held out."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(3)) != 1


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Ranking:
    """A ranking from the labelled ``docs`` outside the held-out fold."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(learned_from(F.col("doc_id")))
    y = y.orderBy(F.xxhash64("doc_id", F.lit("fit")), "doc_id", "y").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array([features(t) for t in utf8(b.column(1))], pa.list_(pa.float64()))], ["y", "x"])

    # at most FIT_ROWS rows of two numbers are broadcast
    with small_batches(docs.sparkSession):
        found = documents_only(docs, id_col, text_col).join(F.broadcast(y), "doc_id").select("doc_id", "text", "y").mapInArrow(run, "y int, x array<double>").toArrow()
    x = np.array(found.column("x").to_pylist(), float).reshape(found.num_rows, len(features(b"")))
    order = np.lexsort(x.T)
    return Ranking(x[order], found.column("y").to_numpy()[order])


def scores(docs: DataFrame, ranking: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (the text's hash) and score of each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            s = ranking(np.array([features(t) for t in utf8(b.column(1))]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s)], ["doc_id", "th", "score"])

    return documents_only(docs, id_col, text_col).withColumn("th", F.xxhash64("text")).mapInArrow(run, "doc_id long, th long, score double")


#: Rejected documents that are broadcast at most, 16 bytes each.
BROADCAST_ROWS = 500_000


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose score reaches ``least``; 0.5 is the fitted quantile.

    Only ids, hashes and scores come back from Python; the rejected are written,
    counted, and joined away: broadcast where they are few, else by a shuffle.
    """
    found = scores(docs, fit(docs, labels, id_col=id_col, text_col=text_col), id_col, text_col)
    bad = materialize(found.where(F.col("score") < least).select(F.col("doc_id").alias("bad"), F.col("th").alias("hash")).distinct(), "rejected")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    rows = docs.select(boxed(docs), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("th"))
    kept = rows.join(bad, F.col("doc_id").eqNullSafe(F.col("bad")) & (F.col("th") == F.col("hash")), "left_anti")
    return kept.select(*unboxed(docs.columns))


def op8_quality_ranking(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ranking = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scores(docs, ranking)
    return out.select("doc_id", (~learned_from(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
