"""Quality classifier by Bradley-Terry ranking.

A document's strength is linear in its features (counts of its surface, and its words by hashed buckets); the odds that one document is preferred to another are logistic in the
difference of strengths, so the weights are learned from preference pairs (a document labelled 1 over one labelled 0)
by logistic loss on feature differences, with Newton steps. The threshold is a quantile of strengths: the share of
label 0 among the labelled rows. Scores are a logistic curve through it, on which the threshold lies at ``cut``.

Training uses a bounded sample of the labelled rows (``rows`` in expectation, by a hash of doc_id), whose features come
to the driver; every document is scored on its whole text, in a map without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WordHashes, arrow_map

CUT = 0.3
NAMES = ["log_words", "word_length", "symbols", "upper", "digits", "marks", "exclaims", "beyond_ascii", "distinct", "stutter", "repeat3", "dup_lines", "line_words"]
WORDS = 64  # buckets that a hash deals the words into
_ALL = bytes(range(256))
_UPPER, _DIGITS, _SYMBOLS, _MARKS = bytes(range(65, 91)), b"0123456789", b"#*$%&|<>", b".,;:?"
_BEYOND = bytes(range(128, 256))


def features(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The counts of a text's surface named in NAMES, and the roots of the shares of its lower-cased words by bucket; a
    null text counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), max(len(raw), 1)

    def share(chars: bytes) -> float:
        return (len(raw) - len(raw.translate(None, chars))) / size

    distinct = len(set(words)) / n if n else 1.0
    stutter = sum(map(eq, words, words[1:])) / n if n else 0.0
    repeat3 = 1 - len(set(zip(words, words[1:], words[2:], strict=False))) / (n - 2) if n > 2 else 0.0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = 1 - len(set(lines)) / len(lines) if lines else 0.0
    low = raw.lower().split()
    buckets = np.bincount((hashes.of(low) >> np.uint64(40)).astype(np.int64) % WORDS, minlength=WORDS) / max(n, 1)
    surface = [
        np.log1p(n), min(size / max(n, 1), 40.0), np.sqrt(share(_SYMBOLS)), share(_UPPER), np.sqrt(share(_DIGITS)), share(_MARKS), np.sqrt(share(b"!")), share(_BEYOND),
        distinct, np.sqrt(stutter), np.sqrt(max(repeat3, 0.0)), np.sqrt(dup), np.log1p(n / max(len(lines), 1)),
    ]
    return np.concatenate([surface, np.sqrt(buckets)])


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strength(x) - self.threshold) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def newton(d: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    """The weights w of least mean of ln(1 + exp(-d w)) + ridge w^2 / 2 over the rows d."""
    w = np.zeros(d.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))  # of the pair being the other way round
        slope = d.T @ p / len(d) - ridge * w
        bend = (d * (p * (1 - p))[:, None]).T @ d / len(d) + np.diag(ridge)
        step = np.linalg.solve(bend, slope)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(x: np.ndarray, y: np.ndarray, pairs: int = 60_000, ridge: float = 1e-3, word_ridge: float = 1e-2, seed: int = 5) -> Ranker:
    """Ranker from features and labels; with one label only, or none, all documents score alike at its side of the cut."""
    width = x.shape[1] if x.ndim == 2 and len(x) else len(NAMES) + WORDS
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranker(np.zeros(width), np.ones(width), np.zeros(width), 1.0 if len(bad) else -1.0, 1.0)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((x - mean) / scale, -6, 6)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = newton(d, np.where(np.arange(width) < len(NAMES), ridge, word_ridge))
    s = z @ w
    threshold = float(np.quantile(s, len(bad) / (len(good) + len(bad))))
    # The curve's slope by maximum likelihood, with the threshold held at the cut.
    a, t, c = 1.0, s - threshold, np.log(CUT / (1 - CUT))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * t + c, -40, 40)))
        a = float(np.clip(a + (t @ (y - p)) / (t * t @ (p * (1 - p)) + 1e-9), 0.05, 20))
    return Ranker(mean, scale, w, threshold, a)


def held_out() -> F.Column:
    """crc32(doc_id as text) mod 5 is 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, rows: int = 20_000) -> Ranker:
    """Learns from labelled rows that aren't held out; rows of ``labels`` with a null are passed over."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int")).where("doc_id is not null and quality in (0, 1)").where(~held_out())
    share = min(1.0, rows / max(known.count(), 1))
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def make():
        hashes = WordHashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = [features(t, hashes) for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(x, pa.list_(pa.float64()))], ["quality", "x"])

        return step

    doc = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string"))
    # `sample` holds about `rows` rows of 12 bytes whatever the tables hold.
    found = arrow_map(doc.join(F.broadcast(sample), "doc_id").select("quality", "text"), make, "quality int, x array<double>").toArrow()
    x = np.array(found.column("x").to_pylist(), float).reshape(found.num_rows, len(NAMES) + WORDS)
    y = found.column("quality").to_numpy().astype(float)
    if len(y):
        order = np.lexsort(tuple(x.T) + (y,))  # rows come in any order; the pairs drawn must not depend on it
        x, y = x[order], y[order]
    return learn(x, y)


def score(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per row of ``docs``; labels, lang, source and doc_id don't enter.

    Null and empty texts get the score of a document without words. Repeated rows and null ids are kept as they come;
    other columns are not looked at. An empty table gives an empty result.
    """

    def make():
        hashes = WordHashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = ranker.score(np.array([features(t, hashes) for t in batch.column("text").to_pylist()], float))
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= CUT).astype(np.int32))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

        return step

    rows = docs.select(F.col("doc_id").cast("bigint"), held_out().alias("held_out"), F.col("text").cast("string"))
    return arrow_map(rows, make, "doc_id bigint, held_out boolean, score double, predicted int")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
