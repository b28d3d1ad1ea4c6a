"""Quality classifier: ordinal cumulative-link regression on graded ratings of hashed text.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector w for all grades, and ordered
thresholds. x holds hashed words, hashed word shapes and hashed figures of the whole text.
The expected grade is the sum of the tail probabilities P(grade >= k); documents are selected
by one of them.

The model is fitted on at most `sample` rated documents, those with the smallest hash of
their id; everything else covers all rows. Only their hashed features reach the driver.

Defined cases: null and empty texts have only the figures of an empty text and are scored; of
several ratings of one document the lowest counts; ratings without a grade are left out;
without ratings, or with one grade only, every document gets the highest grade seen (0 if
none) and is kept; repeated rows are scored alike; an empty table gives no rows; extra columns
pass through.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.bpe import _add

#: Hashed features; must be a power of two.
BUCKETS = 1 << 15
#: Rated documents that the model is fitted on, at most.
SAMPLE = 5_000
#: Distinct words whose weights a worker remembers.
MEMORY_WORDS = 400_000

_LETTER_RUN = re.compile(r"[^\W\d_]+")


def shape(word: str) -> str:
    """A word's form: runs of letters as x, X or Xx, runs of digits as 9, the rest as it is."""
    word = _LETTER_RUN.sub(lambda m: "X" if len(m[0]) > 1 and m[0].isupper() else "Xx" if m[0][0].isupper() else "x", word)
    return re.sub(r"\d+", "9", word)


def bucket(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind}:{value}".encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


def figures(text: str, words: list[str]) -> list[int]:
    """Buckets of binned figures of the whole text: repetition, length, word length, line length."""
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    repeated = 1 - len(set(words)) / n if n else 0
    repeated_lines = 1 - len(set(lines)) / len(lines) if lines else 0
    mean = len(text) / n if n else 0
    found = {"rep": int(10 * repeated), "lines": int(10 * repeated_lines), "len": int(math.log2(n + 1)), "mean": min(20, int(mean)), "bias": 0}
    return [bucket("figure", f"{k}={v}") for k, v in found.items()]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text: words and shapes by their share of all words, figures as 1/4."""
    words = (text or "").split()
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    at, value = figures(text or "", words), [0.25] * 5
    for w, c in counts.items():
        at += [bucket("word", w.lower()), bucket("shape", shape(w))]
        value += [c / len(words), c / len(words)]
    dense = np.bincount(at, value, BUCKETS)
    found = np.flatnonzero(dense)
    return found.astype(np.int32), dense[found].astype(np.float32)


def sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class OrdinalModel:
    """Weights and ordered thresholds of a cumulative-link regression for grades 0..len(thresholds)."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, grades: list[int]):
        self.weights, self.thresholds, self.grades = weights, thresholds, grades

    def tails(self, latent: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...; decreasing in k as thresholds are ordered."""
        return sigmoid(latent[:, None] - self.thresholds[None])

    @staticmethod
    def fit(rows: list[tuple[np.ndarray, np.ndarray]], ratings: np.ndarray, epochs: int = 30, rate: float = 0.5, seed: int = 7) -> OrdinalModel:
        """Adam on the negative log-likelihood; thresholds are a first one plus positive steps."""
        grades = sorted(set(ratings.tolist()))
        k = len(grades) - 1
        weights = np.zeros(BUCKETS, np.float32)
        if k < 1:
            return OrdinalModel(weights, np.zeros(0), grades or [0])
        y = np.searchsorted(grades, ratings)
        share = np.clip([np.mean(y >= j) for j in range(1, k + 1)], 1e-3, 1 - 1e-3)
        first = np.log((1 - share) / share)
        theta = np.concatenate((first[:1], np.log(np.maximum(np.diff(first), 1e-2))))
        rng, step = np.random.default_rng(seed), 0
        m, v, mt, vt = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(k), np.zeros(k)
        for epoch in range(epochs):
            order = rng.permutation(len(rows))
            lr = rate * (1 - epoch / epochs)
            for start in range(0, len(order), 256):
                chosen = order[start : start + 256]
                at = np.concatenate([rows[i][0] for i in chosen])
                val = np.concatenate([rows[i][1] for i in chosen])
                doc = np.repeat(np.arange(len(chosen)), [len(rows[i][0]) for i in chosen])
                latent = np.bincount(doc, weights[at] * val, len(chosen))
                cuts = np.cumsum(np.concatenate((theta[:1], np.exp(theta[1:]))))
                edges = np.concatenate(([-np.inf], cuts, [np.inf]))
                yy = y[chosen]
                upper, lower = sigmoid(edges[yy + 1] - latent), sigmoid(edges[yy] - latent)
                p = np.maximum(upper - lower, 1e-9)
                du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
                d_latent = (du - dl) / len(chosen)
                d_cuts = (np.bincount(np.minimum(yy, k - 1), np.where(yy < k, -du, 0), k) + np.bincount(np.maximum(yy - 1, 0), np.where(yy > 0, dl, 0), k)) / len(chosen)
                after = np.cumsum(d_cuts[::-1])[::-1]
                d_theta = np.concatenate((after[:1], after[1:] * np.exp(theta[1:])))
                grad = np.bincount(at, val * d_latent[doc], BUCKETS) + 1e-6 * weights
                step += 1
                m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
                mt, vt = 0.9 * mt + 0.1 * d_theta, 0.999 * vt + 0.001 * d_theta**2
                a, b = 1 - 0.9**step, 1 - 0.999**step
                weights -= (lr * (m / a) / (np.sqrt(v / b) + 1e-6)).astype(np.float32)
                theta -= 0.1 * lr * (mt / a) / (np.sqrt(vt / b) + 1e-8)
        return OrdinalModel(weights, np.cumsum(np.concatenate((theta[:1], np.exp(theta[1:])))), grades)


class Scorer:
    """Latent scores of whole texts; the weight of each distinct word is worked out once."""

    def __init__(self, model: OrdinalModel):
        self.model, self.known = model, {}

    def weight(self, word: str) -> float:
        if len(self.known) > MEMORY_WORDS:
            self.known.clear()
        w = self.model.weights
        self.known[word] = found = float(w[bucket("word", word.lower())]) + float(w[bucket("shape", shape(word))])
        return found

    def latent(self, text: str | None) -> float:
        words, known = (text or "").split(), self.known
        total = 0.25 * sum(float(self.model.weights[b]) for b in figures(text or "", words))
        if words:
            for w in set(words).difference(known):
                self.weight(w)
            total += sum(known[w] if w in known else self.weight(w) for w in words) / len(words)
        return total


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def rated_features(docs: DataFrame, ratings: DataFrame, sample: int) -> tuple[list, np.ndarray]:
    """Features and grades of the sample; ratings has doc_id and grade."""
    graded = ratings.where("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    chosen = graded.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "grade")  # `sample` rows

    def run(batches):
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("grade"), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32()))],
                names=["doc_id", "grade", "at", "value"],
            )

    found = texts.mapInArrow(run, "doc_id long, grade int, at array<int>, value array<float>")
    found = found.groupBy("doc_id", "grade").agg(F.min(F.struct("at", "value")).alias("x")).orderBy("doc_id").select("grade", "x.*").toArrow()
    rows = [(np.array(a, np.int32), np.array(v, np.float32)) for a, v in zip(found["at"].to_pylist(), found["value"].to_pylist(), strict=True)]
    return rows, np.array(found["grade"].to_pylist(), np.int64)


def score_quality(df: DataFrame, ratings: DataFrame, docs: DataFrame | None = None, keep_grade: int = 1, keep_probability: float = 0.5, sample: int = SAMPLE, out: tuple[str, str, str] = ("expected_grade", "tail_probability", "keep")) -> DataFrame:
    """`df` with expected_grade, tail_probability (of keep_grade or better) and keep.

    ratings: doc_id and grade (0, 1, ...); docs: where rated texts stand, `df` by default;
    out: the names of the three columns, which replace columns of `df` with these names.
    """
    rows, grades = rated_features(df if docs is None else docs, ratings, sample)
    model = OrdinalModel.fit(rows, grades)
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.thresholds, model.grades))  # 128 KB
    base = df.drop(*out)
    schema = T.StructType(base.schema.fields + [T.StructField(out[0], T.DoubleType()), T.StructField(out[1], T.DoubleType()), T.StructField(out[2], T.BooleanType())])

    def run(batches):
        scorer = Scorer(OrdinalModel(*shared.value))
        grades, steps = scorer.model.grades, np.diff(scorer.model.grades)
        at = next((i for i, g in enumerate(grades[1:]) if g >= keep_grade), None)
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                tails = scorer.model.tails(np.array([scorer.latent(t.as_py()) for t in batch.column("text")]))
                expected = grades[0] + tails @ steps
                tail = tails[:, at] if at is not None else np.ones(len(tails))
                for name, column in zip(out, (expected.astype(float), tail, tail >= keep_probability), strict=True):
                    batch = _add(batch, name, pa.array(column))
                yield batch

    return base.mapInArrow(run, schema)


def graded(labels: DataFrame) -> DataFrame:
    """Ratings from the labels table: 0 junk, 1 well-formed but toxic, 2 well-formed and clean."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, 2 - F.coalesce("toxic", F.lit(0))).alias("grade"))
