"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade > k | text) = sigmoid(w . x - t_k) with t_0 <= t_1 <= ...: one weight a feature, shared by all thresholds.
The severity of a text is its expected grade, the sum of these probabilities; it is toxic where P(grade > 0) >= 0.5.

Labels say only toxic or not, so grades above 0 are laid on by intensity: among labelled toxic texts, tertiles of the
number of words that carry a selected feature (0 clean, 1 to 3 toxic). Features are words and their first four and
five letters, chosen where the log odds between the classes are far above their error. Fitting takes a bounded sample
of labelled rows (SAMPLE, those with the lowest hash of the key); scoring covers every text whole.

Defined results: null and empty texts have no features and get the severity of the thresholds alone; labels that are
null, or name no document, are left out; repeated rows are scored alike; without toxic and clean labels nothing can be
fitted, so every severity is 0 and no text is toxic.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, materialize, prepare, table

#: Labelled rows that a model is fitted on, and features that it may use.
SAMPLE, FEATURES = 12_000, 4096
#: A feature needs this many toxic texts and this distance, in standard errors, between the classes' log odds.
LEAST, FAR = 3, 3.0
GRADES = 4
WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in (4, 5) if len(word) >= n)]


@dataclass
class Model:
    """Weights by feature and the thresholds between grades."""

    weights: dict[str, float]
    thresholds: list[float]

    def score(self, text: str | None) -> tuple[float, float]:
        """(expected grade, probability of any toxic grade) of a text."""
        x = 0.0
        if text and self.weights:
            seen: Counter[str] = Counter()
            for word, n in Counter(WORD.findall(text.lower())).items():
                if word[:4] + "*" in self.stems or word in self.weights:
                    for f in features_of(word):
                        if f in self.weights:
                            seen[f] += n
            x = sum(self.weights[f] * np.log1p(n) for f, n in sorted(seen.items()))
        p = [1 / (1 + np.exp(min(t - x, 700.0))) for t in self.thresholds]
        return float(sum(p)), float(p[0] if p else 0.0)

    @property
    def stems(self) -> set[str]:
        if "_stems" not in self.__dict__:
            self._stems = {f.rstrip("*")[:4] + "*" for f in self.weights}
        return self._stems


def _counts(text: str | None) -> Counter[str]:
    out: Counter[str] = Counter()
    for word, n in Counter(WORD.findall((text or "").lower())).items():
        for f in features_of(word):
            out[f] += n
    return out


def select_features(sample: DataFrame, n_toxic: int, n_clean: int) -> list[str]:
    """Features whose presence leans to toxic texts by at least FAR standard errors, the farthest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                for f in _counts(text):
                    seen.setdefault(f, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array([x[1] for x in seen.values()], pa.int64()), pa.array([x[0] for x in seen.values()], pa.int64())], names=["f", "a", "b"])

    rows = sample.mapInArrow(run, "f string, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") >= LEAST)
    odds = F.log((F.col("a") + 0.5) / (n_toxic - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (n_clean - F.col("b") + 0.5))
    z = odds / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    best = rows.withColumn("z", z).where(F.col("z") >= FAR).orderBy(F.desc("z"), "f").limit(FEATURES)
    return [r["f"] for r in best.collect()]


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int, penalty: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model, by Adam on the penalized log likelihood."""
    n, k = len(grades), int(grades.max())
    params = np.zeros(n_features + k)
    for j in range(k):  # thresholds start at the grades' own frequencies; later ones are kept apart by exp(gap)
        p = np.clip((grades > j).mean(), 1e-4, 1 - 1e-4)
        params[n_features + j] = np.log((1 - p) / p)
    t = params[n_features:].copy()
    params[n_features + 1 :] = np.log(np.maximum(np.diff(t), 1e-2))
    m, v = np.zeros_like(params), np.zeros_like(params)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, steps + 1):
        w, gaps = params[:n_features], np.exp(params[n_features + 1 :])
        t = params[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])
        x = np.bincount(rows, w[cols] * values, n)
        upper = np.concatenate([t, [np.inf]])[grades]
        lower = np.concatenate([[-np.inf], t])[grades]
        a, b = np.where(np.isinf(upper), 1.0, sigmoid(upper - x)), np.where(np.isinf(lower), 0.0, sigmoid(lower - x))
        p = np.maximum(a - b, 1e-12)
        da, db = a * (1 - a) / p, b * (1 - b) / p  # of log p by the upper and the lower threshold
        gx = db - da
        gt = np.bincount(grades[grades < k], da[grades < k], k) - np.bincount(grades[grades > 0] - 1, db[grades > 0], k)
        grad = np.concatenate([np.bincount(cols, gx[rows] * values, n_features), [gt.sum()], [gt[j:].sum() * gaps[j - 1] for j in range(1, k)]]) / n
        grad[:n_features] -= penalty * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        params += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return params[:n_features], params[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(params[n_features + 1 :]))])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fits a model on at most `sample` labelled rows; their keys are broadcast, their number is the bound."""
    chosen = (
        labels.where("toxic IN (0, 1)").select(F.col(key).alias("__key"), F.col("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("__key"), "__key").limit(sample)
    )
    rows = docs.select(F.col(key).alias("__id"), F.col("text").alias("text")).join(F.broadcast(chosen), F.col("__id") == F.col("__key")).select("text", "toxic")
    rows = materialize(rows.dropDuplicates(), "toxicity-sample")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(n) < 2 or not (names := select_features(rows, n[1], n[0])):
        return Model({}, [])
    place = {f: i for i, f in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                found = {place[f]: c for f, c in _counts(text).items() if f in place}
                out.append({"toxic": toxic, "f": list(found), "c": list(found.values())})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("toxic", pa.int32()), ("f", pa.list_(pa.int32())), ("c", pa.list_(pa.int32()))]))

    got = rows.mapInArrow(run, "toxic int, f array<int>, c array<int>").collect()  # bounded by the sample
    got.sort(key=lambda r: (r["toxic"], r["f"], r["c"]))
    toxic = np.array([r["toxic"] for r in got])
    r = np.repeat(np.arange(len(got)), [len(x["f"]) for x in got])
    c = np.array([i for x in got for i in x["f"]], np.int64)
    counts = np.array([i for x in got for i in x["c"]], float)
    whole = np.array([not names[i].endswith("*") or len(names[i]) == 5 for i in c], float) if len(c) else counts
    intensity = np.bincount(r, counts * whole, len(got))
    cuts = np.quantile(intensity[toxic == 1], [1 / 3, 2 / 3])
    grades = np.where(toxic == 1, 1 + np.searchsorted(cuts, intensity, "left"), 0)
    grades = np.unique(grades, return_inverse=True)[1]  # grades that no text has are closed up
    w, t = fit_ordinal(r, c, np.log1p(counts), grades, len(names))
    return Model({f: float(x) for f, x in zip(names, w, strict=True)}, [float(x) for x in t])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds severity (double), grade (int, the severity rounded) and toxic (boolean), replacing columns of these names."""
    kept = docs.drop(*[c for c in ("severity", "grade", "toxic") if c != text])
    schema = T.StructType([*kept.schema.fields, T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # this operator remembers nothing between tasks
        for b in batches:
            got = [model.score(x) for x in b.column(text).to_pylist()]
            columns = [pa.array([round(s, 6) for s, _ in got], pa.float64()), pa.array([round(s) for s, _ in got], pa.int32()), pa.array([p >= 0.5 for _, p in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*b.schema.names, "severity", "grade", "toxic"])

    return kept.mapInArrow(run, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("text")
