"""Operator 9, quality classifier: a regularised quadratic discriminant.

A document is a vector of transformed statistics of its whole text (lengths, shares of kinds of bytes and words,
repetition).  Each class has a mean and a covariance, shrunk towards its own diagonal and a multiple of the identity;
the score is the logistic function of the difference of the classes' log densities (Mahalanobis distances and
determinants from Cholesky factors that are computed once) plus the log odds of the classes.

Defined results: null and empty texts are scored as texts without words; rows without a label are scored alike; where
a class has no labelled row, the score is the share of label 1 (0.5 without labels); ids that are labelled repeatedly
count repeatedly; repeated rows are repeated; very long texts are measured whole; a score of exactly one
half is predicted as 1; other columns are ignored, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField

from packframe.llm.common import add_columns, map_batches, stored, table
from packframe.llm.langid import remainder
from packframe.llm.shingles import words

#: Weight of the diagonal in a class's covariance, and the part of the identity, in units of the mean variance.
SHRINKAGE, RIDGE = 0.1, 1e-3
#: Bytes and words without anything remarkable that count as part of every text, so that a mark or an echo in a short
#: one is no large share.
FEW_BYTES, FEW_WORDS = 100, 30

_KINDS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "line": (10,), "blank": (32, 9, 11, 12, 13), "stop": b".,;:?", "shout": b"!", "bar": b"|", "mark": b"#$%&*+/<=>@[\\]^_`{}~", "other": range(128, 256)}
_KIND = np.full(256, len(_KINDS), np.uint8)
for _i, _codes in enumerate(_KINDS.values()):
    _KIND[list(_codes)] = _i
FEATURES = ("words", "word_length", "word_spread", "upper", "digit", "line", "stop", "shout", "bar", "mark", "other", "distinct", "echo", "longest")


def statistics(texts: list[bytes | None]) -> np.ndarray:
    """A row of FEATURES for each text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        if not text:
            continue
        buffer = np.frombuffer(text, np.uint8)
        n = len(buffer)
        share = dict(zip(_KINDS, np.bincount(_KIND[buffer], minlength=len(_KINDS) + 1) / n, strict=False))
        h, start, end = words(buffer)
        k = len(h)
        length = end - start
        letters = share["upper"] + share["lower"] + share["other"]
        out[i] = (
            np.log1p(k),
            np.log1p(length.mean() if k else 0),
            np.log1p(length.std() if k else 0),
            np.sqrt(share["upper"] / max(letters, 1e-9) * n / (n + FEW_BYTES)),
            *(np.sqrt(share[x] * n / (n + FEW_BYTES)) for x in ("digit", "line", "stop", "shout", "bar", "mark")),
            np.sqrt(share["other"]),
            np.log((len(np.unique(h)) + 1) / (k + 1) ** 0.85),
            np.sqrt((h[1:] == h[:-1]).sum() / (k + FEW_WORDS)),
            np.log1p(length.max() if k else 0),
        )
    return out


@dataclass(frozen=True)
class Discriminant:
    """Means and Cholesky factors of label 0 and 1, and the log odds of label 1."""

    odds: float
    means: list = field(default_factory=list)
    factors: list = field(default_factory=list)

    @staticmethod
    def of(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE, ridge: float = RIDGE) -> Discriminant:
        """From count, sums and sums of products of each label."""
        n0, n1 = (moments[c][0] if c in moments else 0 for c in (0, 1))
        odds = float(np.log((n1 + 1e-9) / (n0 + 1e-9))) if n0 + n1 else 0.0
        if not n0 or not n1:
            return Discriminant(odds)
        pooled = sum(moments[c][2] - np.outer(moments[c][1], moments[c][1]) / moments[c][0] for c in (0, 1)) / (n0 + n1)
        means, factors = [], []
        for c in (0, 1):
            n, s, p = moments[c]
            mean = s / n
            own = p / n - np.outer(mean, mean)
            own = (1 - shrinkage) * own + shrinkage * np.diag(np.diag(pooled))
            own += np.eye(len(own)) * (ridge * np.trace(pooled) / len(pooled) + 1e-12)
            means.append(mean)
            factors.append(np.linalg.cholesky(own))
        return Discriminant(odds, means, factors)

    def score(self, x: np.ndarray) -> np.ndarray:
        logs = np.full(len(x), self.odds)
        if not self.means:
            return 1 / (1 + np.exp(-logs))
        for sign, mean, factor in zip((-1, 1), self.means, self.factors, strict=True):
            z = np.linalg.solve(factor, (x - mean).T)
            logs += sign * (-0.5 * (z * z).sum(0) - np.log(np.diag(factor)).sum())
        return 1 / (1 + np.exp(-np.clip(logs, -700, 700)))


def measure(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of every row with x: array<double> of FEATURES."""
    def run(texts: pa.Array) -> list[pa.Array]:
        x = statistics(texts.cast(pa.binary()).to_pylist())
        return [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(FEATURES)), pa.int32()), pa.array(x.ravel()))]

    return add_columns(docs, keep, text_col, [StructField("x", ArrayType(DoubleType()))], run)


def fit(measured: DataFrame) -> Discriminant:
    """From rows (label, x): each task sums its rows, sums are added by place; the driver gets one set of moments."""
    k = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy().reshape(-1, k)
            for c in (0, 1):
                own = np.column_stack((np.ones((labels == c).sum()), x[labels == c]))
                sums[c] = sums.get(c, 0) + own.T @ own
        for c, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * v.size, pa.int32()), pa.array(range(v.size), pa.int32()), pa.array(v.ravel(), pa.float64())], ["label", "place", "value"])

    rows = measured.filter(F.col("label").isin(0, 1)).select(F.col("label").cast("int"), "x")
    got = map_batches(rows, run, "label int, place int, value double").groupBy("label", "place").agg(F.sum("value").alias("value")).collect()
    sums = {c: np.zeros((k + 1) ** 2) for c in (0, 1)}
    for r in got:
        sums[r["label"]][r["place"]] = r["value"]
    full = {c: v.reshape(k + 1, k + 1) for c, v in sums.items()}
    return Discriminant.of({c: (v[0, 0], v[0, 1:], v[1:, 1:]) for c, v in full.items() if v[0, 0] > 0})


def score(measured: DataFrame, model: Discriminant, keep: list[str]) -> DataFrame:
    """The columns `keep` of rows with x, and score."""
    schema = measured.select(*keep).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(batch.num_columns - 1).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.score(x))], [*batch.schema.names[:-1], "score"])

    return map_batches(measured.select(*keep, "x"), run, schema)


def score_texts(docs: DataFrame, model: Discriminant, keep: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """The columns `keep` of every row, and the score, in one pass over the texts."""
    return add_columns(docs, keep, text_col, [StructField(name, DoubleType())], lambda texts: [pa.array(model.score(statistics(texts.cast(pa.binary()).to_pylist())))])


def learnable(id_col: str = "doc_id"):
    return remainder(id_col, 3) != 1


def labelled(measured: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.select(F.col("doc_id"), F.col("quality").alias("label")).filter(learnable())
    return measured.select("doc_id", "x").join(known, "doc_id").select("label", "x")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    measured = stored(measure(docs, ["doc_id"]), "quality")  # a few numbers for each text
    model = fit(labelled(measured, table(spark, sf_dir, "labels")))
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return score(measured, model, ["doc_id"]).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
