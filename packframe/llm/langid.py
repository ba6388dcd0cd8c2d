"""Operator 3, language ID by hyperdimensional profiles.

Every letter (code point) has a random vector of DIMENSIONS signs, drawn from its number alone.  An n-gram of three
letters is bound from the letter vectors, the first permuted twice, the second once; signs are held as bits, so
binding is XOR and a permutation is a rotation of the bytes.  A document is the bundle (sum) of its n-grams, a
language's prototype the bundle of all learned documents of that language; a document gets the language whose
prototype, less what all prototypes have in common, has the largest cosine with it.

Texts are lower-cased; each run of characters that aren't letters is one blank, and counts as a letter.

Defined results: texts that are null or without letters, and all texts where nothing was learned, get `und` and
score 0; equal cosines go to the language that sorts first; null languages aren't learned; repeated rows are repeated;
very long texts are read whole, each as one vector; other
columns are ignored, whatever their names; an empty table stays empty.

Of n-grams that weren't learned a text's cosine with a prototype is noise of deviation 1 / sqrt(DIMENSIONS), whatever
its length.  accept() takes scores of three of these or more.  Texts of fewer than SHORT letters in learned languages
don't reach that reliably: if they have a letter, they are accepted whatever their score.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from packframe.llm.common import add_columns, map_batches, rows_of, table
from packframe.llm.shingles import mix64

DIMENSIONS = 1024
N_GRAMS_AT_ONCE = 4096
#: Least score that accept() takes: three deviations of noise.
LEAST = 3 / DIMENSIONS**0.5
#: Letters from which on accept() asks for that score.
SHORT = 64

_BASE = 1 << 21


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letter_vectors(codes: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The random bits of each code point, a row of bytes each."""
    words = np.arange(dimensions // 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(mix64(codes.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))[:, None] + words[None, :]).astype("<u8").view(np.uint8)


def n_grams(text: str) -> np.ndarray:
    """The n-grams of a text as numbers, one for each place; none without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.concatenate(([0], np.where(_letters()[codes], codes, 0), [0])).astype(np.int64)
    codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
    if len(codes) < 3:
        return np.empty(0, np.int64)
    return (codes[:-2] * _BASE + codes[1:-1]) * _BASE + codes[2:]


def bundle(grams: np.ndarray, counts: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The sum of the n-grams' sign vectors, each taken count times."""
    codes, at = np.unique(np.stack((grams // (_BASE * _BASE), grams // _BASE % _BASE, grams % _BASE)), return_inverse=True)
    a, b, c = at.reshape(3, -1)
    own = letter_vectors(codes, dimensions)
    once, twice = np.roll(own, 1, axis=1), np.roll(own, 2, axis=1)
    kind = np.float32 if counts.sum() < 1 << 24 else np.float64  # sums of counts are exact in either
    total = np.zeros(dimensions, np.float64)
    for s in range(0, len(grams), N_GRAMS_AT_ONCE):
        part = slice(s, s + N_GRAMS_AT_ONCE)
        bits = np.unpackbits(twice[a[part]] ^ once[b[part]] ^ own[c[part]], axis=1).astype(kind)
        total += counts[part].astype(kind) @ bits
    return counts.sum() - 2 * total


@dataclass(frozen=True)
class Profiles:
    """languages, in order, and the unit vectors to compare with."""

    languages: tuple[str, ...]
    vectors: np.ndarray

    @staticmethod
    def of(sums: dict[str, np.ndarray]) -> Profiles:
        names = tuple(sorted(sums))
        if not names:
            return Profiles((), np.zeros((0, DIMENSIONS)))
        units = np.stack([sums[k] / max(1e-12, float(np.linalg.norm(sums[k]))) for k in names])
        if len(names) > 1:
            units = units - units.mean(0)
        return Profiles(names, units / np.maximum(1e-12, np.linalg.norm(units, axis=1, keepdims=True)))

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = n_grams(text) if text and self.languages else np.empty(0, np.int64)
        if not len(grams):
            return "und", 0.0
        v = bundle(*np.unique(grams, return_counts=True), self.vectors.shape[1])
        cosines = self.vectors @ v / max(1e-12, float(np.linalg.norm(v)))
        best = int(np.argmax(cosines))
        return self.languages[best], float(min(1.0, max(0.0, cosines[best])))


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id's decimal text modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> Profiles:
    """Prototypes of all rows with a language: exact sums of integers, one vector per task and language before the
    shuffle.  What reaches the driver is one vector per language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in rows_of(batch):
                by: dict[str, list[np.ndarray]] = {}
                for text, lang in zip(part.column(0), part.column(1), strict=True):
                    by.setdefault(lang.as_py(), []).append(n_grams(text.as_py() or ""))
                for lang, found in by.items():
                    grams, counts = np.unique(np.concatenate(found), return_counts=True)
                    if len(grams):
                        sums[lang] = sums.get(lang, 0) + bundle(grams, counts, dimensions).astype(np.int64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions), pa.array(range(dimensions), pa.int32()), pa.array(v, pa.int64())], ["lang", "place", "value"])

    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col, lang_col)
    parts = map_batches(rows, run, "lang string, place int, value long")
    got = parts.groupBy("lang", "place").agg(F.sum("value").alias("value")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("v")).collect()
    return Profiles.of({r["lang"]: np.array([x["value"] for x in r["v"]], np.float64) for r in got})


def identify(docs: DataFrame, profiles: Profiles, keep: list[str], text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` of every row with the language and the score, under `names`."""
    def predict(texts: pa.Array) -> list[pa.Array]:
        found = [profiles.predict(t.as_py()) for t in texts]
        return [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]

    return add_columns(docs, keep, text_col, [StructField(names[0], StringType()), StructField(names[1], DoubleType())], predict)


def accept(names: tuple[str, str] = ("lang_pred", "score"), least: float = LEAST, text_col: str = "text") -> Column:
    """Whether a document is in one of the learned languages, or too short to tell."""
    letters = F.length(F.regexp_replace(text_col, "\\P{L}", ""))
    return (F.col(names[0]) != "und") & ((F.col(names[1]) >= least) | (letters < SHORT))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    profiles = learn(docs.filter(remainder("doc_id", 5) != 0))
    return identify(docs, profiles, ["doc_id"]).select("doc_id", held.alias("held_out"), "lang_pred", "score")
