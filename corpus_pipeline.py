"""A corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one reads it from Parquet.  All but the last
return the columns of documents: language ID drops documents in none of the learned languages (but those of a few words,
which it can't tell), the quality classifier those more likely of label 0, the n-gram join all but the document with
the least id of each class of near copies (rows of one id whose texts are in different classes are different documents;
those without an id or without words stay).  The last stage packs what is left.

Every stage takes null, empty and very long texts, repeated rows, ids that are repeated with other texts, columns of
any other name, and an empty table, as the docstrings of the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from packframe.llm import langid, ngram_join, packing, quality
from packframe.llm.common import shared_path, stored, table


def in_learned_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    profiles = langid.learn(docs.filter(langid.remainder("doc_id", 5) != 0))
    names = ("packframe_lang", "packframe_score")  # documents may have columns of the usual names
    found = langid.identify(docs, profiles, docs.columns, names=names)
    return found.filter(langid.accept(names)).select(*docs.columns)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    measured = stored(quality.measure(docs, ["doc_id"]), "quality")
    model = quality.fit(quality.labelled(measured, table(spark, sf_dir, "labels")))
    return quality.score_texts(docs, model, docs.columns, name="packframe_score").filter("packframe_score >= 0.5").select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # workers still hold what earlier stages left: less is remembered here than in a job of its own
    return packing.pack(stored(packing.cut(docs, memory=60_000, part_bytes=1 << 20), "pieces"))


STAGES = [
    ("language_id", in_learned_languages),
    ("quality", of_quality),
    ("ngram_join", without_near_copies),
    ("packing", packed),
]

#: The classifier, the language profiles and the tokenizer aren't SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
