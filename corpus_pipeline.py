"""A training corpus from raw documents in five stages.

Each stage is a function of (spark, docs, sf_dir) and gives a DataFrame that is written as
Parquet and read again as the next one's documents. All but the last return the columns of
documents; a document that a stage rejects doesn't reach the next.

Defined results: columns of documents may be null, repeated rows and extra columns of any
name pass through; an empty table passes through every stage and gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import langid, mixing, neardup, packing, quality
from plumbline.llm.common import saved, table
from plumbline.llm.queries import pieces_of

#: Documents of which the words' mean posterior stays below this are of no language.
LEAST_LANGUAGE_SCORE = 0.3


def _aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under column names that nothing clashes with, and the new name of each."""
    names = {c: f"in_{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _back(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(new).alias(old) for old, new in names.items()])


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the labeller knows: und and scores under LEAST_LANGUAGE_SCORE go. A null
    lang becomes the predicted one, so that the next stage judges the document by it."""
    rows, names = _aside(docs)
    model = langid.fit(docs)
    labelled = langid.label_documents(rows, model, text_col=names["text"])
    known = labelled.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return _back(known.withColumn(names["lang"], F.coalesce(names["lang"], "lang_pred")), names)


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and don't diverge from their language."""
    rows, names = _aside(docs)
    judged = quality.quality_verdicts(rows, carry=list(names.values()), text_col=names["text"], lang_col=names["lang"])
    return _back(judged.filter("kept"), names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (five words, similarity 0.8)."""
    return neardup.one_of_each_class(docs, shingle_words=5, similarity_percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    rows, names = _aside(docs)
    mixed = mixing.mix(rows, id_col=names["doc_id"], text_col=names["text"], source_col=names["source"])
    return _back(mixing.repeated(mixed), names)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place in it."""
    return packing.pack(pieces_of(docs), capacity=2048)


STAGES = [
    ("language_id", keep_known_languages),
    ("quality_rules", keep_good_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Labelling and tokenizing can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
