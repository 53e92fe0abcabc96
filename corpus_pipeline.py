"""A training-corpus pipeline: every stage works on all that the stage before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which the
caller writes as Parquet and reads again as the next one's ``docs``. All but the last stage return the
columns of ``documents`` (or whatever columns ``docs`` has, whatever their names). ``doc_id`` is a number or text
that casts to bigint; nulls in other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verso.llm import line_dedup, near_dup, packing, quality, span_dedup
from verso.llm.common import cut, fresh, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the line model accepts; it learns from the labels of rows outside the held-out fold.

    A null text is judged as the empty text. Equal texts have equal scores, so that repeated rows go or stay together.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    name = fresh(docs, "quality_score")
    return quality.score(docs, model, name=name).filter(F.col(name) >= quality.THRESHOLD).drop(name)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, without multi-line chunks that an earlier row has.

    A null text stays null, an empty one empty; rows that repeat an id are one document and change alike.
    """
    return line_dedup.dedup_lines(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates.

    Null texts count as empty; all texts without words are one class. Rows that repeat an id are one document and stay
    together. Of rows with a null id one stays for each text that no row with an id has.
    """
    return near_dup.drop_near(docs)


def substring_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, without sentences of spans that an earlier row has.

    A null text stays null, an empty one empty; rows that repeat an id are one document.
    """
    return span_dedup.dedup_spans(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each row stands in the packed sequences; null and empty texts are their closing id alone."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("minhash near-dedup", near_deduplication),
    ("substring dedup", substring_deduplication),
    ("best-fit packing", best_fit_packing),
]

#: The classifier and the sketches cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
